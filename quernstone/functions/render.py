"""A local renderer for a subset of wikitext, in place of the remote one where there is no network."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column

from quernstone.functions.arrow import string_column

HEADING = re.compile(r"(={2,6})\s*(.*?)\s*\1\s*$")
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\[\]]+(?:\s+([^\[\]]*))?\]")
ITEM = re.compile(r"([*#:;]+)\s*(.*)")
#: Elements whose content is no wikitext; their text is set aside while the rest is rendered.
VERBATIM = re.compile(r"<(nowiki|pre|syntaxhighlight|source|code)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
#: Inline elements of HTML that wikitext allows.
ALLOWED = re.compile(r"&lt;(/?)(b|i|u|s|sub|sup|small|span|br)\b(?:[^&<>]|&(?!lt;|gt;))*?(/?)&gt;", re.I)
TABLE, GALLERY = re.compile(r"\s*:*\{\|"), re.compile(r"<gallery\b.*?</gallery>", re.S | re.I)
LISTS = {"*": ("ul", "li"), "#": ("ol", "li"), ":": ("dl", "dd"), ";": ("dl", "dt")}
BEHAVIOUR = re.compile(r"__[A-Z]+__")


def inline(text: str) -> str:
    text = html.escape(text, quote=False)
    text = ALLOWED.sub(r"<\1\2\3>", text)
    text = LINK.sub(r"<a>\1</a>", text)
    text = EXTERNAL.sub(lambda m: f"<a>{m[1]}</a>" if m[1] else "", text)
    text = re.sub(r"'''(.+?)'''", r"<b>\1</b>", text)
    return re.sub(r"''(.+?)''", r"<i>\1</i>", text)


class Aside:
    """Verbatim elements, kept apart behind marks that stand nowhere else in the text."""

    def __init__(self, text: str) -> None:
        self.mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text)
        self.held: list[str] = []
        self.text = VERBATIM.sub(self._put, text)

    def _put(self, match: re.Match) -> str:
        tag, body = match[1].lower(), html.escape(match[2], quote=False)
        tag = "syntaxhighlight" if tag == "source" else tag
        self.held.append(body if tag == "nowiki" else f"<{tag}>{body}</{tag}>")
        block = tag in ("pre", "syntaxhighlight")
        return f"{'\n' if block else ''}{self.mark}{len(self.held) - 1}{self.mark}{'\n' if block else ''}"

    def back(self, text: str) -> str:
        return re.sub(f"{self.mark}(\\d+){self.mark}", lambda m: self.held[int(m[1])], text)


def to_html(wikitext: str) -> str:
    """Headings, paragraphs, nested and definition lists, tables, links, bold, italic, verbatim elements; templates and galleries are left out."""
    aside = Aside(wikitext)
    wikitext, previous = BEHAVIOUR.sub("", GALLERY.sub("", aside.text)), None
    while previous != wikitext:
        previous, wikitext = wikitext, re.sub(r"\{\{[^{}]*\}\}", "", wikitext)
    out, paragraph, stack = [], [], ""
    tables = 0

    def flush() -> None:
        if paragraph:
            out.append(f"<p>{' '.join(paragraph)}</p>")
            paragraph.clear()

    def to_level(marks: str) -> bool:
        """Closes and opens lists; whether the innermost one goes on."""
        nonlocal stack
        common = 0
        while common < min(len(stack), len(marks)) and LISTS[stack[common]][0] == LISTS[marks[common]][0]:
            common += 1
        while len(stack) > common:
            out.append("</{1}></{0}>".format(*LISTS[stack[-1]]))
            stack = stack[:-1]
        for mark in marks[common:]:
            out.append(f"<{LISTS[mark][0]}>")
            stack += mark
        return common == len(marks)

    for line in wikitext.split("\n"):
        if TABLE.match(line):
            flush()
            to_level("")
            out.append("<table><tr>")
            tables += 1
        elif tables:
            bare = line.strip()
            if bare.startswith("|}"):
                out.append("</tr></table>")
                tables -= 1
            elif bare.startswith("|-"):
                out.append("</tr><tr>")
            elif bare.startswith("|+"):
                out.append(f"<caption>{inline(bare[2:].strip())}</caption>")
            elif bare.startswith(("|", "!")):
                tag = "th" if bare[0] == "!" else "td"
                for cell in re.split(r"\|\||!!" if tag == "th" else r"\|\|", bare[1:]):
                    # Before a single bar stand attributes, where no link does.
                    shown = cell if "[[" in cell.partition("|")[0] else cell.rpartition("|")[2] if "|" in cell and "[[" not in cell else cell.partition("|")[2] or cell
                    out.append(f"<{tag}>{inline(shown.strip())}</{tag}>")
            elif bare:
                out.append(inline(bare))
        elif item := ITEM.match(line):
            flush()
            goes_on = to_level(item[1])
            ended = f"</{LISTS[stack[-1]][1]}>" if goes_on else ""
            stack = stack[:-1] + item[1][-1]
            tag = LISTS[item[1][-1]][1]
            term, colon, meaning = item[2].partition(" : ") if tag == "dt" else (item[2], "", "")
            out.append(f"{ended}<{tag}>{inline(term)}")
            if colon:
                out.append(f"</dt><dd>{inline(meaning)}")
                stack = stack[:-1] + ":"
        else:
            to_level("")
            if heading := HEADING.match(line):
                flush()
                level = len(heading[1])
                out.append(f"<h{level}>{inline(heading[2])}</h{level}>")
            elif re.match(r"-{4,}\s*$", line):
                flush()
                out.append("<hr>")
            elif line.strip():
                paragraph.append(inline(line.strip()))
            else:
                flush()
    to_level("")
    flush()
    out.extend(["</tr></table>"] * tables)
    return aside.back("\n".join(out))


def html_column(wikitext: Column | str) -> Column:
    return string_column(to_html, wikitext)
