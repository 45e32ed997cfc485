"""Wikitext cleaning: nested templates and links, and sections.

Brackets nest, which no regular expression follows, so this is a parser on one text; everything around it stays in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column

from quernstone.functions.arrow import string_column
from quernstone.functions.rules import FIRST_TEMPLATES_KEPT, LINKS_DROPPED, SECTIONS_DROPPED, SIMPLIFIED, TEMPLATES_DROPPED, TRADITIONAL, predicate

# Fixed value: the brackets of wikitext.
BRACKET = re.compile(r"\[\[|\]\]|\{\{|\}\}")
#: A heading is a line of its own; its level is the number of its signs.
HEADING_LINE = r"(?m)^(={2,6})([^=\n]+)={2,6}[^\S\n]*$"
HEADING = re.compile(HEADING_LINE)
TO_SIMPLIFIED = str.maketrans(TRADITIONAL, SIMPLIFIED)

drops_template = predicate(TEMPLATES_DROPPED)
keeps_first = predicate(FIRST_TEMPLATES_KEPT)
drops_link = predicate(LINKS_DROPPED)
drops_section = predicate(SECTIONS_DROPPED)


@dataclass(frozen=True)
class Span:
    """A bracket pair: ``kind`` is its opening bracket, ``depth`` the number of brackets still open around it."""

    kind: str
    start: int
    end: int
    depth: int


def spans(text: str) -> list[Span]:
    """Bracket pairs in the order in which they close; a closing bracket closes the last open one of any kind."""
    opened: list[tuple[str, int]] = []
    found = []
    for match in BRACKET.finditer(text):
        if match[0] in ("[[", "{{"):
            opened.append((match[0], match.start()))
        elif opened:
            kind, start = opened.pop()
            found.append(Span(kind, start, match.end(), len(opened)))
    return found


def template_name(body: str) -> str:
    """Name of a template without its braces; empty where nothing stands before the first pipe."""
    return body.partition("|")[0].strip().lower()


def dropped_ranges(text: str) -> list[tuple[int, int]]:
    """What the rules cut out of a text, as ranges that may overlap."""
    ranges: list[tuple[int, int]] = []
    block_starts: list[int] = []
    leading, lead_end = True, 0
    for span in spans(text):
        body = text[span.start + 2 : span.end - 2]
        if span.kind == "[[":
            if drops_link(body.lower()):
                ranges.append((span.start, span.end))
            continue
        name = template_name(body)
        if leading and not span.depth:
            # Templates before any text of the page go, but for those that are kept there.
            if text[lead_end : span.start].strip():
                leading = False
            else:
                lead_end = span.end
                if name and not keeps_first(name):
                    ranges.append((span.start, span.end))
                continue
        if name == "refbegin":
            block_starts.append(span.start)
            ranges.append((span.start, span.end))
        elif name == "refend":
            ranges.append((block_starts.pop() if block_starts else span.start, span.end))
        elif drops_template(name):
            ranges.append((span.start, span.end))
    return ranges


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, in order; touching ranges become one."""
    union: list[list[int]] = []
    for start, end in sorted(ranges):
        if union and start <= union[-1][1]:
            union[-1][1] = max(union[-1][1], end)
        else:
            union.append([start, end])
    return [(a, b) for a, b in union]


def without_templates(text: str) -> str:
    """The text without dropped templates and links; lines of which nothing is left go with them."""
    touched = merged(dropped_ranges(text))
    if not touched:
        return text
    keep, at, mark = [], 0, next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text)
    for start, end in touched:
        keep.append(text[at:start] + mark)
        at = end
    lines = ("".join(keep) + text[at:]).split("\n")
    return "\n".join(line.replace(mark, "") for line in lines if mark not in line or line.replace(mark, "").strip())


def kept_sections(text: str, nested: bool = True) -> str:
    """The text without sections that are empty or whose title the rules drop.

    The text before the first heading counts as a section without title. A dropped section takes its subsections along, and a
    section without text of its own stays where one of its subsections does. Without ``nested`` every section is judged by itself.
    """
    marks = [(m.start(), m.end(), len(m[1]), m[2]) for m in HEADING.finditer(text)]
    starts, ends = [(0, 0, 0, ""), *marks], [*(m[0] for m in marks), len(text)]
    keep = [bool(text[body:end].strip()) and not drops_section(title.strip().translate(TO_SIMPLIFIED)) for (_, body, _, title), end in zip(starts, ends)]
    if nested:
        dropping = 7
        for k, (_, _, level, title) in enumerate(starts):
            dropping = dropping if level > dropping else 7
            if dropping == 7 and drops_section(title.strip().translate(TO_SIMPLIFIED)):
                dropping = level
            keep[k] &= dropping == 7
        needed = 0  # the level whose parents are needed by a kept section further down
        for k in range(len(starts) - 1, 0, -1):
            level = starts[k][2]
            keep[k] |= level < needed
            needed = level if keep[k] else min(needed, level)
    return "".join(text[start[0] : end] for start, end, kept in zip(starts, ends, keep) if kept)


def cleaned(text: str) -> str:
    return kept_sections(without_templates(text))


def without_templates_column(text: Column | str) -> Column:
    return string_column(without_templates, text)


def cleaned_column(text: Column | str) -> Column:
    """Templates, links and sections cleaned (comments and references are taken out before, in the JVM)."""
    return string_column(cleaned, text)
