"""HTML to Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column

from quernstone.functions.arrow import string_column
from quernstone.functions.text import squeezed, without_edit_links, without_empty_chapters

# What is left out.
TAGS_DROPPED = frozenset({"meta", "title", "img", "style", "annotation", "table", "script"})
CLASSES_DROPPED = frozenset({"ambox", "noteTA-group", "infobox"})
ATTRIBUTES_DROPPED = frozenset({("table", "style", "border:1px solid #ddd; text-align:center; margin: auto;")})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
# Start tags that end an open element of the second kind (implied end tags).
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset({"ul", "ol", "dl", "table", "select", "body", "html", "#root"})
FORMATS = frozenset({"b", "i", "code", "em", "strong", "a", "span", "small", "u", "s"})
MARKS = {"b": "**", "i": "*", "code": "`"}
CODE = frozenset({"pre", "syntaxhighlight"})
#: No page holds these; they are our marks.
NO_MARKS = {0: None, 1: None}


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class TreeBuilder(HTMLParser):
    """A forgiving tree: implied end tags, void elements; an end tag without its start tag is ignored.

    Formatting elements left open when a block ends end with it (browsers would reopen them in the next block).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def close(self, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                del self.open[depth:]
                return
            if self.open[depth].tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.close({"p"}, SCOPES | {"li", "td", "th", "dd", "dt", "div", "section"})
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag], SCOPES)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.close({tag}, frozenset() if tag not in FORMATS else BLOCKS)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parsed(page: str) -> Node:
    builder = TreeBuilder()
    builder.feed(page)
    HTMLParser.close(builder)
    return builder.root


def dropped(node: Node) -> bool:
    if node.tag in TAGS_DROPPED or CLASSES_DROPPED & set(node.attributes.get("class", "").split()):
        return True
    return any(node.tag == tag and node.attributes.get(name) == value for tag, name, value in ATTRIBUTES_DROPPED)


def joined(parts: list[str]) -> str:
    """Text with its white space collapsed; line breaks that the rules put in (NUL) stay."""
    return re.sub(r"[ \t\n\r\f]+", " ", "".join(parts))


def plain(node: Node) -> str:
    """The text of a node without nested lists and dropped elements."""
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag not in ("ul", "ol") and not dropped(child):
            text = plain(child)
            parts.append(marked(MARKS[child.tag], text) if child.tag in MARKS and child.tag not in CODE else text)
    return joined(parts)


def marked(mark: str, text: str) -> str:
    """The text between marks, blanks at its ends outside of them."""
    bare = text.strip()
    return text.replace(bare, f"{mark}{bare}{mark}", 1) if bare else text


def raw(node: Node) -> str:
    """The text of a node with its white space."""
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else raw(c) for c in node.children)


def code_block(node: Node) -> str:
    """Lines of code between fences; lines and blanks stay as they are."""
    lines = raw(node).strip("\n").expandtabs(4).split("\n")
    return "".join("\0" + line.replace(" ", "\x01") for line in ("```", *lines, "```")) + "\0"


def lists(node: Node, depth: int = 0) -> list[str]:
    """Lines of a list: ``- x`` or ``n. x``, four blanks for each level; an item's own text comes before its sublists."""
    lines, number = [], 0
    for item in node.children:
        if isinstance(item, str) or dropped(item):
            continue
        nested = [item] if item.tag in ("ul", "ol") else [c for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        own = "" if item.tag in ("ul", "ol") else plain(item).strip()
        if own or not nested:
            number += 1
            lines.append("    " * depth + (f"{number}. {own}" if node.tag == "ol" else f"- {own}"))
        for child in nested:
            lines += lists(child, depth + 1)
    return lines


def rendered(node: Node) -> str:
    """Markdown of a node; NUL stands for a line break, U+0001 for a blank that stays."""
    if node.tag in CODE:
        return code_block(node) if raw(node).strip() else ""
    if node.tag in ("ul", "ol"):
        return "".join("\0" + line.replace(" ", "\x01") for line in lists(node)) + "\0"
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\0")
        elif not dropped(child):
            parts.append(rendered(child))
    content = joined(parts)
    if node.tag in MARKS:
        return marked(MARKS[node.tag], content)
    if re.fullmatch(r"h\d", node.tag):
        return f"\0\0{'#' * int(node.tag[1])} {content.strip()}\0"
    if node.tag in ("section", "p"):
        return "\0" + content.strip(" ") + "\0"
    return content


def to_markdown(page: str) -> str:
    lines = rendered(parsed(page.translate(NO_MARKS))).split("\0")
    return "\n".join(line.strip(" ").replace("\x01", " ") for line in lines)


def markdown_column(html: Column | str) -> Column:
    """Markdown of an HTML column: the tree is walked in Arrow batches, the tidying stays in the JVM."""
    return squeezed(without_empty_chapters(without_edit_links(string_column(to_markdown, html))))
