"""How a text ends: whole, cut, or open (only other texts can tell).

Works on the last lines of a text and on the balance of its markup; every rule looks at the end that is left when blanks,
replacement characters and marks of omission are taken off.
"""

from __future__ import annotations

import re
from typing import NamedTuple

WHOLE, OPEN, CUT = 0, 1, 2

#: What may follow a cut: blanks, half a character, an omission mark, an invitation to read on.
TRAIL = "\ufffd\u200b\ufeff"
OMISSION = re.compile(r"(?:…+|\.{3,}|\[\s*(?:…|\.{3}|more)\s*\]|[（(\[]\s*(?:阅读全文|閱讀全文|未完|待续|待續|continued|read more|more|weiterlesen)[^）)\]]{0,6}[）)\]]|(?:阅读全文|閱讀全文|read more|continue reading|weiterlesen)\s*[»>]*)\Z", re.I)
#: The full ellipsis of Chinese print, which writers set after a statement; only other texts can tell it from a cut.
WRITTEN = re.compile(r"\S……\Z")
FINAL_MARK = re.compile(r"[（(\[]\s*(?:完|全文完|終|终|end|ende|fin)\s*[）)\]]\Z", re.I)
NOTE_MARK = re.compile(r"(?:\[\d{1,3}\]|<ref[^<>]*/>|<ref[^<>]*>(?:(?!</ref>).)*</ref>)\Z", re.S)
STOP = "。！？!?.｡"
CLOSERS = "”」』’\"'）)]】》〉»*_"
PAUSE = "，、,；;：:—–"
ITEM = re.compile(r"\s*(?:[-*+•・◆●○▪‣#]+|[（(\[【]?\d{1,4}[）)\]】.、:]|\d{1,4}\s*[.)、])\s*")
PAGE = re.compile(r"(?:第\s*\d+\s*页|第\s*\d+\s*頁|S\.\s*\d+|pp?\.\s*\d+)\Z")
HEADING = re.compile(r"\s*#{1,6}\s|\s*(={2,6})[^=].*\1\s*\Z")
HALF_HEADING = re.compile(r"\s*={2,6}[^=]*={0,6}\Z")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "meta", "link", "input", "references", "nowiki"}
PAIRS = {"“": "”", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "(": ")", "〈": "〉"}


class Ending(NamedTuple):
    verdict: int
    reason: str
    unit: str  # the last clause, for comparison with clauses elsewhere
    size: int = 0  # code points without what may follow a cut


def stripped(text: str) -> tuple[str, bool, bool, bool]:
    """The text without what may follow a cut; whether an omission mark did, one that invites to read on, half a character."""
    omitted = invited = broken = False
    while True:
        end = len(text)
        while end and (text[end - 1].isspace() or text[end - 1] in TRAIL):
            end -= 1
        short = text[:end]
        broken |= "�" in text[len(short) :]
        match = OMISSION.search(short[-40:])
        if not match:
            return short, omitted, invited, broken
        omitted = True
        invited |= any(c.isalpha() or c == "[" for c in match[0])
        text = short[: len(short) - (len(short[-40:]) - match.start())]


def open_tag(text: str) -> bool:
    """Whether the end lies inside a tag or an element that other text closes."""
    last = text.rfind("<")
    if last >= 0 and ">" not in text[last:] and re.match(r"<(?:[a-zA-Z/!][^\n]*)?\Z", text[last:]):
        return True
    depth: dict[str, int] = {}
    for match in TAG.finditer(text):
        name = match[2].lower()
        if name in VOID or match[3]:
            continue
        depth[name] = max(0, depth.get(name, 0) + (-1 if match[1] else 1))
    return any(depth.values())


def open_pair(line: str) -> bool:
    """Whether a bracket or a quotation opened in the line is still open at its end."""
    stack: list[str] = []
    for c in line:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c in stack:
            while stack.pop() != c:
                pass
    return bool(stack)


def _cells(line: str) -> int:
    return line.strip().strip("|").count("|")


def last_unit(text: str) -> str:
    """The last clause."""
    tail = text[-300:]
    cut = max((tail.rfind(c) for c in STOP + PAUSE + "\n”“「」"), default=-1)
    return tail[cut + 1 :].strip()


def ending(text: str) -> Ending:
    found = _ending(text)
    return found._replace(size=len(stripped(text)[0]))


def _ending(text: str) -> Ending:
    core, omitted, invited, broken = stripped(text)
    if not core:
        return Ending(WHOLE, "blank", "")
    unit = last_unit(core)
    if broken:
        return Ending(CUT, "half a character", unit)
    if FINAL_MARK.search(core):
        return Ending(WHOLE, "final mark", unit)
    if core.count("```") % 2:
        return Ending(CUT, "code", unit)
    if core.endswith("```"):
        return Ending(WHOLE, "code", unit)
    if core.count("{|") > core.count("|}") and re.search(r"^\{\|", core, re.M):
        return Ending(CUT, "table", unit)
    if core.count("{{") > core.count("}}") or core.count("[[") > core.count("]]"):
        return Ending(CUT, "template or link", unit)
    if open_tag(core):
        return Ending(CUT, "element", unit)
    lines = core.split("\n")
    line = lines[-1].rstrip("\r")
    if re.search(r"\[\[[^\[\]]*\]\]\Z", line) and line.lstrip().startswith("[[") or line.endswith(("|}", ">")) or (line.endswith("}}") and line.lstrip().startswith(("{{", "}}"))):
        return Ending(WHOLE, "markup", unit)
    if line.lstrip().startswith("|") and line.count("|") > 1 or (line.lstrip().startswith("|") and len(lines) > 1 and lines[-2].lstrip().startswith("|")):
        rows = [x for x in lines[-200:-1] if x.lstrip().startswith("|")]
        if not line.rstrip().endswith("|") or len(line.strip()) < 2 or any(_cells(line) < _cells(x) for x in rows[-2:]):
            return Ending(CUT, "table row", unit)
        return Ending(WHOLE, "table row", unit)
    for separator in ("\t", ","):
        before = [x for x in lines[-4:-1] if x.strip()]
        if before and all(x.count(separator) >= 2 and not re.search(r"[。！？]", x) for x in before) and len({x.count(separator) for x in before}) == 1 and (separator == "\t" or " " not in line.replace(", ", "")):
            want = before[0].count(separator)
            if line.count(separator) < want or line.endswith(separator):
                return Ending(CUT, "table row", unit)
            return Ending(OPEN, "table row", unit)
    bare = line
    while match := NOTE_MARK.search(bare):
        bare = bare[: match.start()].rstrip()
    ended = bare.rstrip(CLOSERS)
    if ended and ended[-1] in STOP and not (ended[-1] == "." and omitted and not bare.endswith(".")):
        if open_pair(line):
            return Ending(CUT, "quotation", unit)
        return Ending(WHOLE, "sentence", unit)
    if HEADING.match(line):
        return Ending(WHOLE, "heading", unit)
    if HALF_HEADING.match(line):
        return Ending(CUT, "heading", unit)
    if PAGE.search(line):
        return Ending(WHOLE, "reference", unit)
    if open_pair(line):
        return Ending(CUT, "bracket", unit)
    item = ITEM.match(line)
    said = line[item.end() :] if item else line
    prose = bool(re.search(r"[，。；！？]|[.!?,;] +\S", said)) or len(re.findall(r"[a-zäöüß] ", said)) >= 5
    if ended.endswith(tuple(PAUSE)) and prose:
        return Ending(CUT, "pause", unit)
    if item and not prose:
        return Ending(OPEN, "item", unit)
    if omitted:
        return Ending(CUT if invited else OPEN, "ellipsis" if WRITTEN.search(text.rstrip()) else "omission", unit)
    before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
    if prose or HEADING.match(before) or (re.search(r"[，。；！？]|[a-z], ", before) and not item) or before.rstrip().endswith(tuple(STOP)):
        return Ending(CUT, "sentence", unit)
    return Ending(OPEN, "line", unit)
