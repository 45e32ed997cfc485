"""Statistics of one text, and which of its characters belong to sentences that tell something."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
SPACED_WORD = re.compile(r"[^\W_⺀-鿿]+", re.U)
HEADING = re.compile(r"\s*#{1,6}\s+\S.{0,60}$|\s*={2,6}[^=]+={2,6}\s*$")
ITEM = re.compile(r"\s*(?:[-*+•・◆●○▪‣]\s*(?!\*)|[（(\[【]\d{1,4}[）)\]】]|\d{1,4}[.)、）]\s*(?=\D))")
#: The end of a sentence: full stops and closing marks, no comma behind them, no figure behind a point.
SENTENCE_END = re.compile(r"(?:[。！？!?]|\.(?!\d))++[”」』\"'’）)\]]*+(?![，,])")
STOP = "。！？!?.…"
SYMBOL = re.compile(r"[^\w\s，。、；：！？“”‘’「」『』（）《》〈〉【】·…—,.;:!?'\"()\[\]-]|_")
#: A line without a full stop tells something from this many common words on, and with this share of them.
LEAST_WORDS, LEAST_SHARE = 2, 0.15


class Statistics(NamedTuple):
    lang: str
    characters: int
    words: int
    mean_word_length: float
    symbol_ratio: float
    stop_line_share: float
    common_word_share: float
    prose_share: float


class Vocabulary:
    """Frequent words by language; those of Chinese are matched as character strings, others as whole words."""

    def __init__(self, words: dict[str, list[str]]) -> None:
        self.words = {lang: {w.lower() for w in ws if w} for lang, ws in sorted(words.items())}
        spaced = {lang: ws for lang, ws in self.words.items() if not any(HAN.search(w) for w in ws)}
        joined = {lang: ws for lang, ws in self.words.items() if lang not in spaced}
        self.spaced, self.joined = spaced, joined
        every = sorted({w for ws in joined.values() for w in ws}, key=lambda w: (-len(w), w))
        self.pattern = re.compile("|".join(map(re.escape, every))) if every else re.compile(r"(?!)")
        self.all_spaced = set().union(*spaced.values()) if spaced else set()

    def han_hits(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def spaced_hits(self, words: list[str]) -> int:
        return sum(w in self.all_spaced for w in words)

    def language(self, hits: list[str], han: int, words: list[str]) -> str:
        """The language whose frequent words fill the largest part; ``und`` where hardly any does.

        ``hits`` are those of ``han_hits``, ``han`` the number of Chinese characters, ``words`` the spaced words.
        """
        best, most = "und", 0.0
        found = Counter(hits)
        for lang, ws in self.joined.items():
            # A word that only this language has tells it from its neighbours; shared ones count for all.
            own = sum(n * len(h) * (1 if any(h in o for k, o in self.joined.items() if k != lang) else 4) for h, n in found.items() if h in ws)
            if han and own / han >= 0.02 and own > most:
                best, most = lang, float(own)
        letters = sum(map(len, words))
        for lang, ws in self.spaced.items():
            own = sum(len(w) for w in words if w in ws)
            if words and own / letters >= 0.05 and 1.5 * own > most:
                best, most = lang, 1.5 * own
        return best


def tells(piece: str, vocabulary: Vocabulary, stopped: bool) -> bool:
    """Whether a piece of a line reads as (part of) a sentence."""
    han = len(HAN.findall(piece))
    words = SPACED_WORD.findall(piece.lower())
    letters = sum(map(len, words))
    if han * 2 >= letters:
        hits = vocabulary.han_hits(piece)
        size = sum(map(len, hits))
        if not han or size / han < 0.03:
            return False
        return len(hits) >= (1 if stopped or "，" in piece else LEAST_WORDS) and (stopped or size / han >= 0.05)
    hits = vocabulary.spaced_hits(words)
    return hits >= (1 if stopped and len(words) < 8 else LEAST_WORDS) and hits / len(words) >= LEAST_SHARE


def tabular(line: str) -> bool:
    """Whether the line is a row of cells."""
    bare = line.strip()
    return line.count("\t") >= 2 or bare.startswith(("|", "{|", "!")) or line.count("|") >= 3 or len(re.findall(r"\S {3,}\S", line)) >= 2 or bool(re.fullmatch(r"[^。！？]*(?:,[\d.]+){2,}[^。！？]*", bare))


def visible(text: str) -> int:
    """Characters but blanks."""
    return len("".join(text.split()))


def prose_characters(text: str, vocabulary: Vocabulary) -> tuple[int, int]:
    """(characters of sentences that tell something, all characters but blanks and headings)."""
    told = total = 0
    for line in text.split("\n"):
        size = visible(line)
        if not size or HEADING.match(line):
            continue
        total += size
        if tabular(line) or (line.count("<") > 2 and len(re.findall(r"<[^<>]*>", line)) * 12 > size):
            continue
        own, start, item = 0, 0, ITEM.match(line)
        for match in SENTENCE_END.finditer(line):
            sentence, start = line[start : match.end()], match.end()
            if tells(sentence, vocabulary, True):
                own += visible(sentence)
        rest = line[start:]
        if not item and rest.strip() and tells(rest, vocabulary, False):
            own += visible(rest)
        if item and own * 2 < size:
            own = 0
        told += own
    return told, total


def statistics(text: str, vocabulary: Vocabulary) -> Statistics:
    """Words are Chinese characters, and runs of other letters and digits."""
    han = len(HAN.findall(text))
    words = SPACED_WORD.findall(text.lower())
    hits = vocabulary.han_hits(text)
    n, shown = han + len(words), visible(text)
    lines = [x.rstrip() for x in text.split("\n") if x.strip() and not HEADING.match(x)]
    stops = sum(x.rstrip("”」』\"'’）)]*_ ")[-1:] in STOP and bool(x) for x in lines)
    told, total = prose_characters(text, vocabulary)
    return Statistics(
        vocabulary.language(hits, han, words),
        shown,
        n,
        (han + sum(map(len, words))) / n if n else 0.0,
        len(SYMBOL.findall(text)) / shown if shown else 0.0,
        stops / len(lines) if lines else 0.0,
        (sum(map(len, hits)) + vocabulary.spaced_hits(words)) / n if n else 0.0,
        told / total if total else (1.0 if shown else 0.0),
    )
