"""Splitting texts over a size limit at natural boundaries, with overlap.

A cut is a position in the text; its strength says what boundary lies there. For each piece the strongest cut of the
permissible window is asked of a sparse table (range maximum over boundary strengths, ties broken rightward), then the next
piece steps back by the overlap. Sizes are in Unicode code points.

Defined results: null and empty texts give no piece; a text within its limit is one piece; a text of any length is treated
whole, the table being built over stretches of bounded size; exact duplicate rows of the input count once; a limit that is
null, below 1 or not above the overlap raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode white space, and the marks that are natural boundaries.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0                　"
LINE_ENDS = "\n\v\f\r\x85  "
SENTENCE_ENDS = "。！？.!?"
CLAUSE_ENDS = "；;：:"
PAUSES = "，、,"
MARKS = SENTENCE_ENDS + CLAUSE_ENDS + PAUSES
#: Strength by kind of boundary; 0 is no boundary.
PARAGRAPH, LINE, SENTENCE, CLAUSE, PAUSE, SPACE = 6, 5, 4, 3, 2, 1
#: A sparse table covers at least this many cuts, whatever the limit.
STRETCH = 1 << 15


@dataclass(frozen=True)
class Limit:
    max_size: int
    overlap: int = 0

    def __post_init__(self) -> None:
        if self.max_size < 1 or not 0 <= self.overlap < self.max_size:
            raise ValueError(f"no split has pieces of {self.max_size} with an overlap of {self.overlap}")


def _kinds() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.int8)
    for marks, strength in ((WHITE_SPACE, SPACE), (LINE_ENDS, LINE), (SENTENCE_ENDS, SENTENCE), (CLAUSE_ENDS, CLAUSE), (PAUSES, PAUSE)):
        table[[ord(c) for c in marks]] = strength
    return table


KINDS = _kinds()


def strengths(points: np.ndarray) -> np.ndarray:
    """Strength of the cut behind each code point; the cut before white space is natural too (its least kind)."""
    kind = np.where(points < 0x10000, KINDS[np.minimum(points, 0xFFFF)], 0).astype(np.int8)
    behind = kind.copy()
    behind[1:][(kind[1:] == LINE) & (kind[:-1] == LINE)] = PARAGRAPH
    before = np.zeros_like(behind)
    before[:-1] = np.isin(kind[1:], (SPACE, LINE)) * SPACE
    # A mark followed by closing quotes or a mark inside a number is weaker than one that ends a statement.
    inside = np.zeros(len(points), dtype=bool)
    digit = (points >= 48) & (points <= 57)
    inside[1:-1] = digit[:-2] & digit[2:] & (kind[1:-1] >= PAUSE) & (kind[1:-1] <= SENTENCE)
    behind[inside] = np.minimum(behind[inside], SPACE)
    return np.maximum(behind, before)


class RangeMaximum:
    """Sparse table over keys (strength, position): the largest key of any range, so ties go to the rightmost cut."""

    def __init__(self, strength: np.ndarray, start: int) -> None:
        self.start, self.end = start, start + len(strength)
        self.levels = [strength.astype(np.int64) << 40 | np.arange(start, start + len(strength))]
        half = 1
        while 2 * half <= len(strength):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))
            half *= 2

    def best(self, low: int, high: int) -> tuple[int, int]:
        """Position and strength of the strongest cut in [low, high]."""
        low, high = low - self.start, high - self.start
        level = (high - low + 1).bit_length() - 1
        key = max(int(self.levels[level][low]), int(self.levels[level][high - (1 << level) + 1]))
        return key & (1 << 40) - 1, key >> 40


def pieces(points: np.ndarray, limit: Limit) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece; the last piece's end counts as a paragraph.

    A piece ends behind its strongest boundary in the second half of what it may hold, else in the first half (as far as
    the piece still goes on), else at the limit (strength 0: no boundary there).
    """
    n, found, start, table = len(points), [], 0, None
    most, step = limit.max_size, limit.max_size - limit.overlap
    while n - start > most:
        # The next piece begins at end - overlap and must go on, so a cut lies beyond start + overlap.
        lowest, highest = start + limit.overlap + 1, start + most
        if table is None or highest > table.end:
            first, end = lowest - 1, min(n, lowest + max(STRETCH, 8 * most))
            around = max(0, first - 2)  # the strength of a cut depends on its neighbours
            table = RangeMaximum(strengths(points[around : end + 2])[first - around :][: end - first], first)
        middle = max(lowest, highest - step // 2)
        # Index of a cut: that of the code point before it.
        at, strength = table.best(middle - 1, highest - 1)
        if not strength and middle > lowest:
            at, strength = table.best(lowest - 1, middle - 2)
        cut = at + 1 if strength else highest
        found.append((start, cut, strength))
        start = cut - limit.overlap
    if n:
        found.append((start, n, PARAGRAPH))
    return found


def longest_run(points: np.ndarray) -> int:
    """The most consecutive code points without a natural boundary."""
    if not len(points):
        return 0
    walls = np.flatnonzero(np.where(points < 0x10000, KINDS[np.minimum(points, 0xFFFF)], 0))
    return int(np.diff(np.concatenate(([-1], walls, [len(points)]))).max() - 1)


def split(df: DataFrame, id: str, text: str, item_table: str, limit: Limit) -> DataFrame:
    """Pieces of every text: their numbers, places, texts, and whether the end had to be cut without a boundary.

    ``text_digest`` tells texts apart that share an id.

    Narrow: one pass over the scan behind the removal of duplicate rows, no text is compared with another.
    """
    kind = df.schema[id].dataType.simpleString()
    schema = f"item_table string, `{id}` {kind}, piece int, start int, end int, text string, forced boolean, max_size int, overlap_size int, longest_run int, text_digest bigint"
    names = ["item_table", id, "piece", "start", "end", "text", "forced", "max_size", "overlap_size", "longest_run", "text_digest"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if not value:
                    continue
                if len(value) <= limit.max_size:
                    rows.append((name, 0, 0, len(value), value, False, 0, digest))
                    continue
                points = np.frombuffer(value.encode("utf-32-le"), dtype=np.int32)
                run = longest_run(points)
                for k, (start, end, strength) in enumerate(pieces(points, limit)):
                    rows.append((name, k, start, end, value[start:end], not strength, run, digest))
            if rows:
                names_, no, starts, ends, texts, forced, runs, digests = zip(*rows)
                n = len(rows)
                arrays = [
                    pa.array([item_table] * n), pa.array(names_, batch.column(0).type), *(pa.array(x, pa.int32()) for x in (no, starts, ends)),
                    pa.array(texts, pa.string()), pa.array(forced), pa.array([limit.max_size] * n, pa.int32()), pa.array([limit.overlap] * n, pa.int32()), pa.array(runs, pa.int32()), pa.array(digests, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(F.col(id), F.col(text)).where(F.length(text) > 0)
    digest = rows.select(id, text, F.xxhash64(text).alias("_1"), F.xxhash64(F.lit("second"), F.col(text)).alias("_2"))
    once = digest.groupBy(id, "_1", "_2").agg(F.first(text).alias(text)).select(id, text, "_1")
    return once.mapInArrow(cut, schema)


def limits(size_limits: DataFrame, purpose: str = "split") -> dict[str, Limit]:
    """Limits by item table; ``size_limits`` has a row for each use."""
    rows = size_limits.where(F.col("purpose") == purpose).collect()
    return {r["item_table"]: Limit(r["max_size"] or 0, r["overlap_size"] or 0) for r in rows}
