"""Texts that were cut off, and how often each source cuts.

Evidence from other texts is gathered by a self-join by prefix, over hashed prefixes, so no text meets another one and no
group of texts is ever gathered. A pass over the texts gives each the hashes of its prefixes of 4, 8, 16, ... characters (without
the marks that may follow a cut). A text in question, of length n, asks the texts that share its longest such prefix for the
hash of their first n characters; how many they are doesn't matter, as a text answers for each different length once, and
has fewer of them than characters. Equal hashes prove a strict prefix: two residues of 31 bits of a polynomial in the
characters. All of a text's longer copies are heard; any may prove the cut.

Not every longer text proves one: a list may be a part of a longer list, and a title begins many a text. A longer copy counts
if it goes on with the line in which the text ends, and the text either has several lines, or ends within a word of letters
and figures, or is longer than a title (``Settings``).

The same question is asked of the last clause: is it a whole clause elsewhere, or only the beginning of one? And of the size: do
other cuts of its source fall on the same place? A text whose own end proves the cut needs no such evidence (see ``endings``).

Defined results: null, empty and blank texts are not cut; exact duplicate rows count once, copies of a cut text are cut;
null sources form a source of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.endings import CUT, OPEN, ending
from quernstone.plans.lineage import staged


@dataclass(frozen=True)
class Settings:
    #: A shorter text begins too many others to be proved cut by one.
    least_prefix: int = 6
    #: The longest title: characters of a single line, more than half of them ideographs or not.
    title_ideographs: int = 10
    title_letters: int = 60
    #: A size is a limit of a source if so many of its proven cuts, and this share of them, fall there.
    pile: int = 3
    pile_share: float = 0.2
    #: Numbers (8 bytes each) that may be broadcast to filter texts; beyond, the same filter is a shuffled join.
    broadcast_numbers: int = 500_000

    def __post_init__(self) -> None:
        if self.least_prefix < FIRST_PREFIX:
            raise ValueError(f"prefixes have at least {FIRST_PREFIX} characters")


#: Hashed prefixes have this many characters, and twice as many, and so on.
FIRST_PREFIX = 4
#: Two polynomials modulo 2^31 - 1; their bases.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 1_299_709_123)
#: Clauses keep the stop that ends them.
STOPS = "。！？!?."
CLAUSES = f"(?<=[{STOPS}])|[，、,；;：:\n“”「」]"
ENDED = "h1 bigint, h2 bigint, verdict int, reason string, unit string, size int, asks boolean, within_word boolean, whole bigint, prefixes array<bigint>"
#: How a longer text goes on: with another line, with a letter or figure of a script that is written in words, otherwise.
NEXT_LINE, WORD, OTHER = 0, 1, 2
IDEOGRAPHS = "⺀"


class Prefixes:
    """Hashes of all prefixes of the texts of a batch; the last one has ended where the next one begins."""

    def __init__(self, texts: list[str]) -> None:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(points)) - np.repeat(self.starts[:-1], lengths)
        self.sums = []
        for base in BASES:
            terms = points * _powers(base, int(lengths.max(initial=0)))[place] % np.uint64(PRIME)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))))

    def at(self, row: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of the first ``size`` characters of each ``row``."""
        first, last = self.starts[row], self.starts[row] + size
        high, low = ((s[last] - s[first]) % np.uint64(PRIME) for s in self.sums)
        return (high << np.uint64(31) | low).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo PRIME, by doubling."""
    powers = np.ones(1, dtype=np.uint64)
    step = base
    while len(powers) < n:
        powers = np.concatenate((powers, powers * np.uint64(step) % np.uint64(PRIME)))
        step = step * step % PRIME
    return powers


def _in_words(c: str) -> bool:
    return c.isalnum() and c < IDEOGRAPHS


def _ended(settings: Settings):
    """Arrow map (h1, h2, text) -> how each text ends, whether longer copies may prove it cut, and its prefixes' hashes."""

    def titular(core: str) -> bool:
        wide = sum(c >= IDEOGRAPHS for c in core[: settings.title_letters + 1])
        return "\n" not in core and len(core) <= (settings.title_ideographs if 2 * wide > len(core) else settings.title_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(2).to_pylist()
            ends = [ending(t) for t in texts]
            cores = [t[: e.size] for t, e in zip(texts, ends)]
            within = [bool(c) and _in_words(c[-1]) for c in cores]
            asks = [e.verdict == OPEN and e.size >= settings.least_prefix and (w or not titular(c)) for e, c, w in zip(ends, cores, within)]
            hashed = Prefixes(cores)
            sizes = np.array([e.size for e in ends], dtype=np.int64)
            steps = np.array([max(0, (n // FIRST_PREFIX).bit_length()) for n in sizes.tolist()], dtype=np.int64)
            row = np.repeat(np.arange(len(texts)), steps)
            step = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
            prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(steps))), pa.int32()), pa.array(hashed.at(row, FIRST_PREFIX << step), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([e.verdict for e in ends], pa.int32()),
                    pa.array([e.reason for e in ends], pa.string()),
                    pa.array([e.unit if e.verdict == OPEN else None for e in ends], pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.array(asks, pa.bool_()),
                    pa.array([w and "\n" not in c and titular(c) for c, w in zip(cores, within)], pa.bool_()),
                    pa.array(hashed.at(np.arange(len(texts)), sizes), pa.int64()),
                    prefixes,
                ],
                names=["h1", "h2", "verdict", "reason", "unit", "size", "asks", "within_word", "whole", "prefixes"],
            )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map (size, lengths, text) -> hash of the first ``length`` characters and how the text goes on, for each length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, lengths, texts = (c.to_pylist() for c in batch.columns)
        cores = [t[:n] for t, n in zip(texts, sizes)]
        row = np.repeat(np.arange(len(cores)), [len(x) for x in lengths])
        length = np.array([n for x in lengths for n in x], dtype=np.int64)
        following = [cores[r][n] for r, n in zip(row.tolist(), length.tolist())]
        goes_on = [NEXT_LINE if c in "\r\n" else WORD if _in_words(c) else OTHER for c in following]
        yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(Prefixes(cores).at(row, length), pa.int64()), pa.array(goes_on, pa.int32())], names=["size", "whole", "goes_on"])


def _digest(text: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def _few(numbers: DataFrame, count: Column, settings: Settings) -> bool:
    """Whether the numbers of a (staged) table may be broadcast."""
    return (numbers.agg(F.sum(count)).first()[0] or 0) <= settings.broadcast_numbers


def longer_copies(texts: DataFrame, ended: DataFrame, settings: Settings) -> DataFrame:
    """(h1, h2) of the texts in question that a longer copy proves cut; ``texts`` has (h1, h2, text)."""
    asking = ended.where("asks").select("h1", "h2", "size", "whole", "within_word", (F.size("prefixes") - 1).alias("step"), F.element_at("prefixes", -1).alias("prefix"))
    # One row a prefix: the different lengths asked for lie between one step and the next.
    wanted = asking.groupBy("step", "prefix").agg(F.collect_set("size").alias("lengths"))
    shared = ended.select("h1", "h2", "size", F.posexplode("prefixes").alias("step", "prefix")).join(wanted, ["step", "prefix"])
    shorter = F.filter("lengths", lambda n: n < F.col("size"))
    asked = shared.select("h1", "h2", "size", shorter.alias("lengths")).where(F.size("lengths") > 0)
    asked = staged(asked.groupBy("h1", "h2", "size").agg(F.flatten(F.collect_list("lengths")).alias("lengths")))
    met = texts.join(F.broadcast(asked) if _few(asked, F.size("lengths") + 3, settings) else asked, ["h1", "h2"])
    answers = met.select("size", "lengths", "text").mapInArrow(_answers, "size int, whole bigint, goes_on int").distinct()
    proved = asking.join(answers, ["size", "whole"]).where((F.col("goes_on") != NEXT_LINE) & (~F.col("within_word") | (F.col("goes_on") == WORD)))
    return proved.select("h1", "h2").distinct()


def whole_clauses(texts: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """The ``unit`` (hash of a clause) of ``asked`` that stand somewhere with a stop behind them."""
    pieces = texts.select(F.explode(F.split("text", CLAUSES)).alias("c")).where(F.substring("c", -1, 1).isin(*STOPS))
    pieces = pieces.select(F.xxhash64(F.expr(f"trim(trim(TRAILING '{STOPS}' FROM c))")).alias("unit"))
    units = asked.select("unit").distinct()
    return pieces.join(F.broadcast(units) if _few(units, F.lit(1), settings) else units, "unit", "left_semi").distinct()


def judged(df: DataFrame, text: str, source: str, settings: Settings = Settings()) -> DataFrame:
    """One row a distinct text: digests, ``is_cut`` and the reason."""
    rows = df.select(F.col(text).alias("text"), F.col(source).alias("source")).where(F.length("text") > 0)
    texts = rows.select(*_digest(F.col("text")), "text")
    ended = staged(texts.mapInArrow(_ended(settings), ENDED).dropDuplicates(["h1", "h2"]))
    longer = longer_copies(texts, ended, settings).withColumn("longer", F.lit(True))
    # Last clauses before an omission mark: those that are whole clauses somewhere end a full statement. A clause that is
    # seen nowhere else is taken for cut, but for one before the full ellipsis, which needs a size limit as evidence.
    asked = ended.where((F.col("verdict") == OPEN) & (F.col("reason") == "omission")).select("h1", "h2", F.xxhash64("unit").alias("unit"))
    stated = asked.join(whole_clauses(texts, asked, settings), "unit", "left_semi").select("h1", "h2", F.lit(True).alias("stated"))
    verdicts = ended.select("h1", "h2", "verdict", "reason", "size").join(longer, ["h1", "h2"], "left").join(stated, ["h1", "h2"], "left")
    proved = F.col("longer").isNotNull()
    sure = (F.col("verdict") == CUT) | ((F.col("verdict") == OPEN) & (proved | ((F.col("reason") == "omission") & F.col("stated").isNull())))
    verdicts = staged(verdicts.select("h1", "h2", "verdict", "size", sure.alias("sure"), F.when(proved, "longer copy").otherwise(F.col("reason")).alias("reason")))
    # Sizes at which a source cuts.
    sizes = rows.select("source", *_digest(F.col("text"))).distinct().join(verdicts.select("h1", "h2", "size", "sure", "verdict"), ["h1", "h2"])
    cuts = sizes.where("sure").groupBy("source", "size").agg(F.count("*").alias("cuts"))
    cuts = cuts.withColumn("all_cuts", F.sum("cuts").over(Window.partitionBy("source")))
    limits = cuts.where((F.col("cuts") >= settings.pile) & (F.col("cuts") >= settings.pile_share * F.col("all_cuts"))).select(F.col("source").alias("_s"), F.col("size").alias("_n"))
    piled = sizes.where((F.col("verdict") == OPEN) & ~F.col("sure")).join(limits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")), "left_semi")
    piled = piled.select("h1", "h2", F.lit(True).alias("piled")).distinct()
    final = verdicts.join(piled, ["h1", "h2"], "left")
    is_cut = F.col("sure") | F.coalesce("piled", F.lit(False))
    return final.select("h1", "h2", is_cut.alias("is_cut"), F.when(F.col("piled"), "size limit").otherwise(F.col("reason")).alias("reason"))


def cut_rows(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row (``id``, ``source``) with ``is_cut``; rows without text are not cut."""
    keyed = df.select(id, F.col(source).alias("source"), *_digest(F.col(text))).distinct()
    verdicts = judged(df, text, source)
    return keyed.join(verdicts, ["h1", "h2"], "left").select(id, "source", F.coalesce("is_cut", F.lit(False)).alias("is_cut"), "reason")


def shares(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per source: its documents, the cut ones, and their share."""
    n, cut = F.count("*"), F.count_if("is_cut")
    return cut_rows(df, id, text, source).groupBy("source").agg(n.alias("documents"), cut.alias("cut_documents"), (cut / n).alias("cut_share"))
