"""Text quality: statistics of each document, exact ranks within its language, and outlier scores that decide.

The ranks are those of a full sort, yet no task sees more than its range: equal values are counted before anything moves
(so a value that a third of all documents share is one row), the distinct values are range-partitioned and sorted, every
partition counts on from zero, and the offset of a partition is the sum of the partitions before it.

A rank says how many *natural* documents of the language lie at or below a value: junk is ranked, but not counted, and
documents with the same statistics count once, so junk can't hide itself by being common. From the ranks follow two tail
probabilities for each statistic; the score of a document adds up -ln of the tail on the side where junk lies (of the smaller
tail where junk may lie on either). If a document is natural and its statistics independent, such a sum is at least ``s`` with
probability exp(-s) (1 + s + s^2/2 + ...), with a term for each statistic. That times the number of natural documents is
``expected``: how many of them would be as odd as this one by chance. Where only a few would be, the document is an outlier.
Every document is ranked within its language and among all documents; the smaller ``expected`` holds. Documents of no known
language are ranked among all only.

Defined results: null, empty and blank texts have their statistics (all zero, language ``und``) and no score; exact
duplicate rows count once; an empty table gives an empty result; in a language without natural documents every document is
as odd as can be (``expected`` 0), and the exact check alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import prose
from quernstone.plans.lineage import staged

#: Statistics that are ranked, and the side on which junk lies.
SIDES = {"mean_word_length": "both", "symbol_ratio": "high", "stop_line_share": "low", "common_word_share": "low", "prose_share": "low"}
STATISTICS = "lang string, characters bigint, words bigint, mean_word_length double, symbol_ratio double, stop_line_share double, common_word_share double, prose_share double"
#: The frequent words go to every worker; a table of more than this many is refused.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    """Outliers are documents than which at most ``most_alarms`` natural ones are expected to be odder by chance.

    Natural are those of whose characters at least the share ``least_prose`` stands in sentences.
    """

    least_prose: float = 0.5
    most_alarms: float = 3.0


def vocabulary(common_words: DataFrame) -> prose.Vocabulary:
    """Frequent words by language from a reference table (``lang``, ``word``)."""
    rows = common_words.select("lang", "word").where("lang is not null and word is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} frequent words")
    words: dict[str, list[str]] = {}
    for r in rows:
        words.setdefault(r["lang"], []).append(r["word"])
    return prose.Vocabulary(words)


def statistics(df: DataFrame, id: str, text: str, words: prose.Vocabulary) -> DataFrame:
    """``id``, a digest of the text and its statistics, one row a distinct (id, text). Repeated rows are measured and then dropped,
    so statistics are shuffled and texts are not."""
    kind = df.schema[id].dataType.simpleString()
    names = [id, "digest", "_2", *prose.Statistics._fields]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 5]
        for batch in batches:
            if batch.num_rows:
                rows = [prose.statistics(t or "", words) for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    digests = df.select(id, F.xxhash64(text).alias("digest"), F.xxhash64(F.lit("second"), F.col(text)).alias("_2"), text)
    measured = digests.mapInArrow(measure, f"`{id}` {kind}, digest bigint, _2 bigint, {STATISTICS}")
    return measured.dropDuplicates([id, "digest", "_2"]).drop("_2")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a sorted partition, added up within (grp, stat)."""
    current, total = None, 0
    for batch in batches:
        runs = []
        for grp, stat, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (grp, stat) != current:
                current, total = (grp, stat), 0
            total += n
            runs.append(total)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=["grp", "stat", "value", "n", "pid", "run"])


def tails(values: DataFrame) -> DataFrame:
    """(grp, stat, value) -> exact rank from below, tail probabilities ``low`` (at or below) and ``high`` (at or above).

    ``values`` has the columns grp, stat, value, and may have ``weight``: rows of weight 0 are ranked but not counted. Null
    values are left out; the tails are null in a group where nothing counts.
    """
    weight = F.col("weight") if "weight" in values.columns else F.lit(1)
    counted = values.where("value is not null").groupBy("grp", "stat", "value").agg(F.sum(weight.cast("bigint")).alias("n"))
    ordered = counted.repartitionByRange("grp", "stat", "value").sortWithinPartitions("grp", "stat", "value")
    ordered = ordered.select("grp", "stat", "value", "n", F.spark_partition_id().alias("pid"))
    running = staged(ordered.mapInArrow(_running, "grp string, stat string, value double, n bigint, pid int, run bigint"))
    # A row for each group in each partition that it reaches: partitions + groups rows at most.
    parts = running.groupBy("grp", "stat", "pid").agg(F.sum("n").alias("part"))
    group = Window.partitionBy("grp", "stat")
    before = F.coalesce(F.sum("part").over(group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "stat", "pid", before.alias("offset"), F.sum("part").over(group).alias("total"))
    up_to = F.col("offset") + F.col("run")
    ranked = running.join(F.broadcast(parts), ["grp", "stat", "pid"]).select("grp", "stat", "value", "n", up_to.alias("rank"), "total")
    above = F.col("total") - F.col("rank") + F.col("n")
    return ranked.withColumn("low", F.try_divide("rank", "total")).withColumn("high", F.try_divide(above, F.col("total")))


def improbability(score: Column, statistics: int) -> Column:
    """The probability that so many independent -ln tails add up to ``score`` or more."""
    terms = [F.lit(1.0)]
    for j in range(1, statistics):
        terms.append(terms[-1] * score / F.lit(float(j)))
    return F.exp(-score) * sum(terms[1:], terms[0])


def scored(stats: DataFrame, id: str, settings: Settings = Settings()) -> DataFrame:
    """The statistics with ``score`` and ``expected``, and ``tail_<statistic>`` within the language (among all documents where
    there is none). Computed once."""
    stats = staged(stats)
    counts = F.col("prose_share") >= settings.least_prose
    named = F.array(*[F.struct(F.lit(s).alias("stat"), (F.col(s) + F.lit(0.0)).alias("value")) for s in SIDES])
    groups = F.array_compact(F.array(F.when(F.col("lang") != "und", F.col("lang")), F.lit("*")))
    shown = stats.where("characters > 0").withColumn("grp", F.explode(groups))
    # Documents with the same statistics are one row, which counts once.
    once = shown.select("grp", *SIDES, counts.cast("int").alias("weight")).distinct()
    by_value = tails(once.select("grp", "weight", F.explode(named).alias("v")).select("grp", "weight", "v.*"))
    low = (F.col("rank") + 1) / (F.col("total") + 1)
    high = (F.col("total") - F.col("rank") + F.col("n") + 1) / (F.col("total") + 1)
    side = F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair])[F.col("stat")]
    tail = F.when(side == "low", low).when(side == "high", high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    by_value = by_value.select("grp", "stat", "value", tail.alias("tail"), "total")
    ranked = shown.select(id, "digest", "grp", F.explode(named).alias("v")).select(id, "digest", "grp", "v.*").join(by_value, ["grp", "stat", "value"])
    wide = ranked.groupBy(F.col(id).alias("_id"), F.col("digest").alias("_digest"))
    scores, expected, in_all = {}, {}, F.col("grp") == "*"
    for name, held in (("own", ~in_all), ("all", in_all)):
        scores[name] = F.sum(F.when(held, -F.log("tail")))
        expected[name] = F.max(F.when(held, F.col("total"))) * improbability(scores[name], len(SIDES))
    own = [F.coalesce(F.min(F.when(mine & ~in_all, F.col("tail"))), F.min(F.when(mine, F.col("tail")))).alias(f"tail_{s}") for s in SIDES for mine in (F.col("stat") == s,)]
    wide = wide.agg(F.coalesce(scores["own"], scores["all"]).alias("score"), F.least(expected["own"], expected["all"]).alias("expected"), *own)
    return stats.join(wide, F.col(id).eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left").drop("_id", "_digest")


def no_prose(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``scored`` that are outliers, and hold more of lists, tables and junk than of sentences (the exact check)."""
    return rows.where((F.col("expected") <= settings.most_alarms) & (F.col("prose_share") < settings.least_prose))
