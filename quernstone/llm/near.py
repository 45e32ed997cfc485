"""Near-duplicate records: pairs whose sets of items overlap enough, and the groups they form.

Records with the same set of items form a class; every step works on one row per class, so a text repeated in a third of
all rows costs one row. Steps, none of which caps partners or candidates:

1. one pass hashes the items, and gives each record its class key, its MinHash bands and its pivot table;
2. classes that share a band become candidates (``Settings.bands`` and ``Settings.rows`` say how surely);
3. a candidate pair is discarded when the pivot tables prove that the fingerprints lie too far apart. A fingerprint is cut
   into segments, each with its Hamming distances to the same reference fingerprints; by the triangle inequality the
   largest coordinate difference of a segment is at most the distance there, so the sum over the segments is at most the
   number of items in which the two sets differ. Nothing that is similar enough can be discarded;
4. survivors are verified with their exact sets.

Defined results: records whose items are null or empty take no part in pairs; exact duplicate rows count once; an id with
two different item sets is compared with both; null ids are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import components
from quernstone.plans.lineage import checkpointed, staged


@dataclass(frozen=True)
class Settings:
    """At similarity s a pair becomes a candidate with probability 1 - (1 - s**rows)**bands: 0.99999 at 0.7."""

    threshold: float = 0.8
    bands: int = 64
    rows: int = 5
    segments: int = 32
    segment_bits: int = 16
    references: int = 8
    seed: int = 1
    #: Ids that may be broadcast to prefilter the sets (8 bytes each); beyond, the same filter is a shuffled join.
    broadcast_ids: int = 500_000


@lru_cache(maxsize=4)
def _constants(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers of the hash functions, mixing multipliers of a band, reference fingerprints by segment."""
    rng = np.random.default_rng(s.seed)
    multipliers = rng.integers(0, 2**63, s.bands * s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixers = rng.integers(0, 2**63, s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    references = rng.integers(0, 2, (s.references, s.segments, s.segment_bits)).astype(np.uint8)
    references[0] = 0  # the distance to the empty fingerprint bounds the difference in size
    return multipliers, mixers, references


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits (constants of the public splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_of(items: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key for each band."""
    multipliers, mixers, _ = _constants(s)
    least = np.full(multipliers.shape, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(items), 2048):
        np.minimum(least, (items[start : start + 2048, None] * multipliers).min(axis=0), out=least)
    grid = least.reshape(s.bands, s.rows)
    keys = np.arange(1, s.bands + 1, dtype=np.uint64)
    for k in range(s.rows):
        keys = mixed(keys + grid[:, k] * mixers[k])
    return keys


def pivots_of(items: np.ndarray, s: Settings) -> np.ndarray:
    """Hamming distances of each segment of the fingerprint to the references; shape (segments, references)."""
    bits = np.zeros(s.segments * s.segment_bits, dtype=np.uint8)
    bits[(items >> np.uint64(20)) % np.uint64(len(bits))] = 1
    return (bits.reshape(1, s.segments, s.segment_bits) != _constants(s)[2]).sum(axis=2, dtype=np.uint8).T


def _described(settings: Settings):
    """Arrow map (id, hashes) -> (id, key, half, n, items, bands, pivots), of records with items."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            lengths = np.where(np.asarray(lists.is_valid()), lengths, 0)
            ends = np.cumsum(lengths)
            for name, end, length in zip(batch.column(0).to_pylist(), ends, lengths):
                if not length or name is None:
                    continue
                items = np.unique(values[end - length : end])
                total = np.array([mixed(items).sum(), mixed(items * np.uint64(3) + np.uint64(len(items))).sum()], dtype=np.uint64)
                rows.append((name, total.tobytes(), int(total[0].view(np.int64)), len(items), items.view(np.int64), bands_of(mixed(items), settings).view(np.int64), pivots_of(mixed(items), settings).tobytes()))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], batch.column(0).type),
                        pa.array(cols[1], pa.binary()),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int32()),
                        *(_lists(x) for x in cols[4:6]),
                        pa.array(cols[6], pa.binary()),
                    ],
                    names=["id", "key", "half", "n", "items", "bands", "pivots"],
                )

    return describe


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))


def most_apart(n1: Column, n2: Column, threshold: float) -> Column:
    """The largest number of items in which two sets of these sizes may differ."""
    return F.floor((n1 + n2) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9))


def apart_at_least(settings: Settings):
    """Column function: what two pivot tables prove about the number of differing items."""

    def bound(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shape = (-1, settings.segments, settings.references)
        for a, b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(shape).astype(np.int16) for c in (a, b))
            yield pa.array(np.abs(x - y).max(axis=2).sum(axis=1).astype(np.int32))

    bound.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(bound, "int")


def described(df: DataFrame, id: str, items: str, settings: Settings) -> DataFrame:
    """The first step, kept in the shared folder: it is read three times."""
    hashed = df.select(F.col(id).alias("id"), F.transform(items, lambda x: F.xxhash64(x)).alias("hashes"))
    kind = hashed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key binary, half bigint, n int, items array<bigint>, bands array<bigint>, pivots binary"
    return staged(hashed.mapInArrow(_described(settings), schema))


def banded(all: DataFrame) -> DataFrame:
    """(half, band) of every class; copies are dropped before their bands are rows."""
    return all.groupBy("half").agg(F.first("bands").alias("bands")).select("half", F.explode("bands").alias("band"))


def verified(candidates: DataFrame, all: DataFrame, settings: Settings) -> DataFrame:
    """The candidates (h1, h2) that are similar enough: key1, key2 (binary), similarity."""
    tables = all.groupBy("half", "key").agg(F.first("n").alias("n"), F.first("pivots").alias("pivots"))
    one, two = (tables.select(F.col("half").alias(f"h{i}"), F.col("key").alias(f"key{i}"), F.col("n").alias(f"n{i}"), F.col("pivots").alias(f"t{i}")) for i in (1, 2))
    near = F.least("n1", "n2") >= F.ceil(F.greatest("n1", "n2") * settings.threshold - 1e-9)
    survivors = candidates.join(one, "h1").join(two, "h2").where(near)
    survivors = survivors.withColumn("apart", apart_at_least(settings)("t1", "t2")).where(F.col("apart") <= most_apart(F.col("n1"), F.col("n2"), settings.threshold))
    survivors = checkpointed(survivors.select("key1", "key2"))
    wanted = survivors.select(F.explode(F.array("key1", "key2")).alias("key")).distinct()
    few = wanted.limit(settings.broadcast_ids + 1).count() <= settings.broadcast_ids
    sets = all.select("key", "items").join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    sets = sets.groupBy("key").agg(F.first("items").alias("items"))
    one, two = (sets.select(F.col("key").alias(f"key{i}"), F.col("items").alias(f"items{i}")) for i in (1, 2))
    both = survivors.join(one, "key1").join(two, "key2")
    shared = F.size(F.array_intersect("items1", "items2"))
    similarity = shared / (F.size("items1") + F.size("items2") - shared)
    return both.select("key1", "key2", similarity.alias("similarity")).where(F.col("similarity") >= settings.threshold)


def class_pairs(all: DataFrame, settings: Settings) -> DataFrame:
    """All verified pairs of classes: key1, key2 (binary), similarity."""
    rows = banded(all)
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.half") < F.col("y.half")))
    return verified(met.select(F.col("x.half").alias("h1"), F.col("y.half").alias("h2")).distinct(), all, settings)


def class_links(all: DataFrame, settings: Settings) -> DataFrame:
    """Links out of ``class_pairs`` that connect the same classes: key1, key2.

    First every class of a bucket is verified against the smallest one of the bucket, and the groups of these links are formed. What
    is left are pairs in one bucket but in different groups, so a bucket full of variants of one text makes a row a class.
    """
    rows = staged(banded(all))
    centres = rows.groupBy("band").agg(F.min("half").alias("h1"), F.max("half").alias("last")).where("h1 < last").select("band", "h1")
    star = rows.join(centres, "band").where("h1 < half").select("h1", F.col("half").alias("h2")).distinct()
    star = checkpointed(verified(star, all, settings).select("key1", "key2"))
    names = all.select("key", "half").distinct()
    keyed = star.join(names.withColumnsRenamed({"key": "key1", "half": "h1"}), "key1").join(names.withColumnsRenamed({"key": "key2", "half": "h2"}), "key2")
    grouped = components.groups(keyed, "h1", "h2", "half", "grp")
    marked = rows.join(grouped, "half", "left").select("band", "half", F.coalesce("grp", "half").alias("grp"))
    mixed = marked.groupBy("band").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("band")
    marked = checkpointed(marked.join(mixed, "band", "left_semi"))
    met = marked.alias("x").join(marked.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.half") < F.col("y.half")) & (F.col("x.grp") != F.col("y.grp")))
    rest = verified(met.select(F.col("x.half").alias("h1"), F.col("y.half").alias("h2")).distinct(), all, settings)
    return star.unionAll(rest.select("key1", "key2"))


def pairs(df: DataFrame, id: str, items: str, settings: Settings = Settings()) -> DataFrame:
    """Pairs (id1 < id2, similarity) of different records that are similar enough, copies included.

    Every pair is listed, so n copies make n * (n - 1) / 2 rows; ``membership`` connects the same records without any expansion.
    """
    all = described(df, id, items, settings)
    members = all.select("id", "key").distinct()
    classes = members.groupBy("key").agg(F.count("*").alias("copies"))
    members = checkpointed(members.join(classes.where("copies > 1"), "key", "left"))
    one, two = (members.select(F.col("id").alias(f"i{i}"), F.col("key").alias(f"key{i}")) for i in (1, 2))
    across = class_pairs(all, settings).join(one, "key1").join(two, "key2").where("i1 <> i2")
    across = across.select(F.least("i1", "i2").alias("id1"), F.greatest("i1", "i2").alias("id2"), "similarity")
    copied = members.where("copies > 1")
    x, y = copied.alias("x"), copied.alias("y")
    same = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id1"), F.col("y.id").alias("id2"))
    return across.unionAll(same.withColumn("similarity", F.lit(1.0))).groupBy("id1", "id2").agg(F.max("similarity").alias("similarity"))


def membership(df: DataFrame, id: str, items: str, settings: Settings = Settings()) -> DataFrame:
    """One row a record with items: its class (smallest id with the same set), the number of its copies, and its group.

    The group is the smallest id that the record reaches through similar records.
    """
    all = described(df, id, items, settings)
    members = checkpointed(all.select("id", "key").distinct())
    classes = members.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    one, two = (classes.select(F.col("key").alias(f"key{i}"), F.col("class_id").alias(f"c{i}")) for i in (1, 2))
    linked = class_links(all, settings).join(one, "key1").join(two, "key2").select("c1", "c2")
    # An id with two item sets belongs to both classes and links them.
    split = members.join(classes, "key").where("id <> class_id").select(F.col("id").alias("c1"), F.col("class_id").alias("c2"))
    groups = components.groups(linked.unionAll(split), "c1", "c2", "id", "group_id")
    named = members.join(classes, "key").join(groups, "id", "left")
    return named.groupBy(F.col("id").alias(id)).agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.min(F.coalesce("group_id", "class_id")).alias("group_id"))
