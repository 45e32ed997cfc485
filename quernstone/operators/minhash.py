"""MinHash signatures, banding, candidates and verified pairs.

All steps work on classes of blocks with the same shingles text (``exact_classes``), so a block copied many times is one
row, and a pair stands for the pairs of all its copies; ``class_id`` is the smallest block id. No bucket is capped: buckets are
joined with themselves on (band, key), which AQE splits where one is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import hashing
from quernstone.plans.lineage import staged


@dataclass(frozen=True)
class LshConfig:
    """``max_distance`` is the largest Jaccard distance of a verified pair; bands * rows columns of the signature are used.

    The defaults are those of the published job: a pair at similarity s is found with probability 1 - (1 - s**2)**2, that is 0.87 at 0.8
    and 0.29 at the limit of 0.4. ``for_similarity`` chooses the bands by the share of pairs that is to be found.
    """

    hashes: int = 4
    max_distance: float = 0.6
    k: int = 3
    bands: int = 2
    rows: int = 2

    def __post_init__(self) -> None:
        if min(self.hashes, self.k, self.bands, self.rows) < 1 or self.bands * self.rows > self.hashes:
            raise ValueError(f"{self.bands} bands of {self.rows} rows don't fit into {self.hashes} hash functions")

    @classmethod
    def for_similarity(cls, similarity: float = 0.8, found: float = 0.995, rows: int = 3, k: int = 5) -> LshConfig:
        """As many bands of ``rows`` as find the share ``found`` of the pairs at the limit, and more of all closer ones."""
        if not 0 < similarity < 1 or not 0 < found < 1:
            raise ValueError("shares lie between 0 and 1")
        bands = math.ceil(math.log(1 - found) / math.log(1 - similarity**rows))
        return cls(hashes=bands * rows, max_distance=1 - similarity, k=k, bands=bands, rows=rows)


def exact_classes(blocks: DataFrame) -> DataFrame:
    """(block_id, class_id): blocks with equal text share the smallest block id. Exact duplicate rows count once."""
    keyed = blocks.select("block_id", F.md5("text").alias("digest")).distinct()
    classes = keyed.groupBy("digest").agg(F.min("block_id").alias("class_id"))
    return keyed.join(classes, "digest").select("block_id", "class_id")


def representatives(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each distinct text: ``block_id`` (the smallest) and ``columns``, from one shuffle with partial aggregates."""
    keyed = blocks.select("block_id", F.md5("text").alias("digest"), *columns)
    return keyed.groupBy("digest").agg(F.min("block_id").alias("block_id"), *[F.first(c).alias(c) for c in columns]).select("block_id", *columns)


def signatures(shingled: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """(block_id, signature): minima over the shingles; blocks without shingles have none.

    The shingles are exploded and their minima taken again in the same stage, so one row a block is shuffled and the
    expressions stay in generated code.
    """
    hashed = shingled.select("block_id", F.explode("ngrams").alias("g")).select("block_id", hashing.md5_32(F.col("g")).alias("h"))
    columns = [F.min(hashing.affine(F.col("h"), a, b)).alias(f"s{i}") for i, (a, b) in enumerate(hashing.coefficients(config.hashes))]
    minima = hashed.groupBy("block_id").agg(*columns)
    return minima.select("block_id", F.array(*[f"s{i}" for i in range(config.hashes)]).alias("signature"))


def bands(signed: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """(block_id, band, key): ``bands`` rows a block, the key an array of ``rows`` columns of the signature."""
    slices = F.array(*[F.slice("signature", i * config.rows + 1, config.rows) for i in range(config.bands)])
    return signed.select("block_id", F.posexplode(slices).alias("band", "key"))


def buckets(banded: DataFrame) -> DataFrame:
    """Sizes and ends of the buckets with more than one block."""
    sized = banded.groupBy("band", "key").agg(F.count("*").alias("blocks"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))
    return sized.where("blocks > 1")


def candidates(banded: DataFrame) -> DataFrame:
    """Pairs (block_id1 < block_id2) that share a bucket, once each."""
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.block_id") < F.col("y.block_id")))
    return met.select(F.col("x.block_id").alias("block_id1"), F.col("y.block_id").alias("block_id2")).distinct()


#: Words of 64 bits of a sketch.
WORDS = 16


def described(shingled: DataFrame, config: LshConfig) -> DataFrame:
    """(block_id, n, signature, w0, w1, ...): number of distinct shingles, signature, and a bitmap with a bit set for each shingle.

    Two bitmaps differ in at most as many bits as the sets differ in shingles. The shingles are exploded once, and one row a block
    leaves that stage.
    """
    place = F.pmod(F.xxhash64("g"), F.lit(64 * WORDS)).cast("int")
    items = shingled.select("block_id", F.explode(F.array_distinct("ngrams")).alias("g")).select("block_id", hashing.md5_32(F.col("g")).alias("h"), place.alias("p"))
    items = items.select("block_id", "h", F.expr("p div 64").cast("int").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bit"))
    minima = [F.min(hashing.affine(F.col("h"), a, b)).alias(f"s{i}") for i, (a, b) in enumerate(hashing.coefficients(config.hashes))]
    words = [F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(WORDS)]
    held = items.groupBy("block_id").agg(F.count("*").alias("n"), *minima, *words)
    return held.select("block_id", "n", F.array(*[f"s{i}" for i in range(config.hashes)]).alias("signature"), *[f"w{i}" for i in range(WORDS)])


def described_bands(shingled: DataFrame, config: LshConfig) -> DataFrame:
    """(block_id, band, key, n, w0, ...): what of a block travels with its bands."""
    rows = described(shingled, config)
    slices = F.array(*[F.slice("signature", i * config.rows + 1, config.rows) for i in range(config.bands)])
    return rows.select("block_id", "n", *[f"w{i}" for i in range(WORDS)], F.posexplode(slices).alias("band", "key"))


def may_be_near(x: str, y: str, max_distance: float):
    """False only for pairs whose sizes or sketches (of the aliases ``x`` and ``y``) prove a larger Jaccard distance."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differing = sum((F.bit_count(F.col(f"{x}.w{j}").bitwiseXOR(F.col(f"{y}.w{j}"))) for j in range(WORDS)), F.lit(0))
    sizes = F.least(n, m) >= F.greatest(n, m) * (1 - max_distance) - 1e-6
    return sizes & (differing <= (n + m) * (max_distance / (2 - max_distance)) + 1e-6)


def _met(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    """Pairs (block_id1 < block_id2) of ``x`` and ``y`` in one bucket for which the condition holds, once each."""
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.block_id") < F.col("y.block_id"))
    return x.alias("x").join(y.alias("y"), same & condition).select(F.col("x.block_id").alias("block_id1"), F.col("y.block_id").alias("block_id2")).distinct()


def hashed_sets(shingled: DataFrame) -> DataFrame:
    """(block_id, s): the distinct shingles as 64-bit hashes."""
    return shingled.select("block_id", F.array_distinct(F.transform("ngrams", lambda g: F.xxhash64(g))).alias("s"))


def verified(left: DataFrame, sets: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """Pairs (block_id1, block_id2, distance) whose Jaccard distance 1 - |A and B| / |A or B| is at most ``max_distance``.

    ``left`` has the pairs, ``sets`` the sets that are fetched for them.
    """
    one, two = (sets.select(F.col("block_id").alias(f"block_id{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    shared = left.join(one, "block_id1").join(two, "block_id2").withColumn("k", F.size(F.array_intersect("s1", "s2")))
    distance = 1 - F.col("k") / (F.size("s1") + F.size("s2") - F.col("k"))
    return shared.select("block_id1", "block_id2", distance.alias("distance")).where(F.col("distance") <= config.max_distance)


def near_pairs(shingled: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """Signatures, bands, candidates and verification in one plan.

    The sketches travel with the bands (128 bytes for each), so the pairs of a bucket that they rule out end inside the join and
    are never shuffled. Both sides read one exchange.
    """
    rows = described_bands(shingled, config)
    return verified(_met(rows, rows, may_be_near("x", "y", config.max_distance)), hashed_sets(shingled), config)


def near_links(shingled: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """Pairs out of ``near_pairs`` that connect the same blocks.

    First every block of a bucket is verified against the bucket's smallest one. Blocks that are near one and the same are
    connected then, so of the other pairs only those are looked at whose blocks are not, in buckets that hold such: a bucket full
    of variants of one text makes a row a block instead of all its pairs.
    """
    near = may_be_near("x", "y", config.max_distance)
    rows, sets = staged(described_bands(shingled, config)), staged(hashed_sets(shingled))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("blocks"), F.min(F.struct("block_id", "n", *[f"w{j}" for j in range(WORDS)])).alias("c"))
    centres = sizes.where("blocks > 1").select("band", "key", "c.*")
    star = staged(verified(_met(centres, rows, near), sets, config))
    hubs = star.groupBy(F.col("block_id2").alias("block_id")).agg(F.min("block_id1").alias("hub"))
    marked = rows.join(hubs, "block_id", "left").withColumn("hub", F.coalesce("hub", "block_id"))
    mixed = marked.groupBy("band", "key").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).where("low < high").select("band", "key")
    marked = marked.join(mixed, ["band", "key"], "left_semi")
    apart = (F.col("x.hub") != F.col("y.hub")) & (F.col("x.block_id") != F.col("y.hub"))
    return star.unionAll(verified(_met(marked, marked, apart & near), sets, config))


def by_size_ratio(pairs: DataFrame, shingled: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """Pairs whose distance 1 - |A| / |B| is at most ``max_distance``: for comparison with results made elsewhere.

    That distance is neither symmetric nor a metric.
    """
    sizes = shingled.select("block_id", F.size(F.array_distinct("ngrams")).alias("n"))
    one, two = (sizes.select(F.col("block_id").alias(f"block_id{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    ratio = pairs.join(one, "block_id1").join(two, "block_id2").select("block_id1", "block_id2", (1 - F.col("n1") / F.col("n2")).alias("distance"))
    return ratio.where(F.col("distance") <= config.max_distance)
