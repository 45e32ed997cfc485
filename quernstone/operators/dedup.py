"""Near-duplicate blocks removed, and what is left put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import blocks as B
from quernstone.operators import minhash as M
from quernstone.operators.components import connected_components
from quernstone.plans.lineage import staged

#: For training data: runs of five words, similarity from 0.8 on, at least 0.995 of the pairs at that limit found.
STAGE = M.LshConfig.for_similarity(0.8)


def block_components(blocks: DataFrame, config: M.LshConfig = M.LshConfig()) -> DataFrame:
    """(block_id, component) of every block (block_id, text): near-duplicates share the smallest block id.

    Blocks with fewer than k grams take no part in matching and stay alone, copies of them included.
    """
    shingled = staged(B.with_shingles(M.representatives(blocks, ["text"]), config.k).where(F.size("ngrams") > 0).select("block_id", "ngrams"))
    pairs = M.near_links(shingled, config)
    classes = M.exact_classes(blocks)
    matched = classes.join(shingled.select(F.col("block_id").alias("class_id")), "class_id", "left_semi")
    edges = pairs.select("block_id1", "block_id2").unionAll(matched.where("block_id <> class_id").select("block_id", "class_id"))
    return connected_components(blocks.select("block_id"), edges)


def survivors(blocks: DataFrame, config: M.LshConfig = M.LshConfig()) -> DataFrame:
    """The block with the smallest id of each component, with all its columns."""
    kept = block_components(blocks, config).where("block_id = component").select("block_id")
    return blocks.join(kept, "block_id", "left_semi")


def assembled(blocks: DataFrame) -> DataFrame:
    """(file_name, text): the blocks of each file in their order, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return blocks.groupBy("file_name").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def deduplicated(files: DataFrame, config: M.LshConfig = STAGE, blocker: str = "chapter") -> DataFrame:
    """Files (file_name, text) without their near-duplicate blocks; a file that loses all its blocks is gone."""
    blocks = staged(B.explode_blocks(files.distinct(), blocker=blocker))
    return assembled(survivors(blocks, config))


def exact_deduplicated(files: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """One row a distinct text: the smallest name, the number of copies. Null texts are one group."""
    once = files.select(name, text).distinct()
    groups = once.groupBy(F.md5(text).alias("digest")).agg(F.min(name).alias(name), F.count("*").alias("copies"), F.first(text).alias(text))
    return groups.select(name, "copies", text)
