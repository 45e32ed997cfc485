"""Texts cut into blocks, one row a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T


def explode_blocks(df: DataFrame, name: str = "file_name", text: str = "text", blocker: str = "chapter", **options: int) -> DataFrame:
    """(file_name, seq, block_id, text) of every block; ``block_id`` is ``<file_name>_<seq>``. A null text has no blocks."""
    cut = T.blocker(blocker)(text, **options)
    rows = df.select(F.col(name).alias("file_name"), F.posexplode(cut).alias("seq", "text"))
    return rows.select("file_name", "seq", F.concat_ws("_", "file_name", "seq").alias("block_id"), "text")


def with_shingles(blocks: DataFrame, k: int = 3, keep_trailing: bool = True) -> DataFrame:
    return blocks.withColumn("ngrams", T.shingles(T.grams("text", keep_trailing), k))


def split_block_id(df: DataFrame, block_id: str = "block_id") -> DataFrame:
    """``file_name`` and ``seq`` of a block id, cut at the last underscore."""
    return df.withColumn("file_name", F.regexp_extract(block_id, r"(?s)^(.*)_(\d+)$", 1)).withColumn("seq", F.regexp_extract(block_id, r"(?s)^(.*)_(\d+)$", 2).cast("int"))
