"""Sinks: a file a row, JSON lines of tokens, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str, name: str = "file_name", text: str = "text") -> None:
    """One UTF-8 file a row in a folder that all executors share; existing files are replaced, rows without a name left out.

    ``folder`` is a path or an address of any file system that Arrow knows (``file``, ``hdfs``, ``s3``, ``gs``); others raise. Rows that
    share a name would replace each other, so they raise ``ValueError`` before anything is written. A file appears under its
    name only when it is complete, so a task that is run again leaves no halves. For large corpora Parquet is the better
    layout; this is for consumers that want files.
    """
    rows = df.select(name, text).where(F.col(name).isNotNull())
    shared = rows.groupBy(name).count().where("count > 1").limit(3).collect()
    if shared:
        raise ValueError(f"several rows have one file name: {', '.join(repr(r[0]) for r in shared)}")
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)

    def write(rows: Iterator) -> None:
        files, root = _file_system(folder)
        for row in rows:
            part = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                f.write((row[1] or "").encode("utf-8"))
            files.move(part, f"{root}/{row[0]}")

    rows.foreachPartition(write)


def _file_system(folder: str) -> tuple[FileSystem, str]:
    if "://" in folder:
        return FileSystem.from_uri(folder)
    return LocalFileSystem(), folder.removeprefix("file:")


def write_tokens(df: DataFrame, path: str, block_id: str = "block_id", tokens: str = "tokens") -> None:
    """JSON lines ``{"blockId": ..., "tokens": [...]}``, appended to the folder; a partition never writes into another's file."""
    line = F.to_json(F.struct(F.col(block_id).alias("blockId"), F.col(tokens).alias("tokens")))
    df.select(line.alias("value")).write.mode("append").text(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A table of an intermediate result, beside the main flow instead of inside a transformation."""
    df.write.mode("overwrite").parquet(path)


def rejected(df: DataFrame, reason) -> DataFrame:
    """Number of rows by reason of rejection."""
    return df.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))
