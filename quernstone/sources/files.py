"""Folders of whole text files, and page dumps in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import decoded

#: Given, not inferred: inference reads all the data, and has another type where no ``text`` has attributes.
PAGE_SCHEMA = "title string, revision struct<text: struct<_VALUE: string, _lang: string>>"


def whole_files(spark: SparkSession, path: str, name: str = "file_name", text: str = "text") -> DataFrame:
    """One row a file: its name (not percent-encoded) and its UTF-8 text. Files of no bytes have no row: scans skip them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias(name), decoded("content").alias(text))


def dump_pages(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """(title, text, lang) of every page of an XML dump; pages without text keep a null."""
    pages = spark.read.format("xml").option("rowTag", row_tag).schema(PAGE_SCHEMA).load(path)
    return pages.select("title", F.col("revision.text._VALUE").alias("text"), F.col("revision.text._lang").alias("lang"))
