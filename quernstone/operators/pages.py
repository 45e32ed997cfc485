"""Which pages are worth cleaning, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import wikitext as W
from quernstone.functions.rules import LEAST_LENGTH, LEAST_VIEWS


def ignored_reason(title: str = "title", text: str = "text"):
    """Why a page is ignored; null for a page that is kept."""
    return (
        F.when(F.col(title).isNull(), "no title")
        .when(F.col(title).contains(":"), "other namespace")
        .when(F.col(text).isNull(), "no text")
        .when(T.is_redirect(text), "redirect")
    )


def articles(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pages (title, text, ...) that are articles; with ``done`` (file_name) those already written are left out."""
    kept = pages.where(ignored_reason().isNull())
    if done is None:
        return kept
    return kept.withColumn("_file", T.file_name("title")).join(done.select(F.col("file_name").alias("_file")), "_file", "left_anti").drop("_file")


def view_totals(views: DataFrame, title: str = "title", count: str = "view_count") -> DataFrame:
    """(title, views): sums over deliveries counted once; missing counts are 0, rows without title are left out."""
    once = views.where(F.col(title).isNotNull()).distinct()
    return once.groupBy(F.col(title).alias("title")).agg(F.sum(F.coalesce(count, F.lit(0))).alias("views"))


def popular(pages: DataFrame, totals: DataFrame, least_views: int = LEAST_VIEWS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Pages that are read and long enough. The length filter comes first and needs no join; sums are joined by title."""
    long = pages.where(T.visible_length("text") >= least_length)
    return long.join(totals.where(F.col("views") >= least_views), "title", "left_semi")


def cleaned(pages: DataFrame) -> DataFrame:
    """(title, text) in clean wikitext: comments and references in the JVM, brackets and sections in one Arrow step."""
    return pages.select("title", W.cleaned_column(T.without_refs_and_comments("text")).alias("text"))
