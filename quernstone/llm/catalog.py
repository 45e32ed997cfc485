"""Queries of this package by name, and the SQL that checks them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import components, lookalike, near, pack, quality, split, tokens, truncation
from quernstone.plans.lineage import staged
from quernstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _file_statistics(spark: SparkSession, folder: str) -> DataFrame:
    words = quality.vocabulary(table(spark, folder, "common_words"))
    return quality.statistics(table(spark, folder, "corpus_files", "file_name", "text"), "file_name", "text", words)


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, tails within the language and outlier score of every file."""
    return quality.scored(_file_statistics(spark, folder), "file_name").drop("digest")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose text is not natural prose."""
    return quality.no_prose(quality.scored(_file_statistics(spark, folder), "file_name")).select("file_name").distinct()


def p1_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact ranks and tails, within the announced language, of the sizes of all documents (SQL can check these)."""
    held = table(spark, folder, "documents", "doc_id", "text", "lang").where("text is not null")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = F.array(*[F.struct(F.lit(n).alias("stat"), c.cast("double").alias("value")) for n, c in (("characters", F.length("text")), ("line_breaks", lines))])
    long = held.select("doc_id", F.coalesce("lang", F.lit("und")).alias("grp"), F.explode(sizes).alias("v")).select("doc_id", "grp", "v.*")
    return long.join(quality.tails(long), ["grp", "stat", "value"]).select("doc_id", "grp", "stat", "value", "rank", "total", "low", "high")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every text of the tables that have a split limit."""
    limits = split.limits(table(spark, folder, "size_limits"))
    parts = [split.split(table(spark, folder, name, "file_name", "text"), "file_name", "text", name, limit) for name, limit in sorted(limits.items())]
    return reduce(DataFrame.unionAll, parts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that had to be cut without a boundary, confirmed by the length of the stretch that holds none."""
    forced = p2_pieces(spark, folder).where(F.col("forced") & (F.col("longest_run") > F.col("max_size")))
    return forced.select("item_table", "file_name").distinct()


#: Blocks are similar from 0.7 on (TESTDATA.md).
BLOCKS = near.Settings(threshold=0.7)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of blocks whose sets of n-grams are similar enough."""
    found = near.pairs(table(spark, folder, "blocks", "block_id", "ngrams"), "block_id", "ngrams", BLOCKS)
    return found.select(F.col("id1").alias("block_id1"), F.col("id2").alias("block_id2"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each block with n-grams: class of equal sets, copies, and group."""
    return near.membership(table(spark, folder, "blocks", "block_id", "ngrams"), "block_id", "ngrams", BLOCKS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pages whose title or text looks the same but is not the same string."""
    found = lookalike.alike_pairs(table(spark, folder, "wiki_pages", "page_id", "title", "text"), "page_id", ["title", "text"])
    return found.select(F.col("field").alias("page_field"), F.col("id1").alias("page_id1"), F.col("id2").alias("page_id2"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Title and text of every page: class of equal strings, and group of those that look the same."""
    grouped = lookalike.membership(table(spark, folder, "wiki_pages", "page_id", "title", "text"), "page_id", ["title", "text"])
    return grouped.withColumnRenamed("field", "page_field")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Title and text of every page in their consistent form."""
    pages = table(spark, folder, "wiki_pages", "page_id", "title", "text").distinct()
    return pages.select("page_id", lookalike.consistent("title").alias("title"), lookalike.consistent("text").alias("text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every matched block with the smallest block_id of its group."""
    return components.groups(table(spark, folder, "same_blocks"), "block_id1", "block_id2", node="block_id")


def p2_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Texts put together again from their pieces without the overlaps, and whether every piece is within the limit."""
    pieces = p2_pieces(spark, folder)
    own = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substring("text", F.col("overlap_size") + 1, F.length("text")))
    ordered = F.array_sort(F.collect_list(F.struct("piece", own.alias("own"))))
    # A file name may stand for several texts; its pieces tell them apart by the place of the last end.
    whole = pieces.groupBy("item_table", "file_name", "text_digest").agg(F.array_join(F.transform(ordered, lambda p: p["own"]), "").alias("text"), F.every(F.length("text") <= F.col("max_size")).alias("within"))
    return whole.select("item_table", "file_name", "text", "within")


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the ids of all documents stand for."""
    return p6_ids(spark, folder).select("doc_id", tokens.token_text("ids").alias("text"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "ids")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds a container."""
    limit = split.limits(table(spark, folder, "size_limits"), "pack")["documents"]
    return pack.pack(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", pack.Settings(limit.max_size))


def p7_places(spark: SparkSession, folder: str) -> DataFrame:
    """For each document: whether its pieces follow each other without a gap, and lie in containers that are not overfull."""
    limit = split.limits(table(spark, folder, "size_limits"), "pack")["documents"]
    placed = staged(p7_containers(spark, folder))
    fits = pack.fills(placed, limit.max_size).select("container_id", (F.col("tokens") <= limit.max_size).alias("fits"))
    document = placed.join(fits, "container_id").groupBy("doc_id")
    last = F.max("piece")
    return document.agg(((F.count("*") == last + 1) & (F.sum("start") == last * (last + 1) / 2 * limit.max_size)).alias("whole"), F.every("fits").alias("fits"))


def p7_fills(spark: SparkSession, folder: str) -> DataFrame:
    """How full every container is."""
    limit = split.limits(table(spark, folder, "size_limits"), "pack")["documents"]
    return pack.fills(p7_containers(spark, folder), limit.max_size)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    rows = truncation.cut_rows(table(spark, folder, "documents", "doc_id", "text", "source"))
    return rows.where("is_cut").select("doc_id").distinct()


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, the share of its documents that are cut."""
    return truncation.shares(table(spark, folder, "documents", "doc_id", "text", "source"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_ranks, p1_statistics, p2_found, p2_joined, p2_pieces, p3_found, p3_groups, p4_found, p4_forms, p4_groups, p5_found, p6_ids, p6_texts, p7_containers, p7_fills, p7_places, p8_found, p8_sources)}

def _folded(column: str) -> str:
    """SQL for the consistent form, as far as the characters of the test tables go: one translation, then composition."""
    single = [c for c in (*range(0xFF01, 0xFFE7), *range(0x2F00, 0x2FD6)) if len(unicodedata.normalize("NFKC", chr(c))) == 1]
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in single}
    plain |= dict.fromkeys("\u00a0\u2007\u202f\u3000", " ") | dict(zip(*lookalike.CYRILLIC)) | dict(zip(*lookalike.GREEK))
    plain |= dict.fromkeys(lookalike.DOTS, "\u00b7") | dict.fromkeys(lookalike.HYPHENS, "-") | {"\uff9e": "\u3099"}
    shown = f"regexp_replace({column}, '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')"
    left, right = ("".join(x).replace("'", "''") for x in (plain.keys(), plain.values()))
    return f"nfc_normalize(translate({shown}, '{left}', '{right}'))"


_FORMS = f"""
    pages AS MATERIALIZED (
        SELECT DISTINCT page_id, unnest(['title', 'text']) AS page_field, unnest([title, text]) AS value FROM wiki_pages
    ), forms AS MATERIALIZED (SELECT *, {_folded('value')} AS form FROM pages WHERE value IS NOT NULL)
"""

#: Blocks as sets, every pair that shares an n-gram, and the pairs that are similar enough.
_SIMILAR_BLOCKS = """
    items AS MATERIALIZED (SELECT DISTINCT block_id, unnest(ngrams) AS g FROM blocks),
    sizes AS MATERIALIZED (SELECT block_id, count(*) AS n FROM items GROUP BY block_id),
    shared AS MATERIALIZED (
        SELECT x.block_id AS a, y.block_id AS b, count(*) AS k
        FROM items x JOIN items y ON x.g = y.g AND x.block_id < y.block_id GROUP BY ALL
    ),
    similar_blocks AS MATERIALIZED (
        SELECT a, b FROM shared JOIN sizes p ON p.block_id = a JOIN sizes q ON q.block_id = b
        WHERE k >= 0.7 * (p.n + q.n - k)
    )
"""

_WALLS = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + split.MARKS + "]"

ORACLES: dict[str, str] = {
    "p1_ranks": """
        WITH held AS (SELECT doc_id, coalesce(lang, 'und') AS grp, length(text) AS n, length(text) - length(replace(text, chr(10), '')) AS k FROM documents WHERE text IS NOT NULL),
        long AS (SELECT doc_id, grp, 'characters' AS stat, n::DOUBLE AS value FROM held UNION ALL SELECT doc_id, grp, 'line_breaks', k::DOUBLE FROM held),
        counted AS (
            SELECT *, count(*) OVER (PARTITION BY grp, stat ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank,
                   count(*) OVER (PARTITION BY grp, stat ORDER BY value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
                   count(*) OVER (PARTITION BY grp, stat) AS total FROM long
        ) SELECT doc_id, grp, stat, value, rank, total, rank / total AS low, above / total AS high FROM counted
    """,
    "p2_found": f"""
        WITH items AS (
            SELECT 'corpus_files' AS item_table, file_name, text FROM corpus_files
            UNION SELECT 'tokenizer_files', file_name, text FROM tokenizer_files
        )
        SELECT DISTINCT item_table, file_name FROM items JOIN size_limits USING (item_table)
        WHERE purpose = 'split' AND list_max(list_transform(regexp_split_to_array(text, '{_WALLS}'), lambda x: length(x))) > max_size
    """,
    "p2_joined": """
        SELECT 'corpus_files' AS item_table, file_name, text, true AS within FROM corpus_files WHERE text <> ''
        UNION SELECT 'tokenizer_files', file_name, text, true FROM tokenizer_files WHERE text <> ''
    """,
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_places": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p4_found": f"""WITH {_FORMS}
        SELECT DISTINCT x.page_field, x.page_id AS page_id1, y.page_id AS page_id2
        FROM forms x JOIN forms y ON x.page_field = y.page_field AND x.form = y.form AND x.value <> y.value AND x.page_id < y.page_id
    """,
    "p4_groups": f"""WITH {_FORMS}, kept AS (SELECT DISTINCT page_id, page_field, value, form FROM forms)
        SELECT page_field, page_id, min(page_id) OVER (PARTITION BY page_field, value) AS class_id, count(*) OVER (PARTITION BY page_field, value) AS copies,
               min(page_id) OVER (PARTITION BY page_field, form) AS group_id, len(list_distinct(list(value) OVER (PARTITION BY page_field, form))) AS spellings
        FROM kept
    """,
    "p4_forms": f"""WITH pages AS (SELECT DISTINCT page_id, title, text FROM wiki_pages)
        SELECT page_id, {_folded('title')} AS title, {_folded('text')} AS text FROM pages
    """,
    "p3_groups": f"""WITH RECURSIVE {_SIMILAR_BLOCKS},
        both_ways AS MATERIALIZED (SELECT a, b FROM similar_blocks UNION SELECT b, a FROM similar_blocks),
        reach(block_id, seen) AS (SELECT block_id, block_id FROM sizes UNION SELECT r.block_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
        grouped AS (SELECT block_id, min(seen) AS group_id FROM reach GROUP BY block_id),
        sets AS (SELECT block_id, list_sort(list(g)) AS s FROM items GROUP BY block_id)
        SELECT block_id, min(block_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies, group_id
        FROM sets JOIN grouped USING (block_id)
    """,
    "p3_found": f"WITH {_SIMILAR_BLOCKS} SELECT a AS block_id1, b AS block_id2 FROM similar_blocks",
    "p5_found": """
        WITH RECURSIVE links AS (
            SELECT DISTINCT block_id1 AS a, block_id2 AS b FROM same_blocks
            WHERE block_id1 IS NOT NULL AND block_id2 IS NOT NULL AND block_id1 <> block_id2
        ), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(block_id, seen) AS (
            SELECT a, a FROM both_ways
            UNION
            SELECT r.block_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
        )
        SELECT block_id, min(seen) AS group_id FROM reach GROUP BY block_id
    """,
}
