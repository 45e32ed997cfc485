"""Queries by name, and the SQL that checks them.

Exact duplicate rows of a table count once, so tables are read through ``rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hashing, html, render, wikitext
from quernstone.functions import text as T
from quernstone.functions.rules import SECTIONS_DROPPED, matches
from quernstone.functions.script import simplification
from quernstone.operators import blocks as B
from quernstone.operators import dedup, messages, minhash, pages, tokenize
from quernstone.plans import pipeline
from quernstone.sources import sinks, streams
from quernstone.sources.tables import table
from quernstone.streaming import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return table(spark, folder, name, *columns).distinct()


# Blocks and shingles.

_FILES = "files AS MATERIALIZED (SELECT DISTINCT file_name, text FROM corpus_files WHERE text IS NOT NULL)"
_CHAPTERS = rf"""{_FILES}, cut AS MATERIALIZED (
    SELECT file_name, string_split(regexp_replace(text, '(##+)', chr(1) || chr(2) || '\1', 'g'), chr(1) || chr(2)) AS parts FROM files
), chapters AS MATERIALIZED (
    SELECT file_name, unnest(range(len(parts))) AS seq, unnest(parts) AS text FROM cut
)"""
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_GRAMS = rf"regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9{_SPACE}]')"


def _sql_shingles(grams: str, k: int) -> str:
    return f"list_transform(range(1, len({grams}) - {k} + 2), lambda i: array_to_string({grams}[i:i + {k} - 1], ' '))"


@query(f"WITH {_CHAPTERS} SELECT file_name, seq::INTEGER AS seq, file_name || '_' || seq AS block_id, text FROM chapters")
def chapter_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter blocks of every file."""
    return B.explode_blocks(rows(spark, folder, "corpus_files", "file_name", "text"))


@query("""
    WITH files AS (SELECT DISTINCT file_name, text FROM tokenizer_files WHERE text IS NOT NULL),
    cut AS (SELECT file_name, text, unnest(range(greatest(1, ceil(length(text) / 1000.0)::INTEGER))) AS seq FROM files)
    SELECT file_name, seq::INTEGER AS seq, file_name || '_' || seq AS block_id, substring(text, seq::INTEGER * 1000 + 1, 1000) AS text FROM cut
""")
def length_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of 1000 characters of every file."""
    return B.explode_blocks(rows(spark, folder, "tokenizer_files", "file_name", "text"), blocker="length", size=1000)


@query(f"""
    WITH counted AS (SELECT doc_id, text, {_GRAMS} AS grams FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(grams)::INTEGER AS grams, greatest(0, len(grams) - 2)::INTEGER AS shingles,
           CASE WHEN regexp_matches(text, '[A-Za-z0-9]$') THEN len(grams) - 1 ELSE len(grams) END::INTEGER AS flushed_grams
    FROM counted
""")
def doc_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Grams and shingles of every document, and its grams without a run at the very end."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    grams = F.size(T.grams("text"))
    return docs.select("doc_id", grams.alias("grams"), F.greatest(F.lit(0), grams - 2).alias("shingles"), F.size(T.grams("text", keep_trailing=False)).alias("flushed_grams"))


@query(f"""
    WITH {_CHAPTERS}, g AS MATERIALIZED (SELECT file_name || '_' || seq AS block_id, {_GRAMS} AS grams FROM chapters)
    SELECT block_id, {_sql_shingles('grams', 3)} AS ngrams FROM g
""")
def block_shingles(spark: SparkSession, folder: str) -> DataFrame:
    """Three-gram shingles of every chapter block."""
    return B.with_shingles(B.explode_blocks(rows(spark, folder, "corpus_files", "file_name", "text"))).select("block_id", "ngrams")


@query(r"SELECT DISTINCT block_id, regexp_extract(block_id, '(?s)^(.*)_(\d+)$', 1) AS file_name, regexp_extract(block_id, '(?s)^(.*)_(\d+)$', 2)::INTEGER AS seq FROM blocks")
def block_id_parts(spark: SparkSession, folder: str) -> DataFrame:
    """File name and number of every block id."""
    return B.split_block_id(rows(spark, folder, "blocks", "block_id"))


# Near-duplicates.

#: The published settings, and those of the stages that make training data.
LSH = minhash.LshConfig()
STAGE = dedup.STAGE


def _chain(config: minhash.LshConfig, held: str) -> dict[str, str]:
    """The steps of near-duplicate matching as SQL, each with those before it; ``held`` gives block_id, text, ngrams."""
    minima = ", ".join(f"min((h * {a} + {b}) % {hashing.PRIME})" for a, b in hashing.coefficients(config.hashes))
    slices = ", ".join(f"signature[{i * config.rows + 1}:{(i + 1) * config.rows}]" for i in range(config.bands))
    steps = {
        "representatives": f"""
    held AS MATERIALIZED ({held}),
    classes AS MATERIALIZED (SELECT block_id, min(block_id) OVER (PARTITION BY text) AS class_id, ngrams FROM held),
    shingled AS MATERIALIZED (SELECT block_id, ngrams FROM classes WHERE block_id = class_id AND len(ngrams) > 0)""",
        "signed": f"""
    hashed AS MATERIALIZED (SELECT block_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (SELECT block_id, unnest(ngrams) AS g FROM shingled)),
    signed AS MATERIALIZED (SELECT block_id, [{minima}] AS signature FROM hashed GROUP BY block_id)""",
        "banded": f"""
    banded AS MATERIALIZED (SELECT block_id, unnest(range({config.bands}))::INTEGER AS band, unnest([{slices}]) AS key FROM signed)""",
        "candidates": """
    candidates AS MATERIALIZED (
        SELECT DISTINCT x.block_id AS block_id1, y.block_id AS block_id2
        FROM banded x JOIN banded y ON x.band = y.band AND x.key = y.key AND x.block_id < y.block_id
    )""",
        "verified": f"""
    sets AS MATERIALIZED (SELECT block_id, list_distinct(ngrams) AS s FROM shingled),
    measured AS MATERIALIZED (
        SELECT block_id1, block_id2, len(list_intersect(p.s, q.s)) AS k, len(p.s) + len(q.s) AS n
        FROM candidates JOIN sets p ON p.block_id = block_id1 JOIN sets q ON q.block_id = block_id2
    ),
    verified AS MATERIALIZED (SELECT block_id1, block_id2, 1 - k / (n - k) AS distance FROM measured WHERE 1 - k / (n - k) <= {config.max_distance!r})""",
        "components": """
    links AS MATERIALIZED (
        SELECT block_id1 AS a, block_id2 AS b FROM verified
        UNION SELECT block_id, class_id FROM classes WHERE block_id <> class_id AND len(ngrams) > 0
    ),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(block_id, seen) AS (
        SELECT block_id, block_id FROM held UNION SELECT r.block_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
    ),
    components AS MATERIALIZED (SELECT block_id, min(seen) AS component FROM reach GROUP BY block_id)""",
    }
    so_far, chain = [], {}
    for name, sql in steps.items():
        so_far.append(sql)
        chain[name] = ",".join(so_far)
    return chain


_PUBLISHED = _chain(LSH, "SELECT DISTINCT block_id, text, ngrams FROM blocks")
_REPRESENTATIVES, _SIGNED, _BANDED, _CANDIDATES, _VERIFIED, _COMPONENTS = (_PUBLISHED[n] for n in ("representatives", "signed", "banded", "candidates", "verified", "components"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks", "block_id", "text")


def _shingled(spark: SparkSession, folder: str) -> DataFrame:
    """One row a distinct text that has shingles."""
    held = minhash.representatives(table(spark, folder, "blocks", "block_id", "text", "ngrams"), ["ngrams"])
    return held.where(F.size("ngrams") > 0)


def _banded(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.bands(minhash.signatures(_shingled(spark, folder), LSH), LSH)


@query(f"WITH {_SIGNED} SELECT * FROM signed")
def minhash_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Signature of every distinct block text."""
    return minhash.signatures(_shingled(spark, folder), LSH)


def _murmur_sql(seed: int = 1) -> str:
    """MurmurHash3 of every shingle by integer arithmetic: bytes as hexadecimal digits, four at a time, the last ones first."""
    low = "4294967295::UBIGINT"

    def turned(x: str, bits: int) -> str:
        return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & {low})"

    def scrambled(k: str) -> str:
        return f"({turned(f'({k}) * 3432918353::UBIGINT & {low}', 15)} * 461845907::UBIGINT & {low})"

    word = "('0x' || array_to_string(list_reverse(list_transform(range(len(w) // 2), lambda j: w[2 * j + 1:2 * j + 2])), ''))::UBIGINT"
    step = f"({turned('xor(h, k)', 13)} * 5 + 3864292196::UBIGINT) & {low}"
    return f"""
    bytes AS MATERIALIZED (SELECT block_id, hex(encode(g)) AS x FROM (SELECT DISTINCT block_id, unnest(ngrams) AS g FROM shingled)),
    cut AS MATERIALIZED (SELECT block_id, x, list_transform(range((len(x) + 7) // 8), lambda i: x[8 * i + 1:8 * i + 8]) AS ws FROM bytes),
    words AS MATERIALIZED (SELECT block_id, x, list_transform(ws, lambda w: {word}) AS ks FROM cut),
    scrambled AS MATERIALIZED (SELECT block_id, len(x) // 2 AS size, list_transform(ks, lambda k: {scrambled('k')}) AS ks FROM words),
    body AS MATERIALIZED (
        SELECT block_id, size, list_reduce(ks[:size // 4], lambda h, k: {step}, {seed}::UBIGINT) AS h, CASE WHEN size % 4 > 0 THEN ks[-1] ELSE 0::UBIGINT END AS rest FROM scrambled
    ),
    mixed1 AS MATERIALIZED (SELECT block_id, xor(xor(h, rest), size::UBIGINT) AS h FROM body),
    mixed2 AS MATERIALIZED (SELECT block_id, xor(h, h >> 16) * 2246822507::UBIGINT & {low} AS h FROM mixed1),
    mixed3 AS MATERIALIZED (SELECT block_id, xor(h, h >> 13) * 3266489909::UBIGINT & {low} AS h FROM mixed2),
    hashed AS MATERIALIZED (SELECT block_id, xor(h, h >> 16)::BIGINT AS u FROM mixed3),
    signed_hash AS MATERIALIZED (SELECT block_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM hashed)"""


_SHIFTED = ", ".join(f"min((h + {b}) % {hashing.PRIME})" for b in hashing.shift_increments(4, 1))


@query(f"WITH {_REPRESENTATIVES}, {_murmur_sql()} SELECT block_id, [{_SHIFTED}] AS signature FROM signed_hash GROUP BY block_id")
def murmur_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures of the shift family."""
    return _shingled(spark, folder).select("block_id", hashing.murmur3_signature("ngrams").alias("signature"))


@query(f"WITH {_BANDED} SELECT * FROM banded")
def lsh_bands(spark: SparkSession, folder: str) -> DataFrame:
    return _banded(spark, folder)


@query(f"WITH {_BANDED} SELECT band, key, count(*) AS blocks, min(block_id) AS first_block, max(block_id) AS last_block FROM banded GROUP BY band, key HAVING count(*) > 1")
def band_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.buckets(_banded(spark, folder))


@query(f"WITH {_CANDIDATES} SELECT * FROM candidates")
def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.candidates(_banded(spark, folder))


@query(f"WITH {_VERIFIED} SELECT block_id1, block_id2, round(distance, 9) AS distance FROM verified")
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct texts within the largest distance (``block_classes`` says which blocks a text stands for)."""
    return minhash.near_pairs(_shingled(spark, folder), LSH).withColumn("distance", F.round("distance", 9))


@query(f"""
    WITH {_CANDIDATES}, sizes AS (SELECT block_id, len(list_distinct(ngrams)) AS n FROM shingled)
    SELECT block_id1, block_id2, round(1 - p.n / q.n, 9) AS distance
    FROM candidates JOIN sizes p ON p.block_id = block_id1 JOIN sizes q ON q.block_id = block_id2 WHERE 1 - p.n / q.n <= {LSH.max_distance}
""")
def size_ratio_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by the size ratio, for comparison with results made elsewhere."""
    pairs = minhash.by_size_ratio(minhash.candidates(_banded(spark, folder)), _shingled(spark, folder), LSH)
    return pairs.withColumn("distance", F.round("distance", 9))


@query(f"WITH {_REPRESENTATIVES} SELECT block_id, class_id FROM classes")
def block_classes(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.exact_classes(_blocks(spark, folder))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM components")
def dup_components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every block."""
    return dedup.block_components(_blocks(spark, folder), LSH)


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT block_id, text FROM held JOIN components USING (block_id) WHERE block_id = component")
def dedup_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.survivors(_blocks(spark, folder).distinct(), LSH)


@query(rf"""
    WITH RECURSIVE {_COMPONENTS}, kept AS (
        SELECT regexp_extract(block_id, '(?s)^(.*)_(\d+)$', 1) AS file_name, regexp_extract(block_id, '(?s)^(.*)_(\d+)$', 2)::INTEGER AS seq, text
        FROM held JOIN components USING (block_id) WHERE block_id = component
    ) SELECT file_name, string_agg(text, chr(10) ORDER BY seq) AS text FROM kept GROUP BY file_name
""")
def dedup_blocks_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving blocks of the block table, put together by file."""
    return dedup.assembled(B.split_block_id(dedup.survivors(_blocks(spark, folder).distinct(), LSH)))


_STAGE_BLOCKS = f"""{_CHAPTERS}, grammed AS MATERIALIZED (SELECT file_name || '_' || seq AS block_id, text, {_GRAMS} AS grams FROM chapters),
    {_chain(STAGE, f"SELECT block_id, text, {_sql_shingles('grams', STAGE.k)} AS ngrams FROM grammed")['components']}"""


@query(f"""
    WITH RECURSIVE {_STAGE_BLOCKS}
    SELECT file_name, string_agg(c.text, chr(10) ORDER BY seq) AS text
    FROM chapters c JOIN components k ON k.block_id = file_name || '_' || seq AND k.component = k.block_id GROUP BY file_name
""")
def dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files without their near-duplicate chapters."""
    return dedup.deduplicated(table(spark, folder, "corpus_files", "file_name", "text"))


@query("""
    WITH files AS (SELECT DISTINCT file_name, text FROM corpus_files)
    SELECT min(file_name) AS file_name, count(*) AS copies, text FROM files GROUP BY text
""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_deduplicated(table(spark, folder, "corpus_files"))


# Pages.

_KEPT = "title IS NOT NULL AND NOT contains(title, ':') AND text IS NOT NULL AND NOT regexp_matches(lower(text), '#redirect|#重定向')"
_FILE_NAME = r"""regexp_replace(title, '[<>:"/?*|\\]', '_', 'g') || '.txt'"""
_PAGES = "pages AS MATERIALIZED (SELECT DISTINCT page_id, title, text FROM wiki_pages)"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder, "wiki_pages", "page_id", "title", "text")


@query(f"WITH {_PAGES} SELECT page_id, title FROM pages WHERE {_KEPT}")
def page_ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are articles."""
    return pages.articles(_pages(spark, folder)).select("page_id", "title")


@query(f"""
    WITH {_PAGES}, judged AS (
        SELECT CASE WHEN title IS NULL THEN 'no title' WHEN contains(title, ':') THEN 'other namespace' WHEN text IS NULL THEN 'no text'
               WHEN regexp_matches(lower(text), '#redirect|#重定向') THEN 'redirect' END AS reason FROM pages
    ) SELECT reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY reason
""")
def page_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages are ignored, and why."""
    return sinks.rejected(_pages(spark, folder), pages.ignored_reason())


@query(f"WITH {_PAGES} SELECT page_id FROM pages WHERE regexp_matches(lower(text), '#redirect|#重定向')")
def redirect_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).where(T.is_redirect("text")).select("page_id")


@query(f"WITH {_PAGES} SELECT page_id, title FROM pages WHERE {_KEPT} AND {_FILE_NAME} NOT IN (SELECT file_name FROM corpus_files)")
def pages_to_do(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that the cleaned corpus does not hold yet."""
    done = rows(spark, folder, "corpus_files", "file_name")
    return pages.articles(_pages(spark, folder), done).select("page_id", "title")


@query(rf"""
    SELECT DISTINCT title, {_FILE_NAME} AS file_name, regexp_replace(title, '[<>:"/?*]|\|\|', '_', 'g') || '.txt' AS plain_name
    FROM documents WHERE title IS NOT NULL
""")
def title_to_filename(spark: SparkSession, folder: str) -> DataFrame:
    """File names of all titles, by the full and by the plain rule."""
    titles = rows(spark, folder, "documents", "title").where("title is not null")
    return titles.select("title", T.file_name("title").alias("file_name"), T.file_name("title", pipes_in_pairs=True).alias("plain_name"))


_VIEWS = "views AS MATERIALIZED (SELECT title, sum(coalesce(view_count, 0))::BIGINT AS views FROM (SELECT DISTINCT * FROM page_views) WHERE title IS NOT NULL GROUP BY title)"


@query(f"WITH {_VIEWS} SELECT * FROM views")
def pageview_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Views of every title; repeated deliveries count once."""
    return pages.view_totals(table(spark, folder, "page_views"))


@query(f"WITH {_PAGES}, {_VIEWS} SELECT page_id, title FROM pages SEMI JOIN (SELECT title FROM views WHERE views >= 100) v USING (title) WHERE length(regexp_replace(text, '\\s', '', 'g')) >= 300")
def quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are read and long enough (thresholds of the test tables' size)."""
    return pages.popular(_pages(spark, folder), pages.view_totals(table(spark, folder, "page_views")), 100, 300).select("page_id", "title")


@query(rf"""
    WITH {_PAGES} SELECT page_id, regexp_replace(text, '(?s:<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<references\b[^<>]*/?>)', '', 'g') AS text,
    regexp_replace(text, '<!--.*?-->|(?s:<ref.*?>.*?</ref>)|(?s:<ref.*?/>)', '', 'g') AS plain_text FROM pages
""")
def strip_refs_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Wikitext without comments and references, by both rules."""
    held = _pages(spark, folder)
    return held.select("page_id", T.without_refs_and_comments("text").alias("text"), T.without_refs_and_comments("text", single_line_comments=True).alias("plain_text"))


@query()
def template_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Wikitext without dropped templates and links."""
    return _pages(spark, folder).select("page_id", wikitext.without_templates_column("text").alias("text"))


@query()
def wikitext_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean wikitext of every article."""
    return pages.cleaned(pages.articles(_pages(spark, folder)))


#: The rules for section titles, written out for both scripts.
_DROPPED_TITLES = "[參参][見见]|[參参]考|[參参][閱阅]|[鏈链]接|[連连]接|[連连][結结]|引用|[註注][釋释]", "[參参]看|另[見见]|[擴扩]展[閱阅][讀读]|延伸[閱阅][讀读]"


@query(rf"""
    WITH {_PAGES}, heads AS (SELECT page_id, unnest(regexp_extract_all(text, '{wikitext.HEADING_LINE}', 2)) AS title FROM pages),
    plain AS (SELECT page_id, title, regexp_replace(title, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM heads)
    SELECT page_id, title, regexp_matches(t, '{_DROPPED_TITLES[0]}') OR regexp_full_match(t, '{_DROPPED_TITLES[1]}') AS dropped FROM plain
""")
def section_title_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Section titles of every page, and whether the rules drop the section."""
    heads = _pages(spark, folder).select("page_id", F.explode(F.regexp_extract_all("text", F.lit(wikitext.HEADING_LINE), F.lit(2))).alias("title"))
    return heads.withColumn("dropped", matches(T.simplified(T.stripped("title")), SECTIONS_DROPPED))


@query()
def simplified_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in simplified characters."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.simplified("text", simplification(spark)).alias("text"))


#: Words in both scripts, typed by hand, to check the conversion.
WORDS = (
    ("歷史", "历史"), ("國家", "国家"), ("學校", "学校"), ("時間", "时间"), ("語言", "语言"), ("經濟", "经济"), ("後來", "后来"), ("這裡", "这里"), ("開始", "开始"), ("發現", "发现"),
    ("當時", "当时"), ("居民", "居民"), ("傳統", "传统"), ("建築", "建筑"), ("臺灣", "台湾"), ("電腦", "电脑"), ("軟體", "软体"), ("鐵路", "铁路"), ("機構", "机构"), ("記載", "记载"),
    ("倉庫", "仓库"), ("戰爭", "战争"), ("書籍", "书籍"), ("圖書館", "图书馆"), ("醫院", "医院"), ("參見", "参见"), ("產業", "产业"), ("變化", "变化"), ("村莊", "村庄"), ("廣場", "广场"),
)


def _either(old: str, new: str) -> str:
    """A pattern of the word in either script, or in both mixed."""
    return "".join(a if a == b else f"[{a}{b}]" for a, b in zip(old, new))


@query(" UNION ALL ".join(f"SELECT doc_id, '{b}' AS word, len(regexp_extract_all(text, '{_either(a, b)}')) AS found FROM documents WHERE regexp_matches(text, '{_either(a, b)}')" for a, b in WORDS))
def simplified_words(spark: SparkSession, folder: str) -> DataFrame:
    """How often well-known words stand in the documents once they are in simplified characters, whatever they were written in."""
    found = F.array(*[F.struct(F.lit(new).alias("word"), F.expr(f"(length(text) - length(replace(text, '{new}', ''))) div {len(new)}").alias("found")) for _, new in WORDS])
    return simplified_text(spark, folder).select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.*").where("found > 0")


# HTML and Markdown.


@query()
def html_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown of every document read as HTML."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", html.markdown_column("text").alias("text"))


@query()
def rendered_html(spark: SparkSession, folder: str) -> DataFrame:
    """Articles rendered by the local subset renderer."""
    return pages.cleaned(pages.articles(_pages(spark, folder))).select("title", render.html_column("text").alias("html"))


@query(rf"""
    WITH {_FILES}, ended AS (SELECT file_name, regexp_replace(text, '\n+$', '') || chr(10) AS text FROM files),
    led AS (SELECT file_name, regexp_replace(text, '^(?:[^\S\n]*\n)+', '') AS text FROM ended),
    runs AS (SELECT file_name, regexp_replace(text, '\n(?:[^\S\n]*\n){{2,}}', chr(10) || chr(10), 'g') AS text FROM led)
    SELECT file_name, regexp_replace(text, '\n[^\S\n]+\n', chr(10) || chr(10), 'g') AS text FROM runs
""")
def markdown_squeeze(spark: SparkSession, folder: str) -> DataFrame:
    """Files without superfluous blank lines."""
    files = rows(spark, folder, "corpus_files", "file_name", "text").where("text is not null")
    return files.select("file_name", T.squeezed("text").alias("text"))


@query(rf"""
    WITH {_FILES}, cut AS (SELECT file_name, string_split(regexp_replace(text, '(?m)(^##+ [^\n]*(?:\n|\z))', chr(1) || chr(2) || '\1', 'g'), chr(1) || chr(2)) AS parts FROM files)
    SELECT file_name, array_to_string(list_filter(parts, lambda p: length(regexp_replace(p, '(?m)^##+ [^\n]*(?:\n|\z)|\s', '', 'g')) > 0), '') AS text FROM cut
""")
def empty_chapters_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Files without headings that no text follows."""
    files = rows(spark, folder, "corpus_files", "file_name", "text").where("text is not null")
    return files.select("file_name", T.without_empty_chapters("text").alias("text"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS text FROM documents")
def xml_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.xml_escaped("text").alias("text"))


@query("""
    WITH titles AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)
    SELECT title, 'action=parse&text=' || replace(replace(replace(url_encode(title), '%20', '+'), '~', '%7E'), '%2A', '*') AS form FROM titles
""")
def request_forms(spark: SparkSession, folder: str) -> DataFrame:
    """URL-encoded request bodies."""
    titles = rows(spark, folder, "documents", "title").where("title is not null")
    return titles.select("title", T.form_encoded({"action": F.lit("parse"), "text": F.col("title")}).alias("form"))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS html FROM documents")
def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    """HTML out of parse responses (made of the documents)."""
    body = F.to_json(F.struct(F.struct(F.struct(F.col("text").alias("*")).alias("text")).alias("parse")))
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", messages.parsed_page(body)["html"].alias("html"))


# Messages and events.


@query("SELECT event_id, 2 * coalesce(json_extract(props, '$.k')::BIGINT, 0) AS views FROM events")
def response_views(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of views of responses (made of the events' properties)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    item = F.struct(k.alias("views"))
    body = F.to_json(F.struct(F.array(item, item).alias("items")))
    return table(spark, folder, "events", "event_id", "props").select("event_id", messages.response_views(body).alias("views"))


@query(f"""
    WITH {_PAGES}, sized AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE {_KEPT}) AS articles)
    SELECT 'pages' AS topic, pages AS size, 0::BIGINT AS lag FROM sized UNION ALL SELECT 'wikitext', articles, 0 FROM sized
    UNION ALL SELECT 'html', articles, 0 FROM sized UNION ALL SELECT 'markdown', articles, articles FROM sized
""")
def topic_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every topic of a run of the chain, and how much of it its reader has not taken in yet (nobody reads the last one)."""
    topics, counts = stages.traced_chain(spark, rows(spark, folder, "wiki_pages", "page_id", "title", "text"))
    return messages.topic_sizes(streams.folder_offsets(spark, topics, counts))


@query(r"""
    WITH turns AS (
        SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN 'system' WHEN 2 THEN 'user' WHEN 3 THEN 'assistant' ELSE 'tool' END AS role,
               l_returnflag || l_linestatus AS text FROM lineitem
    )
    SELECT l_orderkey, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY l_linenumber, role, text) FILTER (role <> 'tool'), '') || '<|endoftext|>' AS text
    FROM turns GROUP BY l_orderkey
""")
def chat_render(spark: SparkSession, folder: str) -> DataFrame:
    """Chats in their text format (orders as conversations, lines as turns)."""
    held = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    role = F.element_at(F.array(F.lit("tool"), F.lit("system"), F.lit("user"), F.lit("assistant")), F.col("l_linenumber") % 4 + 1)
    turns = held.select("l_orderkey", F.col("l_linenumber").alias("turn"), role.alias("role"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return messages.chats(turns, "l_orderkey")


# Tokens and whole pipelines.


def _tokenizer() -> tokenize.TokenizerConfig:
    return tokenize.TokenizerConfig(tokenize.public_model())


@query()
def tokenize_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every chapter block of the tokenizer's input."""
    return tokenize.tokenized_blocks(rows(spark, folder, "tokenizer_files", "file_name", "text"), _tokenizer())


@query()
def chat_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of chats, their markers as ids of their own."""
    config = tokenize.TokenizerConfig(tokenize.public_model(), markers=tokenize.CHAT_MARKERS)
    return chat_render(spark, folder).select("l_orderkey", tokenize.token_column("text", config).alias("tokens"))


@query()
def token_json(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that the token sink writes."""
    line = F.to_json(F.struct(F.col("block_id").alias("blockId"), "tokens"))
    return tokenize_blocks(spark, folder).select(line.alias("line"))


@query()
def wiki_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to Markdown files, as one batch plan."""
    return pipeline.corpus(_pages(spark, folder).select("title", "text"))


@query()
def streamed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to Markdown files, as a chain of streaming stages."""
    return stages.streamed_corpus(spark, rows(spark, folder, "wiki_pages", "page_id", "title", "text"))


@query(f"""
    WITH {_PAGES}, named AS (SELECT {_FILE_NAME} AS file_name FROM pages WHERE {_KEPT})
    SELECT file_name, count(*) AS batch, count(*) AS streamed, true AS alike FROM named GROUP BY file_name
""")
def corpus_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """For each file of the corpus, how often the batch plan and the stages give it, and whether with the same texts."""
    sides = [f(spark, folder).select("file_name", F.xxhash64("text").alias("h"), F.lit(n).alias("batch"), F.lit(1 - n).alias("streamed")) for f, n in ((wiki_corpus, 1), (streamed_corpus, 0))]
    texts = sides[0].unionAll(sides[1]).groupBy("file_name", "h").agg(F.sum("batch").alias("batch"), F.sum("streamed").alias("streamed"))
    return texts.groupBy("file_name").agg(F.sum("batch").alias("batch"), F.sum("streamed").alias("streamed"), F.every(F.col("batch") == F.col("streamed")).alias("alike"))


@query("""
    WITH files AS (SELECT DISTINCT file_name, text FROM tokenizer_files WHERE text IS NOT NULL),
    cut AS (SELECT file_name, string_split(regexp_replace(text, '(##+)', chr(1) || chr(2) || '\\1', 'g'), chr(1) || chr(2)) AS parts FROM files)
    SELECT file_name || '_' || unnest(range(len(parts))) AS block_id, unnest(parts) AS text FROM cut
""")
def tokenize_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the token ids of ``tokenize_blocks`` stand for."""
    return tokenize_blocks(spark, folder).select("block_id", tokenize.text_column("tokens", _tokenizer()).alias("text"))


@query(f"""
    WITH RECURSIVE {_STAGE_BLOCKS}, files_left AS (
        SELECT file_name, string_agg(c.text, chr(10) ORDER BY seq) AS text
        FROM chapters c JOIN components k ON k.block_id = file_name || '_' || seq AND k.component = k.block_id GROUP BY file_name
    ), cut_again AS (SELECT file_name, string_split(regexp_replace(text, '(##+)', chr(1) || chr(2) || '\\1', 'g'), chr(1) || chr(2)) AS parts FROM files_left)
    SELECT file_name || '_' || unnest(range(len(parts))) AS block_id, unnest(parts) AS text FROM cut_again
""")
def training_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the token ids of ``training_tokens`` stand for."""
    return training_tokens(spark, folder).select("block_id", tokenize.text_column("tokens", _tokenizer()).alias("text"))


@query()
def training_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of the corpus without near-duplicate chapters."""
    return pipeline.training_tokens(table(spark, folder, "corpus_files", "file_name", "text"), _tokenizer())
