import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernstone.operators import blocks, dedup, messages, minhash, pages, tokenize
from quernstone.operators.components import connected_components
from quernstone.plans import pipeline
from quernstone.plans.lineage import stage
from quernstone.streaming import stages


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    nodes = [f"n{i:03d}" for i in range(60)]
    rng = random.Random(shape)
    shuffled = rng.sample(nodes, 50)
    edges = {"chain": list(zip(shuffled, shuffled[1:])), "star": [("n059", n) for n in nodes[:40]], "random": [tuple(rng.sample(nodes, 2)) for _ in range(40)], "none": []}[shape]
    given = spark.createDataFrame([*edges, *edges[:3], ("n001", "n001"), ("n002", None)], "a string, b string")
    found = connected_components(spark.createDataFrame([(n,) for n in nodes], "block_id string"), given)
    assert {r.block_id: r.component for r in found.collect()} == union_find(nodes, edges)


def test_bands_need_enough_hashes(spark):
    with pytest.raises(ValueError):
        minhash.LshConfig(hashes=3)
    signed = spark.createDataFrame([("x", [1, 2, 3, 4])], "block_id string, signature array<bigint>")
    assert [tuple(r) for r in minhash.bands(signed).collect()] == [("x", 0, [1, 2]), ("x", 1, [3, 4])]


def test_verified_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"g{i}" for i in range(40)]
    sets = {f"b{i:02d}": rng.sample(base, rng.randint(1, 40)) for i in range(25)}
    rows = spark.createDataFrame(list(sets.items()), "block_id string, ngrams array<string>")
    every = spark.createDataFrame(list(itertools.combinations(sets, 2)), "block_id1 string, block_id2 string")
    found = {(r[0], r[1]): round(r[2], 9) for r in minhash.verified(every, minhash.hashed_sets(rows)).collect()}
    want = {(a, b): round(1 - len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}), 9) for a, b in itertools.combinations(sets, 2)}
    assert found == {k: v for k, v in want.items() if v <= 0.6}


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        base = [f"t{k}g{i}" for i in range(rng.randint(4, 30))]
        for j in range(12):
            rows.append((f"b{k:02d}{j:02d}", rng.sample(base, rng.randint(len(base) // 2, len(base))) + [f"x{rng.randint(0, 9)}"]))
    df = spark.createDataFrame(rows, "block_id string, ngrams array<string>")
    nodes = [r[0] for r in rows]
    pairs, links = ([(r[0], r[1]) for r in f(df).collect()] for f in (minhash.near_pairs, minhash.near_links))
    assert set(links) <= set(pairs) and len(links) < len(pairs)
    assert union_find(nodes, links) == union_find(nodes, pairs)


def test_planted_duplicates_are_found(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(20)]
    files = [(f"f{i:02d}", t) for i, t in enumerate(texts)] + [(f"g{i:02d}", t + " end") for i, t in enumerate(texts)] + [("h", texts[0]), ("n", None), ("e", "")]
    out = dedup.deduplicated(spark.createDataFrame(files, "file_name string, text string")).collect()
    kept = {r.file_name for r in out}
    assert {f"f{i:02d}" for i in range(20)} <= kept and "h" not in kept and "e" in kept
    assert sum(n.startswith("g") for n in kept) <= 2


def test_assembled(spark):
    rows = spark.createDataFrame([("f_a", 2, "z"), ("f_a", 0, "x")], "file_name string, seq int, text string")
    assert [tuple(r) for r in dedup.assembled(rows).collect()] == [("f_a", "x\nz")]


def test_split_block_id(spark):
    row = blocks.split_block_id(spark.createDataFrame([("a_b\n.txt_12",)], "block_id string")).first()
    assert (row.file_name, row.seq) == ("a_b\n.txt", 12)


def test_articles(spark):
    held = spark.createDataFrame([("a", "x"), ("b:c", "x"), (None, "x"), ("d", None), ("e", "#REDIRECT [[x]]"), ("f", "#重定向 [[x]]"), ("g/h", "y")], "title string, text string")
    assert [r.title for r in pages.articles(held).collect()] == ["a", "g/h"]
    done = spark.createDataFrame([("g_h.txt",)], "file_name string")
    assert [r.title for r in pages.articles(held, done).collect()] == ["a"]


def test_popular(spark):
    held = spark.createDataFrame([("a", "x" * 500), ("b", "x " * 499), ("c", "y" * 600)], "title string, text string")
    views = spark.createDataFrame([(1, "a", 9000), (2, "a", 1000), (2, "a", 1000), (3, "b", 20000), (4, "c", None)], "id int, title string, view_count bigint")
    assert [r.title for r in pages.popular(held, pages.view_totals(views)).collect()] == ["a"]


def test_pipeline_needs_views(spark):
    with pytest.raises(ValueError):
        pipeline.corpus(spark.createDataFrame([("a", "x")], "title string, text string"), pipeline.PipelineConfig(only_popular=True))


def test_corpus_is_simplified(spark):
    """Titles keep their characters; a traditional page gives the text of its simplified copy, in both chains."""
    held = spark.createDataFrame([("來", "這個國家後來的\n== 歷史 ==\n時間與龍"), ("来", "这个国家后来的\n== 历史 ==\n时间与龙")], "title string, text string")
    batch = {r.file_name: r.text for r in pipeline.corpus(held).collect()}
    assert batch == dict.fromkeys(["來.txt", "来.txt"], "这个国家后来的\n\n## 历史\n\n时间与龙\n")
    assert {r.file_name: r.text for r in stages.streamed_corpus(spark, held).collect()} == batch
    other = pipeline.PipelineConfig(simplify=("歷", "历"))
    assert {r.file_name: r.text for r in pipeline.corpus(held, other).collect()}["來.txt"] == "這個國家後來的\n\n## 历史\n\n時間與龍\n"
    rendered = spark.createDataFrame([("a", "<p>歷時</p>")], "title string, text string")
    assert stages.markdown(rendered, other.simplify).first().text == "历時\n"


def test_chat(spark):
    turns = spark.createDataFrame([(1, 2, "user", "u"), (1, 1, "system", "s"), (1, 3, "assistant", "a"), (1, 4, "tool", "t")], "c int, turn int, role string, text string")
    assert messages.chats(turns, "c").first().text == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n<|endoftext|>"
    assert messages.chats(turns, "c", generate=True).first().text.endswith("<|assistant|>\n")


def test_responses(one):
    assert one(messages.response_views, '{"items":[{"views":3},{"views":null},{"views":4}]}') == 7
    assert one(messages.response_views, "{}") == 0 == one(messages.response_views, None)
    ok, bad = one(messages.parsed_page, '{"parse":{"text":{"*":"a\\nb"}}}'), one(messages.parsed_page, '{"error":{"code":"ratelimited","info":"x"}}')
    assert (ok.html, ok.error, bad.html, bad.error) == ("a b", None, None, "ratelimited")


def test_topic_sizes(spark):
    rows = spark.createDataFrame([("t", 0, 10, 4), ("t", 5, 8, None)], "topic string, earliest bigint, latest bigint, committed bigint")
    assert tuple(messages.topic_sizes(rows).first()) == ("t", 13, 9)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_tokens(spark, model):
    config = tokenize.TokenizerConfig(tokenize.public_model(model), batch=2)
    texts = ["a text", None, "", "中文 😀", "<s> x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tokenize.token_column("text", config).alias("t")).orderBy("i").collect()
    assert rows[1].t == rows[2].t == [] and all(rows[i].t for i in (0, 3, 4))
    assert json.loads(tokenize.json_line("b_0", rows[0].t)) == {"blockId": "b_0", "tokens": rows[0].t}


def test_markers_and_padding(spark):
    plain = tokenize.TokenizerConfig(tokenize.public_model())
    chat = tokenize.TokenizerConfig(tokenize.public_model(), markers=tokenize.CHAT_MARKERS)
    df = spark.createDataFrame([("<|user|>\nhello<|end|>\n<|endoftext|>",)], "t string")
    hello = tokenize.encoded(["hello"], plain)[0]
    ids = [32010, *hello, 32007, 32000]
    column = tokenize.token_column("t", chat)
    row = df.select(column.alias("ids"), tokenize.left_padded(column, 8).alias("padded"), tokenize.left_padded(column, 2).alias("long")).first()
    assert row.ids == row.long == ids and row.padded == [32000] * (8 - len(ids)) + ids
    assert tokenize.encoded(["<|end|>"], plain)[0] != [32007]
    assert tokenize.encoded(["<|end|> \n", "<|endoftext|>\n"], chat) == [[32007], [32000, *tokenize.encoded(["\n"], plain)[0]]]
    assert len(tokenize.encoded(["a b c d e f"], tokenize.TokenizerConfig(tokenize.public_model(), max_length=3))[0]) == 3


def test_shapes_of_hot_plans(spark, small):
    """Columns are pruned at the scan, and signatures shuffle one row a block."""
    table = spark.read.parquet(f"{small}/blocks.parquet")
    plan = minhash.signatures(table.select("block_id", "ngrams"))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    filtered = spark.read.parquet(f"{small}/page_views.parquet").where(F.col("view_count") > 5).select("title")
    assert "PushedFilters: [IsNotNull(view_count), GreaterThan(view_count,5)]" in filtered._jdf.queryExecution().executedPlan().toString()


def test_bands_follow_from_the_similarity():
    config = minhash.LshConfig.for_similarity(0.8)
    assert (config.bands, config.rows, config.hashes, config.k) == (8, 3, 24, 5)
    assert 1 - (1 - 0.8**3) ** config.bands >= 0.995 and config.max_distance == pytest.approx(0.2)
    with pytest.raises(ValueError):
        minhash.LshConfig.for_similarity(1.0)


def test_a_stage_is_computed_and_counted_once(spark):
    held = stage(spark.range(10).withColumn("x", F.rand()), rows=F.count("*"), most=F.max("id"))
    assert held.counts == {"rows": 10, "most": 9} and held.df.collect() == held.df.collect()
    held.drop()
    assert not Path(held.path.removeprefix("file:")).exists()
