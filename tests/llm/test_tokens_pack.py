import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import pack, tokens

VOCABULARY = tokens.Vocabulary()
ODD = ["", None, "a", "中文 😀 x", "  two  blanks \r\n", "it's 'tis we'll", "<|endoftext|>", "é​", "퟿\U0001f469‍\U0001f469", "x" * 5000, "，" * 3000, " " * 4000]


@pytest.fixture(scope="module")
def reference():
    """The same vocabulary by another library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.vocabulary_folder()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_agree_with_the_other_library(spark, reference):
    df = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(ODD)], "doc_id int, text string, ids array<int>")
    rows = tokens.encode(df).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [reference(t) for t in ODD]
    assert tokens.encode(df.limit(0)).count() == 0


def test_decoding_gives_the_texts_back(spark):
    df = tokens.encode(spark.createDataFrame([(t,) for t in ODD], "text string"))
    rows = df.select("text", tokens.token_text("ids").alias("back")).collect()
    assert all(r.back == (r.text or "") for r in rows)
    assert tokens.decode_ids(tokens.encode_text("😀")[:1]) == "�"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 中，。\n'1s.é😀　", max_size=200), st.integers(1, 40))
def test_safe_pieces_change_nothing(text, size):
    assert "".join(tokens.safe_pieces(text, size)) == text
    assert tokens.encode_text(text, size=size) == tokens.encode_text(text)


def test_all_documents_of_the_small_tables(spark, small, reference):
    from quernstone.llm.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, small).collect()}
    assert ids == {k: reference(t) for k, t in texts.items()}


def check_packing(rows, sizes, capacity):
    """Each text lies in containers once and whole, none overflows, only texts over the capacity are divided."""
    filled, pieces = {}, {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.size
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
    assert all(n <= capacity for n in filled.values())
    assert set(pieces) == set(sizes)
    for doc, parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
        assert sum(p[2] for p in parts) == sizes[doc]
        assert len(parts) == max(1, -(-sizes[doc] // capacity))
    return filled


@pytest.mark.parametrize("shard", [3, 4096])
def test_packing(spark, shard):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)] + ODD + [" ".join(words * 3), "", "", None]
    df = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id int, text string, size string, piece int").repartition(3)
    rows = pack.pack(df, "doc_id", "text", pack.Settings(100, shard=shard)).collect()
    sizes = {i: len(tokens.encode_text(t)) for i, t in enumerate(texts)}
    filled = check_packing(rows, sizes, 100)
    total = sum(sizes.values())
    assert len(filled) <= 1.12 * total / 100 + 3


def test_packing_of_nothing_and_of_empty_texts(spark):
    df = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(9)], "doc_id int, text string")
    assert pack.pack(df.limit(0), "doc_id", "text", pack.Settings(10)).count() == 0
    rows = pack.pack(df.coalesce(1), "doc_id", "text", pack.Settings(10)).collect()
    assert len(rows) == 9 and {r.size for r in rows} == {0} and len({r.container_id for r in rows}) == 1
    with pytest.raises(ValueError):
        pack.Settings(0)


def test_even_pieces_leave_no_rest(spark):
    df = spark.createDataFrame([(1, " a" * 40)], "doc_id int, text string")
    rows = sorted(tuple(r)[:4] for r in pack.pack(df, "doc_id", "text", pack.Settings(20)).collect())
    assert rows == [(1, 0, 0, 20), (1, 1, 20, 20)]


def bm25(ids, lengths, s):
    """Scores by the formula, item by item."""
    docs = np.split(ids, np.cumsum(lengths)[:-1])
    hashed = []
    for d in docs:
        d = d.astype(np.uint64)
        pair = (d[:-1] * np.uint64(0x9E3779B97F4A7C15) + d[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - s.term_bits)
        hashed.append(pair.tolist())
    n, mean = len(docs), lengths.mean()
    df = {}
    for h in hashed:
        for t in set(h):
            df[t] = df.get(t, 0) + 1

    def score(q, d):
        total = 0.0
        for t in set(hashed[q]) & set(hashed[d]):
            tf = hashed[d].count(t)
            total += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * lengths[d] / mean))
        return total

    return np.array([[score(q, d) for d in range(n)] for q in range(n)])


def test_index_scores_by_the_formula():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 30, 12)
    ids = rng.integers(0, 9, int(lengths.sum())).astype(np.int32)
    s = pack.Settings(100, query_terms=1000)
    index = pack.Index(ids, lengths, s)
    want = bm25(ids, lengths, s)
    assert all(np.allclose(index.scores(q), want[q]) for q in range(len(lengths)))


def test_neighbours_share_containers():
    """Texts of one topic end up together rather than by chance."""
    rng = random.Random(4)
    topics = [["".join(rng.choices("abcdefghijklmnoprstuvwyz", k=6)) for _ in range(25)] for _ in range(8)]
    texts = [(k, " ".join(rng.choices(topics[k], k=12))) for k in range(8) for _ in range(40)]
    rng.shuffle(texts)
    lists = [tokens.encode_text(t) for _, t in texts]
    lengths = np.array(list(map(len, lists)))
    s = pack.Settings(600)
    container, how = pack.pack_shard(lengths, pack.Index(np.concatenate([np.array(x, np.int32) for x in lists]), lengths, s), 600)
    topic = np.array([k for k, _ in texts])
    same = np.mean([(topic[container == c] == np.bincount(topic[container == c]).argmax()).mean() for c in set(container.tolist())])
    assert same > 0.6  # by chance: about 0.3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_never_overflows(sizes):
    container = pack.best_fit(np.array(sizes, dtype=np.int64), 50)
    assert all(sum(s for s, c in zip(sizes, container) if c == k) <= 50 for k in set(container.tolist()))
    assert len(set(container.tolist())) <= 2 * sum(sizes) / 50 + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25), st.integers(0, 40))
def test_closest_one_or_two(sizes, room):
    sizes = np.array(sorted(sizes), dtype=np.int64)
    found = pack.closest(sizes, room)
    options = [[i] for i in range(len(sizes))] + [[i, j] for i in range(len(sizes)) for j in range(i)]
    best = max((int(sizes[o].sum()) for o in options if sizes[o].sum() <= room), default=None)
    assert (int(sizes[found].sum()) if found else None) == best and len(set(found)) == len(found)


def test_fills(spark, small):
    from quernstone.llm.catalog import QUERIES

    fills = QUERIES["p7_fills"](spark, small)
    total = QUERIES["p6_ids"](spark, small).agg(F.sum(F.size("ids"))).first()[0]
    rows = fills.collect()
    assert sum(r.tokens for r in rows) == total and all(r.tokens <= 4096 for r in rows)
    assert len(rows) <= -(-total // 4096) + 1


def test_a_shard_ends_at_a_number_of_tokens(spark):
    """Very long texts don't gather in one index, whatever their number."""
    texts = [(i, "word " * (3000 if i % 3 == 0 else 5)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    rows = pack.pack(df, "doc_id", "text", pack.Settings(1000, shard_tokens=50_000, least_fill=0.0)).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.container_id.split("-")[1], set()).add(r.doc_id)
    assert len(shards) > 3 and max(map(len, shards.values())) <= 2 * pack.STEP
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.size
    assert sizes == {i: len(tokens.encode_text(t)) for i, t in texts}


def test_neighbour_and_filler():
    sizes = np.array([5, 10, 20, 30, 60])
    live = np.argsort(sizes)
    assert pack.neighbour_and_filler(sizes, live, np.array([1, 3]), 40, 0) == [1, 3]
    assert pack.neighbour_and_filler(sizes, live, np.array([3]), 60, 0) == []
    assert pack.neighbour_and_filler(sizes, live, np.array([3]), 52, 2) == [3, 2]
    assert pack.neighbour_and_filler(sizes, live, np.array([2]), 20, 0) == [2]


def test_all_terms_may_be_asked(spark):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 50, n, dtype=np.int32) for n in rng.integers(5, 60, 80)]
    lengths = np.array([len(x) for x in lists])
    few, every = (pack.Index(np.concatenate(lists), lengths, pack.Settings(100, query_terms=n)) for n in (3, None))
    assert (every.scores(0) >= few.scores(0) - 1e-12).all() and every.scores(0).sum() > few.scores(0).sum()
