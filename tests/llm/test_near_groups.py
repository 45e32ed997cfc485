import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import components, near
from quernstone.operators.components import connected_components


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(items, threshold):
    """Similar pairs of different ids; an id with several sets is compared with each of them."""
    found = set()
    for x, a in items:
        for y, b in items:
            if x < y and a and b and jaccard(a, b) >= threshold:
                found.add((x, y))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"g{i}" for i in range(3000)]
    items = []
    for k in range(40):
        base = rng.sample(words, rng.choice([3, 20, 150, 400]))
        items.append((f"b{k:02d}", set(base)))
        for j in range(3):
            edited = [w for w in base if rng.random() > 0.06 * (j + 1)] + rng.sample(words, max(1, len(base) // 25))
            items.append((f"b{k:02d}{j}", set(edited)))
        items.append((f"c{k:02d}", set(base)))
    return items


def table(spark, items):
    rows = [(x, sorted(s) + sorted(s)[:2], "clash", 1) for x, s in items] + [("null", None, "k", 1), ("empty", [], "k", 1), (None, ["g1", "g2"], "k", 1)]
    return spark.createDataFrame(rows + rows[:5], "block_id string, ngrams array<string>, key string, half int")


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_pairs_against_all_pairs(spark, corpus, threshold):
    found = near.pairs(table(spark, corpus), "block_id", "ngrams", near.Settings(threshold=threshold)).collect()
    want = brute(corpus, threshold)
    assert {(r.id1, r.id2) for r in found} == want and len(found) == len(want)
    sets = dict(corpus)
    assert all(abs(r.similarity - jaccard(sets[r.id1], sets[r.id2])) < 1e-9 for r in found)


def test_shuffled_prefilter_gives_the_same(spark, corpus):
    few, many = (near.pairs(table(spark, corpus), "block_id", "ngrams", near.Settings(threshold=0.7, broadcast_ids=n)) for n in (500_000, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_integer_ids_and_an_id_with_two_sets(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    df = spark.createDataFrame([(10, a), (9, b), (10, b), (2, a)], "id bigint, ngrams array<string>")
    assert {(r.id1, r.id2) for r in near.pairs(df, "id", "ngrams").collect()} == {(9, 10), (2, 10)}
    rows = {r.id: r.group_id for r in near.membership(df, "id", "ngrams").collect()}
    assert rows == {2: 2, 9: 2, 10: 2}


def test_membership(spark, corpus):
    rows = near.membership(table(spark, corpus), "block_id", "ngrams", near.Settings(threshold=0.7)).collect()
    assert sorted(r.block_id for r in rows) == sorted(x for x, _ in corpus)
    sets = dict(corpus)
    parent = {x: x for x in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in brute(corpus, 0.7):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    for r in rows:
        own = frozenset(sets[r.block_id])
        assert r.group_id == root(r.block_id)
        assert r.class_id == min(x for x, s in sets.items() if s == own)
        assert r.copies == sum(s == own for s in sets.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "block_id string, ngrams array<string>")
    assert near.pairs(df, "block_id", "ngrams").count() == 0
    assert near.membership(df, "block_id", "ngrams").count() == 0


def test_variants_of_one_text_make_a_row_each(spark):
    """In a family of variants, each is verified against the smallest one of its bucket instead of against all others."""
    base = [f"g{i}" for i in range(200)]
    items = [(f"v{i:03d}", base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(120)]
    s = near.Settings(bands=8, rows=2)
    all = near.described(spark.createDataFrame(items, "id string, g array<string>"), "id", "g", s)
    links, every = near.class_links(all, s).count(), near.class_pairs(all, s).count()
    assert every > 120 * 119 / 2 * 0.9 and links < 120 * 10


def test_copies_cost_one_row(spark):
    """Half of all rows copy one text: candidates are made of classes, so they don't grow with the copies."""
    rng = random.Random(1)
    words = [f"g{i}" for i in range(500)]
    items = [(f"x{i}", words[:50]) for i in range(60)] + [(f"y{i}", rng.sample(words, 50)) for i in range(60)]
    all = near.described(spark.createDataFrame(items, "id string, g array<string>"), "id", "g", near.Settings())
    assert near.class_pairs(all, near.Settings()).count() == 0
    assert all.select("key").distinct().count() == 61


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120))
def test_pivots_never_exceed_the_true_distance(a, b):
    import numpy as np

    s = near.Settings()
    x, y = (near.pivots_of(near.mixed(np.array(sorted(v), dtype=np.uint64)), s).astype(int) for v in (a, b))
    assert np.abs(x - y).max(axis=1).sum() <= len(a ^ b)


def test_pivots_discard_most_unrelated_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    s, dropped = near.Settings(threshold=0.7), 0
    for _ in range(200):
        x, y = (rng.integers(0, 2**63, 250, dtype=np.uint64) for _ in range(2))
        bound = np.abs(near.pivots_of(x, s).astype(int) - near.pivots_of(y, s).astype(int)).max(axis=1).sum()
        dropped += bound > 500 * 0.3 / 1.7
    assert dropped > 190


SHAPES = {
    "chain": lambda n: [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)],
    "back": lambda n: [(f"n{(i * 37) % 101:04d}", f"n{((i + 1) * 37) % 101:04d}") for i in range(100)],
    "star": lambda n: [("n9999", f"n{i:04d}") for i in range(n)],
    "islands": lambda n: [(f"n{2 * i:04d}", f"n{2 * i + 1:04d}") for i in range(n)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_groups(spark, shape):
    links = SHAPES[shape](60)
    rows = [(a, b, "x") for a, b in links] + [(b, a, "x") for a, b in links[:9]] + [links[0] + ("y",), ("n0001", "n0001", "x"), ("lonely", "lonely", "x"), ("n0002", None, "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "block_id1 string, block_id2 string, group_id string")
    found = components.groups(df, "block_id1", "block_id2", "block_id").collect()
    nodes = sorted({x for link in links for x in link})
    other = connected_components(spark.createDataFrame([(n,) for n in nodes], "block_id string"), df.select("block_id1", "block_id2"))
    assert sorted(map(tuple, found)) == sorted(map(tuple, other.collect()))
    assert [r.block_id for r in sorted(found)] == nodes


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert components.groups(df, "a", "b").count() == 0


def test_integer_nodes_are_ordered_by_value(spark):
    df = spark.createDataFrame([(10, 9), (100, 10)], "a bigint, b bigint")
    assert sorted(map(tuple, components.groups(df, "a", "b").collect())) == [(9, 9), (10, 9), (100, 9)]


def test_many_copies_are_listed_pair_by_pair(spark):
    rows = spark.range(1001).select(F.col("id").cast("string").alias("block_id"), F.array(F.lit("x"), F.lit("y")).alias("ngrams"))
    assert near.pairs(rows, "block_id", "ngrams").count() == 1001 * 1000 // 2
