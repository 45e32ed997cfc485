import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import lookalike, split


def form(text):
    return lookalike.consistent_array(pa.array([text], pa.string())).to_pylist()[0]


SAME = [
    ("Ｇａｄｏ－Ｋｏｖｕ　１１５", "Gado-Kovu 115"), ("ﾄﾞｶﾞ", "ドガ"), ("é", "é"), ("ガ", "ガ"), ("a​b﻿⁠­", "ab"), ("a b c d", "a b c d"),
    ("博塔∙桑·林‧x", "博塔·桑·林·x"), ("a‑b‐c", "a-b-c"), ("⼤⽔年", "大水年"), ("Вinan Gоnіѕ", "Binan Gonis"), ("Ριnan", "Pιnan"), ("о́", "ó"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("，", ","), ("｡", "。"), ("한", "한"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "¹"), ("1", "①"), ("国", "國"), ("a b", "ab"), ("。", "."), ("𝐀", "A"), ("a\nb", "a b"), ("👩‍👩", "👩👩")]


@pytest.mark.parametrize("a, b", SAME)
def test_alike(a, b):
    assert form(a) == form(b) == b


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_not_alike(a, b):
    assert form(a) != form(b)


def test_composition_agrees_with_the_standard_library():
    """On texts whose characters nothing but composition changes, the form is NFC."""
    rng = random.Random(9)
    t = lookalike.tables()
    pool = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and t.one[c] == c and not t.more_count[c]]
    marks = [c for c in pool if unicodedata.combining(chr(c))]
    texts = ["".join(chr(rng.choice(rng.choice((pool, marks, marks[:99], range(0x41, 0x5B), (0x9C7, 0x9BE, 0x1100, 0x1161, 0x11A8))))) for _ in range(rng.randint(0, 9))) for _ in range(8000)]
    got = lookalike.consistent_array(pa.array(texts)).to_pylist()
    assert got == [unicodedata.normalize("NFC", x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_rows_don_t_touch_each_other(texts):
    got = lookalike.consistent_array(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else form(t) for t in texts]
    assert lookalike.consistent_array(pa.array(got, pa.string())).to_pylist() == got


def test_slices_and_long_texts():
    held = pa.array(["skip", "Ａ" * 300_000, None, "", "e" + "̖́" * 200])
    got = lookalike.consistent_array(held.slice(1)).to_pylist()
    assert got[:3] == ["A" * 300_000, None, ""] and got[3] == unicodedata.normalize("NFC", held[4].as_py())


def test_alike_pairs(spark):
    rows = [(1, "Ａ", "x"), (2, "A", "x"), (2, "A", "x"), (3, "A", None), (4, None, "x​"), (5, "", "y"), (6, "​", "y"), (None, "Ａ", "x"), (7, "B", "z")]
    df = spark.createDataFrame([(*r, "f", "v") for r in rows], "page_id bigint, title string, text string, field string, value string")
    found = {(r.field, r.id1, r.id2) for r in lookalike.alike_pairs(df, "page_id", ["title", "text"]).collect()}
    assert found == {("title", 1, 2), ("title", 1, 3), ("title", 5, 6), ("text", 1, 4), ("text", 2, 4)}
    assert lookalike.alike_pairs(df.limit(0), "page_id", ["title"]).count() == 0


def test_membership(spark):
    rows = [(1, "Ａ", "x"), (2, "A", "x"), (2, "A", "x"), (3, "A", None), (4, None, "x\u200b"), (5, "", "y"), (None, "Ａ", "x"), (1, "A", "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, title string, text string, copies int")
    found = sorted(tuple(r) for r in lookalike.membership(df, "page_id", ["title", "text"]).collect())
    assert found == [
        ("text", 1, 1, 2, 1, 2), ("text", 2, 1, 2, 1, 2), ("text", 4, 4, 1, 1, 2), ("text", 5, 5, 1, 5, 1),
        ("title", 1, 1, 1, 1, 2), ("title", 1, 1, 3, 1, 2), ("title", 2, 1, 3, 1, 2), ("title", 3, 1, 3, 1, 2), ("title", 5, 5, 1, 5, 1),
    ]
    assert lookalike.membership(df.limit(0), "page_id", ["title"]).count() == 0


def test_the_form_is_computed_once(spark):
    df = spark.createDataFrame([(1, "Ａ"), (2, "A")], "id int, t string")
    plan = lookalike.alike_pairs(df, "id", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_a_form_of_many_spellings_is_one_row_each(spark):
    marks = ["\u200b" * k for k in range(400)]
    df = spark.createDataFrame([(i, "A" + m) for i, m in enumerate(marks)], "id int, t string")
    rows = lookalike.membership(df, "id", ["t"]).collect()
    assert len(rows) == 400 and {(r.group_id, r.spellings) for r in rows} == {(0, 400)}


def brute_cut(strength, start, limit, step):
    lowest, highest = start + limit.overlap + 1, start + limit.max_size
    middle = max(lowest, highest - step // 2)
    for low, high in ((middle, highest), (lowest, middle - 1)):
        best = max(((int(strength[k - 1]), k) for k in range(low, high + 1)), default=(0, 0))
        if best[0]:
            return best
    return 0, highest


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab中文字1，。.! \n　", max_size=300), st.integers(1, 50), st.integers(0, 49), st.sampled_from([1, 37, 1 << 15]))
def test_pieces_against_a_plain_search(text, size, overlap, stretch):
    limit = split.Limit(size, overlap % size)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    before, split.STRETCH = split.STRETCH, stretch
    try:
        found = split.pieces(points, limit)
    finally:
        split.STRETCH = before
    strength = split.strengths(points) if text else []
    assert "".join(text[a if not k else a + limit.overlap : b] for k, (a, b, _) in enumerate(found)) == text
    for (a, b, s), (c, _, _) in zip(found, found[1:]):
        assert b - a <= size and c == b - limit.overlap
        assert (s, b) == brute_cut(strength, a, limit, size - limit.overlap)
    assert all(b - a <= size for a, b, _ in found)
    if split.longest_run(points) > size:
        assert any(not s for *_, s in found)


def test_strengths_order():
    text = "a b，c；d。e\n\nf\ng 3.14"
    s = dict(zip(range(len(text)), split.strengths(np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)).tolist()))
    assert [s[text.index(c)] for c in " ，；。"] == [split.SPACE, split.PAUSE, split.CLAUSE, split.SENTENCE]
    assert s[text.index("\n\n") + 1] == split.PARAGRAPH and s[text.index("f\n") + 1] == split.LINE
    assert s[text.index(".")] <= split.SPACE


def test_split_table(spark):
    rows = [("a", "x" * 12), ("a", "x" * 12), ("b", None), ("c", ""), ("d", "short"), ("e", "one two three"), (None, "none has a name")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_name string, text string, piece int")
    out = split.split(df, "file_name", "text", "t", split.Limit(10, 2)).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.piece):
        assert r.end - r.start == len(r.text) <= 10
        by.setdefault(r.file_name, []).append(r)
    assert set(by) == {"a", "d", "e", None}
    assert [r.text for r in by["a"]] == ["x" * 10, "x" * 4] and [r.forced for r in by["a"]] == [True, False]
    assert [r.text for r in by["e"]] == ["one two ", "o three"] and by["e"][0].longest_run == 5
    assert split.split(df.limit(0), "file_name", "text", "t", split.Limit(10)).count() == 0
    with pytest.raises(ValueError):
        split.Limit(3, 3)


def test_very_long_text(spark):
    text = "段落，".join(["字" * 50] * 40_000)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    found = split.pieces(points, split.Limit(3000, 200))
    assert all(s for *_, s in found) and found[-1][1] == len(text)


def test_many_rows_of_two_values_are_listed_pair_by_pair(spark):
    rows = spark.range(2002).select(F.col("id"), F.when(F.col("id") % 2 == 0, "a b").otherwise("a\u00a0b").alias("t"))
    assert lookalike.alike_pairs(rows, "id", ["t"]).count() == 1001 * 1001
