import math
import random
import time
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from quernstone.llm import endings, prose, quality, truncation

WORDS = {"zh": ["的", "了", "在", "被", "这"], "zh-Hant": ["的", "了", "在", "被", "這"], "en": ["the", "of", "and", "a", "in", "was"], "de": ["der", "die", "und", "war"]}
PROSE = "这座小镇的仓库在去年被拆除了。居民的生活也因此改变了很多。"
ENGLISH = "The keeper of the tower was in the hall. A guard and the cook sat in the yard of the mill."


@pytest.fixture(scope="module")
def words():
    return prose.Vocabulary(WORDS)


@pytest.mark.parametrize(
    "text, natural",
    [
        (PROSE * 3, True),
        (ENGLISH, True),
        ("\n".join((PROSE * 2)[i : i + 17] for i in range(0, len(PROSE) * 2, 17)), True),
        ("“这里的路在修。”他说。“被拆除了？”她问。" + PROSE, True),
        (PROSE * 2 + "\n- 一\n- 二\n- 三", True),
        ("这座塔的高度在 12.5 与 3,400 之间，即 678 = 22.3 × 152（9087%）。" * 3, True),
        ("- 和山\n- 水寺\n- 林河 石桥\n" * 9, False),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n" * 9, False),
        ("塔\t1\t2\t3\n" * 9, False),
        ("南山河   12    45    3\n" * 9, False),
        ("f0a1 22bc 9de4 77aa\n" * 20, False),
        ("TzF98eNzknGFOgQ4L1BVseq2ci9I12pUeqcRmeyz\n" * 9, False),
        ("尦睴眑瀀峜灣熞癸琯硌。璭奕姨珞嵡犈垀嚮。" * 5, False),
        (PROSE[:15] + "\n" + "古山、水寺、林河、石桥、" * 20, False),
        ("<div class=\"x\"><span id=\"y\">塔</span></div>\n" * 9, False),
    ],
)
def test_what_tells_something(words, text, natural):
    assert (prose.statistics(text, words).prose_share >= 0.5) == natural


def test_statistics_of_a_text(words):
    s = prose.statistics("The cat was in.\nnope nope\n## H\n中的", words)
    assert (s.words, s.lang) == (9, "en") and s.stop_line_share == pytest.approx(1 / 3)
    assert s.common_word_share == pytest.approx(4 / 9) and s.mean_word_length == pytest.approx((3 + 3 + 3 + 2 + 4 + 4 + 1 + 1 + 1) / 9)
    assert prose.statistics("", words) == ("und", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert prose.statistics("¤¤a", words).symbol_ratio == pytest.approx(2 / 3)


def test_one_long_line_is_linear(words):
    assert prose.statistics("ab1/" * 200_000, words).prose_share == 0
    assert prose.statistics("山。" * 200_000, words).words == 200_000


def test_tails_against_sorting(spark):
    rng = random.Random(3)
    held = [(g, s, rng.choice([0.0, 0.5, rng.random()])) for g in ("zh", "en") for s in ("x", "y") for _ in range(150)] + [("de", "x", 1.0), ("de", "x", None)]
    rows = quality.tails(spark.createDataFrame(held, "grp string, stat string, value double").repartition(5)).collect()
    groups = {}
    for g, s, v in held:
        if v is not None:
            groups.setdefault((g, s), []).append(v)
    assert len(rows) == sum(len(set(v)) for v in groups.values())
    for r in rows:
        v = sorted(groups[r.grp, r.stat])
        assert (r.rank, r.total) == (bisect_right(v, r.value), len(v))
        assert r.low == pytest.approx(bisect_right(v, r.value) / len(v)) and r.high == pytest.approx((len(v) - bisect_left(v, r.value)) / len(v))


def test_scores(spark, words):
    texts = [(f"p{i}", PROSE * (i + 1)) for i in range(12)] + [("j", "塔\t1\t2\t3\n" * 30), ("j", "塔\t1\t2\t3\n" * 30), ("n", None), ("e", ""), ("b", " \n"), (None, ENGLISH), ("p0", ENGLISH)]
    df = spark.createDataFrame([(*t, "zh", 1.0) for t in texts], "file_name string, text string, lang string, score double")
    table = quality.scored(quality.statistics(df, "file_name", "text", words), "file_name")
    rows = table.collect()
    assert len(rows) == len(set(texts))
    for r in rows:
        if r.characters:
            assert r.score == pytest.approx(sum(-math.log(r[f"tail_{s}"]) for s in quality.SIDES))
            assert r.expected >= 0
        else:
            assert r.score is None and r.expected is None and r.lang == "und"
    assert max((r for r in rows if r.score is not None), key=lambda r: r.score).file_name == "j"
    assert [r.file_name for r in quality.no_prose(table).collect()] == ["j"]
    assert quality.scored(quality.statistics(df.limit(0), "file_name", "text", words), "file_name").count() == 0


def test_scores_against_brute_force(spark, words):
    rng = random.Random(5)
    texts = [(f"f{i:03d}", natural(rng, i) if i % 4 else rng.choice(JUNK)(rng, i)) for i in range(80)]
    rows = quality.scored(quality.statistics(spark.createDataFrame(texts, "f string, text string"), "f", "text", words), "f").collect()
    side = quality.SIDES
    for r in rows:
        want = {}
        for grp in {r.lang, "*"} - {"und"}:
            held = {tuple(x[s] for s in side) for x in rows if x.prose_share >= 0.5 and (grp == "*" or x.lang == grp)}
            score = 0.0
            for i, s in enumerate(side):
                low, high = (sum(t) + 1 for t in ([h[i] <= r[s] for h in held], [h[i] >= r[s] for h in held]))
                n = len(held) + 1
                tail = {"low": low / n, "high": high / n, "both": min(1.0, 2 * min(low, high) / n)}[side[s]]
                score -= math.log(tail)
            want[grp] = len(held) * math.exp(-score) * sum(score**j / math.factorial(j) for j in range(len(side)))
        assert r.expected == pytest.approx(min(want.values()))


def natural(rng, i):
    """Sentences made by the test itself, some with figures, dialogue or hard line breaks."""
    said = []
    for _ in range(rng.randint(4, 25)):
        if i % 3:
            subject, place, verb = (rng.choice(x) for x in (("小镇", "桥", "仓库", "学堂", "河堤"), ("北山", "东岸", "旧城", "石桥"), ("被拆除了", "在去年修好了", "成了学堂", "被洪水冲毁了")))
            said.append(f"{place}的{subject}{rng.choice(('', '在战后', f'于{rng.randint(1500, 2000)}年', '后来'))}{verb}，这里的人{rng.choice(('在', '都在', '也在'))}{rng.choice(('讨论', '谈论', '记录'))}它。")
        else:
            said.append(f"The {rng.choice(('keeper', 'guard', 'cook', 'miller'))} of the {rng.choice(('tower', 'mill', 'hall'))} was in {rng.choice(('a', 'the'))} {rng.choice(('yard', 'town', 'church'))} and {rng.choice(('waited', 'slept', 'wrote'))} in {rng.randint(1500, 2000)}.")
    return rng.choice(("", "", "\n")).join(said)


#: Texts that are no prose, made by the test itself.
JUNK = [
    lambda rng, i: "\n".join(f"- {''.join(rng.choices('山河桥寺塔林泉谷', k=rng.randint(2, 5)))}" for _ in range(rng.randint(9, 60))),
    lambda rng, i: "\n".join("\t".join(str(rng.randint(0, 9999)) for _ in range(5)) for _ in range(rng.randint(9, 60))),
    lambda rng, i: "\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=64)) for _ in range(rng.randint(5, 30))),
    lambda rng, i: "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(rng.randint(200, 900))) + "。",
    lambda rng, i: "| 名 | 数 |\n| --- | --- |\n" + "\n".join(f"| 山{k} | {rng.randint(1, 99)} |" for k in range(rng.randint(9, 60))),
    lambda rng, i: "".join(f"<div class=\"c{rng.randint(0, 99)}\"><span>{rng.randint(0, 9)}</span></div>\n" for _ in range(rng.randint(9, 60))),
    lambda rng, i: " ".join(rng.choice(("Tower", "Mill", "Abbey", "Bridge", "Ford")) + str(rng.randint(1, 999)) for _ in range(rng.randint(40, 200))),
]


def test_the_score_decides(spark, words):
    """On texts made here, the scores alone tell junk from prose; the exact check that follows drops false alarms only."""
    rng = random.Random(11)
    texts = [(f"n{i:04d}", natural(rng, i)) for i in range(600)] + [(f"j{i:04d}", rng.choice(JUNK)(rng, i)) for i in range(150)]
    rows = quality.scored(quality.statistics(spark.createDataFrame(texts, "f string, text string"), "f", "text", words), "f").collect()
    alone = {r.f for r in rows if r.expected <= quality.Settings().most_alarms}
    junk = {f for f, _ in texts if f[0] == "j"}
    assert len(alone & junk) / len(junk) >= 0.95 and len(alone & junk) / len(alone) >= 0.95
    assert len(alone) < len(rows) / 2  # without the score, every row would be left to the check


def test_common_junk_and_a_language_of_one_file(spark, words):
    """A third of all rows, two thirds of the Chinese ones, are copies of one list, and the only German file is a list as well."""
    listed, german = "- 和山的\n- 水寺\n- 林河 石桥\n" * 9, "- der Turm\n- die Burg\n- und Tal\n" * 9
    texts = [(f"p{i}", PROSE * (i + 1)) for i in range(5)] + [(f"e{i}", ENGLISH * (i + 1)) for i in range(16)] + [(f"j{i}", listed) for i in range(11)] + [("g", german)]
    stats = quality.statistics(spark.createDataFrame(texts, "file_name string, text string"), "file_name", "text", words)
    assert [r.file_name for r in stats.where("lang = 'de'").collect()] == ["g"]
    want = sorted(f"j{i}" for i in range(11))
    assert sorted(r.file_name for r in quality.no_prose(quality.scored(stats, "file_name")).collect()) == ["g", *want]


def test_vocabulary_table(spark):
    held = spark.createDataFrame([("en", "The"), ("en", None), (None, "x"), ("en", "The")], "lang string, word string")
    assert quality.vocabulary(held).words == {"en": {"the"}}


CUT_OFF = [
    "完整的一句。后来的学者在", "句子。然后，", "A whole one. Most of the ri", "A whole one. The hall of Gu ", "“他说得很多，没", "一句。</p>\n<", "<p>一句。</p>\n<p>还有", "<p>一句。", "一句。<ref name=\"a\">{{cite book|titl",
    "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3", "{| class=\"w\"\n! a !! b\n|-\n| 1 || 2", "a\t1\t2\nb\t3\t4\nc\t5", "```\ndef f(x):\n    return", "一句话。\n== 历史 ==\n这座", "一句话。还有半个�", "一句。年产 [more]", "一句。耕地约6…（阅读全文）", "一句。的锦缎（Kupu",
    "一句话，另一句。\n后来的人", "词[[链接|文", "Wort und Satz. Die Mühle war im Sommer für Bes",
]
WHOLE = [
    "完整的一句。", "完整的一句。\n\n", "他说：“好。”", "完整。（完）", "Done here. (end)", "一句。[3]", "一句。<ref>x</ref>", "<p>一句。</p>\n", "一句。\n[[Category:山]]\n", "{| class=\"w\"\n! a !! b\n|-\n| 1 || 2\n|}", "| a | b |\n| --- | --- |\n| 1 | 2 |",
    "```\nx = 1\n```", "春山古道", "Gidon Tudas of Saba", "- 山\n- 河\n- 桥", "1. 山\n2. 河（3米）", "一句。\n- 《山志》，第3页", "a\t1\t2\nb\t3\t4", "山（3米）\n河\nBen Tal 1820", "", " \n", "一句。\n## 历史", "Is it so?",
]


@pytest.mark.parametrize("text", CUT_OFF)
def test_endings_that_are_cut(text):
    assert endings.ending(text).verdict == endings.CUT, endings.ending(text)


@pytest.mark.parametrize("text", WHOLE)
def test_endings_that_are_not(text):
    assert endings.ending(text).verdict != endings.CUT, endings.ending(text)


def cut_ids(spark, rows, **more):
    df = spark.createDataFrame([(i, t, s, True) for i, (t, s) in enumerate(rows)], "doc_id int, text string, source string, is_cut boolean").repartition(4)
    out = truncation.cut_rows(df, **more).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    return {r.doc_id for r in out if r.is_cut}


def test_cut_rows(spark):
    rows = [(t, "a") for t in CUT_OFF] + [(t, "b") for t in WHOLE] + [(None, None), (CUT_OFF[0], None), (CUT_OFF[0], "b")]
    n = len(CUT_OFF)
    assert cut_ids(spark, rows) == {*range(n), len(rows) - 2, len(rows) - 1}


def test_longer_copies_prove_a_cut(spark):
    items = "山（3米）\n河桥\nBen Tal 1820"
    rows = [("山（3米）\n河桥\nBen Ta", "a"), (items, "a"), ("山（3米）\n河桥", "a"), (items + "\n寺", "b"), ("春山古道", "a"), ("春山古道的历史", "b"), ("Old Tow", "a"), ("Old Tower", "a")]
    assert cut_ids(spark, rows) == {0, 6}


def test_longer_copies_of_texts_with_marks(spark):
    """What follows a cut doesn't hide the longer copy; texts that differ in it alone are judged alike."""
    core = "山（3米）\n河桥\nBen Ta"
    rows = [(core + x, "a") for x in ("……", "  ", "...", "")] + [("山（3米）\n河桥\nBen Tal 1820", "b"), ("春山……", "b"), ("春山 古道", "b")]
    assert cut_ids(spark, rows) == {0, 1, 2, 3}


def test_any_longer_copy_proves(spark):
    """One that goes on otherwise hides no other; single lines of ideographs beyond a title's length are proved as well."""
    rows = [("The quick bro", "a"), ("The quick bro fell down.", "a"), ("The quick brown fox jumps over it.", "b"), ("The quick bro\nand more.", "b")]
    assert cut_ids(spark, rows) == {0}
    assert cut_ids(spark, rows[:2] + rows[3:]) == set()
    assert cut_ids(spark, [("北京市海淀区中关村大街", "a"), ("北京市海淀区中关村大街一号院在这里。", "a")]) == {0}
    assert cut_ids(spark, [("北京市海淀区中关村大街", "a"), ("北京市海淀区中关村大街\n一号院在这里。", "a")]) == set()
    assert cut_ids(spark, [("海淀区中关村大街", "a"), ("海淀区中关村大街一号院在这里。", "a")]) == set()
    assert cut_ids(spark, [("Ben", "a"), ("Bengal lies in the east.", "a")]) == set()


def brute_longer(cores, asks, within):
    """Numbers of the texts that a longer one proves cut, by comparing all pairs."""
    found = set()
    for i, x in enumerate(cores):
        for y in cores:
            if asks[i] and len(y) > len(x) and y.startswith(x) and y[len(x)] not in "\r\n":
                c = y[len(x)]
                if not within[i] or (c.isalnum() and c < "⺀"):
                    found.add(i)
    return found


def test_longer_copies_against_all_pairs(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choices("ab山河\n ", weights=(5, 5, 5, 2, 1, 1), k=n)).strip() for n in [*range(4, 40)] * 12}
    texts |= {t[: rng.randint(4, len(t))].strip() for t in sorted(texts) if len(t) > 5 for _ in range(4)}
    shared = "一、" + "山河" * 700  # many texts with one long head
    texts |= {shared + "".join(rng.choices("ab\n", k=rng.randint(1, 9))).strip() for _ in range(150)}
    texts = sorted(t for t in texts if t)
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "h1 bigint, h2 bigint, text string").repartition(5)
    settings = truncation.Settings()
    ended = df.mapInArrow(truncation._ended(settings), truncation.ENDED).cache()
    found = {r.h1 for r in truncation.longer_copies(df, ended, settings).collect()}
    shuffled = truncation.longer_copies(df, ended, truncation.Settings(broadcast_numbers=0))
    info = {r.h1: r for r in ended.collect()}
    rows = [info[i] for i in range(len(texts))]
    cores = [t[: r["size"]] for t, r in zip(texts, rows)]
    want = brute_longer(cores, [r["asks"] for r in rows], [r["within_word"] for r in rows])
    assert found == want == {r.h1 for r in shuffled.collect()} and len(want) > 100
    ended.unpersist()


def test_prefix_hashes():
    import numpy as np

    texts = ["", "a", "山河" * 3000, "\U0001f600b", "ab" * 5]
    hashed = truncation.Prefixes(texts)
    for row, text in enumerate(texts):
        for n in {0, min(1, len(text)), len(text) // 2, len(text)}:
            a, b = (sum((ord(c) + 1) * pow(base, k, truncation.PRIME) for k, c in enumerate(text[:n])) % truncation.PRIME for base in truncation.BASES)
            assert hashed.at(np.array([row]), np.array([n]))[0] == a << 31 | b


def test_a_shared_head_of_a_third_of_all_rows(spark):
    """A text answers for each length once, so texts and questions that share a head don't multiply."""
    head = "名称与年份\n" + "山河桥寺" * 100
    rows = [(f"{head}{'塔' * (i % 50)}{i:04d}", "a") for i in range(900)] + [(f"{head}{'塔' * k}", "b") for k in range(50)] + [(f"另{i}篇。", "c") for i in range(1800)]
    assert cut_ids(spark, rows) == set(range(900, 950))


def test_longer_copies_across_partitions(spark):
    rng = random.Random(1)
    whole = ["".join(rng.choices("山河桥寺", k=5)) + "\nBen " + "".join(rng.choices("abcdefgh", k=30)) for _ in range(40)]
    rows = [(t, "a") for t in whole] + [(t[: rng.randint(12, 30)], "b") for t in whole]
    assert cut_ids(spark, rows) == set(range(40, 80))


def test_written_ellipsis_and_omission(spark):
    rows = [("水位变化成为困难。", "a"), ("一句。此后，水位变化成为困难……", "a"), ("一句。此后，水位变化成为困难…", "a"), ("一句。此后，水位变…", "a"), ("一句。此后，现藏于北山……", "a")]
    assert cut_ids(spark, rows) == {3}


def test_size_limits_of_a_source(spark):
    """A written ellipsis at a size where a source cuts is a cut; elsewhere it is not."""
    base = "这里的人都知道这座桥的来历。"
    cut = [base + x for x in ("水渠是后来", "仓库在去年", "学堂由旧城")]
    rows = [(t + "…", "feed") for t in cut] + [(base + "石桥的木料……", "feed"), (base + "石桥的木料都来自……", "feed"), (base + "石桥的木料……", "other")]
    assert cut_ids(spark, rows) == {0, 1, 2, 3, 5}  # a copy of a cut text is cut too
    assert cut_ids(spark, rows[:3] + rows[4:5]) == {0, 1, 2}


def test_shares(spark):
    df = spark.createDataFrame([(1, CUT_OFF[0], "a"), (1, CUT_OFF[0], "a"), (2, "好。", "a"), (3, None, None)], "doc_id int, text string, source string")
    rows = {r.source: (r.documents, r.cut_documents, r.cut_share) for r in truncation.shares(df).collect()}
    assert rows == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert truncation.shares(df.limit(0)).count() == 0


def test_queries_on_the_small_tables(spark, small):
    from oracle import agree, connection

    from quernstone.llm.catalog import ORACLES, QUERIES

    con = connection(small)
    for name, sql in ORACLES.items():
        agree(QUERIES[name](spark, small), con, sql)
    for name in set(QUERIES) - set(ORACLES):
        df = QUERIES[name](spark, small)
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0, name
    found = QUERIES["p8_found"](spark, small)
    shares = QUERIES["p8_sources"](spark, small).agg(F.sum("documents"), F.sum("cut_documents")).first()
    assert tuple(shares) == (spark.read.parquet(f"{small}/documents.parquet").count(), found.count())


@pytest.mark.parametrize("text", ["x" * 1_000_000, "a" + " " * 1_000_000 + "b", "。" + " \u200b" * 500_000, "1," * 500_000, "<a " * 300_000, "[[" * 300_000, "（" * 500_000, "= " * 500_000, "|" * 500_000, "a b " * 300_000, "…" * 500_000])
def test_endings_are_linear(text):
    began = time.perf_counter()
    endings.ending(text)
    assert time.perf_counter() - began < 5
