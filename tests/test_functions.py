import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import hashing, html, render, wikitext
from quernstone.functions import text as T
from quernstone.functions.rules import SECTIONS_DROPPED, SIMPLIFIED, TRADITIONAL, matches, predicate
from quernstone.functions.script import BY_PHRASE, simplification


@pytest.mark.parametrize(
    "text, blocks",
    [("##a##b ###c # d", ["", "##a", "##b ", "###c # d"]), ("x", ["x"]), ("", [""]), ("p##", ["p", "##"]), ("####", ["", "####"]), (None, None)],
)
def test_chapter_blocks(one, text, blocks):
    assert one(T.chapter_blocks, text) == blocks


def test_length_blocks(one):
    assert one(lambda c: T.length_blocks(c, 3), "中文abcd😀") == ["中文a", "bcd", "😀"]
    assert one(lambda c: T.length_blocks(c, 3), "") == [""]
    assert one(T.length_blocks, None) is None
    with pytest.raises(ValueError):
        T.blocker("none")


def test_grams(one):
    assert one(T.grams, "ab c,中 文　x y z9") == ["ab", "c", ",", "中", "文", "x", "y", "z9"]
    assert one(lambda c: T.grams(c, keep_trailing=False), "x z9") == ["x"]
    assert one(T.grams, "a😀b") == ["a", "😀", "b"]


def test_shingles(one):
    assert one(lambda c: T.shingles(T.grams(c), 3), "hi there 。") == ["hi there 。"]
    assert one(lambda c: T.shingles(T.grams(c), 3), "one") == []
    assert one(lambda c: T.shingles(T.grams(c), 2), "a b a b") == ["a b", "b a", "a b"]


def test_hashes():
    assert hashing.shift_increments(4, 1) == [1569548985, 215764588, 880641847, 874970313]
    assert hashing.murmur3_32([b"hello"], 42).tolist() == [-488910111]
    assert hashing.murmur3_32([], 1).tolist() == [] and hashing.murmur3_32([b""], 0).tolist() == [0]
    items = [b"abcdefghijklm"[:n] for n in range(14)]
    assert hashing.murmur3_32(items, 3).tolist() == [int(hashing.murmur3_32([x], 3)[0]) for x in items]
    assert len(set(hashing.coefficients(9))) == 9


def test_shift_signature_keeps_the_sign(spark):
    df = spark.createDataFrame([(["a b c"],), ([],), (None,)], "g array<string>")
    rows = [r[0] for r in df.select(hashing.murmur3_signature("g")).collect()]
    h = int(hashing.murmur3_32([b"a b c"], 1)[0])
    assert rows[1:] == [None, None]
    assert rows[0] == [int((abs(h + b) % hashing.PRIME) * (1 if h + b >= 0 else -1)) for b in hashing.shift_increments(4, 1)]


def test_file_names(one):
    assert one(T.file_name, "a/b:c?|d") == "a_b_c__d.txt"
    assert one(lambda c: T.file_name(c, pipes_in_pairs=True), "a/b:c?|d||e\\") == "a_b_c_|d_e\\.txt"


def test_refs_and_comments(one):
    text = "a<!-- x\ny -->b<!--q-->c<ref name=z/>KEEP<ref>u\nv</ref>d<ref n/>e"
    assert one(T.without_refs_and_comments, text) == "abcKEEPde"
    assert one(lambda c: T.without_refs_and_comments(c, single_line_comments=True), text) == "a<!-- x\ny -->bcde"


def test_rules(one):
    assert one(lambda c: matches(F.col(c), SECTIONS_DROPPED), "外部链接") is True
    assert one(lambda c: matches(F.col(c), SECTIONS_DROPPED), "历史") is False
    assert one(lambda c: matches(F.col(c), {}), "x") is False
    assert predicate(SECTIONS_DROPPED)("另见") and not predicate(SECTIONS_DROPPED)("另见x")
    assert len(TRADITIONAL) == len(SIMPLIFIED) == len(set(TRADITIONAL)) <= 200
    assert one(T.simplified, "參考文獻") == "参考文献"


def test_squeezed(one):
    assert one(T.squeezed, "\n \na\n\n\n\nb\n \n\t\nc") == "a\n\nb\n\nc\n"
    assert one(T.squeezed, "a") == "a\n"


def test_empty_chapters(one):
    assert one(T.without_empty_chapters, "x\n## A\n\n## B\nb\n### C") == "x\n## B\nb\n"


def test_year_range(spark):
    a, b = T.one_year_range(F.to_date(F.lit("2024-12-30")))
    assert tuple(spark.range(1).select(a, b).first()) == ("20231230", "20241230")


def test_templates():
    assert wikitext.without_templates("text{{cite a}}{{cite b}}{{cite c}}") == "text"
    assert wikitext.without_templates("text{{refbegin}} body {{refend}}") == "text"
    assert wikitext.without_templates("text {{refend}} x") == "text  x"
    assert wikitext.without_templates("{{NoteTA|x}}\n{{Infobox}}\ntext {{lang|zh|y}}") == "{{NoteTA|x}}\ntext {{lang|zh|y}}"
    assert wikitext.without_templates("{{|}}") == "{{|}}"
    assert wikitext.without_templates("[[File:a.jpg]] [[Category:x]] [[word]]") == "  [[word]]"
    assert wikitext.without_templates("a\n{{cite x}}\nb") == "a\nb"
    assert wikitext.without_templates("x ]] }} {{ [[") == "x ]] }} {{ [["


def test_sections():
    text = "== A ==\n=== B ===\nb\n== C ==\nc\n== 參考文獻 ==\nr"
    assert wikitext.kept_sections(text) == "== A ==\n=== B ===\nb\n== C ==\nc\n"
    assert wikitext.kept_sections("lead\n== A ==\n") == "lead\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20)), max_size=12))
def test_merged_ranges_cover_the_same_places(ranges):
    ranges = [(a, a + n) for a, n in ranges]
    union = wikitext.merged(ranges)
    assert all(x[1] < y[0] for x, y in zip(union, union[1:]))
    assert {i for a, b in union for i in range(a, b)} == {i for a, b in ranges for i in range(a, b)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="[]{}|ab= \n", max_size=60))
def test_cleaning_any_text(text):
    assert len(wikitext.without_templates(text)) <= len(text)
    assert isinstance(wikitext.cleaned(text), str)


@pytest.mark.parametrize(
    "page, markdown",
    [
        ("<p>x <b>y</b> <i>z</i> <code>q</code></p>", "x **y** *z* `q`\n"),
        ("<h2>T</h2><p>b</p><h2>Empty</h2>", "## T\n\nb\n"),
        ("<ul><li>a</li><li><ol><li>b</li></ol></li></ul>", "- a\n    1. b\n"),
        ("<ul><li>own<ul><li>sub</li></ul><li>next</ul>", "- own\n    - sub\n- next\n"),
        ("<table><tr><td>1</table><div class='infobox x'>y</div><img><script>a</p></script><p>one<p>two", "one\n\ntwo\n"),
        ("<b><i>x</i></b>", "***x***\n"),
        ("<p>&lt;x&gt; [编辑]</p>", "<x> \n"),
        ("<p>open <b>bold<p>next", "open **bold**\n\nnext\n"),
        ("", ""),
    ],
)
def test_html(one, page, markdown):
    assert one(html.markdown_column, page).replace(" \n", "\n") == markdown.replace(" \n", "\n")


def test_html_null(one):
    assert one(html.markdown_column, None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbul i\"=&;x", max_size=50))
def test_html_any_text(page):
    assert isinstance(html.to_markdown(page), str)


def test_render():
    page = render.to_html("== H ==\n* a\n** b\n* c\n'''x''' [[l|m]]\n\ny {{t|{{u}}}}")
    assert html.to_markdown(page).split() == "## H - a - b - c **x** m y".split()


def test_sections_cascade():
    """A dropped section takes its subsections along; a section without text of its own stays for a subsection."""
    text = "lead\n== 参考 ==\nx\n=== 脚注 ===\ny\n== 历史 ==\n=== 古代 ===\n==== 早期 ====\nz\n=== 空 ===\n\n== 參見 ==\nq\n== 后 ==\nw"
    assert wikitext.kept_sections(text) == "lead\n== 历史 ==\n=== 古代 ===\n==== 早期 ====\nz\n== 后 ==\nw"
    assert wikitext.kept_sections(text, nested=False) == "lead\n=== 脚注 ===\ny\n==== 早期 ====\nz\n== 后 ==\nw"
    assert wikitext.kept_sections("a == b == c\n== d ==\n") == "a == b == c\n"


def test_code_keeps_its_lines():
    assert html.to_markdown("<p>x <b>y</b></p><pre>a\n  b\n\nd</pre><p>z</p>").strip("\n") == "x **y**\n\n```\na\n  b\n\nd\n```\n\nz"
    assert html.to_markdown("<ul><li>i <b>k</b> <code>m</code><ul><li><i>n</i></li></ul></li></ul>").strip("\n") == "- i **k** `m`\n    - *n*"
    assert html.to_markdown("a\0b\x01c") == "abc"


def test_control_characters_cut_nothing(one):
    assert one(T.chapter_blocks, "a\x01b##c\x01#d") == ["a\x01b", "##c\x01#d"]
    assert one(T.chapter_blocks, "## a\n### b") == ["", "## a\n", "### b"] and one(T.chapter_blocks, "") == [""]
    assert one(T.without_empty_chapters, "a\x01\n## b\n## c\nd\x01e\n") == "a\x01\n## c\nd\x01e\n"
    assert wikitext.without_templates("a\0\n{{cite x}}\nb") == "a\0\nb"


def test_all_traditional_characters(spark, one):
    old, new = simplification(spark)
    assert len(old) == len(new) == len(set(old)) > 3000 and not set(BY_PHRASE) & set(old)
    assert one(lambda c: T.simplified(c, (old, new)), "臺灣的電腦軟體，歷史與圖書館") == "台湾的电脑软体，历史与图书馆"
    assert {old[new.index(b)] for b in "历"} and all(dict(zip(old, new))[a] == b for a, b in zip(TRADITIONAL, SIMPLIFIED))


def test_rendering_of_more_wikitext():
    assert render.to_html("{|\n! a !! b\n|-\n| style=x | 1 || [[p|q]]\n|}\nz") == "<table><tr>\n<th>a</th>\n<th>b</th>\n</tr><tr>\n<td>1</td>\n<td><a>q</a></td>\n</tr></table>\n<p>z</p>"
    assert render.to_html("; t : m\n: n") == "<dl>\n<dt>t\n</dt><dd>m\n</dd><dd>n\n</dd></dl>"
    assert render.to_html("a <nowiki>[[x]] <b></nowiki> c") == "<p>a [[x]] &lt;b&gt; c</p>"
    assert render.to_html("see [https://x.y the site] and [https://x.y]<br/>H<sub>2</sub>O <bad>") == "<p>see <a>the site</a> and <br/>H<sub>2</sub>O &lt;bad&gt;</p>"
    assert render.to_html("<syntaxhighlight lang=c>\na {{b}}\n  c\n</syntaxhighlight>") == "<p><syntaxhighlight>\na {{b}}\n  c\n</syntaxhighlight></p>"
    assert render.to_html("* a\n** b\n# c") == "<ul>\n<li>a\n<ul>\n<li>b\n</li></ul>\n</li></ul>\n<ol>\n<li>c\n</li></ol>"
    assert render.to_html("{| never ended\n| a") == "<table><tr>\n<td>a</td>\n</tr></table>"
    assert render.to_html("__TOC__\n<gallery>\nFile:a.jpg\n</gallery>") == ""
