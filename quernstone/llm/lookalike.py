"""One consistent form for text that looks alike but consists of other characters.

A batch's text is copied once from Arrow into an array of code points; everything else works on whole arrays: a gather from
a lookup table (with expansion offsets for characters that become several), one deletion mask, one sort of combining marks,
one composition step for each mark of the longest run. No string function is called for a row.

What the form does: full-width and half-width forms become the ordinary character; blanks become U+0020 (line breaks stay
line breaks, CR LF becomes LF); middle dots become U+00B7 and hyphens U+002D; characters that show nothing are removed (the
joiner between two emoji stays, it changes the picture); radicals and compatibility ideographs become the unified ideograph;
Cyrillic and Greek letters of Latin shape become Latin; letters and marks are composed canonically. What one can see stays:
case, accents, raised or circled figures, simplified or traditional shape, the presence of a blank.

Defined results: null stays null, empty stays empty, a text of any length is treated whole; applying the form twice changes
nothing more.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.lineage import checkpointed, staged

# Letters of other scripts that have the shape of a Latin letter, and characters of one shape.
CYRILLIC = "аеорсухѕіјһԁԛԝАВЕЅІЈКМНОРСТХ", "aeopcyxsijhdqwABESIJKMHOPCTX"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"
DOTS = "··‧∙⋅・･"
HYPHENS = "-‐‑﹣－"
VISIBLE_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
SHOW_NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
JOINER, LEAD_L, LEAD_V, LEAD_T, SYLLABLE = 0x200D, 0x1100, 0x1161, 0x11A7, 0xAC00


class Tables(NamedTuple):
    one: np.ndarray  # code point -> code point, where it stays one; -1 where it is removed
    more_count: np.ndarray  # code point -> number of code points it becomes, 0 where ``one`` holds
    more_start: np.ndarray  # code point -> where they begin in ``pool``
    pool: np.ndarray
    order: np.ndarray  # combining class
    joins: np.ndarray  # 1 where a character may compose with the one before it
    pairs: np.ndarray  # sorted keys (first << 21 | second) of canonical composites
    composed: np.ndarray
    width: np.ndarray  # bytes in UTF-8
    picture: np.ndarray  # emoji


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once in each Python worker from the character database by rule."""
    size = sys.maxunicode + 1
    one = np.arange(size, dtype=np.int32)
    order = np.zeros(size, dtype=np.uint8)
    joins = np.zeros(size, dtype=np.uint8)
    several: dict[int, list[int]] = {}
    alike = dict(zip(map(ord, CYRILLIC[0] + GREEK[0]), map(ord, CYRILLIC[1] + GREEK[1])))
    alike |= dict.fromkeys(map(ord, DOTS), 0xB7) | dict.fromkeys(map(ord, HYPHENS), 0x2D)
    nothing = set(map(ord, SHOW_NOTHING)) | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0))
    pairs: dict[int, int] = {}

    def becomes(c: int) -> list[int]:
        ch = chr(c)
        category = unicodedata.category(ch)
        if c in alike:
            return [alike[c]]
        if c in nothing or (category == "Cf" and ch not in VISIBLE_FORMATS) or (category == "Cc" and ch not in "\t\n\v\f\r\x85"):
            return []
        if category == "Zs" or ch == "\t":
            return [0x20]
        if ch in "\v\f\r\x85" or category in ("Zl", "Zp"):
            return [0x0A]
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            return [c]
        if parts[0][0] != "<" or parts[0] in ("<wide>", "<narrow>", "<noBreak>") or 0x2F00 <= c < 0x2FE0 or c in (0x2E9F, 0x2EF3):
            return [x for p in parts if p[0] != "<" for x in becomes(int(p, 16))]
        return [c]

    for c in range(size):
        if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0xF0000 <= c or (0x3400 <= c < 0xA000) or (0xAC00 <= c < 0xD7A4) or (0x20000 <= c < 0x2F800):
            continue
        ch = chr(c)
        order[c] = unicodedata.combining(ch)
        new = becomes(c)
        if len(new) == 1:
            one[c] = new[0]
        elif not new:
            one[c] = -1
        else:
            several[c] = new
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            first, second = (int(p, 16) for p in parts)
            pairs[first << 21 | second] = c
            joins[second] = 1
    joins[LEAD_V : LEAD_V + 21] = joins[LEAD_T + 1 : LEAD_T + 28] = 1
    more_count = np.zeros(size, dtype=np.uint8)
    more_start = np.zeros(size, dtype=np.int32)
    pool: list[int] = []
    for c, new in several.items():
        more_count[c], more_start[c] = len(new), len(pool)
        pool += new
    keys = np.array(sorted(pairs), dtype=np.int64)
    width = np.ones(size, dtype=np.uint8)
    for low in (0x80, 0x800, 0x10000):
        width[low:] += 1
    picture = np.zeros(size, dtype=bool)
    picture[0x1F000:0x20000] = picture[0x2600:0x27C0] = picture[0x2B00:0x2C00] = True
    return Tables(one, more_count, more_start, np.array(pool, np.int32), order, joins, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), width, picture)


def _composite(first: np.ndarray, second: np.ndarray, t: Tables) -> np.ndarray:
    """The composite of each pair, 0 where there is none."""
    keys = first.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(t.pairs, keys), len(t.pairs) - 1)
    found = np.where(t.pairs[at] == keys, t.composed[at], 0)
    lv = (first >= LEAD_L) & (first < LEAD_L + 19) & (second >= LEAD_V) & (second < LEAD_V + 21)
    found = np.where(lv, SYLLABLE + ((first - LEAD_L) * 21 + second - LEAD_V) * 28, found)
    lvt = (first >= SYLLABLE) & (first < SYLLABLE + 11172) & ((first - SYLLABLE) % 28 == 0) & (second > LEAD_T) & (second < LEAD_T + 28)
    return np.where(lvt, first + second - LEAD_T, found)


def consistent_points(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points in the consistent form, and the row of each; ``row`` must not decrease."""
    t = tables()
    joiner = np.flatnonzero(points == JOINER)
    kept = np.zeros(0, dtype=np.int64)
    if len(joiner):
        inner = joiner[(joiner > 0) & (joiner < len(points) - 1)]
        before = points[inner - 1]
        selector = (before == 0xFE0F) & (inner > 1)
        before = np.where(selector, points[np.maximum(inner - 2, 0)], before)
        kept = inner[t.picture[before] & t.picture[points[inner + 1]] & (row[inner - 1] == row[inner + 1])]
    feeds = np.zeros(0, dtype=np.int64)
    returns = np.flatnonzero(points == 0x0D)
    if len(returns):
        inner = returns[returns < len(points) - 1]
        feeds = inner[(points[inner + 1] == 0x0A) & (row[inner] == row[inner + 1])]
    new = t.one[points]
    new[kept] = JOINER
    new[feeds] = -1
    counts = t.more_count[points]
    if counts.any():
        times = np.where(counts > 0, counts, 1).astype(np.int64)
        starts = np.cumsum(times) - times
        within = np.arange(int(times.sum())) - np.repeat(starts, times)
        many = np.repeat(counts > 0, times)
        source = np.repeat(points, times)
        out = np.repeat(new, times)
        out[many] = t.pool[t.more_start[source[many]] + within[many]]
        new, row = out, np.repeat(row, times)
    shown = new >= 0
    new, row = new[shown], row[shown]
    return _composed(new, row, t)


def _composed(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition: step k treats the k-th mark of every run at once."""
    marks = np.flatnonzero((t.order[points] > 0) | (t.joins[points] > 0))
    if not len(marks):
        return points, row
    new_run = np.ones(len(marks), dtype=bool)
    new_run[1:] = (np.diff(marks) > 1) | (np.diff(row[marks]) > 0)
    run = np.cumsum(new_run) - 1
    classes = t.order[points[marks]].astype(np.int64)
    # A character of class 0 that may still compose bounds the sort: marks never move across it.
    stretch = np.cumsum(new_run | (classes == 0))
    points = points.copy()
    points[marks] = points[marks][np.lexsort((classes, stretch))]
    classes = t.order[points[marks]].astype(np.int64)
    first_of = np.flatnonzero(new_run)
    nth = np.arange(len(marks)) - first_of[run]
    base = marks[first_of] - 1  # where the starter of each run stands, if it has one
    has_base = (base >= 0) & (row[np.maximum(base, 0)] == row[marks[first_of]])
    last = np.zeros(len(first_of), dtype=np.int64)  # class of the last mark left in place, -1 behind a starter
    last[:] = -1
    gone = np.zeros(len(points), dtype=bool)
    by_step = np.argsort(nth, kind="stable")
    bounds = np.flatnonzero(np.diff(nth[by_step], prepend=-1))
    for chosen in np.split(by_step, bounds[1:]):
        r, at = run[chosen], marks[chosen]
        own = classes[chosen]
        open_ = has_base[r] & np.where(own == 0, last[r] == -1, last[r] < own)
        made = np.where(open_, _composite(points[np.maximum(base[r], 0)], points[at], t), 0)
        yes = made > 0
        points[base[r[yes]]] = made[yes]
        gone[at[yes]] = True
        no = ~yes
        starts = no & (own == 0)
        last[r[no]] = own[no]
        base[r[starts]] = at[starts]
        has_base[r[starts]] = True
        last[r[starts]] = -1
    return points[~gone], row[~gone]


def consistent_array(texts: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string array."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return pa.array([], pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    begins = (raw & 0xC0) != 0x80
    lengths = np.diff(np.concatenate(([0], np.cumsum(begins)))[ends - ends[0]])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.int32)
    row = np.repeat(np.arange(n), lengths)
    points, row = consistent_points(points, row) if len(points) else (points, row)
    width = tables().width[points].astype(np.int64)
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, weights=width, minlength=n).astype(np.int64), out=out[1:])
    body = points.astype(np.int32).tobytes().decode("utf-32-le").encode("utf-8")
    valid = None
    if texts.null_count:
        valid = pa.py_buffer(np.packbits(np.asarray(texts.is_valid()), bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(out.tobytes()), pa.py_buffer(body), valid).cast(pa.string())


def consistent(text: Column | str) -> Column:
    """Column in the consistent form."""

    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield consistent_array(texts)

    form.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(form, "string")(text)


def digests(df: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(id, field, form, value) with 128-bit digests, once each; the only step that reads texts. Null values and ids are left out."""
    forms = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), consistent(f).alias("form")) for f in fields])
    long = df.select(F.col(id).alias("id"), F.explode(forms).alias("v")).select("id", "v.*").where("value is not null and id is not null")

    def digest(name: str) -> Column:
        return F.struct(F.xxhash64(name), F.xxhash64(F.lit("second"), F.col(name)))

    return staged(long.select("id", "field", digest("form").alias("form"), digest("value").alias("value")).distinct())


def alike_pairs(df: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """Pairs (field, id1 < id2) of rows whose values in a field look the same but are not the same string.

    Values are compared within a form only where it has several, so a text copied any number of times forms no pairs with itself.
    Every pair is listed; ``membership`` says the same without any expansion. Null values and null ids take no part.
    """
    long = digests(df, id, fields)
    mixed = long.groupBy("field", "form").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high").select("field", "form")
    long = checkpointed(long.join(mixed, ["field", "form"], "left_semi"))
    x, y = long.alias("x"), long.alias("y")
    met = x.join(y, (F.col("x.field") == F.col("y.field")) & (F.col("x.form") == F.col("y.form")) & (F.col("x.value") != F.col("y.value")) & (F.col("x.id") != F.col("y.id")))
    ids = F.col("x.id"), F.col("y.id")
    return met.select(F.col("x.field").alias("field"), F.least(*ids).alias("id1"), F.greatest(*ids).alias("id2")).distinct()


def membership(df: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """One row for each (``id``, field) with a value: the class of its string, and the group of all that look the same.

    ``class_id`` is the smallest id with the same string, ``copies`` the number of ids with it, ``group_id`` the smallest id whose
    value looks the same, ``spellings`` the number of different strings that do. An id with several values in a field has a row
    for each. Counts are combined before they are shuffled, and no pair is formed, so a common form costs a row for each id.
    """
    long = digests(df, id, fields)
    classes = long.groupBy("field", "form", "value").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    forms = classes.groupBy("field", "form").agg(F.min("class_id").alias("group_id"), F.count("*").alias("spellings"))
    named = long.join(classes, ["field", "form", "value"]).join(forms, ["field", "form"])
    return named.select("field", F.col("id").alias(id), "class_id", "copies", "group_id", "spellings")
