"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.rules import SIMPLIFIED, TRADITIONAL

#: A gram: a run of ASCII letters and digits, or any other character that is not white space.
GRAM = r"[A-Za-z0-9]+|[^A-Za-z0-9\p{IsWhite_Space}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded(content: Column | str) -> Column:
    """Text of UTF-8 bytes; null bytes give an empty text."""
    return F.coalesce(F.decode(_col(content), "UTF-8"), F.lit(""))


def grams(text: Column | str, keep_trailing: bool = True) -> Column:
    """Grams in order. Without ``keep_trailing`` a run at the very end of the text is left out."""
    text = _col(text)
    return F.regexp_extract_all(text if keep_trailing else F.regexp_replace(text, r"[A-Za-z0-9]+\z", ""), F.lit(GRAM), F.lit(0))


def shingles(grams_: Column | str, k: int) -> Column:
    """Runs of ``k`` grams joined by a blank, in order, with repeats; empty where there are fewer than ``k``."""

    def of(held: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(held) - k + 1), lambda i: F.array_join(F.slice(held, i, k), " "))
        return F.when(F.size(held) >= k, runs).otherwise(F.array().cast("array<string>"))

    # As a lambda variable the grams are computed once; written out they would be computed again for every shingle.
    return F.element_at(F.transform(F.array(_col(grams_)), of), 1)


def chapter_blocks(text: Column | str) -> Column:
    """The text cut before each run of two or more ``#``; what stands before the first run is the first block."""
    text = _col(text)
    parts = F.split(text, "(?<!#)(?=##)", -1)
    # No split has an empty part before a place without width.
    return F.when(text.startswith("##"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def length_blocks(text: Column | str, size: int = 1000) -> Column:
    """Consecutive slices of ``size`` characters (one empty slice of an empty text, none of a null)."""
    text = _col(text)
    starts = F.when(text.isNotNull(), F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))


#: Block functions by name.
BLOCKERS = {"chapter": chapter_blocks, "length": length_blocks}


def blocker(name: str):
    try:
        return BLOCKERS[name]
    except KeyError:
        raise ValueError(f"no blocker {name!r}; there are {', '.join(BLOCKERS)}") from None


def file_name(title: Column | str, pipes_in_pairs: bool = False) -> Column:
    """The file name of a title: characters that file systems refuse become ``_``.

    With ``pipes_in_pairs`` only two pipes together are replaced, and backslashes stay.
    """
    refused = r'[<>:"/?*]|\|\|' if pipes_in_pairs else r'[<>:"/?*|\\]'
    return F.concat(F.regexp_replace(_col(title), refused, "_"), F.lit(".txt"))


def is_redirect(text: Column | str) -> Column:
    """Whether a redirect marker stands anywhere in the page."""
    return F.lower(_col(text)).rlike("#redirect|#重定向")


def without_refs_and_comments(text: Column | str, single_line_comments: bool = False) -> Column:
    """The wikitext without comments and references.

    With ``single_line_comments`` the pattern (a fixed value) works in one pass as it was first published: comments that span lines stay, and
    a self-closing reference swallows what follows up to the next end tag.
    """
    text = _col(text)
    if single_line_comments:
        return F.regexp_replace(text, r"<!--.*?-->|(?s)<ref.*?>.*?</ref>|<ref.*?/>", "")
    return F.regexp_replace(text, r"(?s)<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<references\b[^<>]*/?>", "")


def simplified(text: Column | str, table: tuple[str, str] = (TRADITIONAL, SIMPLIFIED)) -> Column:
    """Traditional characters replaced by simplified ones, one for one; ``table`` may be a fuller one than that of ``rules``."""
    return F.translate(_col(text), *table)


def stripped(text: Column | str) -> Column:
    """The text without white space at its ends (in Unicode's sense)."""
    return F.regexp_replace(_col(text), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def visible_length(text: Column | str) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(_col(text), r"\s", ""))


def squeezed(text: Column | str) -> Column:
    """Leading blank lines dropped, runs of blank lines made one, every line ended."""
    ended = F.regexp_replace(F.regexp_replace(_col(text), r"\n+\z", ""), r"\z", "\n")
    no_lead = F.regexp_replace(ended, r"\A(?:[^\S\n]*\n)+", "")
    return F.regexp_replace(F.regexp_replace(no_lead, r"\n(?:[^\S\n]*\n){2,}", "\n\n"), r"\n[^\S\n]+\n", "\n\n")


def without_edit_links(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("[编辑]"), F.lit(""))


def without_empty_chapters(markdown: Column | str) -> Column:
    """Markdown without the headings (of two or more ``#``) that no text follows before the next heading."""
    parts = F.split(_col(markdown), r"(?m)(?=^##+ [^\n]*(?:\n|\z))", -1)
    full = F.filter(parts, lambda p: F.length(F.trim(F.regexp_replace(p, r"(?m)^##+ [^\n]*(?:\n|\z)|\s", ""))) > 0)
    return F.array_join(full, "")


def one_year_range(today: Column | None = None) -> tuple[Column, Column]:
    """First and last day of the year up to ``today`` as ``yyyyMMdd``."""
    today = F.current_date() if today is None else today
    return F.date_format(F.add_months(today, -12), "yyyyMMdd"), F.date_format(today, "yyyyMMdd")


def form_encoded(fields: dict[str, Column | str]) -> Column:
    """``name=value`` pairs with URL-encoded values, joined by ``&``."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(_col(v))) for k, v in fields.items()])


def xml_escaped(text: Column | str) -> Column:
    text = _col(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
