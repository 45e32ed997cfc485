"""Conversations, responses of web services, and positions of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat format.
END, END_OF_TEXT, ROLES = "<|end|>\n", "<|endoftext|>", ("system", "user", "assistant")


def chat_text(turns: Column, generate: bool = False) -> Column:
    """Text of an array of (turn, role, text) structs, in the order of turns; other roles are left out."""
    known = F.filter(F.array_sort(turns), lambda t: t["role"].isin(*ROLES))
    said = F.transform(known, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit(END)))
    return F.concat(F.array_join(said, ""), F.lit("<|assistant|>\n" if generate else END_OF_TEXT))


def chats(turns: DataFrame, conversation: str, generate: bool = False) -> DataFrame:
    """(conversation, text) from one row a turn (turn, role, text); a conversation is bounded by what a context holds."""
    return turns.groupBy(conversation).agg(chat_text(F.collect_list(F.struct("turn", "role", "text")), generate).alias("text"))


PARSE_SCHEMA = "parse struct<text: struct<`*`: string>>, error struct<code: string, info: string>"
VIEWS_SCHEMA = "items array<struct<views: bigint>>"


def parsed_page(body: Column | str) -> Column:
    """HTML and error code of a parse response; line breaks become blanks, so words don't run together."""
    answer = F.from_json(body, PARSE_SCHEMA)
    return F.struct(F.replace(answer["parse"]["text"]["*"], F.lit("\n"), F.lit(" ")).alias("html"), answer["error"]["code"].alias("error"))


def response_views(body: Column | str) -> Column:
    """Sum of the views of a page-view response; 0 without items."""
    items = F.coalesce(F.from_json(body, VIEWS_SCHEMA)["items"], F.array().cast("array<struct<views: bigint>>"))
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, i: total + F.coalesce(i["views"], F.lit(0)))


def topic_sizes(offsets: DataFrame) -> DataFrame:
    """(topic, size, lag) from one row a partition (topic, earliest, latest, committed).

    A partition without a committed position has all its records still to come.
    """
    held = F.col("latest") - F.col("earliest")
    return offsets.groupBy("topic").agg(F.sum(held).alias("size"), F.sum(F.col("latest") - F.coalesce("committed", "earliest")).alias("lag"))
