"""The batch pipeline from a page dump to tokens, as one plan a step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quernstone.functions import html, render
from quernstone.functions import text as T
from quernstone.functions.script import simplification
from quernstone.operators import dedup, pages, tokenize
from quernstone.operators.minhash import LshConfig


@dataclass(frozen=True)
class PipelineConfig:
    lsh: LshConfig = dedup.STAGE
    blocker: str = "chapter"
    only_popular: bool = False
    #: Traditional characters and their simplified forms; None stands for all that ICU knows.
    simplify: tuple[str, str] | None = None


def corpus(wiki: DataFrame, config: PipelineConfig = PipelineConfig(), views: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """(file_name, text) in Markdown and simplified characters from pages (title, text); ``views`` (title, views) is needed for popular pages only."""
    kept = pages.articles(wiki, done)
    if config.only_popular:
        if views is None:
            raise ValueError("popular pages need a table of views")
        kept = pages.popular(kept, views)
    rendered = pages.cleaned(kept).select("title", render.html_column("text").alias("html"))
    return rendered.select(T.file_name("title").alias("file_name"), T.simplified(html.markdown_column("html"), config.simplify or simplification(wiki.sparkSession)).alias("text"))


def training_tokens(files: DataFrame, tokenizer: tokenize.TokenizerConfig, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(block_id, tokens) of the files' blocks without near-duplicates."""
    return tokenize.tokenized_blocks(dedup.deduplicated(files, config.lsh, config.blocker), tokenizer, config.blocker)
