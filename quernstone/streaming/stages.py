"""Stages that pass messages on: each reads a topic, transforms, and writes another, and ends when its input is used up."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quernstone.functions import html, render
from quernstone.functions import text as T
from quernstone.functions.script import simplification
from quernstone.operators import pages as P
from quernstone.plans.lineage import own_folder
from quernstone.sources.streams import MESSAGE_SCHEMA, FolderTopic, KafkaTopic, as_messages, as_pages

Topic = FolderTopic | KafkaTopic
Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``transform`` takes pages (title, text) and gives pages; ``folder`` keeps the positions, so a restart goes on."""

    name: str
    source: Topic
    target: Topic
    transform: Transform
    folder: str

    def start(self, spark: SparkSession, until_used_up: bool = True, every: str = "5 seconds") -> StreamingQuery:
        messages = as_messages(self.transform(as_pages(self.source.read(spark))))
        writer = self.target.sink(messages).option("checkpointLocation", f"{self.folder}/{self.name}").queryName(self.name)
        return (writer.trigger(availableNow=True) if until_used_up else writer.trigger(processingTime=every)).start()


def run_chain(spark: SparkSession, stages: list[Stage]) -> list[dict]:
    """The stages one after another, each over all that its topic holds; returns rows taken in by each."""
    done = []
    counted = _Rows()
    spark.streams.addListener(counted)
    try:
        for stage in stages:
            query = stage.start(spark)
            query.awaitTermination()
            done.append({"stage": stage.name, "rows": counted.of(str(query.runId))})
    finally:
        spark.streams.removeListener(counted)
    return done


def run_together(spark: SparkSession, stages: list[Stage], every: str = "1 second") -> list[dict]:
    """The stages side by side, each taking in what the one before has written; they end in their order when all is used up.

    Every stage runs on until the one before has ended and it has caught up; then it takes what is left and stops.
    """
    for stage in stages:
        if isinstance(stage.source, FolderTopic):
            stage.source.create(spark)
    counted = _Rows()
    spark.streams.addListener(counted)
    running = [stage.start(spark, until_used_up=False, every=every) for stage in stages]
    done = []
    try:
        for stage, query in zip(stages, running):
            query.processAllAvailable()
            query.stop()
            done.append({"stage": stage.name, "rows": counted.of(str(query.runId))})
    finally:
        for query in running:
            query.stop()
        spark.streams.removeListener(counted)
    return done


class _Rows(StreamingQueryListener):
    """Adds up what every run takes in (a query itself remembers its last micro-batches only)."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.changed:
            run = str(event.progress.runId)
            self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, run: str, patience: float = 60.0) -> int:
        """Rows of a run that has ended; its last event comes after its progress."""
        with self.changed:
            self.changed.wait_for(lambda: run in self.ended, patience)
            return self.rows.get(run, 0)


def render_locally(pages: DataFrame) -> DataFrame:
    return pages.select("title", render.html_column("text").alias("text"))


def markdown(pages: DataFrame, simplify: tuple[str, str] | None = None) -> DataFrame:
    return pages.select("title", T.simplified(html.markdown_column("text"), simplify or simplification(pages.sparkSession)).alias("text"))


def clean_wikitext(pages: DataFrame) -> DataFrame:
    return P.cleaned(P.articles(pages))


def wiki_chain(root: str, first: Topic, most: int = 100, simplify: tuple[str, str] | None = None) -> tuple[list[Stage], FolderTopic]:
    """Wikitext -> clean wikitext -> HTML -> Markdown in simplified characters on folders below ``root``; the last topic holds the result."""
    topics = [first, *(FolderTopic(f"{root}/{name}", most) for name in ("wikitext", "html", "markdown"))]
    steps: list[Transform] = [clean_wikitext, render_locally, partial(markdown, simplify=simplify)]
    names = ("clean_wikitext", "render", "markdown")
    return [Stage(n, a, b, f, f"{root}/positions") for n, a, b, f in zip(names, topics, topics[1:], steps)], topics[-1]


def traced_chain(spark: SparkSession, pages: DataFrame) -> tuple[dict[str, FolderTopic], dict[str, int]]:
    """The chain over a table of pages: its topics by name, and how many messages of each the next stage has taken in."""
    root = own_folder(spark, "chain")
    first = FolderTopic(f"{root}/pages")
    first.write(as_messages(pages))
    chain, last = wiki_chain(root, first)
    rows = {one["stage"]: one["rows"] for one in run_chain(spark, chain)}
    topics = {stage.source.path.rsplit("/", 1)[-1]: stage.source for stage in chain} | {last.path.rsplit("/", 1)[-1]: last}
    return topics, {stage.source.path.rsplit("/", 1)[-1]: rows[stage.name] for stage in chain}


def streamed_corpus(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The chain over a table of pages: (file_name, text) of its last topic."""
    last = traced_chain(spark, pages)[0]["markdown"]
    return as_pages(spark.read.schema(MESSAGE_SCHEMA).parquet(last.path)).select(T.file_name("title").alias("file_name"), F.col("text"))
