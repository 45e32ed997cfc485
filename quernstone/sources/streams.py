"""Message streams: Kafka, or a folder with the same columns where there is no broker."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MESSAGE_SCHEMA = "key string, value string"


@dataclass(frozen=True)
class KafkaTopic:
    """A topic of string messages. ``most`` bounds what one micro-batch takes in, which is all the backpressure needed."""

    servers: str
    topic: str
    most: int = 10_000

    def read(self, spark: SparkSession) -> DataFrame:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", self.topic)
        stream = stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", self.most).load()
        return stream.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")

    def sink(self, messages: DataFrame) -> DataStreamWriter:
        return messages.writeStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic)

    def write(self, messages: DataFrame) -> None:
        messages.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic).save()


@dataclass(frozen=True)
class FolderTopic:
    """The same on a shared folder of Parquet files; each file is delivered once to each query."""

    path: str
    most: int = 100

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", self.most).parquet(self.path)

    def sink(self, messages: DataFrame) -> DataStreamWriter:
        return messages.writeStream.format("parquet").option("path", self.path).outputMode("append")

    def write(self, messages: DataFrame) -> None:
        messages.write.mode("append").parquet(self.path)

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def create(self, spark: SparkSession) -> None:
        """Makes the empty topic; nothing happens to one that is there."""
        files, path = self._files(spark)
        files.mkdirs(path)

    def delete(self, spark: SparkSession) -> None:
        """Deletes the topic with its messages; nothing happens where there is none."""
        files, path = self._files(spark)
        files.delete(path, True)

    def exists(self, spark: SparkSession) -> bool:
        files, path = self._files(spark)
        return files.exists(path)

    def size(self, spark: SparkSession) -> int:
        """Number of messages, from the footers of the files."""
        return spark.read.schema(MESSAGE_SCHEMA).parquet(self.path).count() if self.exists(spark) else 0


OFFSETS_SCHEMA = "topic string, p int, earliest bigint, latest bigint, committed bigint"


def kafka_offsets(spark: SparkSession, progress: Iterable[dict], first: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(topic, p, earliest, latest, committed) of the partitions that the last progress of Kafka queries names, for
    ``messages.topic_sizes``; ``first`` holds the earliest offsets by topic and partition (0 where it names none)."""
    rows: dict[tuple[str, str], tuple] = {}
    for one in progress:
        for source in one["sources"]:
            ends, latest = (json.loads(source[k]) if isinstance(source.get(k), str) else source.get(k) or {} for k in ("endOffset", "latestOffset"))
            for topic, partitions in {**ends, **latest}.items():
                for p, there in partitions.items():
                    rows[topic, p] = topic, int(p), (first or {}).get(topic, {}).get(p, 0), there, ends.get(topic, {}).get(p)
    return spark.createDataFrame(list(rows.values()), OFFSETS_SCHEMA)


def folder_offsets(spark: SparkSession, topics: dict[str, FolderTopic], taken: dict[str, int]) -> DataFrame:
    """The same of folders, a partition each: their messages, and how many of them have been taken in by the stage that reads them."""
    return spark.createDataFrame([(name, 0, 0, topic.size(spark), taken.get(name)) for name, topic in topics.items()], OFFSETS_SCHEMA)


def as_messages(pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    return pages.select(F.col(title).alias("key"), F.col(text).alias("value"))


def as_pages(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("key").alias("title"), F.col("value").alias("text"))
