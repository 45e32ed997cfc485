"""Shapes of the plans that matter at scale."""

import pytest

from quernstone.llm import catalog, lookalike, quality, split, tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, small, *columns):
    return spark.read.parquet(f"{small}/documents.parquet").select(*columns)


def test_encoding_moves_nothing(spark, small):
    shape = plan(tokens.encode(documents(spark, small, "doc_id", "text")))
    assert "Exchange" not in shape and "source" not in shape.split("ReadSchema")[1].split("\n")[0]


def test_statistics_move_without_texts(spark, small):
    words = quality.vocabulary(spark.read.parquet(f"{small}/common_words.parquet"))
    shape = plan(quality.statistics(spark.read.parquet(f"{small}/corpus_files.parquet"), "file_name", "text", words))
    assert shape.count("Exchange hashpartitioning") == 1 and shape.index("MapInArrow") > shape.index("Exchange hashpartitioning")


def test_splitting_moves_each_text_once(spark, small):
    shape = plan(split.split(spark.read.parquet(f"{small}/corpus_files.parquet"), "file_name", "text", "t", split.Limit(100)))
    assert shape.count("Exchange") == 1


def test_the_form_of_a_column_is_one_pass(spark, small):
    shape = plan(spark.read.parquet(f"{small}/wiki_pages.parquet").select(lookalike.consistent("text")))
    assert "Exchange" not in shape and shape.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.endswith("_found")])
def test_nothing_is_gathered_in_one_task_or_crossed(spark, small, name):
    shape = plan(catalog.QUERIES[name](spark, small))
    assert "SinglePartition" not in shape and "CartesianProduct" not in shape and "BroadcastNestedLoopJoin" not in shape
