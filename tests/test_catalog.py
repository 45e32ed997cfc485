import pytest
from oracle import agree, connection

import __spark_entry__ as contract
from quernstone.plans import catalog


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_agrees_with_sql(name, spark, small):
    agree(catalog.QUERIES[name](spark, small), connection(small), catalog.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_sql_has_rows(name, spark, small):
    df = catalog.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark, small):
    assert contract.entry(spark).columns == ["file_name", "text"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_given_ngrams_are_our_shingles(spark, small):
    given = spark.read.parquet(f"{small}/blocks.parquet").select("block_id", "ngrams").distinct()
    ours = catalog.QUERIES["block_shingles"](spark, small)
    assert given.exceptAll(ours).count() == 0 == ours.exceptAll(given).count()


def test_batch_and_streams_give_the_same_corpus(spark, small):
    batch, stream = (catalog.QUERIES[n](spark, small) for n in ("wiki_corpus", "streamed_corpus"))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
