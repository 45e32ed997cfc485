"""Row functions on strings as Arrow column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def string_column(function: Callable[[str], str], text: Column | str) -> Column:
    """``function`` over a string column, in Arrow batches; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else function(t) for t in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)
