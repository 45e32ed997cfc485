"""Web services as table functions: bodies are fetched once a row in the Python workers, and parsed in the JVM.

Page views belong into a table that is joined; these functions fill it. ``fetch`` can be replaced, as tests do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.messages import parsed_page, response_views
from quernstone.streaming.retry import Backoff

Fetch = Callable[[str, bytes | None], str]
HTTP_OK, TOO_MANY, SERVER_ERRORS = 200, 429, 500


def http_fetch(url: str, data: bytes | None = None, timeout: float = 30.0) -> str:
    """Body of an answer; any status but 200 gives an empty body. A service that is busy or broken (429, 5xx) is a network error."""
    try:
        with urlopen(Request(url, data=data, headers={"User-Agent": "quernstone"}), timeout=timeout) as answer:
            return answer.read().decode("utf-8") if answer.status == HTTP_OK else ""
    except HTTPError as error:
        with error:
            if error.code == TOO_MANY or error.code >= SERVER_ERRORS:
                raise ConnectionError(f"status {error.code}") from error
            return ""


def fetched(df: DataFrame, key: str, request: Callable[[dict], tuple[str, bytes | None]], fetch: Fetch = http_fetch, backoff: Backoff = Backoff()) -> DataFrame:
    """``df`` with the ``body`` of each row's request and a ``status`` (null, or the error after the last attempt).

    Failures keep their row, so nothing is lost silently.
    """
    columns = [c for c in df.columns if c not in ("body", "status")]
    rows = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, states = [], []
            for row in batch.to_pylist():
                body = status = None
                if row[key] is not None:
                    try:
                        body = backoff.call(lambda row=row: fetch(*request(row)))
                    except Exception as error:  # noqa: BLE001 - the error is the result of this row
                        status = f"{type(error).__name__}: {error}"
                bodies.append(body)
                states.append(status)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(states, pa.string())], names=[*columns, "body", "status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, body string, status string")


def page_views(titles: DataFrame, endpoint: str, first_day: str, last_day: str, fetch: Fetch = http_fetch, backoff: Backoff = Backoff()) -> DataFrame:
    """(title, views, status): monthly views between two days (``yyyyMMdd``), summed."""

    def request(row: dict) -> tuple[str, None]:
        return f"{endpoint}/{quote(row['title'], safe='')}/monthly/{first_day}/{last_day}", None

    answers = fetched(titles.select("title").distinct(), "title", request, fetch, backoff)
    return answers.select("title", response_views("body").alias("views"), "status")


def rendered_pages(pages: DataFrame, endpoint: str, fetch: Fetch = http_fetch, backoff: Backoff = Backoff()) -> DataFrame:
    """(title, html, status): wikitext rendered by a service; errors of the service are statuses, not empty pages."""

    def request(row: dict) -> tuple[str, bytes]:
        form = {"action": "parse", "format": "json", "contentmodel": "wikitext", "prop": "text", "text": row["text"]}
        return endpoint, urlencode(form).encode("utf-8")

    answers = fetched(pages.select("title", "text"), "text", request, fetch, backoff).withColumn("page", parsed_page("body"))
    return answers.select("title", F.col("page.html").alias("html"), F.coalesce("status", "page.error").alias("status"))
