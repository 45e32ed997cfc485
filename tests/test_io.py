import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.functions.text import xml_escaped
from quernstone.operators.tokenize import json_line
from quernstone.plans.lineage import checkpointed, shared_dir, staged
from quernstone.operators.messages import topic_sizes
from quernstone.sources import files, sinks, web
from quernstone.sources.streams import FolderTopic, KafkaTopic, as_messages, folder_offsets, kafka_offsets
from quernstone.streaming import retry, stages

TEXTS = {"漢字 a%b_1.txt": "内容\r\nx\n", "plain.txt": "", "b.txt": "tab\t"}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([*TEXTS.items(), (None, "lost")], "file_name string, text string")
    sinks.write_files(rows, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(TEXTS)
    back = files.whole_files(spark, f"{tmp_path}/out/*")
    assert {r.file_name: r.text for r in back.collect()} == {k: v for k, v in TEXTS.items() if v}


def test_xml_pages(spark, tmp_path, one):
    title = "a < b & \"c\" 'd'"
    page = "<page><title>{}</title><revision><text{}>{}</text></revision></page>"
    body = page.format(one(xml_escaped, title), ' lang="zh"', "x\ny") + page.format("plain", "", "z") + "<page><title>none</title><revision></revision></page>"
    (tmp_path / "dump.xml").write_text(f"<wikipedia>{body}</wikipedia>", encoding="utf-8")
    rows = {r.title: (r.text, r.lang) for r in files.dump_pages(spark, f"{tmp_path}/dump.xml").collect()}
    assert rows == {title: ("x\ny", "zh"), "plain": ("z", None), "none": (None, None)}


def test_token_sink(spark, tmp_path):
    rows = spark.createDataFrame([("f_0", [1, 2]), ("f_1", [])], "block_id string, tokens array<int>")
    sinks.write_tokens(rows, f"{tmp_path}/t")
    sinks.write_tokens(rows.limit(0), f"{tmp_path}/t")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert sorted(lines) == sorted(json_line(r.block_id, r.tokens) for r in rows.collect())


def test_snapshot_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    sinks.write_snapshot(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
    reason = F.when(F.col("t").isNull(), "no text")
    assert [tuple(r) for r in sinks.rejected(rows, reason).collect()] == [("no text", 1)]


def test_lineage(spark):
    assert shared_dir(spark)
    rows = spark.range(5).withColumn("x", F.rand())
    kept, table = checkpointed(rows), staged(rows)
    assert kept.collect() == kept.collect() and sorted(table.collect()) == sorted(table.collect())


@pytest.fixture
def fake_fetch():
    """A service; defined inside, so that workers get it by value."""

    def fetch(url, data):
        if "missing" in url:
            return ""
        if "broken" in url:
            raise ConnectionError("down")
        return json.dumps({"items": [{"views": 2}, {"views": 5}]}) if data is None else json.dumps({"parse": {"text": {"*": "<p>a\nb</p>"}}})

    return fetch


def test_page_views(spark, fake_fetch):
    titles = spark.createDataFrame([("a/b",), ("missing",), ("broken",), (None,)], "title string")
    quick = retry.Backoff(sleep=lambda s: None)
    rows = {r.title: (r.views, r.status) for r in web.page_views(titles, "http://x", "20240101", "20250101", fake_fetch, quick).collect()}
    assert rows == {"a/b": (7, None), "missing": (0, None), "broken": (0, "ConnectionError: down"), None: (0, None)}


def test_rendered_pages(spark, fake_fetch):
    rows = web.rendered_pages(spark.createDataFrame([("t", "x")], "title string, text string"), "http://x", fake_fetch).collect()
    assert [tuple(r) for r in rows] == [("t", "<p>a b</p>", None)]


@pytest.mark.parametrize("failures, works", [(0, True), (4, True), (5, False)])
def test_backoff(failures, works):
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) <= failures:
            raise ConnectionError
        return "ok"

    backoff = retry.backoff("exponential", sleep=waits.append)
    if works:
        assert backoff.call(call) == "ok"
    else:
        with pytest.raises(ConnectionError):
            backoff.call(call)
    assert waits == [2, 4, 8, 16][: min(failures, 4)]


def test_backoff_raises_other_errors_at_once():
    waits = []
    with pytest.raises(KeyError):
        retry.Backoff(sleep=waits.append).call(lambda: {}["x"])
    assert not waits
    assert retry.of_types(KeyError)(KeyError()) and retry.of_modules("json")(json.JSONDecodeError("x", "", 0))
    with pytest.raises(ValueError):
        retry.backoff("none")


def test_chain_takes_each_message_once(spark, tmp_path):
    first = FolderTopic(f"{tmp_path}/pages", most=1)
    chain, last = stages.wiki_chain(str(tmp_path), first)
    for k in range(3):
        first.write(as_messages(spark.createDataFrame([(f"t{k}", f"lead {k}\n== H ==\n* a")], "title string, text string").coalesce(1)))
    first.write(as_messages(spark.createDataFrame([("R", "#REDIRECT [[x]]")], "title string, text string")))
    counts = stages.run_chain(spark, chain)
    assert [c["rows"] for c in counts] == [4, 3, 3]
    again = stages.run_chain(spark, chain)
    assert [c["rows"] for c in again] == [0, 0, 0]
    rows = {r.key: r.value for r in spark.read.parquet(last.path).collect()}
    assert rows["t1"] == "lead 1\n\n## H\n\n- a\n" and set(rows) == {"t0", "t1", "t2"}


def test_kafka_needs_its_connector(spark):
    topic = KafkaTopic("localhost:9092", "t")
    with pytest.raises(Exception, match="(?i)kafka"):
        topic.read(spark)


def test_files_of_one_name_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "file_name string, text string")
    with pytest.raises(ValueError, match="one file name"):
        sinks.write_files(rows, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_unknown_file_systems_raise(spark):
    with pytest.raises(Exception, match="(?i)scheme|filesystem|recogni"):
        sinks.write_files(spark.createDataFrame([("a", "x")], "file_name string, text string"), "nowhere://host/out")
    assert not os.path.exists("nowhere:")


def test_http_statuses():
    """A page that isn't there has an empty body at once; a busy service is a network error, which is tried again."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(int(self.path[1:4]))
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    at, waits = f"http://127.0.0.1:{server.server_port}", []
    try:
        again = retry.Backoff(attempts=3, sleep=waits.append)
        assert again.call(lambda: web.http_fetch(f"{at}/200")) == "body"
        assert again.call(lambda: web.http_fetch(f"{at}/404")) == "" and not waits
        for busy in (429, 503):
            waits.clear()
            with pytest.raises(ConnectionError):
                again.call(lambda busy=busy: web.http_fetch(f"{at}/{busy}"))
            assert waits == [2, 4]
    finally:
        server.shutdown()


def test_backoffs_by_name_differ():
    waits = []
    for name, tries in (("exponential", 2), ("network", 1)):
        calls = []

        def call(calls=calls):
            calls.append(1)
            raise KeyError

        with pytest.raises(KeyError):
            retry.backoff(name, attempts=2, sleep=waits.append).call(call)
        assert len(calls) == tries


def test_a_chain_counts_rows_of_many_batches(spark, tmp_path):
    """A query remembers its last micro-batches only; all of them are counted."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        first, last = FolderTopic(f"{tmp_path}/a", most=1), FolderTopic(f"{tmp_path}/b")
        for k in range(6):
            first.write(as_messages(spark.createDataFrame([(f"t{k}", "x")], "title string, text string").coalesce(1)))
        stage = stages.Stage("copy", first, last, lambda pages: pages, f"{tmp_path}/positions")
        assert stages.run_chain(spark, [stage]) == [{"stage": "copy", "rows": 6}]
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_a_topic_grows_with_each_message(spark, tmp_path):
    topic = FolderTopic(f"{tmp_path}/t")
    assert not topic.exists(spark) and topic.size(spark) == 0
    topic.create(spark)
    topic.create(spark)
    assert topic.exists(spark) and topic.size(spark) == 0
    for k in range(10):
        topic.write(as_messages(spark.createDataFrame([(f"t{k}", "x")], "title string, text string").coalesce(1)))
        assert topic.size(spark) == k + 1
    lag = topic_sizes(folder_offsets(spark, {"t": topic}, {"t": 4})).first()
    assert tuple(lag) == ("t", 10, 6)
    topic.delete(spark)
    topic.delete(spark)
    assert not topic.exists(spark)


def test_offsets_of_kafka_queries(spark):
    progress = [{"sources": [{"description": "Kafka", "endOffset": '{"t":{"0":4,"1":2}}', "latestOffset": '{"t":{"0":9,"1":2}}'}]}]
    assert sorted(map(tuple, kafka_offsets(spark, progress, {"t": {"0": 1}}).collect())) == [("t", 0, 1, 9, 4), ("t", 1, 0, 2, 2)]
    assert tuple(topic_sizes(kafka_offsets(spark, progress)).first()) == ("t", 11, 5)
    assert kafka_offsets(spark, []).count() == 0


def test_stages_side_by_side(spark, tmp_path):
    first = FolderTopic(f"{tmp_path}/pages")
    chain, last = stages.wiki_chain(str(tmp_path), first)
    first.write(as_messages(spark.createDataFrame([(f"t{k}", f"lead {k}") for k in range(5)] + [("R", "#REDIRECT [[x]]")], "title string, text string")))
    assert [c["rows"] for c in stages.run_together(spark, chain)] == [6, 5, 5]
    assert last.size(spark) == 5 and not spark.streams.active
