"""Stores, clustered tables, rejected payloads and outcomes."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, review
from threadloom.plans import queries
from threadloom.sources import messages as source
from threadloom.sources import pages as page_source
from threadloom.sources import store

SCHEMA = "conv_id long, turn long, role string, content string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "conv_id long, id string")


def _held(df):
    return sorted((r.conv_id if r.conv_id is not None else -1, r.id) for r in df.collect())


def test_store_replaces_whole_conversations(spark, tmp_path):
    kept = store.GraphStore(spark, str(tmp_path / "s"), buckets=4)
    with pytest.raises(FileNotFoundError):
        kept.read()
    assert kept.write(_rows(spark, (1, "a"), (1, "b"), (2, "c"), (None, "n"))) == 0
    assert kept.write(_rows(spark, (1, "x"), (3, "d"), (None, "m"))) == 1
    assert _held(kept.read()) == [(-1, "m"), (1, "x"), (2, "c"), (3, "d")]
    assert _held(kept.read(0)) == [(-1, "n"), (1, "a"), (1, "b"), (2, "c")]
    assert kept.write(spark.createDataFrame([], "conv_id long, id string")) == 1
    assert kept.vacuum() > 0 and kept.versions() == [1]
    assert _held(kept.read()) == [(-1, "m"), (1, "x"), (2, "c"), (3, "d")]
    assert kept.write(_rows(spark, (2, "z"))) == 2 and (2, "z") in _held(kept.read())


def test_store_only_touches_its_buckets(spark, tmp_path):
    kept = store.GraphStore(spark, str(tmp_path / "s"), buckets=8)
    kept.write(_rows(spark, *[(i, "a") for i in range(40)]))
    before = kept._manifest(0)["folders"]
    kept.write(_rows(spark, (5, "b")))
    after = kept._manifest(1)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_failure_between_the_steps_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    kept = store.GraphStore(spark, str(tmp_path / "s"), buckets=2)
    kept.write(_rows(spark, *[(i, "old") for i in range(10)]))
    whole = _held(kept.read())

    def lost(self, *_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.GraphStore, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            kept.write(_rows(spark, *[(i, "new") for i in range(10)]))
    assert _held(kept.read()) == whole and kept.versions() == [0]
    kept.vacuum()  # takes away what the lost job wrote
    assert _held(kept.read()) == whole
    kept.write(_rows(spark, (3, "new")))
    assert (3, "new") in _held(kept.read()) and (3, "old") not in _held(kept.read())


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    one, two = (store.GraphStore(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    one.write(_rows(spark, (1, "a"), (2, "a")))
    monkeypatch.setattr(two, "versions", lambda: [0])  # began before the next write
    one.write(_rows(spark, (1, "b")))
    with pytest.raises(store.Conflict):
        two.write(_rows(spark, (2, "c")))
    assert _held(one.read()) == [(1, "b"), (2, "a")]


def test_clustered_reviews_need_no_exchange(spark, sf_dir, tmp_path):
    items = graph.numbered(queries.decorated(spark, sf_dir))
    table = store.write_clustered(items, f"items_{uuid.uuid4().hex}", str(tmp_path / "t"), buckets=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (review.counts_of(table), review.degree_of(table), *review.filter_items(table, ["variable", "system"])):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, review.counts_of(table).collect())) == sorted(map(tuple, review.graph_counts(graph.nodes_of(items), graph.edges_of(items)).collect()))


def test_reviews_read_the_messages_once(spark, sf_dir):
    items = graph.numbered(queries.decorated(spark, sf_dir))
    for made in (review.degree_of(items), review.filter_items(items, ["variable"])[1]):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan  # they read stored parts
    for hidden in (["variable"], ["system", "link"], ["task", "artifact"], ["user"], []):
        nodes, edges = review.filter_items(items, hidden)
        want_nodes, want_edges = review.filter_graph(graph.nodes_of(items), graph.edges_of(items), hidden)
        assert sorted(map(str, nodes.collect())) == sorted(map(str, want_nodes.collect()))
        assert sorted(map(str, edges.collect())) == sorted(map(str, want_edges.select(*edges.columns).collect()))


def test_rejected_payloads(spark):
    rows = [(1, '[{"role":"user","content":"a"}]'), (2, "{not json"), (3, None), (4, "[]"), (5, '[{"content":"x"},{"role":""}]'), (6, '[{"role":"user"},{"content":"x"}]'), (7, "")]
    table = spark.createDataFrame(rows, "conv_id long, payload string")
    told = {r.conv_id: r.reason for r in source.malformed(table).collect()}
    assert told == {2: "malformed JSON", 3: "no payload", 4: "no messages", 5: "no roles", 7: "malformed JSON"}
    assert sorted(map(tuple, source.read_messages(table).collect())) == [(1, 0, "user", "a"), (6, 0, "user", "")]
    parsed = source.parsed_messages(table)._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count("from_json") <= 1


def test_latest_snapshot_is_narrow(spark):
    rows = [(1, 5, "b", "wide"), (1, 5, "a", "z"), (1, 4, "z", "z"), (2, None, "n", "n"), (3, 1, "x", "x"), (3, 1, "x", "x"), (None, 2, "q", "q"), (None, 1, "r", "r")]
    shots = spark.createDataFrame(rows, "conv_id long, extracted_at long, graph_json string, other string")
    got = {tuple(r) for r in source.latest_snapshot(shots).collect()}
    assert got == {(1, 5, "b", "wide"), (2, None, "n", "n"), (3, 1, "x", "x"), (None, 2, "q", "q")}
    assert source.latest_snapshot(shots).count() == 4


def test_large_graphs_are_told_apart(spark):
    rows = [(1, i, "user", f"word{chr(97 + i % 26)} number") for i in range(30)] + [(2, 0, "user", "short talk")]
    talks = spark.createDataFrame(rows, SCHEMA)
    told = {r.conv_id: r for r in graph.graph_json_or_reason(talks, max_nodes=10).collect()}
    assert told[1].graph_json is None and told[1].reason == f"Graph too large: {told[1].nodes} nodes"
    assert told[2].reason is None and told[2].graph_json == graph.graph_json(talks.where("conv_id = 2")).first().graph_json
    assert {r.conv_id for r in graph.graph_json(talks, max_nodes=10).collect()} == {2}
    assert {r.conv_id for r in graph.graph_json(talks, max_nodes=None).collect()} == {1, 2}


def test_outcome_of_pages(spark):
    chat = '<main><article data-message-author-role="user">Hello there dear friend</article><article data-message-author-role="assistant">General reply text here</article></main>'
    pasted = "<body>User: What is a join of two tables?<br>Assistant: A pairing of their rows.</body>"
    rows = [(1, "https://chat.example.org", chat), (2, "https://x.example.org", pasted), (3, "https://x.example.org", "<p>Nothing to see</p>"), (4, None, None), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = page_source.extracted(pages)
    told = {r.page_id: r for r in source.extraction_outcome(pages, found).collect()}
    assert {i: (r.status, r.message_count) for i, r in told.items()} == {1: ("ok", 2), 2: ("ok", 2), 3: ("error", 0), 4: ("error", 0), 5: ("error", 0)}
    assert told[3].reason == "No conversation found on this page"
    two = [(r.turn, r.role, r.content) for r in found.where("page_id = 2 and method = 'transcript'").orderBy("turn").collect()]
    assert two == [(0, "user", "What is a join of two tables?"), (1, "assistant", "A pairing of their rows.")]
    assert found.where(F.col("page_id") == 1).where("method = 'transcript'").count() == 0
