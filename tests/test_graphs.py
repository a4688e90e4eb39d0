"""Whole conversations: hand-derived graph, invariants, payloads, stores and the stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import graph, payloads, review
from threadloom.plans import queries
from threadloom.sources import messages as source
from threadloom.streaming import graph_stream

SCHEMA = "conv_id long, turn long, role string, content string"
TALK = [
    (1, 0, "user", "How do Spark joins partition data?"),
    (1, 1, "assistant", 'See [docs](https://spark.apache.org/docs).\n```python\ndf.join(other, "key")\n```\nSpark joins shuffle data.'),
    (1, 2, "user", "Thanks, partition data again. Spark joined it."),
]
NODES = [
    ("t0", None, "How do Spark joins partition data?"), ("a0", "variable", "Spark Joins"), ("a1", "variable", "Partition Data"),
    ("t1", None, "See [docs](https://spark.apache.org/docs).\n\nSpark joins shuffle data."), ("a2", "code", 'df.join(other, "key")'),
    ("a3", "link", "https://spark.apache.org/docs"), ("a4", "variable", "Docs"), ("a5", "variable", "Spark Apache"), ("a6", "variable", "Org Docs"),
    ("a7", "variable", "Join"), ("t2", None, "Thanks, partition data again. Spark joined it."), ("a8", "variable", "Thanks Partition"), ("a9", "variable", "Data Spark"),
]
EDGES = "t0>a0 t0>a1 t0>t1 t1>a2 t1>a3 t1>a4 t1>a5 t1>a6 t1>a7 t1>a0 t1>t2 t2>a8 t2>a9 t2>a7".split()


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(TALK, SCHEMA)


def test_known_graph(talk):
    nodes = graph.graph_nodes(talk).orderBy("node_seq").collect()
    assert [(n.id, n.subtype, n.content) for n in nodes] == NODES
    assert next(n for n in nodes if n.id == "a2").language == "python"
    edges = graph.graph_edges(talk).orderBy("edge_seq").collect()
    assert [f"{e.source}>{e.target}" for e in edges] == EDGES


def test_review_of_known_graph(talk):
    nodes, edges = graph.graph_nodes(talk), graph.graph_edges(talk)
    degree = {r.id: r.degree for r in review.node_degree(nodes, edges).collect()}
    assert degree.pop("t0") == 3 and degree.pop("t1") == 9 and degree.pop("t2") == 4 and degree.pop("a0") == 2 and degree.pop("a7") == 2
    assert set(degree.values()) == {1}
    kept, left = review.filter_graph(nodes, edges, ["variable", "user"])
    assert {r.id for r in kept.collect()} == {"t0", "t1", "t2", "a2", "a3"}
    assert sorted(r.relation for r in left.collect()) == ["contains", "references", "sequence", "sequence"]


def test_payloads(spark):
    hi = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA)
    text = payloads.clipboard_payload(graph.graph_struct(hi)).first().payload
    body = '{\n  "nodes": [\n    {\n      "id": "t0",\n      "type": "task",\n      "role": "user",\n      "content": "hi"\n    }\n  ],\n  "edges": []\n}\n'
    assert text == payloads.CLIPBOARD_PREAMBLE + body
    odd = spark.createDataFrame([(1, 0, "", 'a "quoted" \\ tab\t')], SCHEMA)
    told = json.loads(graph.graph_json(odd).first().graph_json)
    assert told["nodes"][0] == {"id": "t0", "type": "task", "content": 'a "quoted" \\ tab\t'}
    asked = spark.createDataFrame([(1, "other"), (2, "claude"), (3, None)], "conv_id long, target string")
    got = {r.conv_id: (r.url, r.reason) for r in payloads.route_payloads(asked).collect()}
    assert got[1] == (None, "Unknown platform: other") and got[2] == ("https://claude.ai/new", None) and got[3][0] is None


def test_invariants(spark, sf_dir):
    talks = queries.decorated(spark, sf_dir)
    nodes, edges = graph.graph_nodes(talks).collect(), graph.graph_edges(talks).collect()
    ids = {(n.conv_id, n.id) for n in nodes}
    assert len(ids) == len(nodes)
    assert all((e.conv_id, e.source) in ids and (e.conv_id, e.target) in ids for e in edges)
    by_conv: dict = {}
    for n in nodes:
        by_conv.setdefault(n.conv_id, []).append(n)
    for rows in by_conv.values():
        for letter in "ta":
            numbers = sorted(int(n.id[1:]) for n in rows if n.id[0] == letter)
            assert numbers == list(range(len(numbers)))
    assert sum(e.relation == "sequence" for e in edges) == talks.count() - len(by_conv)
    named = {(e.conv_id, e.target) for e in edges if e.relation == "mentions"}
    assert all((n.conv_id, n.id) in named for n in nodes if n.subtype == "variable")
    back, _ = source.read_graph_json(graph.graph_json(talks))
    assert sorted(map(str, back.select("conv_id", "node_seq", "id", "content").collect())) == sorted(map(str, [__import__("pyspark").sql.Row(conv_id=n.conv_id, node_seq=n.node_seq, id=n.id, content=n.content) for n in nodes]))
    shuffled = graph.graph_edges(talks.orderBy("content").repartition(3)).collect()
    assert sorted(shuffled) == sorted(edges)


def test_read_messages(spark):
    rows = [
        (1, '[{"content":"x"},{"role":"","content":"y"},{"role":"user","content":"","z":"1"}]'), (2, "not json"), (3, None), (4, "[]"),
        (5, '[{"role":"user","role":"assistant","content":"a"}]'),
    ]
    table = spark.createDataFrame(rows, "conv_id long, payload string")
    got = source.read_messages(table).orderBy("conv_id").collect()
    assert [(r.conv_id, r.turn, r.role, r.content) for r in got][0] == (1, 0, "user", "")
    assert {r.conv_id for r in got} <= {1, 5}
    assert {r.conv_id for r in source.malformed(table).collect()} >= {3}


def test_store_replaces_conversations(spark, talk, tmp_path):
    path = str(tmp_path / "nodes")
    nodes = graph.graph_nodes(talk)
    other = graph.graph_nodes(spark.createDataFrame([(2, 0, "user", "other talk")], SCHEMA))
    source.write_graph(nodes.union(other), path, buckets=2)
    source.write_graph(graph.graph_nodes(spark.createDataFrame([(1, 0, "user", "new talk")], SCHEMA)), path, buckets=2)
    got = source.read_graph(spark, path)
    assert {r.content for r in got.where("conv_id = 1 and type = 'task'").collect()} == {"new talk"}
    assert got.where("conv_id = 2").count() == other.count()


def _in_turn(spark, talks, folder, parts):
    """Files by ranges of turns, each with a later time than the one before."""
    for number, rows in enumerate(parts):
        talks.where(rows).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if (stamp := f.stat().st_mtime) and not f.name.startswith("seen-"):
                os.utime(f, (stamp + 10 * number, stamp + 10 * number))
                f.rename(folder / f"seen-{number}-{f.name}")


def _streamed(spark, talks, folder, out, idle=None):
    session = graph_stream.stream_session(spark)
    stream = session.readStream.schema(talks.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    graph_stream.append_graph(stream, str(out), idle)
    return graph_stream.read_appended(spark, str(out))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    talks = queries.decorated(spark, sf_dir).where("conv_id < 6")
    talks = talks.withColumn("content", F.when((F.col("conv_id") == 1) & (F.col("turn") == 1), F.lit(None)).otherwise(F.col("content")))
    _in_turn(spark, talks, tmp_path / "in", ["turn < 2", "turn >= 2 and turn < 4", "turn >= 4"])
    nodes, edges, late = _streamed(spark, talks, tmp_path / "in", tmp_path / "out")
    assert late.count() == 0
    assert sorted(nodes.collect(), key=str) == sorted(graph.graph_nodes(talks).select(*nodes.columns).collect(), key=str)
    assert sorted(edges.collect(), key=str) == sorted(graph.graph_edges(talks).select(*edges.columns).collect(), key=str)
    assert nodes.where("conv_id = 1 and type = 'task'").count() == talks.where("conv_id = 1").count()


def test_stream_goes_on_and_tells_late_messages(spark, tmp_path):
    rows = [(1, 0, "user", "Spark joins data"), (1, 1, "user", "Partition data"), (2, 0, "user", "alone"), (1, 1, "bot", "late one"), (1, 0, "bot", None), (1, 2, "user", "Spark joins again")]
    talks = spark.createDataFrame(rows, SCHEMA)
    _in_turn(spark, talks, tmp_path / "in", ["conv_id = 2 or role = 'user' and turn = 0"])
    _streamed(spark, talks, tmp_path / "in", tmp_path / "out")
    _in_turn(spark, talks, tmp_path / "in", ["role = 'user' and conv_id = 1 and turn = 1", "role = 'bot' or turn = 2"])
    nodes, edges, late = _streamed(spark, talks, tmp_path / "in", tmp_path / "out")
    assert sorted((r.turn, r.role) for r in late.collect()) == [(0, "bot"), (1, "bot")]
    kept = talks.where("role = 'user'")
    assert sorted(nodes.collect(), key=str) == sorted(graph.graph_nodes(kept).select(*nodes.columns).collect(), key=str)
    assert sorted(edges.collect(), key=str) == sorted(graph.graph_edges(kept).select(*edges.columns).collect(), key=str)
    whole = graph_stream.streamed_graph(spark, lambda session, stream: session.readStream.schema(talks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")) if stream else talks)
    assert whole[0].where("type = 'task'").count() == len(rows)


def test_idle_conversation_starts_anew(spark, tmp_path):
    talks = spark.createDataFrame([(1, 0, "user", "Spark joins data"), (1, 1, "user", "Spark joins data")], SCHEMA)
    _in_turn(spark, talks, tmp_path / "in", ["turn = 0"])
    _streamed(spark, talks, tmp_path / "in", tmp_path / "out", idle="1 hour")
    _in_turn(spark, talks, tmp_path / "in", ["turn = 1"])
    nodes, _, _ = _streamed(spark, talks, tmp_path / "in", tmp_path / "out", idle="1 hour")
    assert sorted(r.id for r in nodes.where("type = 'task'").collect()) == ["t0", "t1"]


def test_one_giant_conversation(spark, sf_dir):
    """A conversation with a third of all rows, over many ranges of turns: equal to numbering it in one go."""
    talks = queries.decorated(spark, sf_dir).limit(60)
    third = talks.withColumn("turn", F.row_number().over(Window.orderBy("conv_id", "turn")).cast("long") * 3).withColumn("conv_id", F.lit(-1).cast("long"))
    both = talks.union(third)
    small, large = (graph.numbered(both, span).select("conv_id", "turn", "kind", "ord", "id", "is_new", "node_seq", "edge_seq", "before") for span in (4, 1 << 40))
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    rows = graph.nodes_of(graph.numbered(both, 4)).where("conv_id = -1").orderBy("node_seq").collect()
    assert [r.node_seq for r in rows] == list(range(len(rows)))
    edges = graph.edges_of(graph.numbered(both, 4)).where("conv_id = -1").orderBy("edge_seq").collect()
    assert [r.edge_seq for r in edges] == list(range(len(edges)))
    for letter in "ta":
        assert [int(r.id[1:]) for r in rows if r.id[0] == letter] == list(range(sum(r.id[0] == letter for r in rows)))


def test_contents_pass_no_window(spark, sf_dir):
    parts = graph.stored(graph.message_parts(queries.decorated(spark, sf_dir)).withColumn("row", F.monotonically_increasing_id()))
    plan = graph.numbered_parts(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "items" in line]


def test_repeated_turns_and_rows(spark):
    rows = [(1, 0, "user", "alpha beta"), (1, 0, "user", "alpha beta"), (1, 0, "bot", "gamma alpha"), (1, 1, "user", "beta"), (None, 0, "user", "x"), (1, None, "user", "y")]
    items = graph.numbered(spark.createDataFrame(rows, SCHEMA))
    nodes, edges = graph.nodes_of(items).collect(), graph.edges_of(items).collect()
    assert sorted(n.id for n in nodes if n.type == "task") == ["t0", "t1", "t2", "t3"]
    assert sorted(n.node_seq for n in nodes) == list(range(len(nodes))) and len({n.id for n in nodes}) == len(nodes)
    assert sorted(e.edge_seq for e in edges) == list(range(len(edges))) and {e.target for e in edges} <= {n.id for n in nodes}


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graph.graph_nodes(none).count() == 0 and graph.graph_json(none).count() == 0
    blank = spark.createDataFrame([(1, 0, None, ""), (1, 1, "user", "")], SCHEMA)
    assert [(n.id, n.role, n.content) for n in graph.graph_nodes(blank).orderBy("node_seq").collect()] == [("t0", None, ""), ("t1", "user", "")]


def test_null_content_keeps_its_message(spark):
    rows = [(1, 0, "user", "partition data"), (1, 1, "assistant", None), (1, 2, "user", "thanks")]
    items = graph.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string"))
    tasks = {r.id: r.content for r in graph.nodes_of(items).where("type = 'task'").collect()}
    assert tasks == {"t0": "partition data", "t1": "", "t2": "thanks"}
    assert graph.edges_of(items).where("relation = 'sequence'").count() == 2


def test_stream_session_hands_over_few_rows(spark):
    assert int(graph_stream.stream_session(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
