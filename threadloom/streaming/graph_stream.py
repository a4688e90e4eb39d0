"""Conversation graphs from a stream of messages: new turns append nodes and edges without recomputation.

State of a conversation: one value of counters (messages, artifacts, nodes, edges, last turn) and a map with an entry for
each entity.  A batch reads and writes the entries of the entities it mentions, not the map, so its cost does not grow
with the conversation's history.  Messages of a batch are sorted by turn; a turn at or before the last one seen is late and
comes out as rows of kind `late`, one for each message, for recomputation.  What a task holds of a conversation is what one
micro-batch has of it; maxFilesPerTrigger bounds that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import graph
from ..sources.stored import work_folder

OUT = "kind string, conv_id long, seq long, id string, type string, subtype string, role string, language string, content string, source string, target string, relation string, turn long"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_COUNTERS = "tasks long, artifacts long, nodes long, edges long, last_turn long, until long"
#: Messages that a worker of a stream holds as Python values at once.
ROWS = 1000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GraphBuilder(StatefulProcessor):
    """Numbers the messages of a conversation, batch by batch."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.entities = handle.getMapState("entities", "key string", "id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = [(m.turn, m.role, m.items) for frame in rows for m in frame[["turn", "role", "items"]].itertuples(index=False, name="Message")]
        known = self.counters.exists()
        tasks, artifacts, nodes, edges, seen, _ = self.counters.get() if known else (0, 0, 0, 0, None, 0)
        given: dict[str, str] = {}  # entities of this batch
        last, out = seen, []
        for turn, role, items in sorted(told, key=lambda m: m[0]):
            role = role if isinstance(role, str) else None
            if seen is not None and turn <= seen:
                out.append(("late", key[0], None, None, None, None, role, None, None, None, None, None, turn))
                continue
            last, at, tasks = turn, tasks, tasks + 1
            for item in items:
                kind, name = item["kind"], item["key"]
                type_, subtype, relation = graph.KINDS[kind]
                id_ = f"t{at}" if kind == 0 else self._entity(name, given, known) if name is not None else None
                if id_ is None:
                    id_, artifacts = f"a{artifacts}", artifacts + 1
                    if name is not None:
                        given[name] = id_
                        self.entities.updateValue((name,), (id_,))
                    fresh = True
                else:
                    fresh = kind == 0
                if fresh:
                    out.append(("node", key[0], nodes, id_, type_, subtype, role if kind == 0 else None, item["language"], item["content"], None, None, None, turn))
                    nodes += 1
                if kind or at:
                    source = f"t{at}" if kind else f"t{at - 1}"
                    out.append(("edge", key[0], edges, None, None, None, None, None, None, source, id_, relation, turn))
                    edges += 1
        until = 0
        if self.idle_ms is not None:
            until = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(until)
        self.counters.update((tasks, artifacts, nodes, edges, last, until))
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object).astype({"conv_id": "int64", "seq": "Int64", "turn": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Ends a conversation unless it had messages since this timer was set."""
        if self.counters.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.counters.get()[-1]:
            self.counters.clear()
            self.entities.clear()
        yield pd.DataFrame(columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _entity(self, name: str, given: dict[str, str], known: bool) -> str | None:
        """The node of an entity met before, in this batch or, if the conversation is known, in its state."""
        if name in given or not known:
            return given.get(name)
        if self.entities.containsKey((name,)):
            given[name] = self.entities.getValue((name,))[0]
        return given.get(name)


def graph_stream(messages: DataFrame, idle: str | None = None) -> DataFrame:
    """Rows of kind node, edge or late for a stream of messages(conv_id, turn, role, content).

    A null content is empty, and keeps its message; messages without a conversation or a turn take no part.  With `idle`,
    a conversation that is idle for that long loses its state, and later turns start a new graph for it; without it, state
    stays.  The session's state store must be RocksDB (`stream_session`).
    """
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    return graph.message_parts(messages).groupBy("conv_id").transformWithStateInPandas(GraphBuilder(idle_ms), OUT, "append", "None" if idle is None else "ProcessingTime")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB and hand ROWS messages at a time to Python; other
    settings as in `spark`.

    It makes no batches without data: runs over what is there would never end, as timers may always be due later.
    """
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return session


def append_graph(messages: DataFrame, path: str, idle: str | None = None) -> None:
    """Runs the stream over what is there now: rows go to path/rows by kind, progress and state to path/progress.

    A later run over the same folder goes on where this one ended.
    """
    rows = graph_stream(messages, idle).writeStream.format("parquet").outputMode("append").partitionBy("kind")
    query = rows.option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def read_appended(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, late messages) that runs of `append_graph` have written."""
    rows = spark.read.schema(OUT).parquet(f"{path}/rows")
    nodes = rows.where("kind = 'node'").select("conv_id", F.col("seq").alias("node_seq"), "id", "type", "subtype", "role", "language", "content")
    edges = rows.where("kind = 'edge'").select("conv_id", F.col("seq").alias("edge_seq"), "source", "target", "relation")
    return nodes, edges, rows.where("kind = 'late'").select("conv_id", "turn", "role")


def streamed_graph(spark: SparkSession, messages_of, path: str | None = None, idle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stream; conversations with late messages are computed again as a whole, in batch.

    messages_of(session, stream) gives the messages as a stream or, for the second step, as a table.
    """
    path = path or work_folder(spark)
    append_graph(messages_of(stream_session(spark), True), path, idle)
    nodes, edges, late = read_appended(spark, path)
    late = late.select("conv_id").distinct()
    if late.isEmpty():
        return nodes, edges
    again = graph.numbered(messages_of(spark, False).join(late, "conv_id", "left_semi"))
    return (
        nodes.join(late, "conv_id", "left_anti").unionByName(graph.nodes_of(again)),
        edges.join(late, "conv_id", "left_anti").unionByName(graph.edges_of(again)),
    )
