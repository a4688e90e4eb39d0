"""Reading messages and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BUCKETS, GraphStore

MESSAGES = "array<struct<role:string,content:string>>"
GRAPH = (
    "struct<nodes:array<struct<id:string,type:string,subtype:string,role:string,language:string,content:string>>,"
    "edges:array<struct<source:string,target:string,relation:string>>>"
)


def from_conversations(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) of a table whose text column is `text`; rows without a role take no number."""
    kept = table.where(F.coalesce("role", F.lit("")) != "")
    return kept.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


def parsed_messages(payloads: DataFrame, key: str = "conv_id", payload: str = "payload") -> DataFrame:
    """One row for each message of JSON lists, and one for each list that has none to give: (key, turn, role, content,
    reason), all from one parse.

    reason is null for messages; else it says why a list gives nothing: `no payload`, `malformed JSON`, `no messages`, or
    `no roles`, where every entry lacks its role.
    """
    parsed = payloads.select(key, payload, F.from_json(payload, MESSAGES).alias("items"))
    kept = F.filter("items", lambda m: F.coalesce(m["role"], F.lit("")) != "")
    told = parsed.select(key, F.col(payload).isNull().alias("absent"), F.col("items").isNull().alias("broken"), (F.size("items") == 0).alias("empty"), kept.alias("kept"))
    rows = told.select(key, "absent", "broken", "empty", F.posexplode_outer("kept").alias("turn", "m"))
    reason = F.when(F.col("absent"), "no payload").when(F.col("broken"), "malformed JSON").when(F.col("empty"), "no messages").when(F.col("turn").isNull(), "no roles")
    content = F.when(F.col("turn").isNotNull(), F.coalesce("m.content", F.lit("")))
    return rows.select(key, F.col("turn").cast("long").alias("turn"), "m.role", content.alias("content"), reason.alias("reason"))


def read_messages(payloads: DataFrame, key: str = "conv_id", payload: str = "payload") -> DataFrame:
    """Messages of JSON lists; those without a role are dropped and take no number.  Malformed JSON gives no rows."""
    return parsed_messages(payloads, key, payload).where("reason is null").drop("reason")


def malformed(payloads: DataFrame, key: str = "conv_id", payload: str = "payload") -> DataFrame:
    """(key, reason) of the lists that give no message."""
    return parsed_messages(payloads, key, payload).where("reason is not null").select(key, "reason")


def latest_snapshot(snapshots: DataFrame, key: str = "conv_id", at: str = "extracted_at") -> DataFrame:
    """The last row of each conversation; of equal times the largest row, and of equal rows one.

    The aggregation runs over keys and times alone; the rows it names are fetched by a semi-join.  Only conversations with
    several rows at their last time, told by a second narrow count, compare whole rows.  A null time is before all others.
    """
    narrow = snapshots.select(key, at)
    last = narrow.groupBy(key).agg(F.max(F.struct(at)).alias("__last")).select(F.col(key).alias("__key"), F.col(f"__last.{at}").alias("__at"))
    is_last = F.col(key).eqNullSafe(F.col("__key")) & F.col(at).eqNullSafe(F.col("__at"))
    several = narrow.join(last, is_last, "left_semi").groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__tied"))
    tied = F.col(key).eqNullSafe(F.col("__tied"))
    found = snapshots.join(last, is_last, "left_semi")
    rest = [c for c in snapshots.columns if c not in (key, at)]
    best = found.join(several, tied, "left_semi").groupBy(key).agg(F.max(F.struct(at, *rest)).alias("__best")).select(key, "__best.*")
    return found.join(several, tied, "left_anti").unionByName(best.select(*snapshots.columns))


def read_graph_json(graphs: DataFrame, key: str = "conv_id", graph: str = "graph_json") -> tuple[DataFrame, DataFrame]:
    """Node rows and edge rows of graph JSON, numbered in order."""
    parsed = graphs.select(key, F.from_json(graph, GRAPH).alias("g"))
    nodes = parsed.select(key, F.posexplode("g.nodes").alias("node_seq", "x")).select(key, F.col("node_seq").cast("long").alias("node_seq"), "x.*")
    edges = parsed.select(key, F.posexplode("g.edges").alias("edge_seq", "x")).select(key, F.col("edge_seq").cast("long").alias("edge_seq"), "x.*")
    return nodes, edges


def extraction_outcome(pages: DataFrame, messages: DataFrame, key: str = "page_id") -> DataFrame:
    """Messages of each page, or the error row of a page without any."""
    counts = messages.groupBy(key).agg(F.count("*").alias("n"))
    joined = pages.select(key).join(counts, key, "left")
    status = F.when(F.col("n").isNull(), "error").otherwise("ok")
    reason = F.when(F.col("n").isNull(), "No conversation found on this page")
    return joined.select(key, status.alias("status"), F.coalesce("n", F.lit(0)).alias("message_count"), reason.alias("reason"))


def write_graph(rows: DataFrame, path: str, key: str = "conv_id", buckets: int = BUCKETS) -> int:
    """Writes node or edge rows to a `GraphStore`; a conversation's new rows replace its old ones.  Returns the version."""
    return GraphStore(rows.sparkSession, path, key, buckets).write(rows)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return GraphStore(spark, path).read()
