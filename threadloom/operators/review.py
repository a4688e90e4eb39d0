"""Review of graphs: counts, degrees, display types, labels, edge elements, filtering.

Counts, degrees and filters come in two forms: over any node and edge tables, and over numbered items (`graph.numbered`),
whose rows hold a node, an edge or both, so that one pass over one table is enough; over a table of items that is bucketed
by conversation they need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

KEY = ("conv_id", "id")
#: Their nodes cannot be hidden.
SPEAKERS = ("user", "assistant")
# Sites whose first path segment is the label.
PATH_SITES = ("github", "google", "wikipedia", "npmjs", "youtube")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tagged = nodes.select("conv_id", F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select("conv_id", F.lit(0), F.lit(1)))
    return tagged.groupBy("conv_id").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that start or end at each node; nodes and edge ends are counted in one aggregation."""
    ends = edges.select("conv_id", F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("d"), F.lit(0).alias("n"))
    both = ends.union(nodes.select("conv_id", "id", F.lit(0), F.lit(1)))
    return both.groupBy(*KEY).agg(F.sum("d").alias("degree"), F.max("n").alias("n")).where("n = 1").select(*KEY, "degree")


def counts_of(items: DataFrame) -> DataFrame:
    """Nodes and edges of each conversation."""
    return items.groupBy("conv_id").agg(F.count_if("is_new").alias("nodes"), F.count("edge_seq").alias("edges"))


def degree_of(items: DataFrame) -> DataFrame:
    """Edges that start or end at each node; a node that is new counts as zero of them."""
    row = lambda id_, n: F.struct(id_.alias("id"), F.lit(n).cast("long").alias("n"))
    linked = F.col("edge_seq").isNotNull()
    ends = F.array(F.when(F.col("is_new"), row(F.col("id"), 0)), F.when(linked, row(graph.source_of(), 1)), F.when(linked, row(F.col("id"), 1)))
    each = items.select("conv_id", F.explode(F.array_compact(ends)).alias("x")).select("conv_id", "x.*")
    return each.groupBy(*KEY).agg(F.sum("n").alias("degree"))


def filter_items(items: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose display type is not hidden, and the edges between them, told by flags in the items' own rows."""
    gone = [h for h in hidden if h not in SPEAKERS] or [""]
    own = display_type(F.when(F.col("kind") == 0, F.col("role")), graph.by_kind(1), graph.by_kind(0))
    source = display_type(F.when(F.col("kind") == 0, F.col("before")).otherwise(F.col("role")), F.lit(None).cast("string"), F.lit("task"))
    kept = items.where(~own.isin(*gone))
    return graph.nodes_of(kept), graph.edges_of(kept.where(~source.isin(*gone)))


def display_type(role: Column | str, subtype: Column | str, type_: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    raw = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in (role, subtype, type_)], F.lit("artifact"))
    return F.when(raw == "code", F.lit("artifact")).otherwise(raw)


def _raised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def text_label(text: Column) -> Column:
    """The two highest scored identifiers of a text, scored in fifths; none: its first two space-separated pieces."""
    found = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?![A-Za-z0-9_])"), 0)
    kept = F.filter(found, lambda w: ~((F.length(w) <= 3) & (w == F.lower(w))))
    mixed = lambda w: w.rlike("[0-9_]") | (w.rlike("[a-z]") & w.rlike("[A-Z]"))
    points = lambda w: F.lit(5) + F.when(w.rlike("^[A-Z]"), 10).otherwise(0) + F.when(mixed(w), 15).otherwise(0) + F.least(F.length(w), F.lit(10))
    # sorted by word, one pass sums each word's points and keeps the best two: totals and first places, ties to the earlier
    scored = F.array_sort(F.transform(kept, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"), points(w).alias("s"))))
    entry = lambda s, i, w: F.struct(s.alias("s"), i.alias("i"), w.alias("w"))
    none = entry(F.lit(-1), F.lit(0), F.lit(""))
    state = lambda w, i, s, a, b: F.struct(w.alias("w"), i.alias("i"), s.alias("s"), a.alias("a"), b.alias("b"))
    better = lambda x, y: (x["s"] > y["s"]) | ((x["s"] == y["s"]) & (x["i"] < y["i"]))

    def best_two(t: Column) -> tuple[Column, Column]:
        now = entry(t["s"], t["i"], t["w"])
        return F.when(better(now, t["a"]), now).otherwise(t["a"]), F.when(better(now, t["a"]), t["a"]).when(better(now, t["b"]), now).otherwise(t["b"])

    def step(t: Column, x: Column) -> Column:
        more = state(t["w"], t["i"], t["s"] + x["s"], t["a"], t["b"])
        return F.when(t["w"] == x["w"], more).otherwise(state(x["w"], x["i"], x["s"], *best_two(t)))

    best = F.aggregate(scored, state(F.lit(""), F.lit(0), F.lit(-1), none, none), step, lambda t: F.filter(F.array(*best_two(t)), lambda e: e["s"] >= 0))
    plain = F.substring(F.array_join(F.slice(F.split(text, " "), 1, 2), " "), 1, 20)
    return F.when(F.size(kept) > 0, F.array_join(F.transform(best, lambda e: _raised(e["w"])), " ")).otherwise(plain)


def url_label(url: Column) -> Column:
    """Second-last part of the host, or for some sites the first path segment; no address: the text label."""
    found = lambda n: F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:\\s]+)(?::[0-9]*)?([^?#]*)", n)
    parts = F.split(F.regexp_replace(F.lower(found(1)), "^www\\.", ""), "\\.")
    domain = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))
    segment = F.regexp_extract(found(2), "^/+([^/]+)", 1)
    by_path = domain.isin(*PATH_SITES) & (segment != "")
    return F.when(found(1) == "", text_label(url)).when(by_path, _raised(segment)).otherwise(_raised(domain))


def node_labels(nodes: DataFrame) -> DataFrame:
    """Display type and label of each node."""
    typed = nodes.select(*KEY, display_type("role", "subtype", "type").alias("display_type"), F.coalesce("content", F.lit("")).alias("content"))
    label = F.when(F.col("content") == "", _raised(F.col("display_type"))).when(F.col("display_type") == "link", url_label(F.col("content")))
    return typed.select(*KEY, "display_type", label.otherwise(text_label(F.col("content"))).alias("label"))


def edge_elements(edges: DataFrame) -> DataFrame:
    made = F.concat_ws("-", "source", "target", F.col("edge_seq").cast("string"))
    own = F.nullif(F.col("id"), F.lit("")) if "id" in edges.columns else F.lit(None).cast("string")
    return edges.select("conv_id", F.coalesce(own, made).alias("id"), "source", "target", F.coalesce("relation", F.lit("")).alias("label"))


def filter_graph(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose display type is not hidden, and the edges between them; speakers cannot be hidden."""
    gone = [h for h in hidden if h not in SPEAKERS]
    kept = nodes.where(~display_type("role", "subtype", "type").isin(*gone)) if gone else nodes
    ids = kept.select(*KEY)
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["conv_id", end], "left_semi")
    return kept, edges
