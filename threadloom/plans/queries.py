"""Queries over the given tables.  Messages are those of `conversations`, with code, links and terms written into their
texts by a fixed expression, since the raw texts hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import graph, messages, payloads, review
from ..sources import messages as source
from ..sources import store
from ..sources import pages as page_source
from ..sources import transcripts
from ..sources.stored import work_folder
from ..streaming import graph_stream

#: Valid in Spark SQL and DuckDB.
DECORATED = """
 text
 || CASE WHEN (conv_id + turn) % 3 = 0 THEN concat(chr(10), '```', CASE WHEN turn % 2 = 0 THEN 'python  ' ELSE '' END, chr(10), 'x_', CAST(turn AS VARCHAR(20)), ' = load(', CAST(conv_id AS VARCHAR(20)), ')', chr(10), chr(10), '```', chr(10)) ELSE '' END
 || CASE WHEN (conv_id + turn) % 4 = 1 THEN concat(' see [doc](https://docs.example.org/p/', CAST(conv_id % 5 AS VARCHAR(20)), ') and https://docs.example.org/p/', CAST(conv_id % 5 AS VARCHAR(20)), ' or https://www.github.com/Org', CAST(turn % 3 AS VARCHAR(20)), '/repo [x](/rel) [s](/abc) [again](https://docs.example.org/p/', CAST(conv_id % 5 AS VARCHAR(20)), ')') ELSE '' END
 || CASE WHEN turn % 5 = 2 THEN concat(' **term ', CAST(conv_id % 7 AS VARCHAR(20)), '** **** **open') ELSE '' END
"""
HIDDEN = ["variable"]
#: Nodes of a graph in JSON; some of the given conversations have more.
JSON_NODES = 30
#: Several types at once, system turns among them.
HIDDEN_TYPES = ["link", "artifact", "system"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").withColumn("text", F.expr(DECORATED))
    return source.from_conversations(talks)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a JSON list; system turns without a role."""
    talks = _table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role"))
    item = F.struct("turn", F.struct(role.alias("role"), F.col("text").alias("content")).alias("m"))
    return talks.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(item)).getField("m")).alias("payload"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered(decorated(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, sf_dir)
    return graph.nodes_of(items), graph.edges_of(items)


def _stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return source.read_graph_json(graph.graph_json(decorated(spark, sf_dir)))


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table's files as a stream, in the order of their names."""
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema

    def messages_of(session: SparkSession, stream: bool) -> DataFrame:
        # a stream takes a folder or a pattern; this one is the table, be it a folder or a file
        rows = session.readStream.schema(schema).parquet(f"{path[:-1]}[t]") if stream else session.read.schema(schema).parquet(path)
        return source.from_conversations(rows.withColumn("text", F.expr(DECORATED)))

    return graph_stream.streamed_graph(spark, messages_of)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lists, some of them cut short, absent, empty or without roles by their ids."""
    rows = _payloads(spark, sf_dir)
    kind = F.pmod("conv_id", F.lit(7))
    text = F.col("payload")
    bad = F.when(kind == 1, F.expr("substring(payload, 1, length(payload) - 2)")).when(kind == 2, F.lit(None)).when(kind == 3, "[]")
    bad = bad.when(kind == 4, F.regexp_replace(text, '"role":"[a-z]*",', "")).otherwise(text)
    return source.malformed(rows.withColumn("payload", bad))


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as a store gives them back whose conversations were written twice: as they were after their first turn, and whole."""
    kept = store.GraphStore(spark, work_folder(spark), buckets=16)
    talks = decorated(spark, sf_dir)
    kept.write(graph.graph_nodes(talks.where("turn = 0")))
    kept.write(graph.graph_nodes(talks))
    kept.vacuum()
    return kept.read()


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    return store.write_clustered(_items(spark, sf_dir), "items_" + path.rpartition("-")[2], path, buckets=16)


def _on_clustered(operator):
    return lambda spark, sf_dir: operator(_clustered(spark, sf_dir))


def _on_messages(operator):
    return lambda spark, sf_dir: operator(decorated(spark, sf_dir))


def _on_items(operator):
    return lambda spark, sf_dir: operator(_items(spark, sf_dir))


def _latest(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    shots = talks.select("conv_id", (F.col("turn") % 4).alias("extracted_at"), F.concat_ws(":", F.col("turn").cast("string"), "text").alias("graph_json"))
    return source.latest_snapshot(shots)


def _outcome(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id")
    talks = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"))
    return source.extraction_outcome(pages, talks)


def _page_messages(spark, sf_dir):
    return page_source.page_messages(_table(spark, sf_dir, "pages"))


def _page_outcome(spark, sf_dir):
    """Pages by what was found on them; an outcome for every page."""
    pages = _table(spark, sf_dir, "pages")
    return source.extraction_outcome(pages, page_source.extracted(pages))


def _roles(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", transcripts.resolve_role("role", "turn").alias("role"))


def _transcripts(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(name, F.lit(": "), F.regexp_replace("text", "\\A\\s+|\\s+\\z", ""))
    raw = F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).getField("line"), "\n")
    return transcripts.parse_transcript(talks.groupBy("conv_id").agg(raw.alias("raw")))


def _stop_words(spark, sf_dir):
    return messages.explode_list(decorated(spark, sf_dir), texts.words("content"), ("word",), at="pos")


def _scores(spark, sf_dir):
    return messages.textrank_scores(decorated(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _nodes_of_kind(subtype):
    return lambda spark, sf_dir: _graph(spark, sf_dir)[0].where(F.col("subtype") == subtype).drop("role", "type")


def _edges_of_kind(relation):
    return lambda spark, sf_dir: _graph(spark, sf_dir)[1].where(F.col("relation") == relation)


def _display_types(spark, sf_dir):
    nodes = _graph(spark, sf_dir)[0]
    return nodes.select("conv_id", "id", review.display_type("role", "subtype", "type").alias("display_type"))


def _text_labels(spark, sf_dir):
    return decorated(spark, sf_dir).select("conv_id", "turn", review.text_label(F.col("content")).alias("label"))


def _url_labels(spark, sf_dir):
    found = messages.links(decorated(spark, sf_dir))
    return found.select("conv_id", "turn", "ord", review.url_label(F.col("link")).alias("label"))


def _routes(spark, sf_dir):
    target = F.expr("CASE conv_id % 5 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'other' END")
    requests = _table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", target.alias("target"), F.lit("claude").alias("platform"))
    return payloads.route_payloads(requests)


def _clipboard(spark, sf_dir):
    return payloads.clipboard_payload(graph.graph_struct(decorated(spark, sf_dir)))


def _document_keywords(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return messages.keywords(docs, ("doc_id",), "text")


QUERIES = {
    "read_messages": lambda s, d: source.read_messages(_payloads(s, d)),
    "rejected_payloads": _rejects,
    "latest_snapshot": _latest,
    "stored_graph_nodes": _round_trip,
    "read_graph_json_nodes": lambda s, d: _stored_graph(s, d)[0],
    "read_graph_json_edges": lambda s, d: _stored_graph(s, d)[1],
    "graph_json": _on_messages(graph.graph_json),
    "graph_json_or_reason": _on_messages(lambda m: graph.graph_json_or_reason(m, JSON_NODES)),
    "extraction_outcome": _outcome,
    "detect_platform": lambda s, d: _table(s, d, "pages").select("page_id", transcripts.detect_platform("url").alias("platform")),
    "platform_config": lambda s, d: transcripts.platform_config(_table(s, d, "pages")),
    "page_messages": _page_messages,
    "page_outcome": _page_outcome,
    "page_graph_nodes": lambda s, d: graph.graph_nodes(_page_messages(s, d).withColumnRenamed("page_id", "conv_id")),
    "html_to_markdown": lambda s, d: _table(s, d, "pages").select("page_id", page_source.html_to_markdown("html", "url").alias("markdown")),
    "resolve_role": _roles,
    "parse_transcript": _transcripts,
    "task_summary": _on_messages(messages.task_summary),
    "code_blocks": _on_messages(messages.code_blocks),
    "links": _on_messages(messages.links),
    "bold_terms": _on_messages(messages.bold_terms),
    "document_bold_terms": lambda s, d: messages.bold_terms(_table(s, d, "documents"), ("doc_id",), "text"),
    "remove_stopwords": _stop_words,
    "stem_words": _on_messages(messages.vocabulary_stems),
    "tokens": _on_messages(messages.tokens),
    "cooccurrence": _on_messages(messages.cooccurrence),
    "textrank_scores": _scores,
    "top_stems": _on_messages(messages.top_stems),
    "surface_forms": _on_messages(messages.surface_forms),
    "keyword_phrases": lambda s, d: messages.keyword_phrases_of(decorated(s, d)).select("conv_id", "turn", F.explode("keywords").alias("k")).select("conv_id", "turn", "k.phrase", "k.key"),
    "keywords": _on_messages(messages.keywords),
    "document_keywords": _document_keywords,
    "document_cooccurrence": lambda s, d: messages.cooccurrence(_table(s, d, "documents"), ("doc_id",), "text"),
    "textrank_by_joins": lambda s, d: messages.textrank_by_joins(decorated(s, d)).withColumn("score", F.round("score", 6)),
    "document_textrank_scores": lambda s, d: messages.textrank_by_joins(_table(s, d, "documents"), ("doc_id",), "text").withColumn("score", F.round("score", 6)),
    "task_nodes": lambda s, d: _graph(s, d)[0].where("type = 'task'").drop("subtype", "language", "type"),
    "sequence_edges": _edges_of_kind("sequence"),
    "code_nodes": _nodes_of_kind("code"),
    "contains_edges": _edges_of_kind("contains"),
    "link_nodes": _nodes_of_kind("link"),
    "references_edges": _edges_of_kind("references"),
    "entity_registry": _on_messages(graph.entity_registry),
    "mentions_edges": _edges_of_kind("mentions"),
    "artifact_ids": lambda s, d: _graph(s, d)[0].where("type = 'artifact'").select("conv_id", "node_seq", "id"),
    "graph_nodes": lambda s, d: _graph(s, d)[0],
    "graph_edges": lambda s, d: _graph(s, d)[1],
    "graph_counts": _on_items(review.counts_of),
    "node_degree": _on_items(review.degree_of),
    "clustered_graph_counts": _on_clustered(review.counts_of),
    "clustered_node_degree": _on_clustered(review.degree_of),
    "clustered_filter_edges": _on_clustered(lambda items: review.filter_items(items, HIDDEN_TYPES)[1]),
    "display_type": _display_types,
    "text_label": _text_labels,
    "url_label": _url_labels,
    "node_labels": lambda s, d: review.node_labels(_graph(s, d)[0]),
    "edge_elements": lambda s, d: review.edge_elements(_graph(s, d)[1]),
    "filter_graph_nodes": _on_items(lambda items: review.filter_items(items, HIDDEN)[0]),
    "filter_graph_edges": _on_items(lambda items: review.filter_items(items, HIDDEN)[1]),
    "filter_types_nodes": lambda s, d: review.filter_graph(*_graph(s, d), HIDDEN_TYPES)[0],
    "filter_types_edges": _on_items(lambda items: review.filter_items(items, HIDDEN_TYPES)[1]),
    "graph_stream_nodes": lambda s, d: _streamed(s, d)[0],
    "graph_stream_edges": lambda s, d: _streamed(s, d)[1],
    "inject_payload": lambda s, d: payloads.inject_payload(graph.graph_json(decorated(s, d))),
    "clipboard_payload": _clipboard,
    "route_payloads": _routes,
}
