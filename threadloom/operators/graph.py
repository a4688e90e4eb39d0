"""Conversations to property graphs.

All artifacts of a message are built inside its row, once, and stored.  Numbering then works on narrow rows only, and no
step gathers a conversation, so that one with a third of all messages is spread like the others:

* an entity's first mention is a minimum over (turn, place), pre-aggregated for each (conversation, entity);
* counters are prefix sums on two levels: sums over ranges of RANGE turns, running sums of these few rows for each
  conversation, and running sums of messages inside each range;
* numbers go back to the message's row by (conversation, turn), and nodes and edges are two views of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.rank import keyword_phrases
from ..sources.stored import stored

KINDS = {0: ("task", None, "sequence"), 1: ("artifact", "code", "contains"), 2: ("artifact", "link", "references"), 3: ("artifact", "variable", "mentions")}
_ITEM = "struct<kind:int,ord:int,language:string,content:string,key:string>"


#: Turns of a range.
RANGE = 1024
#: A stored message: its place, and a number that tells messages of one place apart.
MESSAGE = ["conv_id", "turn", "row"]


def message_parts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, items): the task, code blocks, links and keywords of each message, in order of emission, in its
    row.  A null content is empty; messages without a conversation or a turn take no part."""
    content = F.coalesce("content", F.lit("")).alias("content")
    parsed = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", content)
    parsed = parsed.withColumn("keywords", keyword_phrases(texts.words("content")))
    null = F.lit(None).cast("string")

    def listed(items, kind, language, content, key):
        return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), language(x).alias("language"), content(x).alias("content"), key(x).alias("key")))

    none = lambda x: null
    task = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("ord"), null.alias("language"), texts.summary("content").alias("content"), null.alias("key")))
    code = listed(texts.code_blocks("content"), 1, lambda x: F.nullif(x["language"], F.lit("")), lambda x: x["code"], none)
    link = listed(texts.links("content"), 2, none, lambda x: x, none)
    word = listed(F.col("keywords"), 3, none, lambda x: x["phrase"], lambda x: x["key"])
    items = F.concat(*[x.cast(f"array<{_ITEM}>") for x in (task, code, link, word)])
    return parsed.select("conv_id", "turn", F.nullif("role", F.lit("")).alias("role"), items.alias("items"))


def message_items(messages: DataFrame) -> DataFrame:
    """One row for each item of `message_parts`."""
    return message_parts(messages).select("conv_id", "turn", "role", F.explode("items").alias("item")).select("conv_id", "turn", "role", "item.*")


def running_sums(rows: DataFrame, names: list[str], span: int = RANGE) -> DataFrame:
    """Messages with each named value replaced by its sum over the earlier messages of the conversation, and `before`, the
    role of the message just before."""
    ranged = rows.withColumn("range", F.floor(F.col("turn") / span))
    sums = ranged.groupBy("conv_id", "range").agg(*[F.sum(n).alias(n) for n in names], F.max_by(F.struct("role"), F.struct("turn", "row")).alias("last"))
    by_range = Window.partitionBy("conv_id").orderBy("range")
    upto = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("conv_id", "range", *[upto(n, by_range).alias(f"{n}_before") for n in names], F.lag("last").over(by_range).alias("last"))
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "row")
    local = ranged.select(*MESSAGE, "range", *[upto(n, inside).alias(n) for n in names], F.lag(F.struct("role")).over(inside).alias("near"))
    before = F.coalesce("near", "last").getField("role").alias("before")
    return local.join(sums, ["conv_id", "range"]).select(*MESSAGE, before, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in names])


def numbered_parts(parts: DataFrame, span: int = RANGE) -> DataFrame:
    """Stored parts with the message's number `at`, the role `before` it, the artifacts and edges before it, the places of its
    keywords that are new (`fresh`), and the artifact number of each of its keywords (`targets`)."""
    plain = F.size(F.filter("items", lambda x: x["kind"].isin(1, 2))).cast("long")
    keys = F.transform(F.filter("items", lambda x: x["kind"] == 3), lambda x: x["key"])
    narrow = parts.select(*MESSAGE, "role", plain.alias("plain"), keys.alias("keys"))
    mentions = narrow.select(*MESSAGE, F.posexplode("keys").alias("ord", "key"))
    first = mentions.groupBy("conv_id", "key").agg(F.min(F.struct("turn", "row", "ord")).alias("first")).select("conv_id", "key", "first.*")
    fresh = first.groupBy(*MESSAGE).agg(F.array_sort(F.collect_list("ord")).alias("fresh"))  # five words of a message at most
    counts = narrow.join(fresh, MESSAGE, "left").withColumn("fresh", F.coalesce("fresh", F.array().cast("array<int>")))
    counts = counts.select(*MESSAGE, "role", "plain", "fresh", F.lit(1).cast("long").alias("at"), (F.col("plain") + F.size("fresh")).alias("artifacts"), (F.col("plain") + F.size("keys")).alias("linked"))
    sums = running_sums(counts.drop("plain", "fresh"), ["at", "artifacts", "linked"], span)
    numbers = stored(sums.join(counts.select(*MESSAGE, "plain", "fresh"), MESSAGE))
    # the number of each entity, and from there of each mention
    given = numbers.select(*MESSAGE, "artifacts", "plain", F.posexplode("fresh").alias("nth", "ord")).select(*MESSAGE, "ord", (F.col("artifacts") + F.col("plain") + F.col("nth")).alias("number"))
    named = first.join(given, [*MESSAGE, "ord"]).select("conv_id", "key", "number")
    targets = mentions.join(named, ["conv_id", "key"]).groupBy(*MESSAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "number"))).getField("number").alias("targets"))
    edges = (F.col("linked") + F.greatest(F.col("at") - 1, F.lit(0))).alias("edges")
    placed = parts.join(numbers, MESSAGE).join(targets, MESSAGE, "left")
    return placed.select("conv_id", "turn", "role", "items", "before", "at", "artifacts", edges, "fresh", "targets")


_NUMBERED = "struct<kind:int,ord:int,language:string,content:string,key:string,is_new:boolean,number:bigint,node_seq:bigint,edge_seq:bigint>"


def numbered(messages: DataFrame, span: int = RANGE) -> DataFrame:
    """One row for each item: message number `at`, the role `before` it, `is_new`, the node id (for repeated keywords the one
    first given), and the places of its node and edge in the conversation (null: none).

    Messages of one conversation and turn stand in no order among themselves.
    """
    parts = numbered_parts(stored(message_parts(messages).withColumn("row", F.monotonically_increasing_id())), span)
    first_edge = F.when(F.col("at") > 0, 1).otherwise(0)

    def item(x, i):
        word = x["kind"] == 3
        is_new = ~word | (F.array_position("fresh", x["ord"]) > 0)
        number = F.when(x["kind"] == 0, F.col("at")).when(word, F.get("targets", x["ord"])).otherwise(F.col("artifacts") + i - 1)
        node_seq = F.when(x["kind"] == 0, F.col("at") + F.col("artifacts")).when(is_new, F.col("at") + number + 1)
        edge_seq = F.when(x["kind"] == 0, F.when(F.col("at") > 0, F.col("edges"))).otherwise(F.col("edges") + first_edge + i - 1)
        fields = {n: x[n] for n in ("kind", "ord", "language", "content", "key")} | {"is_new": is_new, "number": number, "node_seq": node_seq, "edge_seq": edge_seq}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    rows = parts.select("conv_id", "turn", "role", "before", "at", F.explode(F.transform("items", item).cast(f"array<{_NUMBERED}>")).alias("x"))
    rows = rows.select("conv_id", "turn", "role", "before", "at", "x.*")
    return rows.withColumn("id", F.concat(F.when(F.col("kind") == 0, F.lit("t")).otherwise(F.lit("a")), F.col("number")))


def by_kind(place: int):
    made = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        made = F.when(F.col("kind") == kind, F.lit(names[place])).otherwise(made)
    return made


def source_of():
    return F.concat(F.lit("t"), F.when(F.col("kind") == 0, F.col("at") - 1).otherwise(F.col("at")))


def nodes_of(items: DataFrame) -> DataFrame:
    role = F.when(F.col("kind") == 0, F.col("role"))
    return items.where("is_new").select("conv_id", "node_seq", "id", by_kind(0).alias("type"), by_kind(1).alias("subtype"), role.alias("role"), "language", "content")


def edges_of(items: DataFrame) -> DataFrame:
    return items.where("edge_seq is not null").select("conv_id", "edge_seq", source_of().alias("source"), F.col("id").alias("target"), by_kind(2).alias("relation"))


def graph_nodes(messages: DataFrame) -> DataFrame:
    return nodes_of(numbered(messages))


def graph_edges(messages: DataFrame) -> DataFrame:
    return edges_of(numbered(messages))


def entity_registry(messages: DataFrame) -> DataFrame:
    """First mention of each entity of a conversation: its key, node and surface phrase."""
    return numbered(messages).where("kind = 3 and is_new").select("conv_id", F.col("key").alias("entity_key"), F.col("id").alias("node_id"), F.col("content").alias("phrase"))


_NODE = ("id", "type", "subtype", "role", "language", "content")
_EDGE = ("source", "target", "relation")


#: Nodes of a graph that is one row.
MAX_NODES = 1_000_000


def graph_sizes(items: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(conv_id, nodes, edges, fits): whether a conversation's graph is small enough to be one row.  Nothing is gathered."""
    sizes = items.groupBy("conv_id").agg(F.count_if("is_new").alias("nodes"), F.count("edge_seq").alias("edges"))
    return sizes.withColumn("fits", (F.col("nodes") <= max_nodes) & (F.col("edges") <= max_nodes * 8))


def graph_struct(messages: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """(conv_id, graph): nodes and edges in order of emission, as one struct for each conversation.

    Conversations beyond max_nodes (`graph_sizes` lists them) are left out before anything is gathered, and stay in the
    node and edge tables; with None, all are rows.
    """
    return struct_of(numbered(messages), max_nodes)


def struct_of(items: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    if max_nodes is not None:
        items = items.join(graph_sizes(items, max_nodes).where("not fits").select("conv_id"), "conv_id", "left_anti")
    role = F.when(F.col("kind") == 0, F.col("role"))
    node = F.struct("id", by_kind(0).alias("type"), by_kind(1).alias("subtype"), role.alias("role"), "language", "content")
    edge = F.struct(source_of().alias("source"), F.col("id").alias("target"), by_kind(2).alias("relation"))
    gathered = items.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_new"), F.struct(F.col("node_seq").alias("p"), node.alias("x"))))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("edge_seq").isNotNull(), F.struct(F.col("edge_seq").alias("p"), edge.alias("x"))))).alias("e"),
    )
    return gathered.select("conv_id", F.struct(F.col("n.x").alias("nodes"), F.col("e.x").alias("edges")).alias("graph"))


def graph_json(messages: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """(conv_id, graph_json): compact JSON; absent fields are left out.  Graphs beyond max_nodes: see `graph_struct`."""
    return graph_struct(messages, max_nodes).select("conv_id", F.to_json("graph").alias("graph_json"))


def graph_json_or_reason(messages: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(conv_id, graph_json, nodes, reason) of every conversation: its JSON, or why it has none."""
    items = numbered(messages)
    rows = struct_of(items, max_nodes).select("conv_id", F.to_json("graph").alias("graph_json"))
    reason = F.when(~F.col("fits"), F.concat(F.lit("Graph too large: "), "nodes", F.lit(" nodes")))
    return graph_sizes(items, max_nodes).join(rows, "conv_id", "left").select("conv_id", "graph_json", "nodes", reason.alias("reason"))
