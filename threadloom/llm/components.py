"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links(a, b) with the least node of its component.

    Alternates two steps until nothing changes, so the number of rounds grows with the logarithm of the longest chain:
    every node hands its larger neighbours to the least node it knows of, then every node hands its smaller neighbours
    over in the same way.  A node with very many neighbours is only ever aggregated by minimum and joined, never
    gathered.  Rows stay in Spark and lineage is cut each round; an empty graph gives no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(handed.union(low).where("u <> v").distinct())
        drop(edges, large)
        edges = small
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out = cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    drop(edges)
    return out


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
