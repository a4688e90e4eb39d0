"""Operator 2: shards as runs of a Hilbert curve over metadata, in DataFrame functions only.

1. Each metadata dimension becomes a level of BITS bits: a number (or a string, read as a number from the bytes after the
   prefix that all values share) is placed among approximate quantiles, so levels hold about equally many rows and keep
   the order of the values.
2. The levels are the coordinates of a cell; its index on the Hilbert curve is computed with bit operations.
3. Rows are ranked by (index, id) and the ranks cut into runs, law `rows`: run lengths are at most one apart.
   Rows near each other on the curve have like metadata in every dimension, so a file's value ranges are narrow.

Ranking is distributed: range partitions by (index, id), a count for each, and a row number inside each; a cell with very
many rows is spread over partitions by its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BITS = 6
SHARDS = 16


def _text_numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Order-preserving longs of string columns: seven bytes after the prefix that the least and greatest value share."""
    if not names:
        return {}
    ends = df.agg(*[f(F.col(n).cast("binary")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, n in enumerate(names):
        lo, hi = bytes(ends[f"lo{i}"] or b""), bytes(ends[f"hi{i}"] or b"")
        shared = next((k for k, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
        digits = F.rpad(F.hex(F.substring(F.col(n).cast("binary"), shared + 1, 7)), 14, "0")
        out[n] = F.conv(digits, 16, 10).cast("long")
    return out


def _levels(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Columns __x0, __x1, ... with levels from 0 to 2**bits - 1; nulls have level 0."""
    kinds = dict(df.dtypes)
    numbers = _text_numbers(df, [d for d in dims if kinds[d] == "string"])
    df = df.withColumns({f"__v{i}": numbers.get(d, F.col(d).cast("double")) for i, d in enumerate(dims)})
    shares = [k / 2**bits for k in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(f"__v{i}", shares, 10_000).alias(f"q{i}") for i in range(len(dims))]).first()
    made = {}
    for i in range(len(dims)):
        level = F.lit(0)
        for bound in cuts[f"q{i}"] or []:
            level = level + F.coalesce(F.col(f"__v{i}") > F.lit(bound), F.lit(False)).cast("int")
        made[f"__x{i}"] = level
    return df.withColumns(made).drop(*[f"__v{i}" for i in range(len(dims))])


def with_hilbert_index(df: DataFrame, coordinates: list[str], bits: int, out: str) -> DataFrame:
    """df with the index, a long, of integer coordinates from 0 to 2**bits - 1 on the Hilbert curve of that many
    dimensions.  The steps are Skilling's transform from axes to the transposed index, one column update each."""
    n = len(coordinates)
    if n * bits > 62:
        raise ValueError("dimensions times bits must be 62 at most")
    xs = [f"__h{i}" for i in range(n)]
    df = df.withColumns({x: F.col(c).cast("long") for x, c in zip(xs, coordinates, strict=True)})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = F.lit(q - 1)
        for i in range(n):
            has = F.col(xs[i]).bitwiseAND(F.lit(q)) != 0
            swap = F.col(xs[0]).bitwiseXOR(F.col(xs[i])).bitwiseAND(low)
            if i == 0:
                df = df.withColumns({xs[0]: F.when(has, F.col(xs[0]).bitwiseXOR(low)).otherwise(F.col(xs[0]))})
            else:
                df = df.withColumns(
                    {xs[0]: F.when(has, F.col(xs[0]).bitwiseXOR(low)).otherwise(F.col(xs[0]).bitwiseXOR(swap)), xs[i]: F.when(has, F.col(xs[i])).otherwise(F.col(xs[i]).bitwiseXOR(swap))}
                )
    for i in range(1, n):
        df = df.withColumns({xs[i]: F.col(xs[i]).bitwiseXOR(F.col(xs[i - 1]))})
    turn = F.lit(0).cast("long")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(xs[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits):
        for i, x in enumerate(xs):
            bit = F.shiftright(F.col(x).bitwiseXOR(F.col("__turn")), b).bitwiseAND(F.lit(1))
            index = index + F.shiftleft(bit, b * n + n - 1 - i)
    return df.withColumn(out, index).drop(*xs, "__turn")


def hilbert_shards(rows: DataFrame, id_col: str, dims: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows with hilbert (long), shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Every row gets a place, repeated ones and those with null ids, too.  Dimensions are numbers or strings; null values
    have the least level.  An empty table stays empty.
    """
    placed = with_hilbert_index(_levels(rows, dims, bits), [f"__x{i}" for i in range(len(dims))], bits, "hilbert")
    placed = placed.drop(*[f"__x{i}" for i in range(len(dims))])
    order = ["hilbert", *dict.fromkeys([id_col, *rows.columns])]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(placed.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(every), F.lit(0)).alias("__before"))
    total = counts.agg(F.sum("__n")).first()[0] or 1
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = dealt.withColumn("__in", inside).join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    shard = F.floor(F.col("__rank") * shards / F.lit(total)) if total * shards < 1 << 52 else F.expr(f"__rank * {shards} div {total}")
    sharded = ranked.withColumn("shard", shard.cast("int"))
    slot = F.col("__rank") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return sharded.withColumn("slot", slot.cast("long")).drop("__part", "__in", "__before", "__rank")


def write_shards(rows: DataFrame, sharded: DataFrame, id_col: str, path: str) -> None:
    """Writes whole rows as one folder for each shard, in slot order; ids must be unique."""
    joined = rows.join(sharded.select(id_col, "hilbert", "shard", "slot"), id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs of the curve over (source, lang, size): doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang")
    placed = hilbert_shards(meta, "doc_id", ["source", "lang", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
