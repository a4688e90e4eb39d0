"""Operator 7: token ids packed into fixed-length rows by best-fit decreasing.

* A text longer than a row is split, without loss, into full pieces and a rest; a text without tokens has no piece.
* Pieces are placed in order of falling length; each goes to the fullest row that still has room (a segment tree over
  free capacities finds it), or opens a new row.  Pieces of one length are alike to the packing, so the placement is
  worked out on the counts by length, at most CAPACITY numbers whatever the size of the corpus: a run of equal rows
  takes a run of equal pieces at once.  The result is the exact global best-fit-decreasing packing.
* A piece finds its row from its length and its rank among the pieces of that length; ranks come from counts of salted
  groups, so no length is ever ranked in one task.
* A packed row holds the ids, padded with PAD to CAPACITY, the cumulative segment lengths, and position numbers that
  start anew in each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import unigram
from .common import cut, free_shuffles, table
from .textbytes import chunks
from .tokens import VOCABULARY

CAPACITY = 2048
PAD = 0
#: Pieces of one length that are ranked together, about.
RANKED_TOGETHER = 20_000


class Capacities:
    """Segment tree over free capacities 0 .. n: how many row runs have each, and the least one that is enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def least_from(self, capacity: int) -> int | None:
        """The least capacity >= the given one that some run has."""
        i = capacity + self.size
        if self.tree[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placement rules for `counts` pieces of each length: rows of (length, first rank, first row, pieces a row, offset,
    segment), sorted.  The piece of rank r >= first rank (below the next rule's) of that length lies in row
    first row + (r - first rank) // pieces, at offset + ((r - first rank) % pieces) * length."""
    tree = Capacities(capacity)
    free: dict[int, list[tuple[int, int, int, int]]] = {}  # capacity left: runs of (first row, rows, offset, segments)
    rules, rows = [], 0

    def put(left: int, run: tuple[int, int, int, int]) -> None:
        free.setdefault(left, []).append(run)
        tree.add(left, 1)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.least_from(length)
            if left is None:
                left = capacity
                first, n, offset, segments = rows, -(-todo // (capacity // length)), 0, 0
                rows += n
            else:
                first, n, offset, segments = free[left].pop()
                tree.add(left, -1)
            each = left // length
            full = min(n, todo // each)
            if full:
                rules.append((length, rank, first, each, offset, segments))
                put(left - each * length, (first, full, offset + each * length, segments + each))
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and todo and todo < each:
                rules.append((length, rank, first, each, offset, segments))
                put(left - todo * length, (first, 1, offset + todo * length, segments + todo))
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            if n:
                put(left, (first, n, offset, segments))
    return np.array(sorted(rules), np.int64).reshape(-1, 6)


def _encoded(vocabulary: unigram.Vocabulary, dtype: str):
    def run(batches):
        cache = unigram.cache_of(vocabulary, want_ids=True)
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                ids, bounds = unigram.encode_rows(cache, data, offs)
                flat = ids.astype(dtype)
                width = flat.dtype.itemsize
                made = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], made], ["doc", "ids"])

    return run


def pack(docs: DataFrame, vocabulary: unigram.Vocabulary, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each packed row: row (long, gapless from 0), doc_ids array<long>, pieces array<int> (the piece's number
    in its document), cu_seqlens array<int> (from 0 to the tokens used), ids and positions (little-endian int32 rows of
    `capacity` entries).

    Null and empty texts have no tokens and so no piece.  Rows that share an id are packed each for itself.  Other
    columns play no part.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    dtype = "<u2" if len(vocabulary.pieces) <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    coded = cut(texts.mapInArrow(_encoded(vocabulary, dtype), "doc long, ids binary"))
    n = (F.length("ids") / width).cast("long")
    numbers = F.sequence(F.lit(0), F.expr(f"cast((length(ids) div {width} - 1) div {capacity} as int)"))
    pieces = coded.where(F.length("ids") > 0).select("doc", "ids", n.alias("n"), F.explode(numbers).alias("piece"))
    pieces = pieces.select(
        "doc", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"),
        F.expr(f"substring(ids, piece * {capacity * width} + 1, {capacity * width})").alias("ids"),
    )

    by_length = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    rules = best_fit_decreasing(by_length, capacity)
    salts = max(1, -(-max(by_length.values(), default=1) // RANKED_TOGETHER))
    salt = F.pmod(F.xxhash64("doc", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("size", "salt", before.alias("before")))
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc", "piece"))
    ranks = salted.select("doc", "piece", "size", "salt", "ids", within.alias("within"))
    ranked = ranks.join(offsets, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    @F.arrow_udf("struct<row: long, at: int>")
    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        s, r = size.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        big = np.int64(1) << 40
        rule = rules[np.searchsorted(rules[:, 0] * big + rules[:, 1], s * big + r, side="right") - 1]
        step = r - rule[:, 1]
        row = rule[:, 2] + step // rule[:, 3]
        at = rule[:, 4] + step % rule[:, 3] * s
        return pa.StructArray.from_arrays([pa.array(row), pa.array(at.astype(np.int32))], ["row", "at"])

    put = ranked.select(place("size", "rank").alias("p"), "doc", "piece", "ids")
    gathered = put.groupBy(F.col("p.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("p.at", "doc", "piece", "ids"))).alias("parts"))

    def filled(batches):
        for batch in batches:
            parts = batch.column(1)
            offs, items = parts.offsets.to_numpy().astype(np.int64), parts.values
            raw, ends = items.field(3), None
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            flat = np.frombuffer(raw.buffers()[2], dtype)[ends[0] // width : ends[-1] // width].astype("<i4")
            size = np.diff(ends) // width
            first, last = offs[0], offs[-1]
            at = items.field(0).to_numpy()[first:last].astype(np.int64)
            size = size[first:last]
            rows = len(batch)
            count = np.diff(offs)
            owner = np.repeat(np.arange(rows), count)
            ids = np.full(rows * capacity, PAD, "<i4")
            positions = np.zeros(rows * capacity, "<i4")
            start = owner * capacity + at
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            where = np.repeat(start, size) + inner
            skip = int((ends[first] - ends[0]) // width)
            ids[where] = flat[skip : skip + len(where)]
            positions[where] = inner
            # cumulative lengths: the offsets of the segments and the end of the last one
            bounds = offs - first
            cu = np.zeros(len(owner) + rows, np.int32)
            cu[np.arange(len(owner)) + owner] = at
            cu[bounds[1:] + np.arange(rows)] = (at + size)[bounds[1:] - 1]
            lists = lambda values, b: pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), values)
            wide = pa.py_buffer((np.arange(rows + 1) * capacity * 4).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), lists(items.field(1)[first:last], bounds), lists(items.field(2)[first:last], bounds),
                    lists(pa.array(cu), bounds + np.arange(rows + 1)),
                    pa.Array.from_buffers(pa.binary(), rows, [None, wide, pa.py_buffer(ids.tobytes())]),
                    pa.Array.from_buffers(pa.binary(), rows, [None, wide, pa.py_buffer(positions.tobytes())]),
                ],
                ["row", "doc_ids", "pieces", "cu_seqlens", "ids", "positions"],
            )

    free_shuffles(spark)
    return gathered.mapInArrow(filled, "row long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary")


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet files, ordered by row."""
    packed.repartitionByRange("row").sortWithinPartitions("row").write.parquet(path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed row: row, doc_ids, pieces, cu_seqlens, and CRC-32 of the id and position rows."""
    packed = pack(table(spark, sf_dir, "documents"), unigram.read_vocabulary(VOCABULARY))
    return packed.select("row", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
