"""Operator 11: hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

Vectors are made integers, floor(SCALE * x); a score is an integer inner product, and higher scores come first, equal ones
by the smaller id.  An anchor's positives are its first POSITIVES other rows of the same label.  For each anchor and
positive of score s, its negatives are the first NEGATIVES rows of another label whose score lies between 0.5 s and 0.95 s.

Both searches are one join: `ask` rows hold a vector and windows [low, high] of scores, and each window is to be filled
with its k best rows.

* Index.  Rows meet the asks in groups, a stripe of rows with a block of asks.  In a task, rows come in batches; of each
  row, the leading dimensions whose norm, times the largest such norm of the asks, stays below the least threshold are
  left out of the index, and rows left out in whole are never touched.  Dimensions stand in order of growing mean square,
  the same for all, so that as many as possible are left out.
* Accumulation runs over blocks of dimensions from the last to the first.  After each block, pairs whose partial score
  plus the product of the norms still to come stays below the ask's threshold are dropped.  Pairs that are left are
  scored in whole, exactly.
* Thresholds.  A window starts at the score that as many rows as it wants are expected to reach, told by a bounded sample
  of rows, and not below its own low end.  Inside a task the threshold rises with the rows found.  A window that is not
  filled is asked again from a lower threshold: the k-th best score of the sample, then its own low end.

Equal vectors of one label are one point with as many of their least ids as any window can use, so that groups of copies
are met once and nothing is lost.  The same holds for anchors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_shuffles, table

POSITIVES = 5
NEGATIVES = 3
#: Window of negative scores, in hundredths of the positive score.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows that the first thresholds are taken from, at most; fewer where they would hold more than 2**19 components.
SAMPLE = 4096
#: Asks of a block, rows of a stripe, and rows that are indexed at once.
BLOCK, STRIPE, BATCH = 2048, 1 << 16, 1024
#: Dimensions that are accumulated between two prunings.
STEP = 16
#: Below this share of living pairs they are scored one by one.
SPARSE = 0.05

_LEAST, _MOST = -(1 << 62), 1 << 62
_ASK = "point long, label long, vector array<int>, lows array<long>, highs array<long>"
_FOUND = "point long, slot int, score long, row long"


def _ints(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def _sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(col: pa.Array, dims: int, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _norms(v: np.ndarray) -> np.ndarray:
    """n x (d + 1): the norms of the first 0, 1, ..., d components of each row."""
    sums = np.zeros((v.shape[0], v.shape[1] + 1))
    np.cumsum(np.square(v, dtype=np.float64), axis=1, out=sums[:, 1:])
    return np.sqrt(sums)


def reached(q: np.ndarray, q_norms: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row, score) of every pair of the rows of q and x whose inner product reaches the ask's threshold.

    q and x hold integers; q_norms are the prefix norms of q.  Norms are rounded, so bounds have one unit of slack.
    """
    none = np.zeros(0, np.int64)
    if not len(q) or not len(x):
        return none, none, none
    d = x.shape[1]
    x_norms = _norms(x)
    covered = (x_norms * q_norms.max(0) < t.min() - 1.0).sum(1)  # bounds grow with the number of dimensions
    rows = np.flatnonzero(covered <= d)
    if not len(rows):
        return none, none, none
    start = np.maximum(covered[rows] - 1, 0)  # dimensions that are left out
    index = np.where(np.arange(d) >= start[:, None], x[rows], x.dtype.type(0))
    asks = np.arange(len(q))
    part = np.zeros((len(asks), len(rows)), index.dtype)
    for high in range(d, 0, -STEP):
        low = max(0, high - STEP)
        part = part + q[np.ix_(asks, range(low, high))] @ index[:, low:high].T
        rest = np.maximum(low, start)  # dimensions not yet in the sums
        alive = part + q_norms[asks][:, rest] * x_norms[rows, rest] >= (t[asks] - 1.0)[:, None]
        some = alive.any(1), alive.any(0)
        if not some[0].any():
            return none, none, none
        if some[0].mean() < 0.9 or some[1].mean() < 0.9:
            asks, rows, start = asks[some[0]], rows[some[1]], start[some[1]]
            index, part, alive = index[some[1]], part[np.ix_(*some)], alive[np.ix_(*some)]
        if low and alive.mean() < SPARSE:
            break
    a, r = np.nonzero(alive)
    if low == 0 and not start.any():
        score = part[a, r]
        a, r, ok = asks[a], rows[r], score >= t[asks[a]]
        return a[ok], r[ok], score[ok].astype(np.int64)
    a, r = asks[a], rows[r]
    score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[r[i : i + 65536]]) for i in range(0, len(a), 65536)] or [none])
    ok = score >= t[a]
    return a[ok], r[ok], score[ok].astype(np.int64)


class _Windows:
    """The best rows of each window of a block of asks, and the asks' thresholds that follow from them."""

    def __init__(self, point, label, q, lows, highs, k, same):
        self.point, self.label, self.q, self.k, self.same = point, label, q, k, same
        self.norms = _norms(q)
        self.slots = np.array([len(x) for x in lows], np.int64)
        width = max(1, int(self.slots.max(initial=0)))
        fill = lambda lists, empty: np.array([list(x) + [empty] * (width - len(x)) for x in lists], np.int64).reshape(-1, width)
        self.low, self.high = fill(lows, _MOST), fill(highs, _LEAST)
        self.bar = self.low.copy()
        z = np.zeros(0, np.int64)
        self.best = z, z, z, z  # ask, slot, score, row's point

    def feed(self, rows: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        a, r, score = reached(self.q, self.norms, self.bar.min(1).astype(np.float64), x)
        fits = (labels[r] == self.label[a]) == self.same
        a, r, score = a[fits], rows[r[fits]], score[fits]
        parts = [self.best]
        for slot in range(self.low.shape[1]):
            ok = (score >= self.bar[a, slot]) & (score <= self.high[a, slot])
            parts.append((a[ok], np.full(int(ok.sum()), slot, np.int64), score[ok], r[ok]))
        a, slot, score, row = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((row, -score, slot, a))
        a, slot, score, row = a[order], slot[order], score[order], row[order]
        group = a * self.low.shape[1] + slot
        first = np.searchsorted(group, group)
        kept = np.arange(len(group)) - first < self.k
        self.best = a[kept], slot[kept], score[kept], row[kept]
        last = np.arange(len(group)) - first == self.k - 1
        self.bar[a[last], slot[last]] = score[last]

    def found(self) -> pa.RecordBatch:
        a, slot, score, row = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.point[a]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(row)], ["point", "slot", "score", "row"])


def _searched(dims: int, order: list[int], kind, k: int, same: bool):
    """Rows sorted by group, asks before rows, to the k best rows of each window in each group."""

    def run(batches):
        now, windows, waiting = None, None, []
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if group[a] != now:
                    if windows is not None:
                        yield windows.found()
                    now, windows, waiting = group[a], None, []
                part = batch.slice(a, b - a)
                split = int(np.searchsorted(part.column("side").to_numpy(), 1))
                if split:
                    waiting.append(part.slice(0, split))
                if split == b - a or (windows is None and not waiting):
                    continue
                if windows is None:
                    asks = pa.Table.from_batches(waiting).combine_chunks()
                    col = lambda n: asks.column(n).combine_chunks()  # noqa: B023, E731
                    q = _matrix(col("vector"), dims, kind)[:, order]
                    windows, waiting = _Windows(col("point").to_numpy(), col("label").to_numpy(), q, col("lows").to_pylist(), col("highs").to_pylist(), k, same), []
                rows = part.slice(split)
                ids, labels = rows.column("point").to_numpy(), rows.column("label").to_numpy()
                x = _matrix(rows.column("vector"), dims, kind)[:, order]
                for i in range(0, len(ids), BATCH):
                    windows.feed(ids[i : i + BATCH], labels[i : i + BATCH], x[i : i + BATCH])
        if windows is not None:
            yield windows.found()

    return run


def _joined(asks: DataFrame, points: DataFrame, shape: tuple, total: int, k: int, same: bool) -> DataFrame:
    """(point, slot, score, row): the k best rows of each window in each stripe of rows, at least.

    With `same`, only rows of the ask's label meet it; their blocks and stripes are cut by the label's own counts.
    """
    if same:
        up = lambda n, size: F.ceil(F.col(n) / size).cast("int")
        sizes = points.groupBy("label").agg(F.count("*").alias("np")).join(asks.groupBy("label").agg(F.count("*").alias("nq")), "label")
        sizes = cut(sizes.select("label", up("nq", BLOCK).alias("blocks"), up("np", STRIPE).alias("stripes")))
        asks, points = (x.join(sizes, "label").withColumn("key", F.col("label")) for x in (asks, points))
    else:
        known = {"blocks": F.lit(-(-asks.count() // BLOCK)), "stripes": F.lit(-(-total // STRIPE)), "key": F.lit(0).cast("long")}
        asks, points = asks.withColumns(known), points.withColumns(known)
    own = lambda n: F.pmod(F.xxhash64("point"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<long>")
    left = asks.select("key", F.lit(0).alias("side"), "point", "label", "vector", "lows", "highs", own("blocks").alias("b"), each("stripes").alias("s"))
    right = points.select("key", F.lit(1).alias("side"), "point", "label", "vector", none.alias("lows"), none.alias("highs"), own("stripes").alias("s"), each("blocks").alias("b"))
    both = left.unionByName(right).select(F.xxhash64("key", "b", "s").alias("group"), "side", "point", "label", "vector", "lows", "highs")
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dims, order, kind = shape
    return both.repartition(parts, "group").sortWithinPartitions("group", "side").mapInArrow(_searched(dims, order, kind, k, same), _FOUND)


def _steps(sample: tuple, total: int, shape: tuple, k: int, same: bool):
    """Adds to each ask, for each window, the thresholds of the rounds to come: two scores of the sample, then its low end."""
    dims, order, kind = shape
    ids, labels, rows = sample
    rank = max(1, min(k, math.ceil(k * len(ids) / max(total, 1)) + 1))

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("vector"), dims, kind)
            label, point = batch.column("label").to_numpy(), batch.column("point").to_numpy()
            made = []
            for at, (lows, highs) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist(), strict=True)):
                score = rows @ q[at]
                score = np.sort(score[((labels == label[at]) == same) & (ids != point[at])])[::-1]
                steps = []
                for low, high in zip(lows, highs, strict=True):
                    fit = score[np.searchsorted(-score, -high) :]
                    told = [max(low, int(fit[i - 1])) if len(fit) >= i else low for i in (rank, k)]
                    steps.append([told[0], min(told), low])
                made.append(steps)
            kind_ = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("point", "label", "vector", "lows", "highs")), pa.array(made, kind_)], ["point", "label", "vector", "lows", "highs", "steps"])

    return run


def best_in_windows(asks: DataFrame, points: DataFrame, shape: tuple, sample: tuple, total: int, k: int, same: bool) -> DataFrame:
    """(point, slot, score, row): for each window of asks(point, label, vector, lows, highs), the k first points by score
    and least id, or all if fewer; points of the ask's label, or else of the other labels.

    Every round lowers the thresholds of the windows that are not filled; after the third they stand at the low ends.
    """
    open_ = cut(asks.mapInArrow(_steps(sample, total, shape, k, same), f"{_ASK}, steps array<array<long>>"))
    done = None
    for turn in range(3):
        now = F.transform("steps", lambda s: F.get(s, F.lit(turn)))  # noqa: B023
        found = cut(_joined(open_.select("point", "label", "vector", now.alias("lows"), "highs"), points, shape, total, k, same))
        free_shuffles(asks.sparkSession)
        order = Window.partitionBy("point", "slot").orderBy(F.desc("score"), "row")
        best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        counts = best.groupBy("point", "slot").agg(F.count("*").alias("n"))
        slots = open_.select("point", F.posexplode("steps").alias("slot", "s")).join(counts, ["point", "slot"], "left")
        short = (F.coalesce("n", F.lit(0)) < k) & (F.get("s", F.lit(turn)) > F.get("s", F.lit(2)))
        again = slots.where(short).select("point").distinct()
        again = cut(again)
        best = best.select("point", "slot", "score", "row")
        done_now = best.join(again, "point", "left_anti")
        done = done_now if done is None else done.union(done_now)
        if turn == 2 or again.isEmpty():
            return cut(done)
        open_ = cut(open_.join(again, "point", "left_semi"))
    raise AssertionError


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1 for each anchor and positive.

    anchors holds ids (id_col) of rows of vectors.  A negative's score n and the positive's p satisfy
    low p <= 100 n <= high p.  Rows with a null id or label, a null or empty vector, or any null or non-finite component
    take no part, nor do vectors of another length than most (of equally many, the shorter).  Rows that share an id count
    once, with the least label and vector.  Fewer rows than asked for: all there are; empty tables: no rows.  Other
    columns, whatever their names, play no part.  Components so large that a score may pass 2**55 raise a ValueError.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.where(_sound(v) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), _ints(v, scale).alias("vector")).alias("r"))
    rows = cut(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length["n"]
    rows = rows.where(F.size("vector") == dims)
    ends = rows.agg(F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    top = max(abs(ends[0]), abs(ends[1]))
    if dims * top * top >= 1 << 55 or top >= 1 << 31:
        raise ValueError("components are too large for integer scores")
    kind = np.float64 if dims * top * top < 1 << 52 else np.int64
    squares = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("s"))
    order = [r["d"] for r in squares.orderBy("s", "d").collect()]  # one row a dimension
    shape = dims, order, kind

    # equal vectors of one label are one point; a window takes the ids of k points at most, and k of each at most
    k = positives + 1
    need = max(k, negatives)
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("id"))
    least = rows.withColumn("n", place).where(F.col("n") <= need)
    points = least.groupBy("label", "vector").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))
    points = cut(points.select("point", "label", F.col("vector").cast("array<int>").alias("vector"), "ids"))
    asked = rows.join(anchors.select(F.col(id_col).cast("long").alias("id")).distinct(), "id").select("id", "label", F.col("vector").cast("array<int>").alias("vector"))
    asked = cut(asked.join(points.select("point", "label", "vector"), ["label", "vector"]).select("id", "point"))
    ask_points = cut(points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "label", "vector"))
    free_shuffles(spark)
    if ask_points.isEmpty():
        return spark.createDataFrame([], schema)
    total = points.count()
    picked = points.orderBy(F.xxhash64("point"), "point").limit(max(64, min(SAMPLE, (1 << 19) // dims))).select("point", "label", "vector").toArrow()
    sample = picked["point"].to_numpy(), picked["label"].to_numpy(), _matrix(picked["vector"].combine_chunks(), dims, kind)

    # the first rows of the own label, the anchor's own point among them
    wide = ask_points.withColumns({"lows": F.array(F.lit(_LEAST)), "highs": F.array(F.lit(_MOST))})
    near = best_in_windows(wide, points.select("point", "label", "vector"), shape, sample, total, k, True)
    named = near.join(points.select(F.col("point").alias("row"), "ids"), "row").select("point", "score", F.explode("ids").alias("id"))
    by_score = Window.partitionBy("point").orderBy(F.desc("score"), "id")
    first = cut(named.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k).select("point", "score", "id"))

    # a window of scores for each score of a positive; only these can hold 0.5 s <= 0.95 s
    bounds = first.where(f"{low} * score <= {high} * score").groupBy("point").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    lows, highs = F.expr(f"transform(scores, s -> ({low} * s + 99) div 100)"), F.expr(f"transform(scores, s -> {high} * s div 100)")
    narrow = cut(ask_points.join(bounds, "point").select("point", "label", "vector", lows.alias("lows"), highs.alias("highs"), "scores"))
    apart = best_in_windows(narrow.drop("scores"), points.select("point", "label", "vector"), shape, sample, total, negatives, False)
    told = apart.join(points.select(F.col("point").alias("row"), "ids"), "row").select("point", "slot", "score", F.explode("ids").alias("negative_id"))
    by_slot = Window.partitionBy("point", "slot").orderBy(F.desc("score"), "negative_id")
    told = told.withColumn("rank", F.row_number().over(by_slot).cast("int")).where(F.col("rank") <= negatives)
    found = told.groupBy("point", "slot").agg(F.collect_list(F.struct("rank", "negative_id", F.col("score").alias("negative_score"))).alias("found"))
    slots = narrow.select("point", F.posexplode("scores").alias("slot", "score")).join(found, ["point", "slot"])

    # from points back to anchors: an anchor is not its own positive
    lists = first.join(slots.select("point", "score", "found"), ["point", "score"], "left")
    lists = lists.groupBy("point").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "found"))).alias("first"))
    each = asked.join(lists, "point").select(F.col("id").alias("anchor_id"), F.slice(F.filter("first", lambda p: p["id"] != F.col("id")), 1, positives).alias("p"))
    pairs = each.select("anchor_id", F.explode("p").alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"), F.explode("p.found").alias("f"))
    return pairs.select("anchor_id", "positive_id", "f.rank", "f.negative_id", "positive_score", "f.negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every embedding whose vec_id is divisible by 50; where it is divisible by 7, the label moves on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = rows.select("vec_id", "embedding", F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(moved, moved.where(F.pmod("vec_id", F.lit(50)) == 0).select("vec_id"))
