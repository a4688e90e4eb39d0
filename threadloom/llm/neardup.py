"""Operator 3: near-duplicates of texts by weighted Jaccard overlap, found with BagMinHash signatures.

A text is the multiset of its five-word shingles (words are lower-cased, split at white space).  Two texts are linked
when the sum of minima over the sum of maxima of their shingle counts is 0.8 or more; classes are the connected
components of the links.

* Signature.  An element of weight w owns the weight interval [0, w), split into [0, 1), [1, 2), [2, 4), [4, 8), ...
  Each part has its own Poisson process over time, as dense as the part is wide, whose points carry a weight position
  and one of M registers; a point counts if its position lies below w, and a register keeps its earliest point.  The
  processes depend on the shingle alone, so two texts share a register with exactly the chance of their weighted
  Jaccard overlap.  Points are made in order of time and only up to the time by which all registers are filled.
* Bands.  BANDS bands of ROWS registers; texts that agree on a whole band meet.  At overlap 0.8 a link is missed with a
  chance of about 3e-6.
* Equal texts are one node from the start, so copies never meet each other.
* Meeting texts are verified exactly, but not in all pairs.  A shingle that no other meeting text has cannot be shared, so
  a text of n shingles, r of them not its own alone, can only be linked to one of m, q if min(r, q) >= (n + m) 0.8 / 1.8;
  this sets most edited copies apart without a comparison.  Each text is then compared with PIVOTS others, members of
  most of its groups that have the least share of shingles of their own.  Links between the components that are left are
  found by an exact prefix join.  So no met link between components is lost, and a
  large group of near-equal texts costs a few comparisons for each member.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps
from .common import cut, drop, free_shuffles, table
from .components import components
from .textbytes import chunks, mix, row_bounds, shingles, word_hashes

WORDS = 5
#: Links have an overlap of NUM / DEN or more.
NUM, DEN = 4, 5
LINKED = f"{DEN} * i >= {NUM} * (i + d)"
BOUND = f"{NUM + DEN} * least(r, q) >= {NUM} * (n + m)"
#: Pivots that a text is compared with.
PIVOTS = 4
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
#: Bits of the slots of the shingle counts; 4 MB whatever the size of the corpus.
SLOT_BITS = 22
#: Elements that are counted together before they meet the others.
COUNTED = 1 << 20

_U = np.uint64
_TINY = 2.0**-54


def bag(data: np.ndarray, offs: np.ndarray, k: int = WORDS):
    """(element hash, row, count) of each row's shingle multiset, in row order; and each row's words (hash, row)."""
    words, rows = word_hashes(data, offs)
    h, r = shingles(words, rows, len(offs) - 1, k)
    if not len(h):
        return h, r, np.zeros(0, np.int64), words, rows
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    return h[at], r[at], np.diff(np.append(at, len(h))), words, rows


def _uniform(s: np.ndarray) -> np.ndarray:
    return (s >> _U(11)).astype(np.float64) * 2.0**-53 + _TINY


def bag_min_hash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers (times); rows without elements stay infinite."""
    sig = np.full(n * m, np.inf)
    total = np.bincount(row, weights=weight, minlength=n)
    todo = total > 0
    limit = (math.log(m) + 3) / np.maximum(total, 1)
    while todo.any():
        use = todo[row]
        eh, er, ew = h[use], row[use], weight[use].astype(np.float64)
        level = 0
        while len(eh):
            lo, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            has = ew > lo
            eh, er, ew = eh[has], er[has], ew[has]
            if not len(eh):
                break
            s, r, w = mix(eh ^ mix(np.full(1, level + 1, np.uint64))), er, ew
            t = np.zeros(len(s))
            rate = m * width
            while len(s):
                s = mix(s)
                t = t - np.log(_uniform(s)) / rate
                alive = t <= limit[r]
                s, t, r, w = s[alive], t[alive], r[alive], w[alive]
                if not len(s):
                    break
                mark = mix(s ^ _U(0xA5A5A5A5A5A5A5A5))
                register = ((mark >> _U(32)) * _U(m)) >> _U(32)
                counts = slice(None)
                if level:
                    counts = lo + width * ((mark & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w
                np.minimum.at(sig, (r * m + register.astype(np.int64))[counts], t[counts])
            level += 1
        todo &= np.isinf(sig.reshape(n, m)).any(1)
        sig.reshape(n, m)[todo] = np.inf
        limit[todo] *= 2
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(sig), 1))
    for i in range(rows):
        key = mix(key * _U(3) ^ bits[:, :, i])
    return key


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _sketches(batches):
    for batch in batches:
        for a, b, data, offs in chunks(batch.column(1)):
            n = b - a
            h, r, c, words, rows = bag(data, offs)
            sig = bag_min_hash(h, r, c, n)
            keys = band_keys(sig)
            bounds = row_bounds(rows, n)
            place = (np.arange(len(words)) - bounds[rows]).astype(np.uint64)
            fp = []
            for seed in (_U(0x51ED270B), _U(0xB492B66F)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place + seed)))])
                fp.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
            full = np.diff(bounds) > 0
            lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), _long(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array(full), _long(fp[0]), _long(fp[1]), lists], ["doc", "full", "fp_a", "fp_b", "keys"]
            )


def _elements(batches):
    """Multisets as sorted sets: the i-th occurrence of a shingle is an element of its own."""
    for batch in batches:
        for a, b, data, offs in chunks(batch.column(1)):
            h, r, c, _, _ = bag(data, offs)
            each = np.repeat(np.arange(len(h)), c)
            nth = (np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
            values = mix(h[each] ^ mix(nth * _U(0x9E3779B97F4A7C15)))
            bounds = row_bounds(r[each], b - a).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(bounds), _long(values))], ["doc", "elements"])


def _counted(batches):
    """(e, c, doc): the different elements of about COUNTED together, how often each occurs, and its first text; so copies of
    a text that stand together are one set of rows."""
    for batch in batches:
        lists = batch.column("elements")
        ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNTED, side="right")))
            part = lists.slice(a, b - a)
            e, at, c = np.unique(part.flatten().to_numpy(), return_index=True, return_counts=True)
            row = a + np.searchsorted(ends[a:b] - (ends[a - 1] if a else 0), at, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(c, pa.int64()), batch.column("doc").take(pa.array(row))], ["e", "c", "doc"])
            a = b


def _verify(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """pairs(a, b) with the exact sums of minima, i, and of maxima less that, d."""
    left = elements.select(F.col("doc").alias("a"), F.col("elements").alias("ea"))
    right = elements.select(F.col("doc").alias("b"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    met = pairs.join(left, "a").join(right, "b")
    return cut(met.select("a", "b", shared.alias("i"), (F.size("ea") + F.size("eb") - 2 * shared).alias("d")))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class): one row for each row of docs; class is the least id of its near-duplicate class.

    Null, empty and blank texts are in no class but their own.  A text of one to four words is one shingle.  Rows that
    share an id count as one document and must hold one text; rows with a null id are left out.  Other columns of docs,
    whatever their names, play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    schema = "doc long, full boolean, fp_a long, fp_b long, keys array<long>"
    marks = cut(texts.mapInArrow(_sketches, schema))
    free_shuffles(spark)

    # equal texts: the least id stands for all
    full = marks.where("full")
    node_of = cut(full.groupBy("fp_a", "fp_b").agg(F.min("doc").alias("node")))
    nodes = full.join(node_of.select(F.col("node").alias("doc")), "doc", "left_semi").select("doc", F.explode("keys").alias("key"))
    groups = cut(nodes.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"))
    free_shuffles(spark)
    crowd = bitmaps.sketch(groups, "key", bits=26)
    meets = cut(bitmaps.thin(nodes, F.col("key"), crowd).join(groups, "key").distinct())
    drop(groups)
    free_shuffles(spark)

    # shingles of the texts that meet another
    members = cut(meets.select("doc").distinct())
    seen = bitmaps.sketch(members.select(F.xxhash64("doc").alias("h")), "h")
    thinned = bitmaps.thin(texts, F.xxhash64("doc"), seen)
    elements = cut(
        thinned.join(members, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_elements, "doc long, elements array<long>")
    )
    free_shuffles(spark)

    sizes = cut(_sizes(elements))
    work = _hopeful(meets.join(sizes, "doc").where(f"{DEN} * r >= {NUM} * n"))
    drop(meets, members)
    free_shuffles(spark)

    judged = _verify(_pivot_pairs(work), elements)
    links = cut(judged.where(LINKED).select("a", "b"))
    roots = components(links)
    more = _close(work, roots, elements)
    if not more.isEmpty():
        drop(roots)
        roots = components(links.union(more))
    drop(judged, links, more, work, sizes, elements)
    free_shuffles(spark)

    # every text to its node, every node to its class
    placed = full.select("doc", "fp_a", "fp_b").join(node_of, ["fp_a", "fp_b"]).select("doc", "node")
    classed = placed.join(roots, "node", "left").select("doc", F.coalesce("root", "node").alias("class"))
    alone = marks.where("not full").select("doc", F.col("doc").alias("class"))
    return classed.union(alone).select(F.col("doc").alias(id_col), "class")


def _sizes(elements: DataFrame) -> DataFrame:
    """(doc, n, r): shingles of each text, and those of them that another text has, too."""
    own = elements.mapInArrow(_counted, "e long, c long, doc long").groupBy("e").agg(F.sum("c").alias("c"), F.min("doc").alias("doc")).where("c = 1").groupBy("doc").agg(F.count("*").alias("u"))
    return elements.select("doc", F.size("elements").alias("n")).join(own, "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("r"))


def _hopeful(members: DataFrame) -> DataFrame:
    """(key, doc, n, r) without the members whose bound no other of their group, by its least size, can meet."""
    least = members.groupBy("key").agg(F.min("n").alias("m"), F.count("*").alias("c")).where("c > 1")
    return cut(members.join(least, "key").where(f"{NUM + DEN} * r >= {NUM} * (n + m)").select("key", "doc", "n", "r"))


def _pivot_pairs(work: DataFrame) -> DataFrame:
    """Pairs (a, b): every text and PIVOTS texts at most, the pivots of most of its groups.

    The pivots of a group are the members with the least share of shingles of their own, one of each salt.
    """
    own = F.min(F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("own"), "doc", "n", "r")).alias("p")
    pivots = work.groupBy("key", F.pmod(F.xxhash64("doc"), F.lit(PIVOTS)).alias("salt")).agg(own)
    pivots = pivots.select("key", F.col("p.doc").alias("pivot"), F.col("p.n").alias("m"), F.col("p.r").alias("q"))
    met = work.join(pivots, "key").where("doc <> pivot").where(BOUND).groupBy("doc", "pivot").agg(F.count("*").alias("c"))
    best = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "pivot"))).alias("best"))
    return best.select("doc", F.explode(F.slice("best.pivot", 1, PIVOTS)).alias("pivot")).select(*_ordered("doc", "pivot")).distinct()


def _slot_counts(texts: DataFrame) -> DataFrame:
    """(slot, n): the elements of each hash slot, counted in their tasks first, so that near copies are one set of rows."""
    slot = F.shiftrightunsigned("e", 64 - SLOT_BITS).cast("int").alias("slot")
    return texts.mapInArrow(_counted, "e long, c long, doc long").groupBy(slot).agg(F.sum("c").alias("n"))


def _rarity(texts: DataFrame) -> Broadcast:
    """A class for each hash slot, twice the logarithm of its count over all elements; 0 for one element or none."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 2).cast("byte")
    found = _slot_counts(texts).where("n > 1").select("slot", level.alias("level")).toArrow()
    classes = np.zeros(1 << SLOT_BITS, np.int8)
    classes[found["slot"].to_numpy()] = found["level"].to_numpy()
    return texts.sparkSession.sparkContext.broadcast(classes)


def _prefixes(rarity: Broadcast):
    """(e, doc, n, root, i): of each text's n elements the first that a linked text must share one of, with their places from 1."""

    def run(batches):
        for batch in batches:
            doc, root, lists = (batch.column(name) for name in ("doc", "root", "elements"))
            size = lists.value_lengths().to_numpy().astype(np.int64)
            e = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            level = rarity.value[(e >> _U(64 - SLOT_BITS)).astype(np.int64)]
            order = np.lexsort((e, level, row))
            e, level = e[order], level[order]
            i = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size) + 1
            n = size[row]
            ok = (i <= n - (NUM * n + DEN - 1) // DEN + 1) & (level > 0)
            at = pa.array(row[ok])
            columns = [_long(e[ok]), doc.take(at), pa.array(n[ok].astype(np.int32)), root.take(at), pa.array(i[ok].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["e", "doc", "n", "root", "i"])

    return run


def _close(work: DataFrame, roots: DataFrame, elements: DataFrame) -> DataFrame:
    """Links between components that the pivots left, by an exact prefix join.

    Of the texts in groups of several components, the shingles of each are ordered by how many of these texts have them,
    told by counts in SLOTS hash slots; any common order makes the join exact, and a slot of one shingle has no match.  Two
    linked texts of n and m shingles, o of them in common, share one among the first n - o + 1 and m - o + 1.  So texts
    that differ by shingles of their own never meet, however many they are; texts of one component do not meet either.
    Shingles that the same texts have among their first (most of those of a passage) are one cell, told by two 64-bit sums
    over its texts, so a pair meets once for each such set and not once for each shingle.
    """
    cell = ["s", "t"]
    rooted = work.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = cut(rooted.join(several, "key").select("doc", "root").distinct())
    texts = cut(elements.join(open_, "doc").select("doc", "root", "elements"))
    first = cut(texts.mapInArrow(_prefixes(_rarity(texts)), "e long, doc long, n int, root long, i int"))
    drop(texts)
    hashes = [F.bit_xor(F.xxhash64("doc", F.lit(seed))).alias(name) for seed, name in enumerate(cell)]
    several = first.groupBy("e").agg(*hashes, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("e", *cell)
    cells = cut(first.join(several, "e").groupBy(*cell, "doc").agg(F.min("i").alias("i"), F.first("n").alias("n"), F.first("root").alias("root")))
    main = cells.groupBy(*cell).agg(F.min_by("root", "doc").alias("main"))
    apart = cells.join(main, cell).where("root <> main").select(*cell, F.col("doc").alias("pivot"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("i").alias("j"))
    apart = cut(apart)
    need = f"(({NUM} * (n + m) + {NUM + DEN - 1}) div {NUM + DEN})"
    near = f"{DEN} * n >= {NUM} * m and {DEN} * m >= {NUM} * n and i <= n - {need} + 1 and j <= m - {need} + 1"
    pairs = cells.join(apart, cell).where(f"root <> other and {near}").select(*_ordered("doc", "pivot")).distinct()
    judged = _verify(pairs, elements)
    more = cut(judged.where(LINKED).select("a", "b"))
    drop(open_, first, cells, apart, judged)
    return more


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class: doc_id, class_id (the least doc_id of the class)."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.col("class").alias("class_id"))
