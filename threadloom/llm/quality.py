"""Operator 8: a quality classifier from weak labels.

1. Seven overlapping heuristics look at a text and vote good, bad or nothing.
2. Texts with the same votes are counted (at most 3**7 patterns, however large the corpus), and expectation-maximisation
   over the patterns estimates each heuristic's accuracies and the share of good texts; no true label is used.
3. The posterior of its pattern labels each text of a bounded sample, on which a linear scorer over hashed features is
   fitted.  The sample has about SAMPLE rows, those with the least hash of id and text, never more than twice as many, and
   is the only bound here.
4. The scorer reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textbytes import WHITE, chunks, lower, span_hashes, spans

SAMPLE = 4000
DIMS = 4096
KEEP_AT = 0.5
#: Shares of capitals and word lengths of texts of fewer words count as zero, and so as good: the other votes decide them.
FEW = 12

#: Raw statistic of each heuristic: bad at or above the first number, good below the second, else no vote.
HEURISTICS = {
    "symbol_share": (0.06, 0.02),
    "capital_share": (0.30, 0.15),
    "pipes_per_word": (0.15, 0.03),
    "shouts_per_word": (0.20, 0.05),
    "stutter_share": (0.20, 0.05),
    "word_length_off": (4.0, 2.0),
    "repeat_share": (0.85, 0.70),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|~^<>{}[]@\\_=+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x heuristics, words of each row) for flat UTF-8 rows; a row without words has zeros only."""
    n = len(offs) - 1
    out = np.zeros((n, len(HEURISTICS)))
    starts, ends, rows = spans(data, offs, WHITE)
    words = np.bincount(rows, minlength=n).astype(np.float64)
    if not len(starts):
        return out, words
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(offs), 1)
    accented = np.zeros(len(data), bool)  # upper-case Latin-1 letters have two bytes
    lead = data == 0xC3
    accented[1:] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out[:, 0] = _sums(_SYMBOL[data], offs) / size
    out[:, 1] = (words >= FEW) * _sums(_UPPER[data] | accented, offs) / np.maximum(_sums(_LETTER[data] | lead, offs), 1)
    out[:, 2] = _sums(data == 124, offs) / some
    out[:, 3] = _sums(data == 33, offs) / some
    hashes = span_hashes(lower(data), starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out[:, 4] = np.bincount(rows, weights=again, minlength=n) / some
    length = _sums((data & 0xC0) != 0x80, offs) - np.bincount(rows, minlength=n)
    out[:, 5] = np.where(words >= FEW, np.abs(np.maximum(length, 0) / some - 5.5), 0)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    # words beyond what a text of this length would repeat anyway: distinct words against the square root law
    distinct = np.bincount(r, weights=fresh, minlength=n)
    out[:, 6] = np.where(words >= 20, 1 - np.minimum(1, distinct / np.maximum(1, 3 * np.sqrt(words))), 0)
    return out, words


def votes(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 no vote, 1 bad, 2 good; a row without words gets no vote."""
    bad, good = np.array(list(HEURISTICS.values())).T
    v = np.where(stats >= bad, 1, np.where(stats < good, 2, 0))
    v[words == 0] = 0
    return v


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: the posterior chance of being good for each pattern.

    The model: given its true class, a text gets each heuristic's vote (good, bad, none) independently.  Junk is of
    several kinds, each seen by one or two heuristics while the others vote good, so a majority would be a poor start:
    EM starts from "any bad vote is bad" and then weighs the heuristics.  Stops when no posterior moves by 1e-9.
    """
    v = (patterns[:, None] // 3 ** np.arange(len(HEURISTICS))) % 3
    good = np.where((v == 1).any(1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.clip((good * counts).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4)
        log = np.tile(np.log([1 - share, share]), (len(v), 1))
        for k in range(v.shape[1]):
            for cls, weight in ((0, (1 - good) * counts), (1, good * counts)):
                chance = np.bincount(v[:, k], weights=weight, minlength=3) + 0.5
                log[:, cls] += np.log(chance / chance.sum())[v[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    return {int(p): float(g) for p, g in zip(patterns, good, strict=True)}


_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _gram_slots(data: np.ndarray) -> np.ndarray:
    """Hash slot of the three bytes ending at each byte (texts' bounds are handled by the caller)."""
    d = data.astype(np.uint32)
    h = d * _MULT[0]
    h[1:] += d[:-1] * _MULT[1]
    h[2:] += d[:-2] * _MULT[2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int64) % DIMS


def _level_slots(stats: np.ndarray) -> np.ndarray:
    """A hashed feature for each heuristic's statistic, cut into sixteen levels."""
    bad = np.array([b for b, _ in HEURISTICS.values()])
    level = np.minimum(15, (stats / bad * 8).astype(np.int64))
    x = (level + 16 * np.arange(stats.shape[1]) + 1).astype(np.uint32) * _MULT[0]
    x ^= x >> np.uint32(13)
    x *= _MULT[1]
    return (x >> np.uint32(20)).astype(np.int64) % DIMS


def features(data: np.ndarray, offs: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Dense hashed features: shares of byte trigrams, and one for each heuristic's level."""
    n = len(offs) - 1
    out = np.zeros((n, DIMS), np.float32)
    slots = _gram_slots(data)
    for r in range(n):
        own = slots[offs[r] + 2 : offs[r + 1]]
        if len(own):
            out[r] = np.bincount(own, minlength=DIMS) / len(own) * 4
    levels = _level_slots(stats)
    np.add.at(out, (np.arange(n)[:, None], levels), 1.0)
    return out


def fit_scorer(x: np.ndarray, target: np.ndarray, steps: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch gradient steps with momentum; weights and, last, the bias."""
    n = len(x)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if n == 0:
        return np.concatenate([w, [0.0]]).astype(np.float64)
    bad = max((1 - target).sum(), 1e-3)
    weight = np.where(target < 0.5, min(10.0, max(1.0, target.sum() / bad)), 1.0)
    weight = (weight / weight.sum()).astype(np.float32)
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - target) * weight
        vw = 0.9 * vw + (x.T @ g.astype(np.float32) + l2 * w)
        vb = 0.9 * vb + float(g.sum())
        w = w - 0.5 * vw
        b = b - 0.5 * vb
    return np.concatenate([w, [b]]).astype(np.float64)


class Model:
    """Posteriors of vote patterns and the scorer's weights; a few tens of kB, carried in the tasks' closure."""

    def __init__(self, posteriors: dict[int, float], weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights


def _vote_pattern(text: Column | str) -> Column:
    @F.arrow_udf("int")
    def pattern(texts: pa.Array) -> pa.Array:
        parts = [pattern_of(votes(*statistics(data, offs))) for _, _, data, offs in chunks(texts)]
        return pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))

    return pattern(text)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Votes of all texts, then the scorer on a bounded sample.

    Texts without words (null, empty, blank) take no part.  An empty table gives a model that scores every text 0.5.  Rows
    may repeat and ids may be null or equal; other columns, whatever their names, play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.groupBy(_vote_pattern("text").alias("pattern")).agg(F.count("*").alias("n")).collect()
    patterns = np.array(sorted(r["pattern"] for r in found if r["pattern"]), np.int64)
    counts = {r["pattern"]: r["n"] for r in found}
    n = np.array([counts[p] for p in patterns], np.float64)
    posteriors = fit_labellers(patterns, n) if len(patterns) else {}
    share = min(1.0, sample / max(1.0, n.sum()))
    bar = int(share * (1 << 62))

    def sampled(batches):
        for batch in batches:
            made, pats = [], []
            for _, _, data, offs in chunks(batch.column(0)):
                stats, words = statistics(data, offs)
                made += [row.tobytes() for row in features(data, offs, stats).astype(np.float16)]
                pats.append(pattern_of(votes(stats, words)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pats).astype(np.int32) if pats else np.zeros(0, np.int32)), pa.array(made, pa.binary())], ["pattern", "x"])

    chosen = texts.where(F.shiftrightunsigned(F.xxhash64("id", "text"), 2) <= F.lit(bar)).select("text")
    chosen = chosen.mapInArrow(sampled, "pattern int, x binary").limit(2 * sample).collect()
    chosen = [r for r in chosen if r["pattern"] in posteriors]
    x = np.array([np.frombuffer(r["x"], np.float16) for r in chosen], np.float32).reshape(len(chosen), DIMS)
    target = np.array([posteriors[r["pattern"]] for r in chosen], np.float64)
    return Model(posteriors, fit_scorer(x, target))


def quality_score(text: Column | str, model: Model) -> Column:
    """The scorer's chance, 0 to 1, that a text is good; 0 for a text without words."""
    weights = model.weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, bias = weights[:-1], weights[-1]
        parts = []
        for _, _, data, offs in chunks(texts):
            stats, words = statistics(data, offs)
            size = np.diff(offs)
            total = np.concatenate([[0.0], np.cumsum(w[_gram_slots(data)])]) if len(data) else np.zeros(1)
            lo = np.minimum(offs[:-1] + 2, offs[1:])
            grams = np.where(size > 2, (total[offs[1:]] - total[lo]) / np.maximum(size - 2, 1) * 4, 0)
            z = grams + w[_level_slots(stats)].sum(1) + bias
            parts.append(np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and the decision: doc_id, score, keep."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs)
    scored = docs.select("doc_id", F.round(quality_score("text", model), 6).alias("score"))
    return scored.withColumn("keep", F.col("score") >= KEEP_AT)
