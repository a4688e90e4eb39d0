"""Word ranking in one message: weighted PageRank over the graph of stems that stand close together.

A batch of messages is one graph.  Its vertices are the stems of each message, numbered by message and then by stem, its
edges join stems of one message; all messages move together, and a message that has settled is taken out.  Nothing is done
for single messages or words but on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stems_of

DAMPING, ROUNDS, SETTLED, WINDOW, TOP = 0.85, 20, 1e-4, 3, 5
#: Words that are stemmed and ranked at once, so that a worker holds little; one longer message stands alone.
WORDS = 1 << 15


@dataclass
class Ranked:
    """The graph of some messages: of each word its message and vertex; of each vertex its message, stem and score."""

    row: np.ndarray
    vertex: np.ndarray
    vertex_row: np.ndarray
    stems: pa.Array
    score: np.ndarray


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and the number of each word."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def ranked(stems: pa.Array, sizes: np.ndarray, window: int = WINDOW) -> Ranked:
    """Scores of all stems of messages with so many words each.

    All scores start at 1 and move together until none of the message moves by SETTLED, or for ROUNDS rounds.
    """
    names, code = _coded(stems)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keys, at = np.unique(row * max(1, len(names)) + code, return_inverse=True)
    vertex_row = keys // max(1, len(names))
    n = len(keys)
    near = [np.flatnonzero(row[:-d] == row[d:]) for d in range(1, min(window, len(at)))]
    both = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([at[i], at[i + d]]) for d, i in enumerate(near, 1))], axis=1)
    both = both[:, both[0] != both[1]]
    source, target = np.concatenate([both, both[::-1]], axis=1)
    share = 1.0 / np.bincount(source, minlength=n)[source]
    score, moving = np.ones(n), np.ones(len(sizes), bool)
    first = np.flatnonzero(np.append(True, vertex_row[1:] != vertex_row[:-1])) if n else np.zeros(0, np.int64)
    for _ in range(ROUNDS if n else 0):
        new = (1 - DAMPING) + DAMPING * np.bincount(target, weights=score[source] * share, minlength=n)
        active = moving[vertex_row]
        moved = np.where(active, np.abs(new - score), 0.0)
        score = np.where(active, new, score)
        moving[vertex_row[first]] &= np.maximum.reduceat(moved, first) >= SETTLED
        if not moving.any():
            break
        left = moving[vertex_row[source]]
        if 2 * np.count_nonzero(left) < len(left):
            source, target, share = source[left], target[left], share[left]
    return Ranked(row, at, vertex_row, names.take(pa.array(keys % max(1, len(names)))), score)


def _firsts(rows: np.ndarray) -> np.ndarray:
    """For sorted numbers, how many equal ones stand before each."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _forms(words: pa.Array, graph: Ranked, best: np.ndarray) -> np.ndarray:
    """The place of the most frequent word of each vertex of the best, ties to the smaller word; -1 for other vertices."""
    names, code = _coded(words)
    kept = np.flatnonzero(best[graph.vertex])
    keys, at, n = np.unique(graph.vertex[kept] * max(1, len(names)) + code[kept], return_index=True, return_counts=True)
    vertex = keys // max(1, len(names))
    order = np.lexsort((keys, -n, vertex))
    chosen = order[_firsts(vertex[order]) == 0]
    out = np.full(len(best), -1, np.int64)
    out[vertex[chosen]] = kept[at[chosen]]
    return out


def phrases(words: pa.Array, stems: pa.Array, sizes: np.ndarray, top: int = TOP, window: int = WINDOW) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(messages, phrases, stems joined by _) of the best words of each message, in order of first mention, at most `top`.

    The best stems in a row, without equal neighbours, are a run; words at even places of a run open a phrase and those at
    odd places close it.
    """
    g = ranked(stems, sizes, window)
    order = np.lexsort((np.arange(len(g.score)), -np.round(g.score, 9), g.vertex_row))
    best = np.zeros(len(g.score), bool)
    best[order[_firsts(g.vertex_row[order]) < top]] = True
    at = np.flatnonzero(best[g.vertex])
    vertex, row = g.vertex[at], g.row[at]
    joins = np.zeros(len(at), bool)
    joins[1:] = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & (vertex[1:] != vertex[:-1])
    runs = np.cumsum(~joins)
    opens = np.flatnonzero(_firsts(runs) % 2 == 0)
    after = np.minimum(opens + 1, max(len(at) - 1, 0))
    paired = (opens + 1 < len(at)) & joins[after] if len(at) else np.zeros(0, bool)
    one, two = vertex[opens], np.where(paired, vertex[after], -1) if len(at) else opens
    _, seen = np.unique(one * (len(best) + 1) + two + 1, return_index=True)
    seen = np.sort(seen)
    seen = seen[_firsts(row[opens[seen]]) < top]
    one, two = one[seen], two[seen]
    form = _forms(words, g, best)
    pick = lambda values, place: values.take(pa.array(place, pa.int64(), mask=place < 0))
    join = lambda a, b, by: pc.binary_join_element_wise(a, b, by, null_handling="skip")
    shown = [pc.ascii_capitalize(pick(words, np.where(v < 0, -1, form[v]))) for v in (one, two)]
    keys = [pick(g.stems, v) for v in (one, two)]
    return row[opens[seen]], join(*shown, " "), join(*keys, "_")


def scores(stems: list[str], window: int = WINDOW) -> dict[str, float]:
    """Scores of the stems of one message."""
    g = ranked(pa.array(stems, pa.string()), np.array([len(stems)]), window)
    return dict(zip(g.stems.to_pylist(), g.score.tolist(), strict=True))


def keywords_of(words: list[str], stems: list[str], top: int = TOP, window: int = WINDOW) -> list[tuple[str, str]]:
    """(phrase, stems joined by _) of one message."""
    _, shown, keys = phrases(pa.array(words, pa.string()), pa.array(stems, pa.string()), np.array([len(stems)]), top, window)
    return list(zip(shown.to_pylist(), keys.to_pylist(), strict=True))


def _parts(rows: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first message, end, words of each) of consecutive messages with about WORDS words; a null message has none."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS, side="right")))
        yield a, b, sizes[a:b]
        a = b


def _listed(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def near_pairs(stems: pa.Array, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(messages, stems, stems, weights): how often two different stems of a message stand less than `window` places apart,
    both ways."""
    names, code = _coded(stems)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n, keys = max(1, len(names)), [np.zeros(0, np.int64)]
    for d in range(1, min(window, len(code))):
        at = np.flatnonzero((row[:-d] == row[d:]) & (code[:-d] != code[d:]))
        one, two = code[at], code[at + d]
        keys.append((row[at] * n + np.minimum(one, two)) * n + np.maximum(one, two))
    keys, weight = np.unique(np.concatenate(keys), return_counts=True)
    row, one, two = keys // n // n, names.take(pa.array(keys // n % n)), names.take(pa.array(keys % n))
    return np.concatenate([row, row]), pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), np.concatenate([weight, weight])


def _kept(rows: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array, pa.Array]]:
    """(first message, end, words of each, words, stems) of the words whose stem has more than one letter, by parts of the rows."""
    for a, b, sizes in _parts(rows):
        words = rows.slice(a, b - a).flatten()
        stems = stems_of(words)
        kept = pc.greater(pc.utf8_length(stems), 1)
        row = np.repeat(np.arange(b - a), sizes)[kept.to_numpy(zero_copy_only=False)]
        yield a, b, np.bincount(row, minlength=b - a), words.filter(kept), stems.filter(kept)


def pair_rows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, src, dst, weight) for rows of key columns and `words`: `near_pairs` of each row, without a shuffle."""
    key = rows.drop("words").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, sizes, _, stems in _kept(batch.column("words")):
                row, src, dst, weight = near_pairs(stems, sizes, window)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in key), src, dst, pa.array(weight, pa.int64())], [*key, "src", "dst", "weight"])

    fields = [*rows.drop("words").schema.fields, T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.LongType(), False)]
    return rows.mapInArrow(run, T.StructType(fields))


def rank_stems(words: Column | str, window: int = WINDOW) -> Column:
    """array<struct<stem, score>> for the kept words of a message; stemming and ranking share a worker."""

    @F.arrow_udf("array<struct<stem: string, score: double>>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for a, b, sizes, _, stems in _kept(rows):
            g = ranked(stems, sizes, window)
            out.append(_listed(pa.StructArray.from_arrays([g.stems, pa.array(g.score)], ["stem", "score"]), g.vertex_row, b - a))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("stem", pa.string()), ("score", pa.float64())])))

    return run.asNondeterministic()(words)


def keyword_phrases(words: Column | str, top: int = TOP, window: int = WINDOW) -> Column:
    """array<struct<phrase, key>> for the kept words of a message; stemming and ranking share a worker."""

    @F.arrow_udf("array<struct<phrase: string, key: string>>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for a, b, sizes, kept, stems in _kept(rows):
            row, shown, keys = phrases(kept, stems, sizes, top, window)
            out.append(_listed(pa.StructArray.from_arrays([shown, keys], ["phrase", "key"]), row, b - a))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("phrase", pa.string()), ("key", pa.string())])))

    return run.asNondeterministic()(words)
