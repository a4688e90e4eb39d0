"""Operator 5: benchmark decontamination by template canonicalisation.

Texts and benchmark items become token sequences in which numbers, names and units are typed placeholders:

* a token is a run without white space and ASCII punctuation; digits joined by one of . , : are one token;
* a token with a digit is a <number>; a fixed list of words right after a number are a <unit>; a token of several letters
  of which only the first is a capital, and which does not begin a sentence (after . ! ? : or a line end, or at the start
  of the text), is a <name>;
* every other token stands for itself, lower-cased.

Windows of eight template tokens are joined by hash with those of the texts; a shorter item is one window, joined with the
texts' windows of its length.  An item's first word stands for itself, so a <name> or <unit> that begins a window of a text
may also stand for itself.  A window with fewer than half literal tokens is no evidence of that kind.  On each diagonal
(text position minus item position) the values in the slots must match one to one: one item value always stands for the
same text value and the other way round, so a question with new numbers or names is caught, and a chance mix of templates
is not.  A second hash, over the
values, joins windows that are equal word for word; these count whatever their share of literal tokens.  An item is found
in a text if consistent diagonals and equal windows hold at least half of its windows with enough literal tokens, or at
least half of all its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps
from .common import table
from .textbytes import WHITE, chunks, lower, mix, row_bounds, span_hashes, spans

WINDOW = 8
COVER = 0.5
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres"
).split()

_U = np.uint64
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BREAK = WHITE | _PUNCTUATION
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_JOINER = np.zeros(256, bool)
_JOINER[[ord(c) for c in ".,:"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMBER, _UNIT, _NAME = (_U(x) for x in (0x1111, 0x2222, 0x3333))


def _unit_codes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), np.uint8)
    size = np.array([len(u) for u in UNITS])
    ends = np.cumsum(size)
    return np.sort(span_hashes(joined, ends - size, ends))


_UNIT_CODES = _unit_codes()


def template(data: np.ndarray, offs: np.ndarray):
    """(code, value, is slot, row) of every token; code is the template token, value the token itself."""
    starts, ends, rows = spans(data, offs, _BREAK)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, bool), rows
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[ends] > digits[starts]
    pure = digits[ends] - digits[starts] == ends - starts
    # digits joined by one mark belong to the token before
    joined = np.zeros(len(starts), bool)
    joined[1:] = pure[1:] & number[:-1] & (rows[1:] == rows[:-1]) & (starts[1:] == ends[:-1] + 1) & _JOINER[data[ends[:-1] % max(len(data), 1)]]
    head = np.flatnonzero(~joined)
    last = np.append(head[1:], len(starts)) - 1
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    starts, ends, rows, number = starts[head], ends[last], rows[head], number[head]
    low = lower(data)
    value = span_hashes(low, starts, ends)
    previous = np.concatenate([[0], ends[:-1]])
    begins = np.ones(len(starts), bool)
    begins[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] > stops[previous[1:]])
    # one capital, at the start, and more than one letter: a shouted text is no run of names
    capitals = np.concatenate([[0], np.cumsum(low != data)])
    first = np.where(data[starts] == 0xC3, np.minimum(starts + 1, len(data) - 1), starts)
    upper = (low[first] != data[first]) & (capitals[ends] - capitals[starts] == 1) & (ends > first + 1)
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1] & (rows[1:] == rows[:-1])
    unit = after_number & ~number & np.isin(value, _UNIT_CODES)
    name = upper & ~begins & ~number & ~unit
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return code, value, number | unit | name, rows


def _hashes(tokens: np.ndarray, at: np.ndarray, k: int, first: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k tokens from each place on, the first of them replaced if told; those of other lengths differ."""
    h = np.full(len(at), k, np.uint64)
    for i in range(k):
        h = mix(h * _U(3) + (tokens[at + i] if i or first is None else first))
    return h


def windows(data: np.ndarray, offs: np.ndarray, lengths: list[int] | None, verbatim: bool):
    """Windows: (hash, index of the first token, index from which slots count, tokens, is verbatim, has enough literal
    tokens), and (value, is slot, bounds) of the tokens.  Verbatim windows are hashed by value and have no slots.

    Of a text, all windows of the lengths; with lengths None, those of an item: of WINDOW tokens, or the whole if shorter.
    """
    code, value, slot, rows = template(data, offs)
    bounds = row_bounds(rows, len(offs) - 1)
    m = len(code)
    slots = np.concatenate([[0], np.cumsum(slot)])
    left = bounds[rows + 1] - np.arange(m)
    size = np.diff(bounds)[rows]
    parts = []
    for k in range(1, WINDOW + 1) if lengths is None else lengths:
        at = np.flatnonzero((left >= k) & ((size == k) | (k == WINDOW) | (lengths is not None)))
        if not len(at):
            continue
        literal = k - (slots[at + k] - slots[at])
        rich = literal * 2 >= k
        own = at[rich]
        parts.append((_hashes(code, own, k), own, own, np.full(len(own), k), np.zeros(len(own), bool), np.ones(len(own), bool)))
        if verbatim:
            parts.append((mix(_hashes(value, at, k)), at, at + k, np.full(len(at), k), np.ones(len(at), bool), rich))
        if lengths is not None:
            # a name or unit at the start as the word itself
            first = slot[at] & (code[at] != _NUMBER) & ((literal + 1) * 2 >= k)
            own = at[first]
            parts.append((_hashes(code, own, k, value[own]), own, own + 1, np.full(len(own), k), np.zeros(len(own), bool), np.ones(len(own), bool)))
    none = np.zeros(0, np.int64)
    found = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [none.astype(np.uint64), none, none, none, none.astype(bool), none.astype(bool)]
    return (*found, value, slot, bounds)


def _window_rows(only: bitmaps.Sketch | None, lengths: list[int] | None, verbatim: bool):
    def run(batches):
        for batch in batches:
            for a, _, data, offs in chunks(batch.column(1)):
                h, index, begin, here, raw, rich, value, slot, bounds = windows(data, offs, lengths, verbatim)
                if only is not None and len(h):
                    ok = only.lets_through(h)
                    h, index, begin, here, raw, rich = h[ok], index[ok], begin[ok], here[ok], raw[ok], rich[ok]
                row = np.searchsorted(bounds, index, side="right") - 1
                # slot values of each window, in order
                before = np.concatenate([[0], np.cumsum(slot)])
                values = value[slot].view(np.int64)
                lo = before[begin]
                n = before[index + here] - lo
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = values[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], n)]
                slots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                ids = batch.column(0).take(pa.array(row + a))
                columns = [ids, pa.array(h.view(np.int64)), pa.array(index - bounds[row]), slots, pa.array(here.astype(np.int32)), pa.array(raw), pa.array(rich)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "pos", "slots", "size", "raw", "rich"])

    return run


_SCHEMA = "id long, h long, pos long, slots array<long>, size int, raw boolean, rich boolean"


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER, verbatim: bool = True) -> DataFrame:
    """(id, item, matched, windows, coverage): every benchmark item found in a text, one row for each pair.

    Null and empty texts or items have no windows and never match.  Only with `verbatim`, as the
    queries have it, are windows compared by value, and items without enough literal tokens found.  Equal rows and equal items give equal decisions.  Other columns play no part.  A sketch of the items'
    windows (1 MB, whatever their number) thins out the scan; the join that follows is exact.
    """
    tests = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).mapInArrow(_window_rows(None, None, verbatim), _SCHEMA)
    tests = tests.select(F.col("id").alias("item"), "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("size").alias("tokens"), "raw", "rich")
    rich = lambda place: F.count_distinct(F.when(F.col("rich"), F.col(place)))
    size = tests.groupBy("item").agg(F.count_distinct("item_pos").alias("all_windows"), rich("item_pos").alias("rich_windows"))
    only = bitmaps.sketch(tests, "h")
    lengths = [WINDOW, *(r.tokens for r in tests.where(f"tokens < {WINDOW}").select("tokens").distinct().collect())]
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_window_rows(only, lengths, verbatim), _SCHEMA)
    found = found.select("id", "h", "pos", "slots")
    met = found.join(tests, "h").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    line = met.groupBy("id", "item", "diagonal", "raw").agg(pairs.alias("values"), F.collect_set(F.struct("item_pos", "rich")).alias("at"))
    distinct = lambda name: F.size(F.array_distinct(F.col("values").getField(name)))
    n = F.size("values")
    steady = line.where((distinct("item_slots") == n) & (distinct("slots") == n))
    places = steady.select("id", "item", F.explode("at").alias("at")).select("id", "item", "at.item_pos", "at.rich")
    matched = places.groupBy("id", "item").agg(F.count_distinct("item_pos").alias("all_matched"), rich("item_pos").alias("rich_matched"))
    judged = matched.join(size, "item")
    enough = F.coalesce(F.try_divide("rich_matched", "rich_windows") >= cover, F.lit(False))
    judged = judged.select("id", "item", *(F.when(enough, F.col(f"rich_{n}")).otherwise(F.col(f"all_{n}")).alias(n) for n in ("matched", "windows")))
    judged = judged.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= cover)
    return judged.select("id", "item", "matched", "windows", "coverage")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, matched_windows, item_windows, coverage."""
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), verbatim=True)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("matched").alias("matched_windows"),
        F.col("windows").alias("item_windows"),
        F.round("coverage", 6).alias("coverage"),
    )
