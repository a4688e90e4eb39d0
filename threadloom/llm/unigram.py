"""Unigram tokenisation: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search.

The vocabulary is that of a SentencePiece model file, a parameter; nothing is trained.  For a file of unigram type the
piece scores are the file's own.  The public file at hand holds merge ranks instead, so its unigram scores are derived
by a fixed rule, -ln(rank + 2), rank being the place among the ordinary pieces, rounded to multiples of 1/16.  Scores are
summed as integers, multiples of 2**-30: sums are exact and do not depend on where a text is cut, which lets every
distinct unit of a task be solved once.  A library that adds 32-bit floats gives the same ids unless its own rounding
decides between paths whose true scores are equal or closer than its last digit; for scores in sixteenths it has none.

Search rules, those of the public SentencePiece unigram tokenizer:

* a dummy space is put before a text that is not empty; spaces are the symbol U+2581 (here the byte 0x20); a literal
  U+2581 in a text counts as a space, too;
* only ordinary and user-defined pieces are searched, control, unused and byte pieces never match a text; a user-defined
  piece has the score (its UTF-8 length * highest ordinary score - 0.1);
* a position keeps the first candidate that reaches its best score, candidates being tried by growing start, so of
  equal paths the one whose last piece is longest stays;
* a character that is no piece itself may be an unknown symbol at (lowest score - 10); it is then written as the byte
  pieces of its UTF-8 form, one token for each byte; without byte pieces, a run of such characters is one unknown token;
* of the file's normaliser, the dummy space and the removal of extra spaces are done as it says; a file that maps
  characters, keeps spaces unescaped or puts them behind words is refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .textbytes import mix, span_hashes

#: Scores are kept as multiples of 1 / SCALE, derived ones as multiples of 1 / COARSE.
SCALE = 1 << 30
COARSE = 16
NEG = -(1 << 60)
_SPACE = " "


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = buf[at]
        at += 1
        x |= (b & 127) << shift
        if b < 128:
            return x, at
        shift += 7


def _fields(buf: bytes):
    """(field number, value) of one protocol-buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model file.  kinds: 1 ordinary, 2 unknown, 3 control, 4 user-defined, 6 byte.  scores: times SCALE."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool = True
    one_space: bool = False


def read_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; a vocabulary has a few MB at most and travels in the tasks' closure."""
    with open(path, "rb") as f:
        return parse_vocabulary(f.read())


def parse_vocabulary(model: bytes) -> Vocabulary:
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").replace(b"\xe2\x96\x81", b" "))
            scores.append(np.frombuffer(piece[2], "<f4")[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("a vocabulary that maps characters, keeps spaces unescaped or puts them behind words is not supported")
    kinds_ = np.array(kinds, np.int32)
    exact = np.array(scores, np.float64)
    ordinary = np.flatnonzero(kinds_ == 1)
    if trainer.get(3, 1) != 1:  # merge ranks
        exact[ordinary] = [round(-math.log(rank + 2) * COARSE) / COARSE for rank in range(len(ordinary))]
    highest = exact[ordinary].max(initial=-math.inf) if len(ordinary) else 0.0
    for i in np.flatnonzero(kinds_ == 4):
        exact[i] = (len(pieces[i]) + 2 * pieces[i].count(b" ")) * highest - 0.1
    return Vocabulary(tuple(pieces), np.rint(exact * SCALE).astype(np.int64), kinds_, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def derived_scores(vocabulary: Vocabulary) -> np.ndarray:
    """The scores as numbers, for a library that is to search the same vocabulary."""
    return vocabulary.scores / SCALE


def _kept(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


class Engine:
    """The automaton as dense arrays, with the searches over many byte strings at once."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.vocabulary = v
        ids = [i for i in np.flatnonzero((v.kinds == 1) | (v.kinds == 4)) if v.pieces[i]]
        texts = [v.pieces[i] for i in ids]
        self.space_leads = all(b" " not in t.lstrip(b" ") for t in texts)
        self.no_newline = all(b"\n" not in t for t in texts)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, t in zip(ids, texts, strict=True):
            node = 0
            for b in t:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = len(children)
                    children[node][b] = nxt
                    children.append({})
                    ends.append(-1)
                node = nxt
            if ends[node] < 0:
                ends[node] = int(i)
        n = len(children)
        symbols = sorted({b for c in children for b in c})
        self.symbol = np.zeros(256, np.int64)  # 0: in no piece
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        width = len(symbols) + 1
        go = np.zeros((n, width), np.int32)
        fail = np.zeros(n, np.int64)
        piece = np.array(ends, np.int64)
        link = np.zeros(n, np.int64)  # nearest node with a piece along failure links, itself first; 0: none
        level = [0]
        while level:
            parents, bytes_, kids = [], [], []
            for p in level:
                for b, k in children[p].items():
                    parents.append(p)
                    bytes_.append(int(self.symbol[b]))
                    kids.append(k)
            if not kids:
                break
            parents_, bytes__, kids_ = np.array(parents), np.array(bytes_), np.array(kids)
            fail[kids_] = np.where(parents_ == 0, 0, go[fail[parents_], bytes__])
            go[parents_, bytes__] = kids_
            go_rows = go[fail[kids_]]
            go[kids_] = go_rows
            level = kids
            link[kids_] = np.where(piece[kids_] >= 0, kids_, link[fail[kids_]])
            # the level below overwrites the entries of real children
        self.go, self.piece = go.reshape(-1), piece
        self.width = width
        self.out = link
        self.next = np.where(piece >= 0, link[fail], 0)
        self.next[0] = 0
        self.score = np.where(piece >= 0, v.scores[np.maximum(piece, 0)], 0)
        lengths = np.array([len(p) for p in v.pieces], np.int64)
        self.length = np.where(piece >= 0, lengths[np.maximum(piece, 0)], 0)
        ordinary = v.scores[v.kinds == 1]
        self.unknown = int(ordinary.min()) - 10 * SCALE if len(ordinary) else -10 * SCALE
        self.byte_piece = np.full(256, -1, np.int64)
        for i in np.flatnonzero(v.kinds == 6):
            self.byte_piece[int(v.pieces[i][3:5], 16)] = i
        self.unk_id = int(np.flatnonzero(v.kinds == 2)[0]) if (v.kinds == 2).any() else 0
        self.has_bytes = bool((self.byte_piece >= 0).all())
        # decoding: bytes of every id
        spelled = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.spelled_len = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.spelled_len)])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    # -- units -----------------------------------------------------------------------------------------------------

    def prepare(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with U+2581 as a space, extra spaces removed and a dummy space before each text that is not empty, where the
        vocabulary asks for these."""
        if self.vocabulary.one_space:
            space = data == 32
            before = np.ones(len(data), bool)
            before[1:] = space[:-1]
            before[offs[:-1][np.diff(offs) > 0]] = True
            data, offs = _kept(data, offs, ~(space & before))
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(marks):
            row = np.searchsorted(offs, marks, side="right") - 1
            inside = marks + 3 <= offs[row + 1]
            marks, row = marks[inside], row[inside]
            keep = np.ones(len(data), bool)
            keep[marks + 1] = keep[marks + 2] = False
            data = data.copy()
            data[marks] = 32
            data = data[keep]
            offs = offs - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offs) - 1) * 2)])
        if self.vocabulary.one_space and len(data):
            # the last byte of a row that is no space, and what comes before it
            last = np.maximum.accumulate(np.where(data != 32, np.arange(len(data)), -1))
            end = np.where(np.diff(offs) > 0, last[np.maximum(offs[1:] - 1, 0)] + 1, offs[1:])
            data, offs = _kept(data, offs, np.arange(len(data)) < np.repeat(end, np.diff(offs)))
        if not self.vocabulary.dummy_prefix:
            return data, offs
        size = np.diff(offs)
        full = size > 0
        new = np.concatenate([[0], np.cumsum(size + full)])
        out = np.full(int(new[-1]), 32, np.uint8)
        at = np.arange(len(data)) + np.repeat(np.cumsum(full), size)
        out[at] = data
        return out, new

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of units no piece crosses: runs of spaces with what follows, and single line ends."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        if self.space_leads and n:
            space = data == 32
            first[1:n] |= space[1:] & ~space[:-1]
        if self.no_newline and n:
            line = np.flatnonzero(data == 10)
            first[line] = True
            first[line + 1] = True
        cuts = np.flatnonzero(first)
        return cuts[:-1], cuts[1:]

    # -- search ----------------------------------------------------------------------------------------------------

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, want_ids: bool):
        """Token counts of the units, and if asked their ids as (flat ids, offsets)."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        size = ends - starts
        order = np.argsort(size, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < n:
            # like lengths together; a matrix of about a million cells at most, or one long unit
            longest = int(size[order[a]])
            b = a + 1
            limit = max(longest + 4, longest * 5 // 4)
            b = max(b, int(np.searchsorted(size[order], limit, side="right")))
            b = min(b, a + max(1, 1_000_000 // (limit + 1)))
            rows = order[a:b]
            counts[rows], ids = self._solve(data, starts[rows], size[rows], want_ids)
            if want_ids:
                parts.append((rows, *ids))
            a = b
        if not want_ids:
            return counts, None
        offs = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(offs[-1]), np.int64)
        for rows, own_counts, ids in parts:
            own = np.cumsum(own_counts) - own_counts
            flat[np.arange(len(ids)) + np.repeat(offs[rows] - own, own_counts)] = ids
        return counts, (flat, offs)

    def _solve(self, data, starts, size, want_ids):
        n, width = len(starts), int(size.max())
        best = np.full((width + 1, n), NEG, np.int64)
        count = np.zeros((width + 1, n), np.int64)
        back = np.zeros((width + 1, n), np.int32)
        via = np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        state = np.zeros(n, np.int64)
        head = np.zeros(n, np.int64)  # start of the character at hand
        last = len(data) - 1
        for pos in range(width):
            live = pos < size
            byte = data[np.minimum(starts + pos, last)]
            head = np.where((byte & 0xC0) != 0x80, pos, head)
            state = np.where(live, self.go[state * self.width + self.symbol[byte]], 0)
            end = pos + 1
            nxt = data[np.minimum(starts + end, last)]
            closed = live & ((end == size) | ((nxt & 0xC0) != 0x80))
            single = np.zeros(n, bool)
            node = np.where(closed, self.out[state], 0)
            at = np.flatnonzero(node)
            while len(at):
                which = node[at]
                start = end - self.length[which]
                candidate = best[start, at] + self.score[which]
                single[at] |= start == head[at]
                wins = (candidate > best[end, at]) & (best[start, at] > NEG)
                w = at[wins]
                best[end, w] = candidate[wins]
                count[end, w] = count[start[wins], w] + 1
                back[end, w] = start[wins]
                via[end, w] = self.piece[which[wins]]
                node[at] = self.next[which]
                at = at[node[at] > 0]
            at = np.flatnonzero(closed & ~single)
            if len(at):
                start = head[at]
                candidate = best[start, at] + self.unknown
                wins = candidate > best[end, at]
                w, start = at[wins], start[wins]
                best[end, w] = candidate[wins]
                count[end, w] = count[start, w] + (end - start if self.has_bytes else 1)
                back[end, w] = start
                via[end, w] = -1
        total = count[size, np.arange(n)]
        if not want_ids:
            return total, None
        # walk back all units together; an unknown character gives its bytes one by one
        offs = np.concatenate([[0], np.cumsum(total)])
        ids = np.zeros(int(offs[-1]), np.int64)
        fill = offs[1:].copy()
        pos = size.astype(np.int64)
        at = np.flatnonzero(pos > 0)
        while len(at):
            p = pos[at]
            piece, start = via[p, at].astype(np.int64), back[p, at].astype(np.int64)
            known = piece >= 0
            k = at[known]
            fill[k] -= 1
            ids[fill[k]] = piece[known]
            pos[k] = start[known]
            u = at[~known]
            if len(u):
                if self.has_bytes:
                    for step in range(1, 5):
                        here = u[pos[u] - step >= back[pos[u], u]]
                        fill[here] -= 1
                        ids[fill[here]] = self.byte_piece[data[starts[here] + pos[here] - step]]
                else:
                    fill[u] -= 1
                    ids[fill[u]] = self.unk_id
                pos[u] = back[pos[u], u]
            at = at[pos[at] > 0]
        return total, (total, ids)


class Cache:
    """Solved units of a task by 64-bit hash, up to a number of units; then it starts anew."""

    def __init__(self, engine: Engine, want_ids: bool, most: int = 1_500_000):
        # runs of unknown characters may cross units, and only ids show them
        self.engine, self.want_ids, self.most = engine, want_ids or not engine.has_bytes, most
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, place of the first id in self.ids) of each unit."""
        hashes = span_hashes(data, starts, ends) ^ mix((ends - starts).astype(np.uint64))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = ~known
        if new.any():
            counts, ids = self.engine.solve(data, starts[first[new]], ends[first[new]], self.want_ids)
            at = np.zeros(len(counts), np.int64)
            if ids is not None:
                at = ids[1][:-1] + len(self.ids)
                self.ids = np.concatenate([self.ids, ids[0].astype(np.uint32)])
            where = np.searchsorted(self.keys, unique[new])
            self.keys = np.insert(self.keys, where, unique[new])
            self.counts = np.insert(self.counts, where, counts)
            self.at = np.insert(self.at, where, at)
            place = np.searchsorted(self.keys, unique)
        return self.counts[place][inverse], self.at[place][inverse]


_ENGINES: dict[int, tuple[Vocabulary, Engine]] = {}


def engine_of(vocabulary: Vocabulary) -> Engine:
    """One automaton per worker process and vocabulary."""
    key = hash((vocabulary.pieces, vocabulary.scores.tobytes(), vocabulary.kinds.tobytes(), vocabulary.dummy_prefix, vocabulary.one_space))
    if key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[key] = (vocabulary, Engine(vocabulary))
    return _ENGINES[key][1]


_CACHES: dict[tuple[int, bool], Cache] = {}


def cache_of(vocabulary: Vocabulary, want_ids: bool) -> Cache:
    engine = engine_of(vocabulary)
    key = (id(engine), want_ids)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = Cache(engine, want_ids)
    return _CACHES[key]


def count_rows(cache: Cache, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Tokens of each row."""
    if not cache.engine.has_bytes:
        return np.diff(encode_rows(cache, data, offs)[1])
    data, offs = cache.engine.prepare(data, offs)
    starts, ends = cache.engine.units(data, offs)
    if not len(starts):
        return np.zeros(len(offs) - 1, np.int64)
    counts, _ = cache.lookup(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(counts)])
    unit_of = np.searchsorted(starts, offs[:-1])
    return total[np.append(unit_of[1:], len(starts))] - total[unit_of]


def encode_rows(cache: Cache, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows and their offsets."""
    data, offs = cache.engine.prepare(data, offs)
    starts, ends = cache.engine.units(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    counts, at = cache.lookup(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(counts)])
    ids = cache.ids[np.arange(total[-1]) + np.repeat(at - total[:-1], counts)]
    unit_of = np.searchsorted(starts, offs[:-1])
    bounds = total[np.append(unit_of, len(starts))]
    if not cache.engine.has_bytes and len(ids):
        unknown = ids == cache.engine.unk_id
        again = np.zeros(len(ids), bool)
        again[1:] = unknown[1:] & unknown[:-1]
        again[bounds[:-1][np.diff(bounds) > 0]] = False
        ids, bounds = _kept(ids, bounds, ~again)
    return ids, bounds


def decode_rows(engine: Engine, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes spelled by the ids of each row, without the dummy space, and their offsets."""
    size = engine.spelled_len[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = engine.spelled[np.arange(total[-1]) + np.repeat(engine.spelled_at[ids] - total[:-1], size)]
    ends = total[offs]
    full = (np.diff(ends) > 0) & engine.vocabulary.dummy_prefix
    drop = ends[:-1][full]
    keep = np.ones(len(data), bool)
    keep[drop] = data[drop] != 32
    lost = np.zeros(len(full), np.int64)
    lost[full] = ~keep[drop]
    return data[keep], ends - np.concatenate([[0], np.cumsum(lost)])
