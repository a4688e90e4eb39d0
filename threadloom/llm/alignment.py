"""Operator 12: alignment of two tokenizers over a corpus, with counts of the token pairs that cover the same bytes.

Tokenizer A is a byte-level BPE file, tokenizer B a SentencePiece file.  A text's tokens of both spell the same bytes, a
space and the text; a token of A and one of B are linked where their byte ranges overlap, and places where tokens of both
end cut the text into groups.  A text whose tokens do not spell these bytes (B may normalise, or a literal U+2581 reads as
a space) has no tokens, as have null and empty texts.

1. Every text is encoded once; ids and groups are stored.
2. The distinct linked pairs of ids, from every task, get a minimal perfect hash: keys are dealt to shards, and in a shard
   each level sets a bit where exactly one key falls and hands the other keys to the next level; a key's number is the
   count of bits before its own.  The keys stand beside the hash, in its order, so every look-up is verified.
3. Counts.  Each task aligns its texts again and counts into one dense vector indexed by the hash.  Vectors are cut by
   shards and summed as a tree, FAN at a time.
4. A second pass aligns the texts again and looks the counts up.

What tasks hold is bounded: pairs are split by B id into slices of about SLICE pairs, and steps 3 and 4 run once for each
slice.  There are at most |A| |B| pairs, however large the corpus.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, free_shuffles, table
from .textbytes import mix, utf8
from .unigram import _fields

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs whose hash, keys and counts a task holds at once, and those of a shard, about.
SLICE, SHARD = 1 << 22, 1 << 13
#: Bits of a level for each of its keys.
GAMMA = 2
#: Vectors that are summed at once.
FAN = 32
#: Bytes of text that are encoded at once, and tokens that are aligned at once; one longer text stands alone.
CHUNK, TOKENS = 1 << 20, 1 << 18
#: Words that are encoded as one text.
JOINED = 1 << 12
#: Distinct pairs that a task gathers before it hands them on.
GATHER = 1 << 20

# Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_U = np.uint64
_TOKENS = "row long, doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"


@dataclass(frozen=True)
class Files:
    """The contents of both tokenizer files."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, a: str = FILE_A, b: str = FILE_B) -> Files:
        with open(a, "rb") as fa, open(b, "rb") as fb:
            return cls(fa.read(), fb.read())


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A: ids of texts, and the bytes of each id.

    The fast encoder merges by the id of the merged token; it is used where the file's merges stand in that very order,
    with the usual split and no normaliser, which makes both the same.  Other files run in their own library.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        told = json.loads(data)
        model, letters = told["model"], _byte_letters()
        special = {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        self.pieces = [spelled.get(i, b"") for i in range(max([*model["vocab"].values(), *special.values()]) + 1)]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary.get(x + y, -1) for x, y in merges]
        before = told.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = not told.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token")
        whole = len(vocabulary) == len(made) + 256 and all(x < y for x, y in zip(made, made[1:], strict=False)) and min(made) >= 256
        self.by_word = usual and plain and whole
        if self.by_word:
            import tiktoken

            fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={p: i for i, p in spelled.items()}, special_tokens={})
            self.ids = lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            slow = Tokenizer.from_buffer(data)
            slow.encode_special_tokens = True
            self.ids = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.int32)


class PieceTokenizer:
    """B: ids of texts, and the bytes of each id.

    Where the file maps no characters and no piece has a space behind another character, no piece spans two words, and
    words can be encoded one by one.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        rules = {n: dict(_fields(value)) for n, value in _fields(data) if n in (2, 3)}
        plain = not rules.get(3, {}).get(2) and rules.get(3, {}).get(5, 1) and rules.get(3, {}).get(3, 1) and not rules.get(2, {}).get(24, 0)
        self.by_word = bool(plain) and not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        self.pieces = [self._spelled(model, i) for i in range(model.get_piece_size())]
        self.encode = lambda texts: [np.array(x, np.int32) for x in model.encode(texts, num_threads=1)]

    @staticmethod
    def _spelled(model, i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


#: White space, and what keeps a text from being cut into words: spaces beside another one, at its ends, or between white
#: space, and the symbol for a space.
_WHITE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_UNCUT = rf"\A | \z|  |{_WHITE} {_WHITE}|▁"
#: Words that are not encoded among others: their first character is white space.
_ALONE = rf"\A{_WHITE}"


class Pair:
    """Both tokenizers in a task, and tables of their tokens."""

    def __init__(self, files: Files):
        self.a, self.b = ByteTokenizer(files.a), PieceTokenizer(files.b)
        self.bytes_ = [pa.array(t.pieces, pa.binary()) for t in (self.a, self.b)]
        self.digits = [pa.array([str(i) for i in range(len(t.pieces))], pa.string()) for t in (self.a, self.b)]
        self.sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b)]
        self._by_word = self.a.by_word and self.b.by_word

    def _plain(self, side: int, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not empty, one by one."""
        return self.b.encode(texts) if side and texts else [self.a.ids(" " + t) for t in texts]

    def _of_names(self, side: int, names: pa.Array) -> pa.Array:
        """Ids of different words, encoded in rows of JOINED words with a space between."""
        starts = np.arange(0, len(names), JOINED)
        rows = pc.binary_join(_lists(names, np.append(starts, len(names))), " ").to_pylist() if len(names) else []
        flat = np.concatenate([*self._plain(side, rows), np.zeros(0, np.int32)])
        told, want = np.cumsum(self.sizes[side][flat]), np.cumsum(pc.binary_length(names).to_numpy().astype(np.int64) + 1)
        ends = np.searchsorted(told, want)
        if len(told) and told[-1] == want[-1] and (told[ends] == want).all():
            return _lists(flat, np.append(0, ends + 1))
        each = self._plain(side, names.to_pylist())
        return _lists(np.concatenate([*each, np.zeros(0, np.int32)]), _offsets([len(x) for x in each]))

    def _of_words(self, texts: pa.Array) -> list[pa.Array]:
        """Ids of texts for each tokenizer; every different word is encoded once."""
        lists = pc.split_pattern(texts, " ")
        words, bounds = lists.flatten().dictionary_encode(), _offsets(lists.value_lengths())
        alone = pc.match_substring_regex(words.dictionary, _ALONE).to_numpy(zero_copy_only=False)
        order = np.argsort(alone, kind="stable")
        many, few = words.dictionary.filter(pa.array(~alone)), words.dictionary.filter(pa.array(alone)).to_pylist()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = []
        for side in (0, 1):
            each = self._plain(side, few)
            rest = _lists(np.concatenate([*each, np.zeros(0, np.int32)]), _offsets([len(x) for x in each]))
            by_word = pa.concat_arrays([self._of_names(side, many), rest]).take(pa.array(place[words.indices.to_numpy()]))
            out.append(_lists(by_word.flatten(), _offsets(by_word.value_lengths())[bounds]))
        return out

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """Lists of ids of texts for each tokenizer; empty texts have none."""
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut = full & self._by_word & ~pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(full & ~cut)
        slow = texts.take(pa.array(whole)).to_pylist()
        place = np.full(len(texts), -1)
        place[np.flatnonzero(cut)] = np.arange(int(cut.sum()))
        place[whole] = int(cut.sum()) + np.arange(len(whole))
        place[~full] = int(full.sum())
        fast, out = self._of_words(texts.filter(pa.array(cut))), []
        for side in (0, 1):
            each = [*self._plain(side, slow), np.zeros(0, np.int32)]
            rest = _lists(np.concatenate(each), _offsets([len(x) for x in each]))
            out.append(pa.concat_arrays([fast[side], rest]).take(pa.array(place)))
        return out


_PAIRS: dict[str, Pair] = {}


def _pair(files: Files) -> Pair:
    key = hashlib.sha256(files.a + files.b).hexdigest()
    if key not in _PAIRS:
        _PAIRS[key] = Pair(files)
    return _PAIRS[key]


def _lists(values, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _offsets(sizes) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(sizes, np.int64))])


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For growing ends of tokens over the same bytes: the tokens (a, b) of each link, and the tokens that end a group."""
    marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] += 2
    cuts = marks[np.flatnonzero(marks)]
    is_a, is_b = cuts & 1, cuts >> 1
    a, b = np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
    both = cuts == 3
    return a, b, a[both], b[both]


def _encoded(pair: Pair, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(flat ids, offsets) for each tokenizer; texts that do not come back byte for byte have none."""
    data = pc.fill_null(texts.cast(pa.binary()), b"")
    try:
        said = data.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 do not come back
        said = pa.array([x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string())
    found = [(x.flatten().to_numpy(zero_copy_only=False), _offsets(x.value_lengths())) for x in pair.encode(said)]
    joined = [pc.binary_join(_lists(pair.bytes_[side].take(pa.array(flat)), offs), b"") for side, (flat, offs) in enumerate(found)]
    wanted = pc.binary_join_element_wise(pa.scalar(b" "), data, pa.scalar(b""))
    wanted = pc.if_else(pc.equal(pc.binary_length(data), 0), pa.scalar(b""), wanted)
    exact = pc.and_(pc.equal(joined[0], wanted), pc.equal(joined[1], wanted)).to_numpy(zero_copy_only=False)
    if exact.all():
        return found
    return [(flat[np.repeat(exact, np.diff(offs))], _offsets(np.diff(offs) * exact)) for flat, offs in found]


def _encode_rows(files: Broadcast):
    def run(batches):
        pair = _pair(files.value)
        for batch in batches:
            col = batch.column("text").cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
            offs, a, n = _offsets(sizes), 0, len(sizes)
            while a < n:
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, side="right")) - 1)
                yield _told(pair, batch.slice(a, b - a), _encoded(pair, col.slice(a, b - a)))
                a = b
        pa.default_memory_pool().release_unused()

    return run


def _kind(pieces) -> type:
    """The number type that stored ids take."""
    return np.uint16 if len(pieces) <= 1 << 16 else np.uint32


def _packed(flat: np.ndarray, offs: np.ndarray, pieces) -> pa.Array:
    """Ids as bytes, which neither Spark nor Parquet handles one by one."""
    values = flat.astype(_kind(pieces))
    bounds = (offs * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(col: pa.Array, pieces) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets)."""
    data, offs = utf8(col)
    kind = _kind(pieces)
    return data.view(kind).astype(np.int64), offs // np.dtype(kind).itemsize


def _told(pair: Pair, rows: pa.RecordBatch, ids: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    flat, offs = zip(*ids, strict=True)
    ends = [np.cumsum(pair.sizes[side][flat[side]]) for side in (0, 1)]
    links, _, last_a, last_b = aligned(*ends)
    groups, n_groups = [], len(last_a)
    for side, last in ((0, last_a), (1, last_b)):
        groups.append(pc.binary_join(_lists(pair.digits[side].take(pa.array(flat[side])), np.concatenate([[0], last + 1])), ","))
    told = pc.binary_join_element_wise(*groups, "|") if n_groups else pa.array([], pa.string())
    at = np.searchsorted(last_a, offs[0])  # groups before each text
    texts = pc.binary_join(_lists(told, at), ";").to_pylist()
    digest = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts], pa.string())
    count = lambda x: pa.array(np.diff(x).astype(np.int64))
    stored = [_packed(x, o, pair.sizes[side]) for side, (x, o) in enumerate(ids)]
    columns = [rows.column("row"), rows.column("doc"), count(offs[0]), count(offs[1]), count(at), count(np.searchsorted(links, offs[0])), digest, *stored]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TOKENS.split(", ")])


# -- links of stored texts ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sizes:
    """Bytes of each token."""

    a: np.ndarray
    b: np.ndarray


def _pieces(batches, column: str = "a"):
    """Batches of about TOKENS tokens; one longer text stands alone."""
    for batch in batches:
        offs, a, n = _offsets(pc.binary_length(batch.column(column))), 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + 2 * TOKENS, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _links(batch: pa.RecordBatch, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(code, row of the batch) of every link; a code is a * |B| + b."""
    (a, offs), (b, _) = _unpacked(batch.column("a"), sizes.a), _unpacked(batch.column("b"), sizes.b)
    la, lb, _, _ = aligned(np.cumsum(sizes.a[a]), np.cumsum(sizes.b[b]))
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return a[la] * len(sizes.b) + b[lb], rows[la]


def _grouped(sizes: Broadcast):
    def run(batches):
        for batch in _pieces(batches):
            (a, offs), (b, _) = _unpacked(batch.column("a"), sizes.value.a), _unpacked(batch.column("b"), sizes.value.b)
            _, _, last_a, last_b = aligned(np.cumsum(sizes.value.a[a]), np.cumsum(sizes.value.b[b]))
            at = np.diff(np.searchsorted(last_a, offs))  # groups of each text
            rows = np.repeat(np.arange(len(at)), at)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(at) - at, at)
            lists = [_lists(x.astype(np.int32), np.append(0, last + 1)) for x, last in ((a, last_a), (b, last_b))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("row", "doc")), pa.array(number), *lists], ["row", "doc", "number", "a_ids", "b_ids"])

    return run


def _distinct_codes(sizes: Broadcast):
    def run(batches):
        held, parts, n = np.zeros(0, np.int64), [], 0
        for batch in _pieces(batches):
            parts.append(np.unique(_links(batch, sizes.value)[0]))
            n += len(parts[-1])
            if n > GATHER:
                held, parts, n = np.unique(np.concatenate([held, *parts])), [], 0
                if len(held) > GATHER:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([held, *parts])))], ["code"])

    return run


# -- minimal perfect hash ----------------------------------------------------------------------------------------------


def _spread(codes: np.ndarray, seed: int, n) -> np.ndarray:
    """Numbers below n (one, or one for each code) from codes."""
    return ((mix(codes.astype(np.uint64) ^ mix(np.full(1, seed, np.uint64))) >> _U(32)) * np.asarray(n, np.uint64) >> _U(32)).astype(np.int64)


def slice_of(codes: np.ndarray, n_b: int, slices: int) -> np.ndarray:
    """All pairs of one B id are in one slice."""
    if slices == 1:
        return np.zeros(len(codes), np.int64)
    return _spread(codes % n_b, 101, slices)


def build(codes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, their words, the codes in order of their numbers) of distinct codes."""
    sizes, words, left = [], [], codes
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = _spread(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    flat = np.concatenate([*words, np.zeros(0, np.uint64)])
    table_ = Hash(flat, np.array([sizes]), np.zeros(0, np.int64))
    order = np.empty(len(codes), np.int64)
    order[table_.numbers(codes, np.zeros(len(codes), np.int64))] = codes
    return sizes, flat, order


class Hash:
    """Numbers 0 to n - 1 of n codes, those of one shard after those of the one before."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.words, self.keys, self.sizes = words, keys, sizes
        ends = np.cumsum(sizes, axis=1)
        base = _offsets(ends[:, -1])[:-1] if sizes.size else np.zeros(len(sizes), np.int64)
        self.starts = base[:, None] + ends - sizes
        self.ranks = _offsets(np.bitwise_count(words))

    def numbers(self, codes: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int64)
        todo = np.arange(len(codes))
        for level in range(self.sizes.shape[1]):
            if not len(todo):
                break
            s = shards[todo]
            todo, s = todo[self.sizes[s, level] > 0], s[self.sizes[s, level] > 0]
            at = self.starts[s, level] + _spread(codes[todo], level, self.sizes[s, level])
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            rank = self.ranks[at >> 6] + np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        return out

    def verified(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of codes; -1 for a code that is none of the keys."""
        if not len(self.keys):
            return np.full(len(codes), -1, np.int64)
        found = self.numbers(codes, _spread(codes, 103, len(self.sizes)))
        return np.where((found >= 0) & (self.keys[found] == codes), found, -1)


def _sharded(n_b: int, slices: int, shards: int):
    def run(batches):
        for batch in batches:
            codes = batch.column("code").to_numpy()
            columns = [pa.array(x.astype(np.int32)) for x in (slice_of(codes, n_b, slices), _spread(codes, 103, shards))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("code")], ["slice", "shard", "code"])

    return run


def _runs(batches, keys: list[str]):
    """(key values, rows) of each run of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and any(held[-1].column(k)[0].as_py() != batch.column(k)[a].as_py() for k in keys):
                yield [held[0].column(k)[0].as_py() for k in keys], pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield [held[0].column(k)[0].as_py() for k in keys], pa.Table.from_batches(held)


def _built(batches):
    for (part, shard), rows in _runs(batches, ["slice", "shard"]):
        sizes, words, keys = build(rows.column("code").to_numpy())
        made = [[part], [shard], [sizes], [words.tobytes()], [keys.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["slice", "shard", "sizes", "words", "keys"])


def _assembled(rows: pa.Table, shards: int) -> Hash:
    """The hash of one slice from its shards; a shard without keys has no levels."""
    by = {r["shard"]: r for r in rows.to_pylist()}
    depth = max([len(r["sizes"]) for r in by.values()] or [1])
    sizes = np.zeros((shards, depth), np.int64)
    for shard, r in by.items():
        sizes[shard, : len(r["sizes"])] = r["sizes"]
    parts = [by[s] for s in sorted(by)]
    join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in parts), kind)
    return Hash(join("words", np.uint64), sizes, join("keys", np.int64))


# -- counts ------------------------------------------------------------------------------------------------------------


def _counted(hash_: Broadcast, bounds: np.ndarray, sizes: Broadcast, part: int, slices: int):
    """One dense vector of counts for each task, cut by shards; shards without a count are left out."""

    def run(batches):
        h, s = hash_.value, sizes.value
        counts = np.zeros(len(h.keys), np.int64)
        for batch in _pieces(batches):
            codes, n = np.unique(_links(batch, s)[0], return_counts=True)
            own = slice_of(codes, len(s.b), slices) == part
            found = h.verified(codes[own])
            if (found < 0).any():
                raise AssertionError("a pair is not among the keys")
            counts[found] += n[own]
        task = TaskContext.get().partitionId()
        some = [i for i in range(len(bounds) - 1) if counts[bounds[i] : bounds[i + 1]].any()]
        for i in range(0, len(some), 64):
            ids = some[i : i + 64]
            vectors = [counts[bounds[k] : bounds[k + 1]].tobytes() for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([task] * len(ids), pa.int32()), pa.array(vectors, pa.binary())], ["shard", "branch", "counts"])

    return run


def _summed(batches):
    for (shard, branch), rows in _runs(batches, ["shard", "branch"]):
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([branch], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "branch", "counts"])


def _tree_sum(vectors: DataFrame, branches: int) -> DataFrame:
    """(shard, counts): the vectors of all branches, summed FAN at a time."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        branches = -(-branches // FAN)
        dealt = vectors.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).repartition(parts, "shard", "branch")
        vectors = dealt.sortWithinPartitions("shard", "branch").mapInArrow(_summed, "shard int, branch int, counts binary")
        if branches <= 1:
            return cut(vectors.select("shard", "counts"))


def _looked_up(hash_: Broadcast, counts: Broadcast, sizes: Broadcast, part: int, slices: int):
    def run(batches):
        h, s, (count, best) = hash_.value, sizes.value, counts.value
        for batch in _pieces(batches):
            codes, rows = _links(batch, s)
            own = slice_of(codes, len(s.b), slices) == part
            codes, rows = codes[own], rows[own]
            each, back = np.unique(codes, return_inverse=True)
            n = count[h.verified(each)][back] if len(each) else np.zeros(0, np.int64)
            top = n == best[codes % len(s.b)]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], rows[top], 1)
            np.add.at(sums[1], rows, n)
            kept = [batch.column(c) for c in ("row", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1])], [*_DIGEST, "n_best", "count_sum"])

    return run


_DIGEST = ["row", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class CrossAlignment:
    """Two tokenizers aligned over the texts of docs.

    `tokens`: (row, doc, n_a, n_b, n_groups, n_links, groups_sha256, a, b), one row for each row of docs; a and b are the
    ids, as bytes.  `groups()`: (row, doc, number, a_ids, b_ids) of every group.  `pairs()`: (a_id, b_id, count) of every
    linked pair.  `links()`: the columns of `tokens` but ids, with n_best and count_sum.

    Null ids stay null; rows that share an id stay rows of their own; other columns of docs, whatever their names, play no
    part.  An empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: Files | None = None, slice_pairs: int = SLICE):
        spark = docs.sparkSession
        files = files or Files.read()
        pair = _pair(files)
        self.n_b = len(pair.b.pieces)
        self._sizes = spark.sparkContext.broadcast(Sizes(*pair.sizes))
        texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        self.tokens = cut(texts.mapInArrow(_encode_rows(spark.sparkContext.broadcast(files)), _TOKENS))
        self._ids = self.tokens.select("a", "b")
        codes = cut(self._ids.mapInArrow(_distinct_codes(self._sizes), "code long").distinct())
        free_shuffles(spark)
        n = codes.count()
        self.slices = max(1, math.ceil(n / slice_pairs))
        self.shards = max(1, math.ceil(n / self.slices / SHARD))
        dealt = codes.mapInArrow(_sharded(self.n_b, self.slices, self.shards), "slice int, shard int, code long").repartition("slice", "shard")
        self._hashes = cut(dealt.sortWithinPartitions("slice", "shard").mapInArrow(_built, "slice int, shard int, sizes array<int>, words binary, keys binary"))
        drop(codes)
        self._counts = [self._count(part) for part in range(self.slices)]

    def _count(self, part: int) -> tuple[Broadcast, DataFrame]:
        context = self.tokens.sparkSession.sparkContext
        hash_ = _assembled(self._hashes.where(F.col("slice") == part).toArrow(), self.shards)
        bounds = _offsets(np.bincount(_spread(hash_.keys, 103, self.shards), minlength=self.shards)) if len(hash_.keys) else np.zeros(self.shards + 1, np.int64)
        shared = context.broadcast(hash_)
        branches = max(16, 2 * context.defaultParallelism)
        vectors = self._ids.coalesce(branches).mapInArrow(_counted(shared, bounds, self._sizes, part, self.slices), "shard int, branch int, counts binary")
        return shared, _tree_sum(vectors, branches)

    def groups(self) -> DataFrame:
        rows = self.tokens.select("row", "doc", "a", "b")
        return rows.mapInArrow(_grouped(self._sizes), "row long, doc long, number long, a_ids array<int>, b_ids array<int>")

    def pairs(self) -> DataFrame:
        n_b, each = self.n_b, None

        def named(batches):
            for batch in batches:
                for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                    codes = np.frombuffer(keys.as_py(), np.int64)
                    columns = codes // n_b, codes % n_b, np.frombuffer(counts.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a_id", "b_id", "count"])

        for part, (_, sums) in enumerate(self._counts):
            rows = self._hashes.where(F.col("slice") == part).join(sums, "shard").select("keys", "counts")
            rows = rows.mapInArrow(named, "a_id long, b_id long, count long")
            each = rows if each is None else each.union(rows)
        return each

    def links(self) -> DataFrame:
        context, each = self.tokens.sparkSession.sparkContext, None
        for part, (hash_, sums) in enumerate(self._counts):
            by = sums.toArrow().sort_by("shard")
            count = np.frombuffer(b"".join(x.as_py() for x in by.column("counts")), np.int64)  # as many as the slice has pairs
            best = np.zeros(self.n_b, np.int64)
            np.maximum.at(best, hash_.value.keys % self.n_b, count)
            run = _looked_up(hash_, context.broadcast((count, best)), self._sizes, part, self.slices)
            schema = _TOKENS.partition(", a binary")[0] + ", n_best long, count_sum long"
            rows = self.tokens.select(*_DIGEST, "a", "b").mapInArrow(run, schema)
            each = rows if each is None else each.union(rows)
        if self.slices > 1:
            each = each.groupBy(*_DIGEST).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return each.drop("row")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links under both tokenizers, with the counts of its linked pairs."""
    found = CrossAlignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.links().select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
