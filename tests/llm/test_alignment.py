"""Operator 12 against a plain walk over the bytes."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(alignment.FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)


def _spelled(plain, text):
    """(id, bytes) of the tokens of both, or none."""
    a, b = plain
    letters = alignment._byte_letters()
    if not text:
        return [], []
    made = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(letters[c] for c in t)) for i, t in zip(made.ids, made.tokens, strict=True)]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])


def _brute(plain, texts):
    told, pairs = [], Counter()
    for text in texts:
        owner = []
        for tokens in _spelled(plain, text):
            owner.append([k for k, (_, x) in enumerate(tokens) for _ in x])
        one, two = _spelled(plain, text)
        links = list(dict.fromkeys(zip(*owner, strict=True)))
        ids = [(one[i][0], two[j][0]) for i, j in links]
        pairs.update(ids)
        groups, at, sizes = [], (0, 0), [np.cumsum([len(x) for _, x in t]).tolist() for t in (one, two)]
        for end in sorted(set(sizes[0]) & set(sizes[1])):
            upto = sizes[0].index(end) + 1, sizes[1].index(end) + 1
            groups.append(",".join(str(i) for i, _ in one[at[0] : upto[0]]) + "|" + ",".join(str(i) for i, _ in two[at[1] : upto[1]]))
            at = upto
        told.append((len(one), len(two), groups, ids))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    rows = []
    for a, b, groups, ids in told:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((a, b, len(groups), len(ids), sum(pairs[p] == best[p[1]] for p in ids), sum(pairs[p] for p in ids), digest))
    return rows, pairs


def _odd():
    long = " ".join(f"word{i} größer 日本{i}" for i in range(3000))
    return [None, "", " ", "\n\n", "a", "the cat sat on the mat", "the cat sat on the mat", "▁ literal", "<|endoftext|> and <s> are text", "x" * 5000, "a\u0000b", "🙂 emoji\tand  two spaces ", "<0x41>", long]


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 500])
def test_against_a_walk(spark, plain, slice_pairs):
    rows = [(i, t) for i, t in enumerate(_odd())]
    docs = spark.createDataFrame([*rows, (5, rows[5][1]), (None, "no id")], "doc_id long, text string")
    for name in ("row", "doc", "a", "count"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = alignment.CrossAlignment(docs.repartition(3), slice_pairs=slice_pairs)
    assert (found.slices > 1) == (slice_pairs == 500)
    want, pairs = _brute(plain, [*_odd(), rows[5][1], "no id"])
    got = [tuple(r[c] for c in COLUMNS) for r in found.links().collect()]
    assert Counter(got) == Counter(want)
    assert {(r.a_id, r.b_id): r["count"] for r in found.pairs().collect()} == dict(pairs)
    spelled = Counter()
    for _, rows_ in itertools.groupby(sorted(found.groups().collect(), key=lambda r: (r.row, r.number)), key=lambda r: r.row):
        spelled[hashlib.sha256(";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in rows_).encode()).hexdigest()] += 1
    assert spelled == Counter(w[-1] for w in want if w[-1])


def test_whole_table(spark, sf_dir, plain):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, _ = _brute(plain, [r.text for r in rows])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.op12_alignment(spark, sf_dir).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_no_rows(spark):
    found = alignment.CrossAlignment(spark.createDataFrame([], "doc_id long, text string"))
    assert found.links().count() == 0 and found.pairs().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 31), unique=True, max_size=400))
def test_hash_is_minimal_and_perfect(codes):
    codes = np.array(codes, np.int64)
    sizes, words, keys = alignment.build(codes)
    made = alignment.Hash(words, np.array([sizes], np.int64).reshape(1, -1), keys)
    assert sorted(made.verified(codes).tolist()) == list(range(len(codes)))
    assert (made.verified(codes + (1 << 40)) == -1).all()


@functools.cache
def _library():
    made = Tokenizer.from_file(alignment.FILE_A)
    made.encode_special_tokens = True
    return made


@functools.cache
def _pieces():
    return sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab \n\t\u00a0▁é\u3000\r\x1c\x85'1.s", max_size=25)), max_size=6))
def test_words_encoded_once_give_the_ids_of_the_libraries(texts):
    found = [x.to_pylist() for x in alignment._pair(alignment.Files.read()).encode(pa.array(texts, pa.string()))]
    assert found[0] == [_library().encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts]
    assert found[1] == [_pieces().encode(t) if t else [] for t in texts]
