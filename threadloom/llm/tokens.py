"""Operators 6 and 9: token counts, SentencePiece encoding and decoding.

All three are column functions, so other columns of the table, whatever their names, pass by untouched.  Null or empty
texts have no tokens; very long texts are taken whole (a batch is cut into pieces of about 2 MB, one longer text alone).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import unigram
from .common import table
from .textbytes import chunks

#: The default vocabulary file; every function takes another one as a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def token_count(text: Column | str, vocabulary: unigram.Vocabulary) -> Column:
    """Count-only Viterbi: tokens of each text under the vocabulary's unigram scores (rules in `unigram`), as a long.

    Nulls, empty texts: 0.  Only the best score and its number of pieces are carried; no ids are made.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        cache = unigram.cache_of(vocabulary, want_ids=False)
        parts = [unigram.count_rows(cache, data, offs) for _, _, data, offs in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return count(text)


def encode(text: Column | str, vocabulary: unigram.Vocabulary) -> Column:
    """Token ids of each text as array<int>; an empty array for nulls and empty texts."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        cache = unigram.cache_of(vocabulary, want_ids=True)
        flat, sizes = [], [np.zeros(1, np.int64)]
        for _, _, data, offs in chunks(texts):
            ids, bounds = unigram.encode_rows(cache, data, offs)
            flat.append(ids)
            sizes.append(np.diff(bounds))
        values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        bounds = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))

    return ids_of(text)


def decode(ids: Column | str, vocabulary: unigram.Vocabulary) -> Column:
    """The text that token ids spell; null for null ids.  Bytes that are no UTF-8 become U+FFFD.

    decode(encode(t)) is t, save that a literal U+2581 in t comes back as a space.
    """

    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        engine = unigram.engine_of(vocabulary)
        offs = rows.offsets.to_numpy().astype(np.int64)
        ids = rows.values.to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.asarray(rows.is_null()) if rows.null_count else np.zeros(len(rows), bool)
        out: list[pa.Array] = []
        a, n = 0, len(rows)
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + 1_000_000, side="right")) - 1)
            data, ends = unigram.decode_rows(engine, ids[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            made = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            try:
                out.append(made.cast(pa.string()))
            except pa.ArrowInvalid:
                out.append(pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string()))
            a = b
        whole = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.string()), whole) if missing.any() else whole

    return text_of(ids)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_bytes, n_tokens."""
    vocabulary = unigram.read_vocabulary(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count("text", vocabulary).alias("n_tokens"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, a hash of the ids, and whether decoding gave the text back."""
    vocabulary = unigram.read_vocabulary(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.withColumn("ids", encode("text", vocabulary))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (decode("ids", vocabulary) == F.translate("text", "▁", " ")).alias("round_trip"),
    )
