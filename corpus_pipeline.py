"""A corpus pipeline of five stages over the documents table; each stage is one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept.  All but the last return the columns of
documents.  `run` stores each stage's rows as Parquet in the shared checkpoint folder and reads them back for the next.

In every stage: texts that are null, empty or blank go with the first stage (score 0) and pass the others untouched; a text is
taken whole, however long; equal rows get equal decisions, and of repeated lines and near-duplicates the one with the least
doc_id stays; an empty table stays empty; columns beside those of documents are kept as they are and play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, lines, neardup, quality, tokens, unigram
from threadloom.llm.common import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weak-label quality scorer accepts; the scorer is fitted on this input."""
    model = quality.fit(docs)
    return docs.where(quality.quality_score("text", model) >= quality.KEEP_AT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document that loses all its lines goes."""
    left = lines.remove_lines(docs, lines.repeated_lines(docs, few=0))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class."""
    gone = neardup.near_duplicates(docs).where(F.col("class") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), verbatim=True)
    gone = found.select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    vocabulary = unigram.read_vocabulary(tokens.VOCABULARY)
    coded = docs.withColumn("token_ids", tokens.encode("text", vocabulary))
    back = tokens.decode("token_ids", vocabulary)
    exact = back == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return coded.select(
        "doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), exact.alias("round_trip")
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL cannot express the trained scorer and the signatures; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/pipeline-{uuid.uuid4().hex}/{number}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
