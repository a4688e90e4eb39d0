"""Message-level operators: every function takes a table of messages and returns rows keyed like it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.porter import stem_words
from ..functions.rank import DAMPING, ROUNDS, SETTLED, TOP, WINDOW, keyword_phrases, pair_rows, rank_stems
from ..sources.stored import stored

KEY = ("conv_id", "turn")
#: Bytes of a text that is ranked by joins.
LARGE = 1 << 20


def explode_list(df: DataFrame, items: Column, names: tuple[str, ...], key=KEY, at: str = "ord") -> DataFrame:
    """One row for each entry of an array, with its place, a long from 0."""
    rows = df.select(*key, items.alias("__items")).select(*key, F.posexplode("__items").alias(at, "__item"))
    fields = [F.col("__item").alias(names[0])] if len(names) == 1 else [F.col(f"__item.{n}").alias(n) for n in names]
    return rows.select(*key, F.col(at).cast("long").alias(at), *fields)


def task_summary(messages: DataFrame) -> DataFrame:
    return messages.select(*KEY, texts.summary("content").alias("summary"))


def code_blocks(messages: DataFrame) -> DataFrame:
    return explode_list(messages, texts.code_blocks("content"), ("language", "code"))


def links(messages: DataFrame) -> DataFrame:
    return explode_list(messages, texts.links("content"), ("link",))


def bold_terms(df: DataFrame, key=KEY, text: str = "content") -> DataFrame:
    return explode_list(df, texts.bold_terms(text), ("term",), key)


def with_words(df: DataFrame, key=KEY, text: str = "content") -> DataFrame:
    """Key columns and the in-row array words."""
    return df.select(*key, texts.words(text).alias("words"))


def tokens(df: DataFrame, key=KEY, text: str = "content") -> DataFrame:
    return explode_list(df.select(*key, text), texts.tokens(text), ("word", "stem"), key, "pos")


def vocabulary_stems(df: DataFrame, text: str = "content") -> DataFrame:
    """Each distinct word of a corpus, stop words aside, with its stem."""
    found = df.select(texts.words(text).alias("words")).select(F.explode("words").alias("word")).distinct()
    return found.select("word", stem_words(F.array("word"))[0].alias("stem"))


def _repeated(df: DataFrame, key) -> tuple[DataFrame, Column]:
    """(table of the keys that several rows share, condition that a row's key is one of them); only keys are read."""
    many = df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return many, same


def cooccurrence(df: DataFrame, key=KEY, text: str = "content", window: int = WINDOW) -> DataFrame:
    """Directed weights of pairs of different stems less than `window` places apart.

    Pairs are counted inside the row; only those of rows that share a key are added up.
    """
    counted = lambda rows: pair_rows(with_words(rows, key, text), window)
    many, same = _repeated(df, key)
    if many.isEmpty():
        return counted(df)
    again = counted(df.join(many, same, "left_semi")).groupBy(*key, "src", "dst").agg(F.sum("weight").alias("weight"))
    return counted(df.join(many, same, "left_anti")).union(again)


def textrank_by_joins(df: DataFrame, key=KEY, text: str = "content", window: int = WINDOW, large: int = LARGE) -> DataFrame:
    """The scores of `textrank_scores`, for texts of any size: those of `large` bytes or more, and rows that share a key and
    so are one text, are ranked by joins over the co-occurrence table, all others inside their row.

    A round joins scores with the shares of their neighbours and sums them up by target; a text whose scores have all
    moved less than SETTLED is frozen.  Every round is stored, so that lineage does not grow; rounds end when all texts
    are frozen, or after ROUNDS.
    """
    key = list(key)
    many, same = _repeated(df, key)
    is_large = F.coalesce(F.octet_length(text) >= large, F.lit(False))
    split, whole = df.where(is_large), df.where(~is_large)
    if not many.isEmpty():
        split, whole = split.join(many, same, "left_anti").unionByName(df.join(many, same, "left_semi")), whole.join(many, same, "left_anti")
    ranked = textrank_scores(whole, key, text, window)
    return ranked if split.isEmpty() else ranked.union(_ranked_by_joins(split, key, text, window))


def _ranked_by_joins(df: DataFrame, key: list[str], text: str, window: int) -> DataFrame:
    found = stored(df.select(*key, texts.tokens(text).getField("stem").alias("stems")))
    pairs = stored(pair_rows(with_words(df, key, text), window).groupBy(*key, "src", "dst").agg(F.sum("weight").alias("weight")))
    out = pairs.groupBy(*key, "src").agg(F.sum("weight").alias("out"))
    share = stored(pairs.join(out, [*key, "src"]).select(*key, F.col("src").alias("stem"), "dst", (F.col("weight") / F.col("out")).alias("share")))
    vertices = found.select(*key, F.explode(F.array_distinct("stems")).alias("stem")).distinct()
    done, now = None, vertices.withColumn("score", F.lit(1.0))
    for left in range(ROUNDS - 1, -1, -1):
        sums = share.join(now, [*key, "stem"]).groupBy(*key, F.col("dst").alias("stem")).agg(F.sum(F.col("score") * F.col("share")).alias("sum"))
        new = (1 - DAMPING) + DAMPING * F.coalesce("sum", F.lit(0.0))
        moved = stored(now.join(sums, [*key, "stem"], "left").select(*key, "stem", new.alias("score"), F.abs(new - F.col("score")).alias("moved")))
        frozen = moved.groupBy(*key).agg(F.max("moved").alias("most")).where(F.col("most") < SETTLED).select(*key)
        ended = moved.select(*key, "stem", "score").join(frozen, key, "left_semi") if left else moved.select(*key, "stem", "score")
        done = ended if done is None else done.union(ended)
        if not left:
            break
        now = moved.select(*key, "stem", "score").join(frozen, key, "left_anti")
        if now.isEmpty():
            break
    return done


def textrank_scores(df: DataFrame, key=KEY, text: str = "content", window: int = WINDOW) -> DataFrame:
    """(key, stem, score); a text is ranked inside its row, in one task (`textrank_by_joins` spreads giant ones)."""
    ranked = with_words(df, key, text).select(*key, rank_stems("words", window).alias("all")).select(*key, F.explode("all").alias("r"))
    return ranked.select(*key, "r.stem", "r.score")


def top_stems(df: DataFrame, key=KEY, text: str = "content", top: int = TOP) -> DataFrame:
    """The best stems of each message; ties go to the smaller stem.  Ranked inside the row, without a shuffle."""
    ranked = with_words(df, key, text).select(*key, rank_stems("words").alias("r"))
    order = F.array_sort(F.transform("r", lambda x: F.struct((-F.round(x.getField("score"), 9)).alias("low"), x.getField("stem").alias("stem"))))
    return explode_list(ranked.withColumn("best", F.slice(order, 1, top).getField("stem")), F.col("best"), ("stem",), key, "rank")


def surface_forms(df: DataFrame, key=KEY, text: str = "content") -> DataFrame:
    """The most frequent word of each stem of a message, first letter raised; ties go to the smaller word."""
    counts = tokens(df, key, text).groupBy(*key, "stem", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*key, "stem").orderBy(F.desc("n"), "word")
    chosen = counts.withColumn("r", F.row_number().over(order)).where("r = 1")
    return chosen.select(*key, "stem", F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")).alias("form"))


def keyword_phrases_of(df: DataFrame, key=KEY, text: str = "content", top: int = TOP, window: int = WINDOW) -> DataFrame:
    """Key columns and the in-row array keywords of struct<phrase, key>."""
    return with_words(df, key, text).select(*key, keyword_phrases("words", top, window).alias("keywords"))


def keywords(df: DataFrame, key=KEY, text: str = "content", top: int = TOP, window: int = WINDOW) -> DataFrame:
    return explode_list(keyword_phrases_of(df, key, text, top, window), F.col("keywords.phrase"), ("phrase",), key)
