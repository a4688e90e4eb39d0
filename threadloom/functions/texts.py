"""Column functions over message texts: summary, code blocks, links, bold terms, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem_words

# English words that are never keywords.
STOP_WORDS = (
    "a about above after again against all am an and any are aren as at be because been before being below between both but by can "
    "could couldn d did didn do does doesn doing don down during each few for from further get got had hadn has hasn have haven having "
    "he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me might mightn more most mustn my "
    "myself need needn no nor not now o of off on once only or other our ours ourselves out over own re s same shall shan she should "
    "shouldn so some such t than that the their theirs them themselves then there these they this those through to too under until up "
    "ve very was wasn we were weren what when where which while who whom why will with won would wouldn you your yours yourself "
    "yourselves also like well much many even still already since however although though yet may us let say said one two new know "
    "make use way go going see look thing things think good back people really want give take come made find right work first using "
    "used try tell something called"
).split()

SUMMARY_BYTES = 120


def summary(content: Column | str) -> Column:
    """The text without fenced spans, at most 120 bytes of it and then three dots; a cut character becomes U+FFFD."""
    plain = F.regexp_replace(content, "(?s)```.*?```", "")
    head = F.make_valid_utf8(F.substring(plain.cast("binary"), 1, SUMMARY_BYTES).cast("string"))
    return F.when(F.octet_length(plain) > SUMMARY_BYTES, F.concat(head, F.lit("..."))).otherwise(plain)


def code_blocks(content: Column | str) -> Column:
    """array<struct<language, code>> of closed fences whose opening line ends."""
    fence = F.lit("(?s)```([^\\n]*)\\n(.*?)```")
    language = F.transform(F.regexp_extract_all(content, fence, 1), lambda x: F.rtrim(x, F.lit(" \r")))
    code = F.transform(F.regexp_extract_all(content, fence, 2), lambda x: F.rtrim(x, F.lit("\n\r")))
    return F.arrays_zip(language.alias("language"), code.alias("code"))


def links(content: Column | str) -> Column:
    """Markdown targets of more than four bytes, repeats kept, then bare http(s) addresses that are new."""
    targets = F.filter(F.regexp_extract_all(content, F.lit("\\]\\(([^)]*)\\)"), 1), lambda x: F.octet_length(x) > 4)
    bare = F.regexp_extract_all(content, F.lit('https?://[^ \\n)"]*'), 0)
    return F.concat(targets, F.array_except(bare, targets))


def bold_terms(content: Column | str) -> Column:
    """Terms between double asterisks, not empty and below 80 bytes."""
    found = F.regexp_extract_all(content, F.lit("(?s)\\*\\*(.*?)\\*\\*"), 1)
    return F.filter(found, lambda x: (x != "") & (F.octet_length(x) < 80))


def words(content: Column | str) -> Column:
    """Lower-cased runs of ASCII letters, longer than two letters and no stop words."""
    found = F.transform(F.regexp_extract_all(content, F.lit("[A-Za-z]+"), 0), F.lower)
    return F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*dict.fromkeys(STOP_WORDS)))


def tokens(content: Column | str) -> Column:
    """array<struct<word, stem>> of the words whose stem has more than one letter."""
    kept = words(content)
    return F.filter(F.arrays_zip(kept.alias("word"), stem_words(kept).alias("stem")), lambda t: F.length(t.getField("stem")) > 1)
