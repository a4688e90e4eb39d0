"""The Porter (1980) stemmer for lower-case ASCII words, as rule tables.

Two points differ from the published algorithm: `ies` loses its last letter only, and step 2 has `abli` and no `logi`.
Words of one or two letters stay.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the algorithm, longest first where one ends in another.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Words that a worker remembers, and words that are looked up at once.
KNOWN, PART = 1 << 16, 1 << 16


def shape(word: str) -> str:
    """`c` or `v` for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _mapped(word: str, rules) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if measure(stem) > 0 else word
    return word


def _past_tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem
    return word


@lru_cache(maxsize=KNOWN)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies") or (word.endswith("s") and not word.endswith("ss")):
        word = word[:-1]
    word = _past_tense(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, STEP_2), STEP_3)
    for suffix in STEP_4:
        if word.endswith(suffix):
            head = word[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
            word = head if measure(head) > 1 else word
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stems_of(words: pa.Array) -> pa.Array:
    """Stems of words; each distinct word is stemmed once."""
    coded = words.dictionary_encode()
    stems = pa.array([stem(w) if w is not None else None for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices) if len(stems) else pa.array([], pa.string())


def stem_words(words: Column | str) -> Column:
    """Stems of an array of words; each distinct word of a part of PART words is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        stems = pa.concat_arrays([stems_of(flat.slice(at, PART)) for at in range(0, max(1, len(flat)), PART)])
        offsets = pa.compute.subtract(rows.offsets, rows.offsets[0]) if len(rows) else pa.array([0], pa.int32())
        return pa.ListArray.from_arrays(offsets, stems, mask=rows.is_null() if rows.null_count else None)

    # not to be evaluated again for filters that Spark infers below an explode
    return run.asNondeterministic()(words)
