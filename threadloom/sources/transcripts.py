"""Platforms by address, roles, and plain transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import SITES

# Platforms by part of the host, and speaker labels.
PLATFORMS = (("chat.openai", "chatgpt"), ("chatgpt", "chatgpt"), ("claude", "claude"), ("gemini", "gemini"))
LABELS = "You|User|Human|Assistant|ChatGPT|Claude|AI|Model"


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)", 1))


def detect_platform(url: Column | str) -> Column:
    found = F.lit("generic")
    for part, name in reversed(PLATFORMS):
        found = F.when(F.contains(host(url), F.lit(part)), F.lit(name)).otherwise(found)
    return found


def platform_config(pages: DataFrame) -> DataFrame:
    """Selectors for pages of the configured sites, nulls for all others."""
    out = {c: F.lit(None).cast("string") for c in ("container", "message_block", "role_attribute")}
    for domain, *values in reversed(SITES):
        here = F.contains(host("url"), F.lit(domain))
        out = {c: F.when(here, F.lit(v)).otherwise(old) for (c, old), v in zip(out.items(), values, strict=True)}
    return pages.select("page_id", *[e.alias(c) for c, e in out.items()])


def resolve_role(role: Column | str, turn: Column | str) -> Column:
    low = F.lower(role)
    parity = F.when(F.pmod(F.col(turn) if isinstance(turn, str) else turn, F.lit(2)) == 0, "user").otherwise("assistant")
    return F.when(low.rlike("user|human"), "user").when(low.rlike("assistant|model|bot|system"), "assistant").otherwise(parity)


def parse_transcript(transcripts: DataFrame, key: str = "conv_id", raw: str = "raw") -> DataFrame:
    """Messages of pasted text that is labelled line by line; text without any message is one user message."""
    trim = lambda c: F.regexp_replace(c, "\\A\\s+|\\s+\\z", "")
    text = trim(F.col(raw))
    pieces = F.filter(F.transform(F.split(text, f"(?im)(?=^(?:{LABELS})\\s*:)"), trim), lambda x: x != "")
    label = lambda x: F.lower(F.regexp_extract(x, f"(?i)\\A({LABELS})\\s*:", 1))

    def message(x: Column) -> Column:
        role = F.when(label(x).isin("", "you", "user", "human"), "user").otherwise("assistant")
        return F.struct(role.alias("role"), trim(F.regexp_replace(x, f"(?i)\\A(?:{LABELS})\\s*:", "")).alias("content"))

    found = F.filter(F.transform(pieces, message), lambda m: m["content"] != "")
    whole = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    chosen = F.when(F.size(found) > 0, found).when(text != "", whole)
    rows = transcripts.select(key, F.posexplode(chosen).alias("turn", "m"))
    return rows.select(key, F.col("turn").cast("long").alias("turn"), "m.role", "m.content")
