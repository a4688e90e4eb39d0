"""Stored pages to messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from .stored import stored
from .transcripts import LABELS, parse_transcript

#: Pages that a worker holds as Python values at once.
PART = 128
MESSAGES = "page_id long, turn long, role string, content string, method string"


def _parts(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch as Python values, PART at a time."""
    for at in range(0, batch.num_rows, PART):
        yield list(zip(*(c.to_pylist() for c in batch.slice(at, PART).columns), strict=True))


def html_to_markdown(html: Column | str, url: Column | str) -> Column:
    """Markdown of an HTML fragment; links are made absolute by the page's address."""

    @F.arrow_udf("string")
    def run(html_: pa.Array, url_: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([html_, url_], ["html", "url"])
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([dom.html_to_markdown(h or "", u or "") for h, u in part], pa.string()) for part in _parts(batch))])

    return run(html, url)


def page_messages(pages: DataFrame) -> DataFrame:
    """(page_id, turn, role, content, method) of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for part in _parts(batch):
                rows = [(page, turn, *m) for page, url, html in part for turn, m in enumerate(dom.page_messages(url, html))]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["page_id", "turn", "role", "content", "method"])

    return pages.select("page_id", "url", "html").mapInArrow(run, MESSAGES)


def with_transcripts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Messages found on pages and, for pages without any, those of a transcript that their text holds (method transcript).

    A stored page has no selection, so its whole visible text stands for it, and only if two lines at least begin with a
    speaker's label; other pages stay without messages.
    """
    missing = pages.join(found.select("page_id").distinct(), "page_id", "left_anti")
    text = missing.select("page_id", html_to_markdown("html", "url").alias("raw"))
    labelled = F.size(F.regexp_extract_all("raw", F.lit(f"(?im)^(?:{LABELS})\\s*:"), 0)) > 1
    told = parse_transcript(text.where(labelled), "page_id").withColumn("method", F.lit("transcript"))
    return found.unionByName(told)


def extracted(pages: DataFrame) -> DataFrame:
    """All messages of pages: those of the page's structure, or else of a transcript; pages are read into trees once."""
    return with_transcripts(pages, stored(page_messages(pages)))
