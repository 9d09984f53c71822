"""Overlapping sentence-safe chunks of articles.

Packing is a sequential fold over one text's sentences, so it runs as an Arrow UDF over whole
columns; texts are independent, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.text import format_chunk, strip
from fascicle.sources.tables import spread

MAX_WORDS, OVERLAP_WORDS = 200, 20
#: Texts that are Python objects at a time.
PART = 64
_SENTENCE = re.compile("[^.!?]+(?:[.!?]+(?:[\"”']+)?[ ]*|$)")
_COMPLETE = re.compile("[.!?][\"”']?$")


def split_sentences(text: str) -> list[str]:
    """As functions.text.sentences. A text of closing marks only is one sentence."""
    flat = " ".join(re.split(r"[ \t\n\x0b\f\r]+", text or "")).strip(" ")
    if not flat:
        return []
    return [s for s in (p.strip(" ") for p in _SENTENCE.findall(flat) or [flat]) if s]


def tail(numbers: list[int], sizes: list[int], complete: list[bool], words: int) -> list[int]:
    """The shortest end of numbers' complete sentences (of all, if none is complete) that has `words` words."""
    if words <= 0:
        return []
    source = [k for k in numbers if complete[k]] or numbers
    sums = accumulate(sizes[k] for k in reversed(source))
    return source[-next((n for n, have in enumerate(sums, 1) if have >= words), len(source)) :]


def chunk_numbers(sizes: list[int], complete: list[bool], most: int, again: int) -> tuple[list[list[int]], list[int]]:
    """Numbers of the sentences in each full chunk, and in what is left at the end.

    A chunk is what it carries from the one before and then a run of sentences, whose end is found in
    the sums of words. It is cut after its last complete sentence.
    """
    sums, out, carried, start = [0, *accumulate(sizes)], [], [], 0
    while start < len(sizes) or carried:
        room = most - sum(sizes[k] for k in carried)
        stop = max(start, bisect_right(sums, sums[start] + room) - 1)
        chunk = [*carried, *range(start, stop)]
        if stop == len(sizes):
            return out, chunk
        if not chunk:  # one sentence that no chunk can hold
            out.append([stop])
            carried, start = tail([stop], sizes, complete, again) if complete[stop] else [], stop + 1
            continue
        end = max((n for n, k in enumerate(chunk, 1) if complete[k]), default=1)
        out.append(chunk[:end])
        carried = tail(chunk[:end], sizes, complete, again) + chunk[end:]
        if sum(sizes[k] for k in carried) + sizes[stop] > most:
            carried = []
        carried, start = [*carried, stop], stop + 1
    return out, []


def pack_sentences(text: str, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> list[str]:
    """Chunks of about max_words words that end on complete sentences where they can.

    A sentence beyond max_words stays whole. At the start of a bucket it is emitted and also
    carried as overlap, so it appears again with what follows. Incomplete sentences after the last
    complete one wait for the next chunk and go where that one cannot hold them.
    """
    parts = split_sentences(text)
    sizes = [len(s.split(" ")) for s in parts]
    if sum(sizes) <= max_words:
        return [" ".join(parts)] if parts else []
    full, left = chunk_numbers(sizes, [bool(_COMPLETE.search(s)) for s in parts], max_words, overlap_words)
    *out, last = (" ".join(parts[k] for k in chunk) for chunk in (*full, left))
    return [*out, last] if left and out[-1:] != [last] else out


def packed_texts(a: pa.Array, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> pa.Array:
    """Chunks of each text; only PART texts are Python objects at a time, whatever the size of the batch."""
    part = lambda k: pa.array([pack_sentences(x or "", max_words, overlap_words) for x in a.slice(k, PART).to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([part(k) for k in range(0, max(len(a), 1), PART)])


def packed(text: Column, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> Column:
    """array<string> of the chunks of each text; null counts as empty."""

    @F.arrow_udf("array<string>")
    def of(a: pa.Array) -> pa.Array:
        return packed_texts(a, max_words, overlap_words)

    return of(text)


def chunk_articles(articles: DataFrame, max_words: int = MAX_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """Stored chunks of articles(source, date, pageNumber, section, heading, body[, totalPages]).

    Ids are digests of date, page, heading, place and text, so writing an issue again replaces
    its rows instead of adding to them.
    """
    total_pages = F.col("totalPages") if "totalPages" in articles.columns else F.lit(None).cast("int")
    body = F.when(strip(F.coalesce("body", F.lit(""))) == "", F.col("heading")).otherwise(F.col("body"))
    cut = spread(articles).withColumn("pieces", packed(body, max_words, overlap_words)).withColumn("chunkTotal", F.size("pieces"))
    cut = cut.select("*", F.posexplode("pieces").alias("at", "piece"))
    d = F.col("date")
    content = format_chunk(F.col("heading"), F.col("piece"), F.col("at") + 1, F.col("chunkTotal"), d)
    key = F.concat_ws("|", d.cast("string"), "source", "pageNumber", "heading", (F.col("at") + 1).cast("string"), content)
    return cut.select(
        F.sha2(key, 256).alias("chunk_id"), content.alias("page_content"), "source", "date", (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).alias("dateInt"), F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        "pageNumber", F.col("pageNumber").alias("pageStart"), F.col("pageNumber").alias("pageEnd"), total_pages.alias("totalPages"), "section", F.substring("heading", 1, 350).alias("heading"), F.lit("sentence-pack").alias("chunking"), (F.col("at") + 1).alias("chunkIndex"), "chunkTotal",
    )
