"""A lexical index in segments: a date is replaced without tokenising any other.

Each write makes one segment: documents, postings of all tokens (each file sorted by token) and document
frequencies by date. A small manifest says which segment holds each date, so replacing a date is a
new segment and one changed line: the old segment's rows of that date are dead from then on
(tombstone), and its frequencies no longer count. A reader takes the live (segment, date) pairs,
sums their frequencies, and prunes common tokens by these sums, so what it sees equals an index
built anew from all chunks. Segments that have grown to like size are compacted by copying their
live rows; nothing is tokenised then either.

Scale. The manifest has one entry a date of the calendar. A question's tokens reach the sorted
postings as literals; dead segments are pruned as folders. Each chunk is rewritten once for each
power of FANOUT that its segment grows by. One writer at a time; readers may go on meanwhile, and
`vacuum` removes what no manifest names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators.lexical import RARE_RATIO, LexicalIndex, chunk_runs, exploded, index_stats
from fascicle.sources.progress import load_json, save_json
from fascicle.sources.tables import _hadoop, cut

TABLES = ("docs", "postings", "df")
FANOUT = 4
#: The live pairs are broadcast up to so many, else joined.
PAIRS = 50_000


def manifest(spark: SparkSession, path: str) -> dict:
    """{date: {"segment", "chunks", "lengths"}}: where each live date is."""
    return (load_json(spark, f"{path}/manifest.json") or {}).get("dates", {})


def _commit(spark: SparkSession, path: str, dates: dict) -> dict:
    save_json(spark, f"{path}/manifest.json", {"dates": dates})
    return dates


def _write(docs: DataFrame, postings: DataFrame, df: DataFrame, path: str) -> str:
    """A new segment of the three tables; no reader sees it before the manifest names it."""
    name = f"s{uuid.uuid4().hex}"  # never read as a number
    docs.write.parquet(f"{path}/docs/segment={name}")
    # Each task sorts its own postings: nothing moves, and a question's tokens prune each file to a few pages.
    postings.sortWithinPartitions("token", "chunk_id").write.parquet(f"{path}/postings/segment={name}")
    df.repartitionByRange("token", "date").sortWithinPartitions("token", "date").write.parquet(f"{path}/df/segment={name}")
    return name


def replace_dates(chunks: DataFrame, path: str, dates: list[str] | None = None, strip_header: bool = False) -> dict:
    """Let chunks(chunk_id, page_content, heading, date) take the place of all chunks of their dates.

    dates: the dates that are replaced where chunks may hold none of one (then it is emptied).
    Chunks without a date are kept under ''. Returns the new manifest.
    """
    spark = chunks.sparkSession
    dated = chunks.withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("")))
    runs = cut(chunk_runs(dated, strip_header, ("date",)))
    found = runs.groupBy("date").agg(F.count("*").alias("chunks"), F.sum(F.greatest("length", F.lit(1)).cast("long")).alias("lengths")).collect()
    live = manifest(spark, path)
    for d in dates or ():
        live.pop(d, None)
    if found:
        rows = exploded(runs, "date")
        name = _write(runs.select("chunk_id", "date", "length"), rows, rows.groupBy("token", "date").agg(F.count("*").alias("df")), path)
        live |= {r["date"]: {"segment": name, "chunks": r["chunks"], "lengths": r["lengths"]} for r in found}
    return _commit(spark, path, live)


def _live(spark: SparkSession, path: str, table: str, live: dict) -> DataFrame:
    """Rows of the live pairs of segment and date."""
    names = sorted({x["segment"] for x in live.values()})
    pairs = spark.createDataFrame([(x["segment"], d) for d, x in live.items()], "segment string, date string")
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/segment={n}" for n in names))
    return rows.join(F.broadcast(pairs) if len(live) <= PAIRS else pairs, ["segment", "date"], "left_semi")


def open_segments(spark: SparkSession, path: str, rare_ratio: float | None = RARE_RATIO) -> LexicalIndex | None:
    """The index of all live dates as it stands now; None where there is none."""
    live = manifest(spark, path)
    if not live:
        return None
    n, lengths = sum(x["chunks"] for x in live.values()), sum(x["lengths"] for x in live.values())
    df = _live(spark, path, "df", live).groupBy("token").agg(F.sum("df").alias("df"))
    if rare_ratio is not None:
        df = df.where(F.col("df") < rare_ratio * max(n, 1))
    postings = _live(spark, path, "postings", live).join(df, "token").select("token", "chunk_id", "tf", "df", "length")
    return LexicalIndex(_live(spark, path, "docs", live).select("chunk_id", "length"), postings, index_stats(spark, n, lengths, rare_ratio))


def rare_tokens(spark: SparkSession, path: str, rare_ratio: float = RARE_RATIO) -> DataFrame:
    """token, df of the tokens that the index serves; postings are not read."""
    live = manifest(spark, path)
    df = _live(spark, path, "df", live).groupBy("token").agg(F.sum("df").alias("df"))
    return df.where(F.col("df") < rare_ratio * max(sum(x["chunks"] for x in live.values()), 1))


def compact(spark: SparkSession, path: str, fanout: int = FANOUT) -> dict:
    """Merge segments of like size wherever `fanout` of them have gathered; returns the manifest."""
    while True:
        live, size = manifest(spark, path), {}
        for x in live.values():
            size[x["segment"]] = size.get(x["segment"], 0) + x["chunks"]
        tiers: dict[int, list[str]] = {}
        for name, n in size.items():
            tiers.setdefault(int(math.log(max(n, 1), fanout)), []).append(name)
        full = next((names for _, names in sorted(tiers.items()) if len(names) >= fanout), None)
        if full is None:
            return live
        own = {d: x for d, x in live.items() if x["segment"] in full}
        docs, postings, df = (_live(spark, path, t, own).drop("segment") for t in TABLES)
        name = _write(docs, postings, df, path)
        _commit(spark, path, live | {d: x | {"segment": name} for d, x in own.items()})


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of segments that hold no live date; their number. No reader may be open on them."""
    live, gone = {x["segment"] for x in manifest(spark, path).values()}, 0
    for t in TABLES:
        fs, at = _hadoop(spark, f"{path}/{t}")
        for f in fs.listStatus(at) if fs.exists(at) else ():
            if (name := f.getPath().getName()).startswith("segment=") and name.removeprefix("segment=") not in live:
                fs.delete(f.getPath(), True)
                gone += t == TABLES[0]
    return gone
