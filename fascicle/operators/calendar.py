"""The issue calendar: which dates have a file, what state each is in, and what is due.

Progress is a table keyed by date: date, source, sourceMtimeMs, sourceSize, status, totalPages,
nextPage, vectorCount. Syncing is one pass of joins on the date and a CASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.dates import base_name, date_from_name, issue_name, iso_date, manual_path, public_url

STATUSES = ("missing", "pending", "in_progress", "complete", "stale")
DUE = ("pending", "in_progress", "stale")
FIELDS = ("date", "source", "sourceMtimeMs", "sourceSize", "status", "totalPages", "nextPage", "vectorCount")
PROGRESS_SCHEMA = "date date, source string, sourceMtimeMs double, sourceSize long, status string, totalPages int, nextPage int, vectorCount long"


def discover(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues by date, skipped names) of files(path, modificationTime, length).

    Only .pdf names count. Of several files of one date the last by path stays.
    """
    named = files.where(F.lower("path").endswith(".pdf")).withColumn("date", date_from_name(F.col("path")))
    stat = F.struct("path", (F.unix_micros("modificationTime") / 1000).alias("mtime"), "length")
    found = named.where("date is not null").groupBy("date").agg(F.max(stat).alias("f"))
    skipped = named.where("date is null").select(base_name(F.col("path")).alias("name"))
    return found.select("date", F.col("f.path").alias("source"), F.col("f.mtime").alias("sourceMtimeMs"), F.col("f.length").alias("sourceSize")), skipped


def sync(previous: DataFrame, found: DataFrame, start: str, today: Column | str) -> DataFrame:
    """Progress from start to the later of today and the last file; earlier files are ignored.

    No file: missing. A file without history: pending. A changed file: stale if it was complete or
    in progress, else pending, counters reset. An unchanged one keeps its row. Idempotent.
    """
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    last = found.agg(F.greatest(today, F.max("date")).alias("last"))
    # One row of bounds makes the spine: a few hundred dates.
    spine = last.select(F.explode(F.sequence(F.lit(start).cast("date"), "last", F.expr("interval 1 day"))).alias("date"))
    old = [F.col(c).alias(f"o_{c}") for c in FIELDS if c != "date"]
    j = spine.join(found, "date", "left").join(previous.select("date", *old), "date", "left")
    has = F.col("source").isNotNull()
    known = F.col("o_status").isNotNull() & (F.col("o_status") != "missing")
    same = (base_name(F.col("o_source")) == base_name(F.col("source"))) & F.col("o_sourceMtimeMs").eqNullSafe(F.col("sourceMtimeMs")) & F.col("o_sourceSize").eqNullSafe(F.col("sourceSize"))
    keep = has & known & same
    status = F.when(~has, "missing").when(~known, "pending").when(same, F.col("o_status")).when(F.col("o_status").isin("complete", "in_progress"), "stale").otherwise("pending")
    counter = lambda c, new: F.when(keep, F.col(f"o_{c}")).when(has, new)
    out = j.select("date", "source", "sourceMtimeMs", "sourceSize", status.alias("status"), counter("totalPages", F.lit(None)).cast("int").alias("totalPages"), counter("nextPage", F.lit(1)).cast("int").alias("nextPage"), counter("vectorCount", F.lit(0)).cast("long").alias("vectorCount"))
    return out


def mark(progress: DataFrame, day: str, **fields) -> DataFrame:
    """Progress with the fields of one date set."""
    is_day = F.col("date") == F.lit(day).cast("date")
    kinds = dict(progress.dtypes)
    return progress.withColumns({k: F.when(is_day, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in fields.items()})


def reset(progress: DataFrame) -> DataFrame:
    """All present files pending from their first page."""
    present = F.col("status") != "missing"
    new = {"status": F.lit("pending"), "totalPages": F.lit(None).cast("int"), "nextPage": F.lit(1), "vectorCount": F.lit(0).cast("long")}
    return progress.withColumns({k: F.when(present, v).otherwise(F.col(k)) for k, v in new.items()})


def due(progress: DataFrame, day: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    c = F.col("status").isin(*DUE)
    for op, v in (("__eq__", day), ("__ge__", start), ("__le__", end)):
        if v:
            c = c & getattr(F.col("date"), op)(F.lit(v).cast("date"))
    return progress.where(c)


def batch(progress: DataFrame, limit: int = 10, day: str | None = None, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the next files by date, one row of due and remaining). A single day has no limit."""
    all_due = due(progress, day, start, end)
    queue = all_due.orderBy("date")
    bounded = not day and limit and limit > 0
    queue = queue.limit(limit) if bounded else queue
    counts = all_due.agg(F.count("*").alias("due")).select("due", (F.greatest(F.lit(0), F.col("due") - F.lit(limit)) if bounded else F.lit(0)).cast("long").alias("remaining"))
    return queue, counts


def status_counts(progress: DataFrame) -> DataFrame:
    """status, count for every status, zero included."""
    names = progress.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(progress.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))


def summary(progress: DataFrame) -> DataFrame:
    """complete (false where no file is present), vectorCount and the missing dates, in one row."""
    present = F.col("status") != "missing"
    complete = F.coalesce(F.bool_and(F.when(present, F.col("status") == "complete")), F.lit(False))
    missing = F.array_sort(F.collect_list(F.when(~present, F.col("date"))))
    return progress.agg(complete.alias("complete"), F.coalesce(F.sum("vectorCount"), F.lit(0)).alias("vectorCount"), missing.alias("missing"))


def archive(progress: DataFrame, stored: DataFrame) -> DataFrame:
    """Dates with a file here or in the store, newest first. stored(date, filename, sizeBytes):
    its name wins; pages come from progress."""
    have = progress.where(F.col("status") != "missing").select("date", base_name(F.col("source")).alias("own"), "sourceSize", "totalPages")
    j = have.join(stored, "date", "full")
    return j.select("date", F.coalesce("filename", "own").alias("filename"), F.coalesce("sizeBytes", "sourceSize").alias("sizeBytes"), "totalPages").orderBy(F.desc("date"))


def resume_page(row, force: bool = False) -> tuple[int, bool]:
    """(first page to read, whether the date starts over) for one progress row."""
    fresh = force or row["status"] in ("stale", "pending", "complete")
    return (1, True) if fresh else (max(int(row["nextPage"] or 1), 1), False)


def resolve(asked: DataFrame, progress: DataFrame, base: str, latest: str, prefix: str = "Issue") -> DataFrame:
    """asked(date string) with valid, filename, url, remoteUrl, totalPages and sizeBytes of the issue to serve.

    A blank date stands for the latest issue, which is always there. A date known as missing, or
    one that is no date, has no file; any other has the name in progress, or the usual name.
    """
    text = F.trim(F.coalesce("date", F.lit("")))
    rows = asked.select(F.col("date").alias("asked"), text.alias("__text"), iso_date(text).alias("__day"))
    known = progress.select(F.col("date").alias("__day"), "source", "status", "totalPages", F.col("sourceSize").alias("sizeBytes"))
    j = rows.join(known, "__day", "left")
    blank = F.col("__text") == ""
    own = F.when(base_name(F.col("source")) != "", base_name(F.col("source"))).otherwise(issue_name(F.col("__day"), prefix))
    has = F.col("__day").isNotNull() & ~F.coalesce(F.col("status") == "missing", F.lit(False))
    name = F.when(blank, F.lit(latest)).when(has, own)
    return j.select(
        F.col("asked").alias("date"), (blank | F.col("__day").isNotNull()).alias("valid"), name.alias("filename"), F.when(name.isNotNull(), manual_path(F.col("__day"))).alias("url"),
        public_url(base, name).alias("remoteUrl"), F.when(has, F.col("totalPages")).alias("totalPages"), F.when(has, F.col("sizeBytes")).alias("sizeBytes"),
    )


def health_report(vectors: DataFrame, progress: DataFrame, collection: str) -> DataFrame:
    """One row on the state of an archive: ok, indexReady, vectorCount, collection, error, ingestComplete, and
    while not every present file is complete: date, nextPage, totalPages of the first file in
    progress, pending and missing files.

    A collection without vectors is not ok, and nothing is said of its ingest then.
    """
    n = vectors.agg(F.count("*").alias("vectorCount"))
    at = F.when(F.col("status") == "in_progress", F.struct("date", "nextPage", "totalPages"))
    there, whole = F.count_if(F.col("status") != "missing"), F.count_if(F.col("status") == "complete")
    p = progress.agg(((there > 0) & (there == whole)).alias("whole"), F.min(at).alias("at"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "missing").alias("missing"))
    ok = F.col("vectorCount") > 0
    open_ = lambda c: F.when(ok & ~F.col("whole"), c)
    return n.crossJoin(p).select(
        ok.alias("ok"), ok.alias("indexReady"), "vectorCount", F.lit(collection).alias("collection"), F.when(~ok, F.lit(f'Collection "{collection}" is empty')).alias("error"), F.when(ok, F.col("whole")).alias("ingestComplete"),
        open_(F.col("at.date")).alias("date"), open_(F.col("at.nextPage")).alias("nextPage"), open_(F.col("at.totalPages")).alias("totalPages"), open_(F.col("pending")).alias("pending"), open_(F.col("missing")).alias("missing"),
    )
