"""A folder or bucket of issues as a data source: batch and stream, one row a positioned item.

    spark.dataSource.register(issue_source(open_issue))
    spark.read.format("issues").option("path", folder).load().where("date >= '2026-01-05' AND pageNumber >= 3")
    spark.readStream.format("issues").option("path", folder).option("startPage", 3).load()

A file's date is the end of its name (YYYY-MM-DD or DD-MM-YYYY); other files are no issues. The
parser is injected: open_issue(bytes) returns an object with `pages` (their number) and
`items(page)`, so that a page that is not wanted is never parsed.

Batch. Comparisons on date and pageNumber are pushed into the source: files of other dates are not
opened and other pages not parsed (the session needs spark.sql.python.filterPushdown.enabled, which
`read_issues` sets). A file is `shares` tasks, each of which parses every shares-th page; with one
share, small files are read together.

Stream. The offset is the time and path of the last file, so a restarted stream goes on where it
stopped; files of one time are taken in order of their paths. Files must appear with a time that is
not before those already seen (a rename in one bucket, or an upload).

Storage is reached through pyarrow's file systems (local, hdfs, s3, gs). The listing is one entry a
file of the calendar and is made on the driver; contents are read in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ISSUE_SCHEMA = "source string, date date, pageNumber int, page_width double, item_no int, text string, x double, y double, size double, width double"


class Issue(Protocol):
    """A parsed file; items(page) are (page_width, text, x, y, size, width) of a page from 1 on."""

    pages: int

    def items(self, page: int) -> Iterable[tuple]: ...


Opener = Callable[[bytes], Issue]


def file_date(path: str) -> date | None:
    """The date at the end of a file's stem, whole year first or last."""
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.replace("\\", "/").rsplit("/", 1)[-1])
    for form, order in ((r"(?:^|[^0-9])(\d{4})-(\d{2})-(\d{2})$", (1, 2, 3)), (r"(?:^|[^0-9])(\d{2})-(\d{2})-(\d{4})$", (3, 2, 1))):
        if m := re.search(form, stem):
            try:
                return date(*(int(m[k]) for k in order))
            except ValueError:
                pass
    return None


#: Small files are read together in one task up to so many bytes; rows of a batch.
PART_BYTES, BATCH = 16 * 1024 * 1024, 8192


@dataclass(frozen=True, order=True)
class File:
    """Time in nanoseconds and path: the order of a stream."""

    at: int
    path: str
    size: int = field(default=0, compare=False)


def _storage(folder: str):
    """(file system, path inside it, prefix that paths get back)."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return *fs.FileSystem.from_uri(folder), folder[: folder.index(":") + 1]
    return fs.LocalFileSystem(), folder, ""


def listed(folder: str, pattern: str) -> list[File]:
    """Issues in a folder, oldest first."""
    from pyarrow import fs

    store, at, _ = _storage(folder)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(File(f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and re.search(pattern, f.base_name, re.I) and file_date(f.path))


class Share(InputPartition):
    """Every `step`-th page from `first` of some files, where a range of pages is wanted."""

    def __init__(self, paths: list[str], first: int, step: int, low: int, high: int | None) -> None:
        self.paths, self.first, self.step, self.low, self.high = paths, first, step, low, high


def shared_out(files: Iterable[File], shares: int, low: int, high: int | None) -> list[Share]:
    """Tasks: `shares` a file, or where that is one, small files together."""
    if shares > 1:
        return [Share([f.path], k, shares, low, high) for f in files for k in range(shares)]
    out, size = [], PART_BYTES
    for f in files:
        if size + f.size > PART_BYTES:
            out.append(Share([], 0, 1, low, high))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


def rows_of(folder: str, part: Share | None, opener: Opener) -> Iterator:
    """Arrow batches of a share's items; a folder without issues has one task without a share."""
    import pyarrow as pa

    if part is None:
        return
    store, _, _ = _storage(folder)
    kinds = {"string": pa.string(), "date": pa.date32(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ISSUE_SCHEMA.split(", "))])
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), schema.types)], schema=schema)

    for path in part.paths:
        with store.open_input_stream(path) as f:
            issue = opener(f.read())
        name, day = path.rsplit("/", 1)[-1], file_date(path)
        for page in range(1, min(issue.pages, part.high if part.high is not None else issue.pages) + 1):
            if page >= part.low and (page - 1) % part.step == part.first:
                held += [(name, day, page, width, k, text, x, y, size, w) for k, (width, text, x, y, size, w) in enumerate(issue.items(page))]
                if len(held) >= BATCH:
                    yield batch()
                    held.clear()
    if held:
        yield batch()


class Wanted:
    """Dates and pages that pushed comparisons leave; those that are not understood leave all."""

    def __init__(self, start_page: int = 1) -> None:
        self.days: list[Callable[[date], bool]] = []
        self.low, self.high = max(1, start_page), None

    def push(self, f: Filter) -> None:
        of = {EqualTo: lambda v: lambda d: d == v, GreaterThan: lambda v: lambda d: d > v, GreaterThanOrEqual: lambda v: lambda d: d >= v, LessThan: lambda v: lambda d: d < v, LessThanOrEqual: lambda v: lambda d: d <= v, In: lambda v: lambda d: d in v}.get(type(f))
        name, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if of is None or (value is None and not isinstance(f, In)):
            return
        if name == ("date",):
            self.days.append(of(value))
        elif name == ("pageNumber",):
            values = [v for v in value if v is not None] if isinstance(f, In) else [value]
            low = {EqualTo: 0, GreaterThan: 1, GreaterThanOrEqual: 0, In: 0}.get(type(f))
            high = {EqualTo: 0, LessThan: -1, LessThanOrEqual: 0, In: 0}.get(type(f))
            if low is not None:
                self.low = max(self.low, min(values, default=1 << 30) + low)
            if high is not None:
                self.high = min(x for x in (self.high, max(values, default=0) + high) if x is not None)

    def has(self, day: date) -> bool:
        return all(f(day) for f in self.days)


def issue_source(opener: Opener, name: str = "issues") -> type[DataSource]:
    """A data source class around a parser, to be registered under `name`.

    options: path; pattern (of file names, "\\.pdf$"); startPage (1); shares (1).
    """

    class Reader(DataSourceReader):
        def __init__(self, options) -> None:
            self.folder, self.pattern, self.shares = options["path"], options.get("pattern", r"\.pdf$"), int(options.get("shares", 1))
            self.wanted = Wanted(int(options.get("startPage", 1)))

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                self.wanted.push(f)
                yield f  # Spark looks again: pages come in ranges

        def partitions(self) -> list[Share]:
            files = [f for f in listed(self.folder, self.pattern) if self.wanted.has(file_date(f.path))]
            return shared_out(files, self.shares, self.wanted.low, self.wanted.high)

        def read(self, partition: Share) -> Iterator:
            return rows_of(self.folder, partition, opener)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options) -> None:
            self.folder, self.pattern = options["path"], options.get("pattern", r"\.pdf$")
            self.start_page, self.shares = int(options.get("startPage", 1)), int(options.get("shares", 1))

        def initialOffset(self) -> dict:
            return {"at": -1, "path": ""}

        def latestOffset(self) -> dict:
            files = listed(self.folder, self.pattern)
            return {"at": files[-1].at, "path": files[-1].path} if files else self.initialOffset()

        def partitions(self, start: dict, end: dict) -> list[Share]:
            new = (f for f in listed(self.folder, self.pattern) if File(**start) < f <= File(**end))
            return shared_out(new, self.shares, self.start_page, None)

        def read(self, partition: Share) -> Iterator:
            return rows_of(self.folder, partition, opener)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ISSUE_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    return Source


def read_issues(spark: SparkSession, folder: str, opener: Opener, start_page: int = 1, stream: bool = False, **options) -> DataFrame:
    """Items of all issues of a folder from start_page on, as a table or a stream."""
    spark.dataSource.register(issue_source(opener))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.readStream if stream else spark.read
    return reader.format("issues").options(path=folder, startPage=start_page, **options).load()


class LineIssue:
    """An issue kept as text, one JSON array of items a line and page: a stand-in for a PDF."""

    def __init__(self, content: bytes) -> None:
        self.lines = content.splitlines()
        self.pages = len(self.lines)

    def items(self, page: int) -> list[tuple]:
        import json

        return [tuple(i) for i in json.loads(self.lines[page - 1])]


def write_line_issues(items: DataFrame, folder: str, suffix: str = ".pdf") -> int:
    """Write items(date, pageNumber, page_width, item_no, text, x, y, size, width) as LineIssue files,
    one a date; pages that are missing become empty ones. Returns the number of files.

    A page's items meet in one row and an issue's pages in one task, a page at a time.
    """
    from pyspark.sql import functions as F

    item = F.struct(F.col("item_no").alias("n"), *(F.col(c) for c in ("page_width", "text", "x", "y", "size", "width")))
    pages = items.groupBy("date", "pageNumber").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def run(batches):
        import json

        import pyarrow as pa

        store, at, _ = _storage(folder)
        store.create_dir(at, recursive=True)
        out, day, page, done = None, None, 0, []

        def close():
            if out:
                out.close()
                store.move(f"{at}/.{day}.part", f"{at}/Issue-{day:%d-%m-%Y}{suffix}")
                done.append(str(day))

        for b in batches:
            for r in b.to_pylist():
                if r["date"] != day:
                    close()
                    day, page = r["date"], 0
                    out = store.open_output_stream(f"{at}/.{day}.part")
                while page < r["pageNumber"] - 1:
                    out.write(b"[]\n")
                    page += 1
                page += 1
                out.write(json.dumps([[i[c] for c in ("page_width", "text", "x", "y", "size", "width")] for i in r["items"]]).encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"date": pa.array(done, pa.string())})

    return pages.repartition("date").sortWithinPartitions("date", "pageNumber").mapInArrow(run, "date string").count()
