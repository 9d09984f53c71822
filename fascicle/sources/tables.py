"""Sources and sinks: file listings, the chunk and vector tables, and guarded maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.functions.filters import compile_filter

PDF_LIMIT = 50 * 1024 * 1024
#: Columns of a text scan; vectors are never among them.
TEXT_COLUMNS = ("chunk_id", "page_content", "source", "date", "dateInt", "pageNumber", "section", "heading", "chunkIndex", "chunkTotal")


#: Tables estimated below this are dealt over all cores before heavy row work.
SMALL_BYTES = 256 * 1024 * 1024
#: What a task gets of a larger table whose files are beyond SMALL_BYTES each.
TASK_BYTES = 64 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small or in few large files: a row group is read by one task, and would keep one core busy.

    The size is the optimizer's estimate; tables of many files have enough splits and are left alone.
    """
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    if size <= SMALL_BYTES:
        return df.repartition(cores)
    files = len(df.inputFiles())
    return df.repartition(max(cores, size // TASK_BYTES)) if files and size > files * SMALL_BYTES else df


#: Folders that stand in for a shared one, by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without it gets a temporary folder; on a cluster its absence is an error, as
    files in a machine's own folder would be lost to the others.
    """
    import tempfile

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="fascicle-")
    return _FOLDERS[app]


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """df cut from its lineage as Parquet in the shared folder: for rows of arrays and texts, which a checkpoint holds uncompressed."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of the files of a folder or bucket; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def is_pdf(content: Column, length: Column, declared: Column | None = None) -> Column:
    """Whether bytes may be stored as an issue: not empty, within the limit, PDF by mark or type."""
    mark = F.substring(content, 1, 4) == F.lit(b"%PDF")
    kind = F.lower(declared) == "application/pdf" if declared is not None else F.lit(False)
    return (length > 0) & (length <= PDF_LIMIT) & (mark | F.coalesce(kind, F.lit(False)))


def read_items(spark: SparkSession, folder: str, parse) -> DataFrame:
    """Positioned items of PDFs by an injected parser: parse(path, bytes) -> iterable of dicts.

    One file is one row and is parsed in one task.
    """
    from fascicle.operators.layout import ITEM_SCHEMA

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(parse(path, content)), columns=[c.split()[0] for c in ITEM_SCHEMA.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content").mapInPandas(run, ITEM_SCHEMA)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks partitioned by date. Only the dates in chunks are replaced, so writing a date
    again is idempotent and also deletes its old chunks.

    The rebalance hint lets adaptive execution cut a large date into several tasks.
    """
    dealt = chunks.hint("rebalance", F.col("date"))
    dealt.sortWithinPartitions("date", "pageNumber", "chunkIndex").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def merge_pages(chunks: DataFrame, path: str) -> list[str]:
    """Write chunks over those of the same source and page, and keep all others of their dates.

    An issue may so arrive in any number of parts, and a part that comes again changes nothing. Only
    the dates in chunks are read and written again; they are returned (a date is an issue, so a
    batch has few). A page that a new edition lacks is not known here: drop_dates() first.
    """
    spark = chunks.sparkSession
    new = durable(chunks)
    dates = sorted(r[0] for r in new.select(F.col("date").cast("string")).distinct().collect() if r[0] is not None)
    fs, at = _hadoop(spark, path)
    if fs.exists(at) and dates:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("date").cast("string").isin(dates))
        page = ["date", "source", "pageNumber"]
        new = durable(new.unionByName(old.join(new.select(*page).distinct(), page, "left_anti").select(*new.columns)))
    write_chunks(new, path)
    return dates


def embed_chunks(chunks: DataFrame, embed, batch: int = 24, attempts: int = 12, wait: float = 8.0, pause: float = 0.0) -> DataFrame:
    """chunk_id, embedding by an injected embed(list of texts) -> list of vectors.

    Calls take `batch` texts, `pause` seconds apart, and are retried with doubling waits; a call
    that keeps failing fails its task, which Spark retries. chunk_id keeps its type.
    """

    def run(batches):
        import time

        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                if at and pause:
                    time.sleep(pause)
                for k in range(attempts):
                    try:
                        out = embed(part["page_content"].fillna("").tolist())
                        break
                    except Exception:
                        if k == attempts - 1:
                            raise
                        time.sleep(wait * 2**k)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": [list(map(float, v)) for v in out]})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "page_content").mapInPandas(run, f"chunk_id {kind}, embedding array<float>")


#: Scans that are kept in memory, by the plan they come from.
_KEPT: dict[str, DataFrame] = {}


def cached_scan(chunks: DataFrame, filter=None) -> DataFrame:
    """scan() kept in executors' memory and disk until clear_scans()."""
    found = scan(chunks, filter)
    key = f"{found.sparkSession.sparkContext.applicationId}:{found.semanticHash()}"
    if key not in _KEPT:
        _KEPT[key] = found.persist()
    return _KEPT[key]


def clear_scans() -> None:
    while _KEPT:
        _KEPT.popitem()[1].unpersist()


def scan(chunks: DataFrame, filter=None) -> DataFrame:
    """Texts and metadata of all chunks, or of a filter's; the filter and the columns reach the scan."""
    return chunks.where(compile_filter(filter, chunks)).select(*[c for c in TEXT_COLUMNS if c in chunks.columns])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the Java side, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_dates(spark: SparkSession, path: str, dates: list[str]) -> None:
    """Delete whole date partitions."""
    for d in dates:
        fs, at = _hadoop(spark, f"{path}/date={d}")
        fs.delete(at, True)


def drop_table(spark: SparkSession, path: str, protected: tuple[str, ...] = ()) -> None:
    """Delete a table's folder; protected names are refused."""
    if path.rstrip("/").rsplit("/", 1)[-1] in protected:
        raise ValueError(f"{path} is protected")
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, created empty where there is none."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table."""
    rows.write.mode("append").parquet(path)


def health(chunks: DataFrame) -> DataFrame:
    """One row: ok, vectors."""
    return chunks.agg(F.count("*").alias("vectors")).select((F.col("vectors") > 0).alias("ok"), "vectors")


def replace_copy(articles: DataFrame, path: str) -> DataFrame:
    """Copy a table over another and return its rows by section.

    The copy is written beside the old table and then takes its place, so articles may come from it.
    """
    spark, new = articles.sparkSession, f"{path.rstrip('/')}.new"
    articles.write.mode("overwrite").parquet(new)
    (fs, old), (_, made) = _hadoop(spark, path), _hadoop(spark, new)
    fs.delete(old, True)
    if not fs.rename(made, old):
        raise OSError(f"{new} could not be moved to {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path).groupBy("section").agg(F.count("*").alias("count"))
