"""Embedding through a service with a quota: bounded calls a second, resumable batches.

Texts are dealt into batches by their place in id order, so the same rows always make the same
batches. A batch is one call and one file, put in place by a rename when the call is over; a run that
was killed, a lost executor or a repeated task finds the files and calls for the missing batches
only. The stage has `lanes` tasks, and each lane begins its calls at least lanes / per_second apart,
retries included, so all together stay within the quota however many cores the cluster has. A
resource profile may give the stage executors of its own kind. Speculative execution would run a
lane twice at once and must be off.

The folder must rename files in one step (hdfs, a local or shared disk). Vectors are read back with
`vectors_of`.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.operators.positions import positions
from fascicle.sources.issues import _storage
from fascicle.sources.tables import _hadoop, durable

Embed = Callable[[list[str]], list[list[float]]]


class Pace:
    """Lets calls begin `every` seconds apart; the first one waits as well, as another task may just have ended here."""

    def __init__(self, every: float) -> None:
        self.every, self.next = every, time.monotonic() + every

    def wait(self) -> None:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.every


def called(embed: Embed, texts: list[str], pace: Pace, attempts: int, wait: float) -> list[list[float]]:
    """embed(texts), tried up to `attempts` times with doubling waits; every try keeps the pace."""
    for k in range(attempts):
        pace.wait()
        try:
            out = embed(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
            return out
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be at least 1")


def embed_within_quota(chunks: DataFrame, path: str, embed: Embed, per_second: float, lanes: int = 8, batch: int = 24, attempts: int = 12, wait: float = 8.0, profile=None) -> int:
    """Embed chunks(chunk_id, page_content) into batch files under path; how many batches were made now.

    chunk_id must be unique and not null; null texts count as empty. Batches whose file is there are
    not called for again, so path belongs to one set of chunks.
    """
    spark = chunks.sparkSession
    rows = positions(chunks.select("chunk_id", F.coalesce("page_content", F.lit("")).alias("text")), [F.col("chunk_id").asc()])
    rows = rows.withColumn("batch", F.floor(F.col("position") / batch).cast("long"))
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    here = spark.read.format("binaryFile").option("pathGlobFilter", "batch-*.parquet").load(path).select(F.regexp_extract("path", r"batch-(\d+)\.parquet$", 1).cast("long").alias("batch"))
    missing = durable(rows.join(here, "batch", "left_anti"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, folder, _ = _storage(path)
        pace, held, number = Pace(lanes / per_second), [], None

        def call():
            if not held:
                return None
            ids, texts = zip(*held)
            table = pa.table({"chunk_id": pa.array(ids), "embedding": pa.array([list(map(float, v)) for v in called(embed, list(texts), pace, attempts, wait)], pa.list_(pa.float32()))})
            part = f"{folder}/.part-{number}-{time.time_ns()}"
            with store.open_output_stream(part) as f:
                pq.write_table(table, f)
            store.move(part, f"{folder}/batch-{number}.parquet")
            return pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64())})

        for b in batches:
            for r in b.to_pylist():
                if r["batch"] != number:
                    if made := call():
                        yield made
                    held, number = [], r["batch"]
                held.append((r["chunk_id"], r["text"]))
        if made := call():
            yield made

    dealt = missing.repartition(lanes, "batch").sortWithinPartitions("batch", "position").select("batch", "chunk_id", "text")
    return dealt.mapInArrow(run, "batch long", profile=profile).count()


def vectors_of(chunks: DataFrame, path: str) -> DataFrame:
    """chunk_id, embedding of all batches under path; chunk_id has its type in chunks."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.sparkSession.read.schema(f"chunk_id {kind}, embedding array<float>").option("pathGlobFilter", "batch-*.parquet").parquet(path)
