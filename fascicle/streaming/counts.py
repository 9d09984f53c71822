"""Counts of curated articles kept by a stream, with retractions when pages are curated again.

A batch brings verdicts on articles (source, pageNumber, section, kept) and the page from which each
source was curated anew. Its change is one signed row for each source, page and section: what was
counted before on the pages that are replaced is taken back, what the batch brings is added. Rows of
a batch lie in a folder of its own, and what it takes back is read from earlier batches only, so a
batch that runs again writes the same rows in the same place. Counts are sums of the signed rows;
articles themselves are never read again.

Scale. A batch is combined by source, page and section before it is shuffled; earlier rows are read
for its sources only. `compact` sums up old batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.sources.tables import _hadoop, durable

CHANGES = "source string, pageNumber int, section string, raw long, kept long, batch long"
VERDICTS = "source string, pageNumber int, section string, kept boolean, fromPage int"


def changes(spark: SparkSession, path: str) -> DataFrame:
    """All signed rows; none where no batch has run."""
    fs, at = _hadoop(spark, path)
    return spark.read.schema(CHANGES).parquet(path) if fs.exists(at) else spark.createDataFrame([], CHANGES)


def change(before: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Signed rows of a batch of verdicts, given the rows of earlier batches.

    A source's pages from its least fromPage on are replaced; articles before it are added. A source
    whose pages hold no article any more is named by a row without a pageNumber.
    """
    new = verdicts.where("source IS NOT NULL")
    starts = new.groupBy("source").agg(F.min(F.coalesce("fromPage", F.lit(1))).alias("from"))
    old = before.join(starts, "source").where(F.col("pageNumber") >= F.col("from")).groupBy("source", "pageNumber", "section").agg((-F.sum("raw")).alias("raw"), (-F.sum("kept")).alias("kept"))
    own = new.where("pageNumber IS NOT NULL").groupBy("source", "pageNumber", F.when(F.col("kept"), F.col("section")).alias("section")).agg(F.count("*").alias("raw"), F.count_if("kept").alias("kept"))
    both = old.unionByName(own).groupBy("source", "pageNumber", "section").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"))
    return both.where("raw <> 0 OR kept <> 0")


def apply_batch(verdicts: DataFrame, batch_id: int, path: str) -> None:
    """Write what a batch changes; running it again changes nothing."""
    spark = verdicts.sparkSession
    made = durable(change(changes(spark, path).where(F.col("batch") < batch_id), durable(verdicts)))
    made.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def count_stream(verdicts: DataFrame, path: str, checkpoint: str):
    """Keep the counts under path up to date with a stream of VERDICTS."""
    return verdicts.writeStream.foreachBatch(lambda b, k: apply_batch(b, k, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def section_counts(spark: SparkSession, path: str) -> DataFrame:
    """section, count of kept articles, now."""
    return changes(spark, path).groupBy("section").agg(F.sum("kept").alias("count")).where("count > 0 AND section IS NOT NULL")


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """source, pageNumber, raw, kept, dropped articles, now."""
    pages = changes(spark, path).groupBy("source", "pageNumber").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"))
    return pages.where("raw > 0").withColumn("dropped", F.col("raw") - F.col("kept"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Sum the rows of batches up to `upto`, all of which must be over, into that batch's folder.

    Not while a stream writes. The sum is cut to the shared folder first; if the swap is stopped half
    way, replay the source, as after any lost table.
    """
    old = changes(spark, path).where(F.col("batch") <= upto)
    numbers = sorted(r["batch"] for r in old.select("batch").distinct().collect())
    if len(numbers) < 2:
        return
    total = durable(old.groupBy("source", "pageNumber", "section").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept")).where("raw <> 0 OR kept <> 0"))
    for n in numbers[:-1]:
        fs, at = _hadoop(spark, f"{path}/batch={n}")
        fs.delete(at, True)
    total.write.mode("overwrite").parquet(f"{path}/batch={numbers[-1]}")
    spark.catalog.refreshByPath(path)
