"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources, in code-point order with null last, weigh WEIGHTS, repeating. Together they share the size
of the whole corpus; a target stops at MOST times its source's size, and what it leaves is shared
again by weight: target = min(MOST * size, weight * rate), where the rate is raised until the
targets add up.

Sampling. A document's expected copies are its source's target over its size. Documents stand in
order of size, the expected copies before each are summed, one random offset a source is added, and
a document is emitted once for each integer that its own expected copies step over. So copies
differ by one at most within a source, and as neighbours are of equal size the words taken stay
within about the largest document of the target. To come nearer, documents above 1/LARGE of their
source are drawn first, and the expected copies of the others make up for what that left over.

As documents that are drawn together have equal expected copies, their prefix sum is a multiple of
the document's place; places come from a range sort with prefix counts, and the fraction of the
sum is computed in whole units of 2**-30, so no sum loses digits however long it is.

Scale. Texts are read once and shrink to (doc_id, source, size). A source that holds a third of all
rows is spread over many ranges, equal sizes included. The driver gets a few sums a round.

Rows. Null and empty texts have size 0 and are never counted as taken. Repeated rows are documents
of their own. Offsets and order follow from a seed, so reruns agree. An empty table gives no row.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import BROADCAST_ROWS, durable
from fascicle.operators.positions import positions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Most copies of a document and so the largest target of a source, in its sizes.
MOST = 3
LARGE = 100
SEED = 13
#: Units in which fractions of copies are summed.
UNIT = 1 << 30


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(source, ...) with weight: weights by turns, in code-point order, null last."""
    placed = positions(sources, [F.col("source").isNull().asc(), F.col("source").asc()])
    turn = (F.col("position") % len(weights)).cast("int")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).drop("position")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size, weight) with target (double): shares of the sum of all sizes by weight.

    A round computes the rate of all sources that are not held at their most; it ends when no
    further source is above it. Sums of one row reach the driver.
    """
    cap, rate, held = most * F.col("source_size"), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > cap
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("weights"), F.count_if(above).alias("held")).first()
        if row["held"] == held or not row["weights"]:
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(rate)))
        rate, held = (row["all"] - (row["fixed"] or 0)) / row["weights"], row["held"]


def offset(source: Column, draw: Column, seed: int = SEED) -> Column:
    """The random offset of a source and draw, in units of 2**-30."""
    return (F.crc32(F.concat_ws(":", F.lit(seed).cast("string"), draw.cast("string"), source).cast("binary")) % UNIT).cast("long")


def copies(expected: Column, place: Column, start: Column) -> Column:
    """Integers that the prefix sum of equal expected copies steps over at a place (from 0)."""
    whole = F.floor(expected)
    part = F.round((expected - whole) * UNIT).cast("long")
    at = (part * (place % UNIT) + start) % UNIT
    return whole + F.when(at + part >= UNIT, 1).otherwise(0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")))
    sums = durable(own.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = durable(targets(weighted(sums, weights), most).select(F.col("source").alias("goal"), "source_size", "target"))
    few = goal.count() <= BROADCAST_ROWS
    beside = lambda rows, side: rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("goal")), "left").drop("goal")
    draw = (LARGE * F.col("size") <= F.col("source_size")).cast("int")
    own = beside(own, goal).withColumn("draw", draw)
    tie = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = positions(own, [F.col("size").asc(), tie.asc(), F.col("doc_id").asc()], ["source", "draw"])

    even = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    first = placed.where("draw = 0").withColumn("copies", copies(even, F.col("position"), offset(F.col("source"), F.lit(0), seed)))
    gone = durable(first.groupBy("source").agg(F.sum("size").alias("large"), F.sum(F.col("copies") * F.col("size")).alias("drawn")).withColumnRenamed("source", "goal"))
    rest = beside(placed.where("draw = 1"), gone)
    small = F.col("source_size") - F.coalesce("large", F.lit(0))
    left = F.when(small > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.coalesce("drawn", F.lit(0))) / small))).otherwise(0.0)
    rest = rest.withColumn("copies", copies(left, F.col("position"), offset(F.col("source"), F.lit(1), seed)))
    out = first.unionByName(rest.drop("large", "drawn"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
