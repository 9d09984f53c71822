"""Places in a total order without one task for the order: a range sort and prefix counts.

Rows are dealt by ranges of their order, so a partition holds neighbours; a row's place is its
number inside the partition plus the rows of its group in the partitions before. Only one row for
each partition and each group in it is summed up, whatever a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fascicle.sources.tables import durable

#: Prefix counts of up to so many rows are broadcast, else joined by a shuffle.
COUNT_ROWS = 50_000
_BITS = 33


def positions(rows: DataFrame, order: list[Column], group: list[str] = (), name: str = "position") -> DataFrame:
    """rows with `name`: their place (long, from 0) in `order` within each value of the columns `group`.

    Rows are materialised once, so rows should be narrow. Ties share no place but take any order
    among themselves: end `order` with a unique column where places must not change between runs.
    A null group is a group. An empty table stays empty.
    """
    part, at = F.shiftright("__place", _BITS), F.col("__place").bitwiseAND((1 << _BITS) - 1)
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order]
    # Partition number and row number in one column, fixed by the cut.
    dealt = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"__part": part, "__at": at})
    counts = dealt.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__n"))
    counts = durable(counts.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__g{k}") for k, c in enumerate(group)), "__first", "__before"))
    met = F.col("__part") == F.col("__p")
    for k, c in enumerate(group):
        met &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    out = dealt.join(F.broadcast(counts) if counts.count() <= COUNT_ROWS else counts, met)
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).select(*rows.columns, name)


def page(placed: DataFrame, limit: int, skip: int = 0, name: str = "position") -> DataFrame:
    """Rows `skip` to `skip + limit` of each group: a filter on places, however deep the page."""
    return placed.where((F.col(name) >= skip) & (F.col(name) < skip + limit))
