"""Places by range sort and prefix counts against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from fascicle.operators.positions import page, positions


@pytest.mark.parametrize("group", [[], ["g"], ["g", "h"]])
def test_places_equal_sorted(spark, group):
    rng = random.Random(len(group))
    rows = [(k, rng.choice(["a", "b", None] + ["hot"] * 9), rng.choice([None, 1]), rng.randrange(9)) for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, g string, h int, v int")
    got = positions(df, [F.col("v").desc(), F.col("id").asc()], group, "place").collect()
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        k = tuple({"g": r[1], "h": r[2]}[c] for c in group)
        want[r[0]] = seen[k] = seen.get(k, -1) + 1
    assert {r["id"]: r["place"] for r in got} == want and len(got) == len(rows)
    deep = page(positions(df, [F.col("id").asc()], group), 3, 700)
    assert deep.count() == 3 * sum(n >= 702 for n in seen.values())


def test_no_rows_and_ties(spark):
    df = spark.createDataFrame([], "id int, g string")
    assert positions(df, [F.col("id").asc()], ["g"]).count() == 0
    same = spark.createDataFrame([(1, "a")] * 500, "id int, g string")
    assert sorted(r["position"] for r in positions(same, [F.col("id").asc()], ["g"]).collect()) == list(range(500))


def test_deep_pages_equal_shallow_ones(spark):
    """The same page by places and by a sort, with ties in every key but the id."""
    from fascicle.operators.curation import search

    rng = random.Random(6)
    rows = [(k, rng.choice(["high", "low", None]), rng.choice([1, 2, None]), rng.randrange(3), "National", "t flood" if k % 2 else "t", "s", ["x"]) for k in range(3000)]
    a = spark.createDataFrame(rows, "id int, examRelevance string, pageNumber int, at int, section string, title string, summary string, examTags array<string>").withColumn("createdAt", F.timestamp_seconds("at")).drop("at")
    for how in ({}, {"q": "fl.od"}, {"relevance": "high"}, {"rank_relevance": True}):
        for skip in (0, 640, 2950, 9000):
            one, other = search(a, limit=70, skip=skip, deep=10**9, **how), search(a, limit=70, skip=skip, deep=0, **how)
            assert other.columns == one.columns and other.collect() == one.collect()
