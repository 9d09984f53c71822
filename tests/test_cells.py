"""Vector cells: the rows of a full scan, with most vectors never looked at."""

import re

import numpy as np
import pytest

from fascicle.operators import cells
from fascicle.operators.retrieval import cosine_topk

SCHEMA = "chunk_id long, embedding array<float>, label int"
QUERY = "topic_id int, query array<float>"


def clustered(n, dim=16, groups=40, seed=0, spread=0.08):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return [(k, (centre[k % groups] + rng.normal(size=dim) * spread).astype(float).tolist(), k % 7) for k in range(n)]


def answers(df):
    return [(r["topic_id"], r["chunk_id"], r["rank"], round(r["cosine"], 9)) for r in df.orderBy("topic_id", "rank").collect()]


@pytest.mark.parametrize("how", [None, {"label": {"$eq": 3}}, {"label": {"$eq": 99}}, {"chunk_id": {"$lt": 12}}])
def test_equals_full_scan(spark, tmp_path, how):
    rows = clustered(2000) + [(5, clustered(1)[0][1], 3), (9001, None, 3), (9002, [0.0] * 16, 3), (9003, [float("nan")] * 16, 3), (9004, [1.0], 3), (9005, [None] + [1.0] * 15, 3)]
    rows += [(9100 + k, rows[7][1], 3) for k in range(30)]  # many equal vectors: ties go to the smaller id
    df = spark.createDataFrame(rows, SCHEMA)
    cells.write_cells(df, str(tmp_path / "c"), 24)
    asked = spark.createDataFrame([(0, rows[7][1]), (1, clustered(5, seed=9)[2][1]), (2, [0.0] * 16), (3, None)], QUERY)
    found = cells.Cells(spark, str(tmp_path / "c")).search(asked, 10, how)
    whole = df.where("embedding IS NOT NULL AND size(embedding) = 16 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")
    assert answers(found.rows) == answers(cosine_topk(whole, asked.where("topic_id < 2"), 10, how))
    assert found.indexed == 2031


def test_most_vectors_are_skipped(spark, tmp_path):
    """Ten times the vectors: the share that cannot be ruled out stays small."""
    for n in (2000, 20_000):
        path = str(tmp_path / str(n))
        cells.write_cells(spark.createDataFrame(clustered(n), SCHEMA), path, 40)
        asked = spark.createDataFrame([(0, clustered(n)[11][1])], QUERY)
        found = cells.Cells(spark, path).search(asked, 10)
        assert found.rows.count() == 10
        assert found.candidates.count() < 0.3 * found.indexed
        plan = found.candidates._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan)
        assert "GreaterThanOrEqual(far," in plan


def test_vectors_without_clusters_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=24).tolist(), 0) for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells.write_cells(df, str(tmp_path / "c"), 300)
    asked = spark.createDataFrame([(t, rng.normal(size=24).tolist()) for t in range(3)], QUERY)
    assert answers(cells.Cells(spark, str(tmp_path / "c")).search(asked, 7).rows) == answers(cosine_topk(df, asked, 7))


def test_empty_table(spark, tmp_path):
    cells.write_cells(spark.createDataFrame([], SCHEMA), str(tmp_path / "c"))
    opened = cells.Cells(spark, str(tmp_path / "c"))
    assert opened.search(spark.createDataFrame([(0, [1.0, 2.0])], QUERY), 5).rows.count() == 0
    with pytest.raises(LookupError):
        cells.Cells(spark, str(tmp_path / "none"))
