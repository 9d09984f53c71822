"""Exact cosine search that reads few vectors: cells around centroids, skipped by triangle bounds.

Vectors are scaled to length one, so cosine c is Euclidean distance sqrt(2 - 2c). Each vector lies
in the cell of its nearest centroid, in a table partitioned by cell and sorted by `far`, its
distance from that centroid. A question scans the cells nearest to it for k rows; the distance of
the k-th is a radius within which all answers lie. By the triangle inequality a vector at `far`
from a centroid that is d from the question is no nearer than |d - far|, so only rows with `far`
within the radius of d can be answers: whole cells are skipped as folders, and row groups of the
others by the statistics of `far`. What is left is compared exactly, so the result is that of a
full scan for any centroids; they only decide how much is read.

Scale. Centroids are fitted on at most SAMPLE vectors and number MOST_CELLS at most; every vector
is indexed, in one pass, and larger tables have longer cells that `far` cuts instead. Only
centroids, cell sizes and k rows a question reach the driver.

Rows. Null, zero and non-finite vectors are kept in cell -1 and never found. Repeated ids are rows
of their own. An empty table has no cell and no answer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.functions.filters import compile_filter
from fascicle.operators.lexical import rank_topk
from fascicle.sources.progress import load_json, save_json

#: Vectors that centroids are fitted on, most cells, vectors a cell aims at, rounds of fitting.
SAMPLE, MOST_CELLS, CELL_ROWS, ROUNDS = 20_000, 1024, 2_000, 8
#: Slack for rounding in the bounds; terms of a pushed predicate beyond which a join bounds the rows.
SLACK, TERMS = 1e-6, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without a finite length above zero become NaN."""
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where((size > 0) & np.isfinite(size), x / size, np.nan)


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows by rounds of nearest means; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        moved = unit(sums)
        at = np.where(np.isnan(moved), at, moved)
    return at


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column as float64 rows; null, short or long ones become NaN."""
    rows = column.to_pylist()
    out = np.full((len(rows), dim), np.nan)
    for k, v in enumerate(rows):
        if v is not None and len(v) == dim:
            out[k] = [np.nan if x is None else x for x in v]
    return out


def _dense(column, dim: int) -> np.ndarray:
    """_matrix, at once where every vector is whole."""
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) == dim * len(column) and all(n == dim for n in column.value_lengths().unique().to_pylist()):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return _matrix(column, dim)


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> dict:
    """Index vectors(chunk_id, embedding, ...) under path; returns what is known of the cells.

    cells: their number; by default one for each CELL_ROWS vectors, MOST_CELLS at most.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    part = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.col("chunk_id").cast("string")), "chunk_id").limit(SAMPLE).select("embedding")
    raw = [r[0] for r in part.collect()]
    dim = max((len(v) for v in raw), default=0)
    whole = [[np.nan if x is None else x for x in v] for v in raw if len(v) == dim]
    sample = unit(np.array(whole, float).reshape(len(whole), dim))
    sample = sample[~np.isnan(sample).any(1)]
    wanted = cells or int(np.clip(np.ceil(n / CELL_ROWS), 1, MOST_CELLS))
    centroids = fit_centroids(sample, wanted) if len(sample) else np.empty((0, dim))

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            x = unit(_dense(b.column("embedding"), dim)) if dim else np.full((b.num_rows, 1), np.nan)
            bad = np.isnan(x).any(1)
            if len(centroids):
                own = np.where(bad, 0, (np.nan_to_num(x) @ centroids.T).argmax(1))
                far = np.sqrt(((x - centroids[own]) ** 2).sum(1))
            else:
                own, far, bad = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            columns = [*b.columns, pa.array(np.where(bad, -1, own), pa.int32()), pa.array(np.where(bad, 0.0, far))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "cell", "far"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInArrow(assign, f"{schema}, cell int, far double")
    # A large cell is cut into several files, each sorted over its whole range of `far`.
    placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "far").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stats = spark.read.schema(placed.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("rows"), F.min("far").alias("near"), F.max("far").alias("far")).where("cell >= 0").collect()
    known = {"dim": dim, "schema": placed.schema.json(), "centroids": centroids.tolist(), "cells": {str(r["cell"]): [r["rows"], r["near"], r["far"]] for r in stats}}
    return save_json(spark, f"{path}/cells.json", known)


@dataclass
class Found:
    """Ranked rows; the vectors that could not be ruled out (of both passes); how many are indexed."""

    rows: DataFrame
    candidates: DataFrame
    indexed: int


class Cells:
    """An index opened for search."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        from pyspark.sql.types import StructType

        known = load_json(spark, f"{path}/cells.json")
        if known is None:
            raise LookupError(f"no vector cells at {path}")
        self.dim, self.centroids = known["dim"], np.array(known["centroids"], float).reshape(len(known["centroids"]), known["dim"])
        self.cells = {int(c): tuple(v) for c, v in known["cells"].items()}
        self.vectors = spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{path}/vectors")

    def _scored(self, rows: DataFrame, asked: dict[int, np.ndarray], bounds: dict[tuple[int, int], tuple[float, float]]) -> DataFrame:
        """topic_id, chunk_id, cosine of the rows that each topic's bounds of (topic, cell) admit."""
        dim, limits = self.dim, {}
        for t in asked:
            limits[t] = np.tile((np.inf, -np.inf), (len(self.centroids) + 1, 1))  # the last row is cell -1
            for c in self.cells:
                limits[t][c] = bounds.get((t, c), limits[t][c])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
                x = unit(_dense(b.column("embedding"), dim))
                for topic, q in asked.items():
                    at = np.flatnonzero((far >= limits[topic][cell, 0]) & (far <= limits[topic][cell, 1]))
                    if len(at):
                        cos = (x[at] * q).sum(1)  # row by row, so equal vectors tie exactly
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), topic, np.int32)), b.column("chunk_id").take(pa.array(at)), pa.array(cos)], ["topic_id", "chunk_id", "cosine"])

        kind = rows.schema["chunk_id"].dataType.simpleString()
        return rows.select("chunk_id", "embedding", "cell", "far").mapInArrow(run, f"topic_id int, chunk_id {kind}, cosine double")

    def _within(self, bounds: dict) -> Column:
        """Predicate on cell and far that reaches the scan: folders, and row groups by their statistics."""
        merged: dict[int, list[float]] = {}
        for (_, c), (lo, hi) in bounds.items():
            m = merged.setdefault(c, [lo, hi])
            m[0], m[1] = min(m[0], lo), max(m[1], hi)
        if not merged:
            return F.lit(False)
        inside = F.col("cell").isin(sorted(merged))
        if len(merged) <= TERMS:
            each = [(F.col("cell") == c) & F.col("far").between(lo, hi) for c, (lo, hi) in sorted(merged.items())]
            return inside & reduce(lambda a, b: a | b, each)
        return inside

    def search(self, queries: DataFrame, k: int, filter=None) -> Found:
        """The k nearest vectors of each of queries(topic_id, query): topic_id, chunk_id, cosine, rank."""
        asked = {r["topic_id"]: unit(np.array([r["query"]], float))[0] for r in queries.collect() if r["query"] is not None and len(r["query"]) == self.dim}
        asked = {t: q for t, q in asked.items() if not np.isnan(q).any()}
        rows = self.vectors.where(compile_filter(filter, self.vectors))
        from_centroid = {t: np.sqrt(np.maximum(0, ((self.centroids - q) ** 2).sum(1))) for t, q in asked.items()}
        order = {t: sorted(self.cells, key=lambda c: d[c]) for t, d in from_centroid.items()}
        every = (0.0 - SLACK, np.inf)
        radius, probed, width = {t: np.inf for t in asked}, {}, 1
        # Widen the probe until k rows are there or no cell is left (a filter may admit few).
        while open_ := [t for t in asked if np.isinf(radius[t]) and len(probed.get(t, ())) < len(self.cells)]:
            for t in open_:
                probed[t] = order[t][:width]
            bounds = {(t, c): every for t in open_ for c in probed[t]}
            best = rank_topk(self._scored(rows.where(self._within(bounds)), asked, bounds), "cosine", k)
            for r in best.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect():
                if r["n"] >= k:
                    radius[r["topic_id"]] = float(np.sqrt(max(0.0, 2 - 2 * r["least"])))
            width *= 4
        bounds = {}
        for t, d in from_centroid.items():
            for c, (_, near, far) in self.cells.items():
                lo, hi = d[c] - radius[t] - SLACK, d[c] + radius[t] + SLACK
                if lo <= far and hi >= near:
                    bounds[t, c] = float(lo), float(hi)
        read = bounds | {(t, c): every for t, cs in probed.items() for c in cs}
        scored = self._scored(rows.where(self._within(bounds)), asked, bounds)
        return Found(rank_topk(scored, "cosine", k), self.vectors.where(self._within(read)), sum(v[0] for v in self.cells.values()))
