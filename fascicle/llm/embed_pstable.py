"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions (2-stable), shifted, and quantised by
WIDTH; the quantised values of a table's projections together name a bucket.

Scale. Projections and tables follow from the number of distinct vectors (see shape): a bucket
holds about MEET unrelated vectors at any size, and the tables find a pair at the threshold with
probability RECALL. So compared pairs for each vector stay flat as the corpus grows; what grows is
the number of tables, by the corpus to the power 0.27 or so.

Two passes over the same buckets. The first shuffles 128-bit sketches (signs of projections) and
marks vectors with a partner whose sketch is close enough for the threshold; it may mark too many,
and misses a pair with a probability under 1e-6. The second shuffles the marked vectors alone and
compares them exactly in double precision.

Exact copies collapse to one vector first. A hot bucket is dealt out to pairs of parts, so no task
holds more than two parts of a bucket. A pair found in several tables counts in the first only.
Links inside a bucket come back as counts and a spanning forest, never as all pairs.
"""

from __future__ import annotations

from math import ceil, erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import connected_components, deal, durable, forest, runs, sampled

THRESHOLD = 0.9
WIDTH = 2.5
#: Unrelated vectors that a bucket holds besides a vector, and the chance to find a pair at the threshold.
MEET = 256
RECALL = 0.97
SPLIT = 4096
SEED = 20240521
#: Words of 64 bits in a sketch, and deviations by which a pair's sketches may differ beyond the mean.
WORDS = 2
SLACK = 5.0


def same_value(cosine: float, width: float = WIDTH) -> float:
    """Probability that unit vectors of a cosine share one quantised value."""
    r = width / sqrt(2 - 2 * cosine)
    return 1 - erfc(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections a table, tables) for so many distinct vectors."""
    k = max(4, ceil(log(max(rows, MEET) / MEET) / -log(same_value(0.0))))
    return k, ceil(log(1 - RECALL) / log(1 - same_value(min(threshold, 0.999999)) ** k))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hash:
    """Bucket names and sketches of unit vectors of one dimension."""

    def __init__(self, dim: int, projections: int, tables: int):
        rng = np.random.default_rng([SEED, dim])
        self.dim, self.projections, self.tables = dim, projections, tables
        self.planes = rng.standard_normal((dim, 64 * WORDS))
        self.a = rng.standard_normal((dim, tables * projections))
        self.b = rng.uniform(0, WIDTH, tables * projections)

    def buckets(self, x: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
        """(rows, tables) 63-bit names in the tables from first to stop; dimension and table are part of a name."""
        stop = self.tables if stop is None else stop
        n = slice(first * self.projections, stop * self.projections)
        q = np.floor((x @ self.a[:, n] + self.b[n]) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), stop - first, self.projections)
        # The table's salt is spread over all bits first: small numbers alone would meet across tables.
        salt = (np.uint64(self.dim * 4096) + np.arange(first, stop, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h = np.tile(salt ^ (salt >> np.uint64(32)), (len(x), 1))
        for k in range(self.projections):
            h = (h ^ q[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(1)).astype(np.int64)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1, bitorder="little").view("<i8")


def reach(threshold: float) -> int:
    """Bits in which the sketches of a pair at the threshold may differ."""
    p = np.arccos(min(threshold, 1.0)) / np.pi
    n = 64 * WORDS
    return int(np.ceil(n * p + SLACK * np.sqrt(n * p * (1 - p)))) + 1


def _by_dimension(batches, names: list[str]):
    """(the named columns, raw rows, dimension) of the rows of each dimension in a batch, some thousands at a time."""
    for b in batches:
        vec = b.column("embedding")
        lengths = np.diff(vec.offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == dim)
            for at in range(0, len(every), 4096):
                pick = pa.array(every[at : at + 4096])
                flat = vec.take(pick).flatten().to_numpy(zero_copy_only=False)
                yield [b.column(c).take(pick) for c in names], flat.reshape(-1, dim), dim


def _sketches(projections: int, tables: int):
    def run(batches):
        made = {}
        for (node,), x, dim in _by_dimension(batches, ["node"]):
            h = made.setdefault(dim, Hash(dim, projections, tables))
            u = unit(x)
            names, s = h.buckets(u), h.sketch(u)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(names[:, t]), node, *(pa.array(s[:, w]) for w in range(WORDS))], ["bucket", "node", *(f"s{w}" for w in range(WORDS))])

    return run


def _vectors(projections: int, tables: int):
    def run(batches):
        made = {}
        for (node, n), x, dim in _by_dimension(batches, ["node", "n"]):
            names = made.setdefault(dim, Hash(dim, projections, tables)).buckets(unit(x))
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            for t in range(tables):
                cols = [pa.array(names[:, t]), node, n, pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), dim, np.int32)), raw]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "node", "n", "tab", "dim", "raw"])

    return run


def near_sketches(s: np.ndarray, part: np.ndarray, cross: bool, most: int) -> np.ndarray:
    """Rows with another row (of the other part, where cross) within `most` bits."""
    hit = np.zeros(len(s), bool)
    for at in range(0, len(s), 512):
        d = sum(np.bitwise_count(s[at : at + 512, None, w] ^ s[None, :, w]).astype(np.int16) for w in range(s.shape[1]))
        close = d <= most
        if cross:
            close &= part[at : at + 512, None] != part
        else:
            close[np.arange(len(close)), np.arange(at, at + len(close))] = False
        hit[at : at + 512] |= close.any(1)
    return np.flatnonzero(hit)


def _mark(most: int):
    def run(batches):
        for t, cuts in runs(batches, ["bucket", "i", "j"]):
            s = np.stack([t.column(f"s{w}").to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
            part, i, j = (t.column(c).to_numpy() for c in ("part", "i", "j"))
            found = [near_sketches(s[a:b], part[a:b], i[a] != j[a], most) + a for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
            found = np.concatenate(found) if found else np.empty(0, np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(t.column("node").to_numpy()[found]))], ["node"])

    return run


#: Earlier tables whose names are compared at a time.
STEP = 4


def unmet(h: Hash, x: np.ndarray, tab: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows that share no bucket of a table before `tab`."""
    for first in range(0, tab, STEP):
        if not len(i):
            break
        used = np.zeros(len(x), bool)
        used[i] = used[j] = True
        at = np.cumsum(used) - 1
        names = h.buckets(x[used], first, min(first + STEP, tab))
        new = np.ones(len(i), bool)
        for k in range(0, len(i), 65536):
            new[k : k + 65536] = ~(names[at[i[k : k + 65536]]] == names[at[j[k : k + 65536]]]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def met(h: Hash, x: np.ndarray, tab: int) -> np.ndarray:
    """Whether a row is in the largest group of rows that share a bucket of one of the first tables before `tab`."""
    core = np.zeros(len(x), bool)
    if tab and len(x) >= 64:
        names = h.buckets(x, 0, min(STEP, tab))
        for t in range(names.shape[1]):
            value, count = np.unique(names[:, t], return_counts=True)
            if count.max() > core.sum():
                core = names[:, t] == value[count.argmax()]
    return core


def bucket_links(x, node, n, part, h: Hash | None, tab: int, cross: bool, threshold: float):
    """(nodes, their link counts, link ends a, link ends b) of one bucket, or of a pair of its parts.

    Pairs that share a bucket of a table before `tab` are left to that one; a large group of them
    is not even multiplied, so a dense group costs its square once and not once a table.
    """
    links, ii, jj, core = np.zeros(len(x), np.int64), [], [], met(h, x, tab)
    own = np.flatnonzero(~core)
    for at in range(0, len(own), 512):
        rows = own[at : at + 512]
        i, j = np.nonzero(x[rows] @ x.T >= threshold)
        i = rows[i]
        keep = (i < j) | core[j]
        if cross:
            keep &= part[i] != part[j]
        i, j = unmet(h, x, tab, i[keep], j[keep])
        if len(i):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            k = forest(i, j, len(x))
            ii.append(i[k])
            jj.append(j[k])
    some = np.flatnonzero(links)
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (ii, jj))
    k = forest(a, b, len(x))
    return node[some], links[some], node[a[k]], node[b[k]]


def _compare(projections: int, tables: int, threshold: float, kind):
    def run(batches):
        made = {}
        for t, cuts in runs(batches, ["bucket", "tab", "dim", "i", "j"]):
            node, n, part, tab, dim, i, j = (t.column(c).to_numpy() for c in ("node", "n", "part", "tab", "dim", "i", "j"))
            raw = t.column("raw").combine_chunks()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                d = int(dim[a])
                h = made.setdefault(d, Hash(d, projections, tables))
                x = unit(np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), kind).reshape(b - a, d))
                some, count, u, v = bucket_links(x, node[a:b], n[a:b], part[a:b], h, int(tab[a]), i[a] != j[a], threshold)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(count)], ["a", "b", "links"])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["a", "b", "links"])

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, split: int = SPLIT) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding).

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing
    and is kept. Vectors of different lengths never link. Repeated rows count as copies of each
    other. Vectors are what links; ids only name components, so different vectors under one id
    have their own links (and may lie in components of one name). A row with a null id links like any
    other and is kept; a component without any id is null. An empty table gives no row. Other
    columns are not read.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    e = F.col("embedding")
    good = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", good.alias("good"), F.xxhash64(e).alias("k1"), F.xxhash64(F.lit(17), e).alias("k2"))
    rows = rows.withColumn("k1", F.when(F.col("good"), F.col("k1"))).withColumn("k2", F.when(F.col("good"), F.col("k2")))
    kinds = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    # Each distinct vector has a number of its own, fixed by the cut.
    kinds = durable(kinds.withColumn("node", F.monotonically_increasing_id()))
    k, tables = shape(kinds.count(), threshold)

    def dealt(rows, make, schema):
        made = rows.mapInArrow(make, schema)
        return deal(made, sampled(rows, "node").mapInArrow(make, schema).select("bucket"), "bucket", "node", split)

    sketched = dealt(kinds.select("node", "embedding"), _sketches(k, tables), "bucket long, node long, " + ", ".join(f"s{w} long" for w in range(WORDS)))
    marked = sketched.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_mark(reach(threshold)), "node long")
    marked = durable(marked.distinct())
    near = durable(kinds.join(marked, "node", "left_semi").select("node", "n", "embedding"))
    found = dealt(near, _vectors(k, tables), "bucket long, node long, n long, tab int, dim int, raw binary")
    found = found.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "tab", "dim", "i", "j")
    found = durable(found.mapInArrow(_compare(k, tables, threshold, np.float32 if single else np.float64), "a long, b long, links long"))
    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("id").alias("node"), "root")
    # Cut here, so that the join below has plain shuffles: one component may hold a third of all vectors.
    names = durable(roots.join(kinds.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("name")))
    named = kinds.select("k1", "k2", "node", "first", "n").join(links, "node", "left").join(roots, "node", "left").join(names, "root", "left")
    component = F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("first"))
    named = named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"))
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
