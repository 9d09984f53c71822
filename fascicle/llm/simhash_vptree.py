"""SimHash near-duplicates, joined exactly by a forest of vantage-point trees.

Fingerprint: 64 bits over word shingles hashed by XXH64 (seed 42).

Join. Two fingerprints within RADIUS bits differ in at most RADIUS // 3 bits of one of three
fixed slices of the fingerprint (pigeonhole). Each slice has a vantage-point tree. A node looks at
a window of two bits of its own and measures the Hamming distances from two vantage points there,
which branch into one child for each pair of distances. By the triangle inequality the largest
difference of the distances to one vantage point is a lower bound of two fingerprints' distance on
the window, and as windows do not overlap, the bounds of a path add up to a lower bound of their
distance on the slice. A fingerprint lives in the shard (leaf) of its own distances and must visit
only leaves whose summed bound is within the slice's radius; every other branch is pruned. Of two
such leaves only the one with smaller distances visits the other, so that each pair meets once a
tree. Inside a shard, pairs are checked exactly on all 64 bits.

As windows hold two bits and vantage points are fixed, a leaf is in effect the slice's bits and a
visit goes to a leaf one bit away: vantage points drawn from the fingerprints, with median splits,
would compare and hold far more (figures in the README).

Scale. Trees grow with the corpus: a leaf holds about LEAF fingerprints until the slice's bits are
used up (2**21 leaves a tree), so compared pairs for each fingerprint stay flat up to 3.4 * 10**7 of
them and grow in proportion beyond (477 a leaf at 10**9). A fingerprint is in 3 to 35 shards. Exact copies collapse to one fingerprint before the join. A shard
beyond SPLIT is dealt out to pairs of parts, so no task holds more than two parts however skewed
the fingerprints are. A shard returns a spanning forest of its links, so large groups of near
copies cost no quadratic output. Components come from distributed star contraction; nothing that
grows with the corpus reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import connected_components, deal, durable, forest, runs, sampled

SHINGLE = 4
RADIUS = 4
SLICES = ((0, 21), (21, 21), (42, 22))
#: Most bits of a slice that a tree uses.
DEPTH = 21
#: Fingerprints that a leaf holds on average, and beyond how many a shard is split.
LEAF = 16
SPLIT = 4096
#: First vantage points of the windows, read bit by bit along each slice; the second differs in the window's first bit.
VANTAGE = 0x9E3779B97F4A7C15
BLOCK = 512


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of UTF-8 bytes, repeats included; empty where there is no word.

    Words are runs of anything but ASCII white space; A-Z count as a-z. Fewer words than a
    shingle holds make one shingle.
    """
    from functools import partial

    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    digest, text = partial(xxh64_intdigest, seed=42), b" ".join(words)
    if len(words) <= size:
        return np.array([digest(text)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    return np.fromiter((digest(text[a:b]) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def simhash(raw: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes; 0 where there is no word. Repeated shingles count each time."""
    h = shingle_hashes(raw, size)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        counts += np.unpackbits(h[k : k + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprint column; null texts count as empty."""

    @F.arrow_udf("long")
    def of(a: pa.Array) -> pa.Array:
        return pa.array([simhash(x or b"", size) for x in a.cast(pa.binary()).to_pylist()], pa.int64())

    return of(text)


def depth(rows: int) -> int:
    """Bits of a slice that a tree uses for so many fingerprints."""
    return int(min(DEPTH, max(2, np.ceil(np.log2(max(rows, 1) / LEAF)))))


def branch(fp: np.ndarray, at: int, bits: int) -> np.ndarray:
    """The child (0 to 3) of each fingerprint at the node that looks at `bits` bits from `at`.

    Children are numbered by the distances (d, e) from the two vantage points: (0, 1), (1, 0), (1, 2) and (2, 1);
    a window of one bit has (0, 1) and (1, 0).
    """
    mask = np.uint64(((1 << bits) - 1) << at)
    first = np.uint64(VANTAGE)
    d = np.bitwise_count((fp ^ first) & mask).astype(np.int64)
    e = np.bitwise_count((fp ^ first ^ np.uint64(1 << at)) & mask).astype(np.int64)
    return d + (e == 2) + (d == 2)


#: Distances (d, e) of each child, and for each the larger children whose triangle bound is 1.
CHILDREN = ((0, 1), (1, 0), (1, 2), (2, 1))
NEXT = tuple(tuple(k for k in range(c + 1, 4) if max(abs(x - y) for x, y in zip(CHILDREN[c], CHILDREN[k])) == 1) for c in range(4))


def tree_shards(fp: np.ndarray, tree: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard that each fingerprint lives in or visits in one tree."""
    if RADIUS // len(SLICES) != 1:
        raise ValueError("trees are built for a slice radius of 1")
    start, home, levels = SLICES[tree][0], np.full(len(fp), tree, np.int64), []
    for at in range(start, start + bits, 2):
        width = min(2, start + bits - at)
        child = branch(fp, at, width)
        levels.append((child, 1 << width))
        home = home * 4 + child
    rows, shards, weight = [np.arange(len(fp))], [home], 1
    for child, n in reversed(levels):
        # One window may differ by one bit and the others by none.
        for c in range(n):
            own = np.flatnonzero(child == c)
            for k in NEXT[c]:
                if k < n:
                    rows.append(own)
                    shards.append(home[own] + (k - c) * weight)
        weight *= 4
    return np.concatenate(rows), np.concatenate(shards)


def _replicate(bits: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                fp = b.column("fp").slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                for tree, _ in enumerate(SLICES):
                    rows, shards = tree_shards(fp, tree, bits)
                    home = np.arange(len(rows)) < len(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fp[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return run


def shard_links(fp: np.ndarray, home: np.ndarray, part: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that span all pairs within radius of a resident and any other of a shard.

    part: where given, pairs of different parts only. Every pair is looked at, a block of residents at a time.
    """
    own, ii, jj = np.flatnonzero(home), [], []
    for at in range(0, len(own), BLOCK):
        rows = own[at : at + BLOCK]
        close = np.bitwise_count(fp[rows][:, None] ^ fp) <= radius
        close &= ~home | (rows[:, None] < np.arange(len(fp)))  # two residents meet once
        if part is not None:
            close &= part[rows][:, None] != part
        i, j = np.nonzero(close)
        if len(i):
            k = forest(rows[i], j, len(fp))
            ii.append(rows[i][k])
            jj.append(j[k])
    if not ii:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    i, j = np.concatenate(ii), np.concatenate(jj)
    k = forest(i, j, len(fp))
    return fp[i[k]], fp[j[k]]


def _walk(batches):
    """Rows come sorted by shard and parts; a run of equal ones is in memory at a time."""
    for t, cuts in runs(batches, ["shard", "i", "j"]):
        fp = t.column("fp").to_numpy().view(np.uint64)
        home, part, i, j = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "part", "i", "j"))
        some = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
        out = [shard_links(fp[a:b], home[a:b], part[a:b] if i[a] != j[a] else None) for a, b in some]
        out = [x for x in out if len(x[0])]
        if out:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def fingerprint_links(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints within RADIUS bits.

    prints: one row a fingerprint (fp long); they are counted first.
    """
    prints = prints.select("fp")
    make, schema = _replicate(depth(prints.count())), "shard long, fp long, home boolean"
    sample = sampled(prints, "fp").mapInArrow(make, schema).select("shard")
    shards = deal(prints.mapInArrow(make, schema), sample, "shard", "fp", split)
    return shards.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(_walk, "a long, b long")


def simhash_groups(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' key with fp (long), fingerprint (16 hex digits) and component_id.

    One row for each row of docs. Null and empty texts have fingerprint 0 and link like any other;
    repeated rows share a fingerprint and so a component; the smallest key of a component names it
    (null keys are ignored there). An empty table gives no row. Texts of any length are hashed
    whole. Further columns of docs are not read.
    """
    own = docs.select(F.col(key).alias("__key"), fingerprint(F.col(text), size).alias("fp"))
    own = durable(own)
    prints = durable(own.groupBy("fp").agg(F.min("__key").alias("first")))
    roots = connected_components(fingerprint_links(prints))
    # Prints without a link are their own component and need no row of the map.
    linked = prints.join(roots.withColumnRenamed("id", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    named = prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # Cut here, so that the join below has plain shuffles on both sides: one print may hold a third
    # of all documents, and adaptive execution splits only such joins.
    named = durable(named)
    return own.join(named, "fp", "left").select(
        F.col("__key").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
