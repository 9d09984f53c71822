"""Near copies by shingle similarity: long SimHash prints find pairs, shingle sets decide them.

Copies whose sets of word shingles agree by 0.8 differ in about 15 of 100 SimHash bits: far more
than the few bits within which the vantage-point forest of simhash_vptree prunes. Here a text has
a print of WORDS * 64 bits over its distinct shingles, and each tree has a vantage point of its own,
a print drawn from the table. A level measures the distance from it in a window of one bit; by the
triangle inequality the difference of two prints' distances there is a lower bound of their
distance in the window, and the bounds of a path add up, as windows do not overlap. A print lives
in the shard of its own distances and visits every boundary shard whose summed bound is at most 1;
of two such shards only the print with the smaller distance visits the other, so each pair meets
once a tree. Levels follow from the number of distinct prints, so that about LEAF of them live in a
shard at any size, and trees from the levels, so that a pair of similarity SIMILARITY meets in
some tree with probability 1 - MISS (one of 0.9 with 0.9999).

Inside a shard, pairs of a resident and any other within REACH of the first 128 bits are candidates; links that
span them go on. First come hubs: in the home shards of HUB_TREES trees (cut into parts of about SPLIT rows) a row
with DENSE candidates or more links to the one that has most. What these links connect is a cluster. Then all shards
pass on a spanning forest of the candidates of different clusters, closest pairs first. So a group of m near copies
makes about HUB_TREES * m links, however many shards its members share. A shard beyond SPLIT rows is dealt out to
pairs of parts, so no task holds more than two; parts of one cluster are not dealt to each other. Each link is then
decided by the exact Jaccard similarity of the two whole texts' shingle sets (64-bit hashes of shingles).

Links that fail that test may have stood in for a pair that meets it. Such a pair joins
two groups, and each of them has a rejected link that leaves it. So the members of those groups
are dealt to their shards once more, those within REACH of another group with their shingle sets,
and there every pair of different groups is decided exactly before it may join them. What is
found therefore does not depend on which links stood in. Members of one group are not compared there.

A print is in 1 + levels / 2 shards a tree (33 bytes each; 42 in all at 10**5 prints, 319 at 10**8).
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import connected_components, deal, durable, forest, hot_keys, joined_hot, runs, sampled
from fascicle.llm.simhash_vptree import shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 9
#: Prints that live in a shard on average, and the chance to miss a pair at the similarity.
LEAF, MISS = 128, 0.005
#: Share of bits in which prints of texts at the similarity differ.
DIFFER = 0.1515
#: Bits of the first 128 in which a candidate pair may differ (0.8: 19.4 on average, deviation 4.1).
REACH = 32
SPLIT = 2048
#: Trees whose home shards give hubs, and candidates in a shard from which a row links to its hub.
HUB_TREES, DENSE = 4, 32
SEED = 5
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shape(rows: int) -> tuple[int, int]:
    """(levels, trees) for so many distinct prints."""
    levels = max(8, ceil(log2(max(rows, 1) / LEAF)))
    # A pair meets in a tree if it differs in none of the levels' bits, or in one.
    meet = (1 - DIFFER) ** levels + levels * DIFFER * (1 - DIFFER) ** (levels - 1)
    return levels, ceil(log(MISS) / log(1 - meet))


def tree_bits(levels: int, trees: int) -> np.ndarray:
    """(trees, levels) numbers of the print's bits; trees share bits only where there are not enough."""
    rng, n, out = np.random.default_rng(SEED), WORDS * 64, []
    while len(out) < trees:
        out.extend(rng.permutation(n)[: n // levels * levels].reshape(-1, levels))
    return np.array(out[:trees])


def long_print(raw: bytes, size: int = SHINGLE) -> bytes:
    """SimHash of WORDS * 64 bits over the distinct shingles; zero where there is no word."""
    h = np.unique(shingle_hashes(raw, size))
    counts = np.zeros(WORDS * 64, np.int64)
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(h), 4096):
        x = h[k : k + 4096, None] + steps
        for c, shift in zip(MIX, (30, 27)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(c)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def shingle_set(raw: bytes, size: int = SHINGLE) -> bytes:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(shingle_hashes(raw, size)).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Of two shingle sets; 0 where one is empty."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def _of_text(text: Column, f, size: int) -> Column:
    @F.arrow_udf("binary")
    def of(a: pa.Array) -> pa.Array:
        parts = (a.slice(k, 256).cast(pa.binary()).to_pylist() for k in range(0, len(a), 256))
        return pa.array((f(x or b"", size) for part in parts for x in part), pa.binary())

    return of(text)


def _similarity(a: str, b: str) -> Column:
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([jaccard(s.as_buffer(), t.as_buffer()) for s, t in zip(x, y)], pa.float64())

    return of(a, b)


def vantage_points(prints: DataFrame, trees: int) -> list[bytes]:
    """A print of prints(sig, node) for each tree (again from the first where there are not enough)."""
    drawn = [bytes(r["sig"]) for r in prints.select("sig", "node").orderBy("node").limit(trees).collect()]
    return [drawn[k % len(drawn)] for k in range(trees)] if drawn else [bytes(WORDS * 8)] * trees


def tree_shards(bits: np.ndarray, vantage: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard that each print lives in (first) or visits in one tree.

    bits, vantage: bits of the prints and of the tree's vantage point at the tree's levels.
    """
    levels = bits.shape[1]
    distance, weights = (bits ^ vantage).astype(np.int64), 1 << np.arange(levels, dtype=np.int64)
    home = distance @ weights + (tree << levels)
    # One window may differ by one bit and the others by none: the nearer side visits the farther one.
    row, level = np.nonzero(distance == 0)
    return np.concatenate((np.arange(len(bits)), row)), np.concatenate((home, home[row] + weights[level]))


def _replicate(levels: int, trees: int, vantage: list[bytes], most: int | None = None):
    """most: where given, only the home shards of so many trees."""

    def run(batches):
        pick = tree_bits(levels, trees)
        points = np.unpackbits(np.frombuffer(b"".join(vantage), np.uint8).reshape(-1, WORDS * 8), axis=1, bitorder="little")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, WORDS * 8)
                bits = np.unpackbits(sig, axis=1, bitorder="little")
                first = np.ascontiguousarray(sig[:, :16]).view("<i8")
                more = [n for n in b.schema.names if n not in ("sig", "node")]
                for tree, p in enumerate(pick[:most]):
                    row, shard = tree_shards(bits[:, p], points[tree, p], tree)
                    row, shard = (row, shard) if most is None else (row[: len(sig)], shard[: len(sig)])
                    home, take = np.arange(len(row)) < len(sig), pa.array(row)
                    out = [pa.array(shard), part.column("node").take(take), pa.array(first[row, 0]), pa.array(first[row, 1]), pa.array(home)]
                    yield pa.RecordBatch.from_arrays(out + [part.column(n).take(take) for n in more], ["shard", "node", "p0", "p1", "home", *more])

    return run


def close_pairs(p0: np.ndarray, p1: np.ndarray, cuts: np.ndarray, part: np.ndarray, cross: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits) of all pairs within REACH of rows of one run (from cut to cut), of different parts where cross.

    home: where given, one of a pair is a resident; residents come first in each run.
    """
    end = np.repeat(cuts[1:], np.diff(cuts))
    out, k, i = [], 1, np.arange(len(p0)) if home is None else np.flatnonzero(home)
    while len(i := i[i + k < end[i]]):
        d = np.bitwise_count(p0[i] ^ p0[i + k]) + np.bitwise_count(p1[i] ^ p1[i + k])
        near = np.flatnonzero((d <= REACH) & ~(cross[i] & (part[i] == part[i + k])))
        if len(near):
            out.append((i[near], i[near] + k, d[near]))
        k += 1
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _pairs(batches):
    """(table, cuts, i, j, bits) of sorted rows, whole shards (or pairs of parts) at a time."""
    for t, cuts in runs(batches, ["shard", "i", "j"]):
        p0, p1 = (t.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1"))
        part, a, b, home = (t.column(c).to_numpy() for c in ("part", "i", "j", "home"))
        yield t, cuts, *close_pairs(p0, p1, cuts, part, a != b, home)


def _walk(batches):
    """A spanning forest of the candidates of each shard that are of different roots, closest pairs first."""
    for t, cuts, i, j, bits in _pairs(batches):
        root = t.column("root").to_numpy()
        apart = root[i] != root[j]
        i, j, bits = i[apart], j[apart], bits[apart]
        order = np.argsort(bits, kind="stable")
        i, j = i[order], j[order]
        # Rows of one root in one shard are one end of links.
        run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        by = np.lexsort((root, run))
        new = np.concatenate(([False], (np.diff(run[by]) != 0) | (np.diff(root[by]) != 0)))
        end = np.empty(len(by), np.int64)
        end[by] = np.cumsum(new)
        k = forest(end[i], end[j], t.num_rows)
        if len(k):
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i[k])), node.take(pa.array(j[k]))], ["a", "b"])


def hubs(p0: np.ndarray, p1: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hub): of each row with DENSE others within REACH, the one that has most (the larger node of equals)."""
    near = lambda at: np.bitwise_count(p0[at : at + 256, None] ^ p0) + np.bitwise_count(p1[at : at + 256, None] ^ p1) <= REACH
    blocks = range(0, len(node), 256)
    degree = np.concatenate([near(at).sum(1) - 1 for at in blocks])
    if degree.max() < DENSE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.empty(len(node), np.int64)
    rank[np.lexsort((node, degree))] = np.arange(len(node))
    # A row is near itself, so the row of the highest rank is its own hub and gives no link.
    hub = np.concatenate([np.where(near(at), rank, -1).argmax(1) for at in blocks])
    row = np.flatnonzero((degree >= DENSE) & (hub != np.arange(len(node))))
    return row, hub[row]


def _hubs(batches):
    """Links of rows to their hubs; rows come sorted by shard and part."""
    for t, cuts in runs(batches, ["shard", "part"]):
        p0, p1 = (t.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1"))
        node = t.column("node").to_numpy()
        some = [(lo, *hubs(p0[lo:hi], p1[lo:hi], node[lo:hi])) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if hi - lo > DENSE]
        if some:
            a, b = (np.concatenate([x[0] + x[k] for x in some]) for k in (1, 2))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _contested(batches):
    """Rows within REACH of a row of another group in their shard."""
    for t, _, i, j, _ in _pairs(batches):
        root, hit = t.column("root").to_numpy(), np.zeros(t.num_rows, bool)
        other = root[i] != root[j]
        hit[i[other]] = hit[j[other]] = True
        if hit.any():
            yield from t.select(["shard", "i", "j", "node", "root"]).take(pa.array(np.flatnonzero(hit))).combine_chunks().to_batches()


def joining(sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that span all pairs of similar sets of different groups, each decided exactly.

    A row's common shingles with all later rows are counted at once: shingles that many rows hold by
    products of a matrix, the others from the rows of each shingle. The rows of the largest group come
    last and are never counted from.
    """
    largest = group == np.bincount(group).argmax()
    order, n_from = np.argsort(largest, kind="stable"), int((~largest).sum())
    sets, group = [sets[k] for k in order], group[order]
    parent = list(range(int(group.max()) + 1))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n, size = len(sets), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.bincount(code)
    common = np.zeros((n_from, n), np.float32)
    number = np.cumsum(held * 16 > n) - 1
    wide, step = (held * 16 > n)[code], max(1, (1 << 22) // n)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        some = np.flatnonzero(wide & (number[code] >= lo) & (number[code] < lo + step))
        m = np.zeros((n, step), np.float32)
        m[row[some], number[code[some]] - lo] = 1
        common += m[:n_from] @ m.T
    # Rows of a shingle ascend, and the rows before i have been passed: `first` is where the others begin.
    row, code = row[~wide], code[~wide]
    holders = row[np.argsort(code, kind="stable")]
    end = np.cumsum(np.bincount(code, minlength=len(held)))
    at, parts, out = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), len(set(group.tolist())), []
    first = np.concatenate(([0], end[:-1])) if len(end) else end
    for i in range(n_from):
        own = code[at[i] : at[i + 1]]
        first[own] += 1
        left = end[own] - first[own]
        where = np.repeat(first[own] - np.concatenate(([0], np.cumsum(left)[:-1]))[: len(own)], left) + np.arange(left.sum())
        both = common[i, i + 1 :] + np.bincount(holders[where], minlength=n)[i + 1 :]
        for j in (i + 1 + np.flatnonzero((both > 0) & (both / np.maximum(size[i] + size[i + 1 :] - both, 1) >= SIMILARITY))).tolist():
            x, y = root(int(group[i])), root(int(group[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(order[i]), int(order[j])))
                parts -= 1
        if parts == 1:
            break
    return out


def _join_groups(batches):
    """Links of roots; rows come sorted by shard and parts with their shingle sets."""
    for t, cuts in runs(batches, ["shard", "i", "j"]):
        roots, out = t.column("root").combine_chunks(), []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            group = roots.slice(lo, hi - lo).dictionary_encode().indices.to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s").slice(lo, hi - lo)]
            out.extend((i + lo, j + lo) for i, j in joining(sets, group))
        if out:
            a, b = (roots.take(pa.array(x)) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


PLACED = "shard long, node long, p0 long, p1 long, home boolean"


def _hub_links(prints: DataFrame, levels: int, trees: int, vantage: list[bytes], split: int) -> DataFrame:
    """Links (a, b) of prints(sig, node) to their hubs; a shard beyond split rows is cut into parts, anew in each tree."""
    make = _replicate(levels, trees, vantage, HUB_TREES)
    rows, hot = prints.mapInArrow(make, PLACED), hot_keys(sampled(prints, "node").mapInArrow(make, PLACED), split, "shard")
    rows = joined_hot(rows, hot, hot.count(), "shard")
    part = F.pmod(F.xxhash64("node", "shard"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.select("shard", part.alias("part"), "node", "p0", "p1").repartition("shard", "part").sortWithinPartitions("shard", "part")
    return rows.mapInArrow(_hubs, "a long, b long")


def _dealt(prints: DataFrame, levels: int, trees: int, vantage: list[bytes], split: int) -> DataFrame:
    """prints(sig, node, root) in their shards, sorted by shard and parts, residents first."""
    make, schema = _replicate(levels, trees, vantage), f"{PLACED}, root long"
    rows = deal(prints.mapInArrow(make, schema), sampled(prints, "node").mapInArrow(make, schema).select("shard", "root"), "shard", "node", split, "root")
    return rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", F.desc("home"))


def _rejoined(prints: DataFrame, judged: DataFrame, sets: DataFrame, roots: DataFrame, shards) -> DataFrame:
    """roots of all nodes in judged(a, b, same), where similar pairs that other links hid are joined too."""
    nodes = durable(sets.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = judged.where("not same").join(end("a"), "a").join(end("b"), "b").where("ra <> rb")
    apart = durable(apart.select(F.explode(F.array("ra", "rb")).alias("root")).distinct())
    rows = prints.join(nodes.join(apart, "root", "left_semi"), "node").select("sig", "node", "root")
    near = shards(rows).mapInArrow(_contested, "shard long, i int, j int, node long, root long").join(sets, "node").select("shard", "i", "j", "root", "s")
    links = near.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(_join_groups, "a long, b long")
    merged = connected_components(durable(links.distinct())).select(F.col("id").alias("root"), F.col("root").alias("__root"))
    return durable(nodes.join(merged, "root", "left").select("node", F.coalesce("__root", "root").alias("root")))


def _identity(text: str, key: str) -> dict[str, Column]:
    """128 bits of a row's key and text, so that rows that share a key, or have none, stay apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"r0": F.xxhash64(F.col(key), t), "r1": F.xxhash64(F.lit(17), F.col(key), t)}


def similar_roots(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id", split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(prints, roots): node, sig and the first row (keyless, key, r0, r1) of each distinct print; node and root of
    each node with a candidate. Rows with a key come before rows without one, smaller keys first.
    """
    rows = docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in _identity(text, key).items()), F.col(text).alias("text"))
    first = F.min(F.struct(F.col("key").isNull().alias("keyless"), "key", "r0", "r1"))
    prints = rows.select("key", "r0", "r1", _of_text(F.col("text"), long_print, size).alias("sig")).groupBy("sig").agg(first.alias("first"))
    prints = durable(prints.withColumn("node", F.xxhash64("sig")))
    levels, trees = shape(prints.count())
    vantage = vantage_points(prints, trees)
    shards = lambda some: _dealt(some, levels, trees, vantage, split)
    once = lambda some: some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dense = durable(once(_hub_links(prints.select("sig", "node"), levels, trees, vantage, split)))
    clusters = connected_components(dense).withColumnRenamed("id", "node")
    rooted = prints.join(clusters, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    links = durable(once(shards(rooted).mapInArrow(_walk, "a long, b long")).unionByName(dense))
    # Sets are made of one text for each linked print only.
    linked = prints.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    texts = rows.select("r0", "r1", "text").join(linked.select("node", "first.r0", "first.r1"), ["r0", "r1"])
    texts = texts.groupBy("node").agg(F.any_value("text").alias("text"))
    sets = durable(texts.select("node", _of_text(F.col("text"), shingle_set, size).alias("s")))
    judged = links.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    judged = durable(judged.select("a", "b", (_similarity("sa", "sb") >= SIMILARITY).alias("same")))
    roots = connected_components(judged.where("same").select("a", "b")).withColumnRenamed("id", "node")
    return prints, _rejoined(prints, judged, sets, roots, shards)


def keep_first(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id", split: int = SPLIT) -> DataFrame:
    """The columns of docs for one document of each group of near copies: the one with the smallest key.

    Texts without a word (null, empty, blank) are copies of each other. Rows are told apart by key
    and text, so rows that share a key, or have none, are decided by their texts; of rows that
    agree in both one stays. A group without any key keeps one row. An empty table gives no row.
    """
    prints, roots = similar_roots(docs, size, text, key, split)
    heads = prints.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    free = [n for k in range(len(docs.columns) + 2) if (n := f"__r{k}") not in docs.columns][:2]
    heads = heads.select(*(F.col(f"first.r{k}").alias(n) for k, n in enumerate(free)))
    named = docs.withColumns(dict(zip(free, _identity(text, key).values())))
    return named.join(heads, free, "left_semi").dropDuplicates(free).select(*(F.col(f"`{c}`") for c in docs.columns))
