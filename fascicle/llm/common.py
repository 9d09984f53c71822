"""Helpers that the corpus operators share: durable cuts, per-process caches, components."""

from __future__ import annotations

import sys
import tempfile
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def per_process(key, build):
    """build() once for each Python process, however many tasks it serves."""
    store = sys.modules.setdefault("_fascicle_process_cache", ModuleType("_fascicle_process_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


#: Folders that stand in for a shared one, by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session without it (tests, a laptop) gets a temporary folder; on a cluster its absence
    is an error, as files in a machine's own folder would be lost to the others.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="fascicle-")
    return _FOLDERS[sc.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: One of so many members of a sample tells which keys are hot; lists of hot keys up to BROADCAST_ROWS are broadcast.
SAMPLE_RATE = 32
BROADCAST_ROWS = 50_000


def sampled(rows: DataFrame, member: str) -> DataFrame:
    """Rows of about one member in SAMPLE_RATE, chosen by a hash of the member."""
    return rows.where(F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.lit(SAMPLE_RATE)) == 0)


def hot_keys(sample: DataFrame, split: int, *key: str) -> DataFrame:
    """(key..., parts) of keys that hold more than `split` rows by their sampled() members; about `split` of them a part."""
    n = F.col("count") * SAMPLE_RATE
    return durable(sample.groupBy(*key).count().where(n > split).select(*key, F.ceil(n / split).cast("int").alias("parts")))


def joined_hot(rows: DataFrame, hot: DataFrame, n_hot: int, *key: str) -> DataFrame:
    return rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, list(key), "left")


def deal(rows: DataFrame, sample: DataFrame, key: str, member: str, split: int, group: str | None = None) -> DataFrame:
    """rows with part, i and j: members of a key beyond `split` rows are dealt to pairs (i, j) of parts.

    A part holds about `split` members of the key, and a task works on one key, i and j: all pairs of
    part i where i = j, else the pairs between parts i and j. So any two members of a key meet once,
    and no task holds more than about two parts, however hot the key. `sample` is what rows is made
    of sampled() members; it only decides how a key is dealt, never which members meet.

    group: where given, members of one group need not meet. A group beyond `split` rows in a key has
    parts of its own, which are not dealt to each other, so its rows grow with its size, not with its square.
    """
    hot = hot_keys(sample, split, key)
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumns({c: F.lit(0) for c in ("part", "i", "j")})
    own = hot_keys(sample, split, key, group) if group else None
    n_own = own.count() if group else 0
    if n_own:
        # Parts of the other members come first, then those of each large group.
        own = own.join(hot.withColumnRenamed("parts", "all"), key)
        large = F.sum("parts").over(Window.partitionBy(key))
        own = own.withColumn("rest", F.greatest(F.col("all") - large, F.lit(1)))
        before = F.sum("parts").over(Window.partitionBy(key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
        own = durable(own.select(key, group, F.col("parts").alias("own"), "rest", (F.col("rest") + F.coalesce(before, F.lit(0))).alias("from"), (F.col("rest") + large).alias("whole")))
        more = own.groupBy(key).agg(F.any_value("rest").alias("rest"), F.any_value("whole").alias("whole"))
        hot = durable(hot.join(more, key, "left").select(key, F.coalesce("rest", "parts").alias("rest"), F.coalesce("whole", "parts").alias("parts")))
    dealt, seen = joined_hot(rows, hot, n_hot, key), F.xxhash64(F.col(member), F.lit(13))
    whole = F.coalesce("parts", F.lit(1))
    if n_own:
        dealt = joined_hot(dealt, own.select(key, group, "own", "from"), n_own, key, group)
        part = F.coalesce(F.col("from") + F.pmod(seen, F.col("own")), F.pmod(seen, F.coalesce("rest", F.lit(1))))
        others = F.filter(F.sequence(F.lit(0), whole.cast("int") - 1), lambda x: F.col("own").isNull() | (x < F.col("from")) | (x >= F.col("from") + F.col("own")))
    else:
        part, others = F.pmod(seen, whole), F.sequence(F.lit(0), whole - 1)
    dealt = dealt.withColumn("part", part.cast("int")).withColumn("other", F.explode(others))
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts", "rest", "own", "from")


def runs(batches, keys: list[str]):
    """(table, cuts): rows sorted by keys as tables that hold whole runs of equal keys, from cut to cut."""
    import numpy as np
    import pyarrow as pa

    rest = None

    def cuts(t):
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            at = cuts(t)
            if len(at) > 1:
                yield t.slice(0, int(at[-1])).combine_chunks(), at
            rest = t.slice(int(at[-1]))
        del b
    if rest is not None:
        t = rest.combine_chunks()
        yield t, np.append(cuts(t), t.num_rows)
    # The worker serves later stages too, and what the pool keeps counts as the executor's.
    del rest
    pa.default_memory_pool().release_unused()


def forest(a, b, n: int):
    """Indices of links (a[k], b[k]) that span their components over n nodes; earlier links win.

    Links inside a known component are dropped a block at a time, so that dense links cost little.
    """
    import numpy as np

    root, kept, at, size = np.arange(n), [], 0, 256
    while at < len(a):
        x, y = root[a[at : at + size]], root[b[at : at + size]]
        new = np.flatnonzero(x != y)
        if len(new):
            parent = {}

            def find(v):
                while v in parent:
                    up = parent[v]
                    parent[v] = parent.get(up, up)
                    v = up
                return v

            for k, u, v in zip(new.tolist(), x[new].tolist(), y[new].tolist()):
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    kept.append(at + k)
            move = np.arange(n)
            move[list(parent)] = [find(v) for v in parent]
            root = move[root]
        at, size = at + size, min(2 * size, 1 << 16)
    return np.array(kept, np.int64)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would change other scripts)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id belongs to fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: a binding inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for each id in edges(a, b); root is the smallest id reachable.

    Alternating large-star and small-star rounds. Every round is two shuffles over the
    remaining edges and ends in a checkpoint, so a lost executor costs one round. Only two
    numbers a round reach the driver.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    now = durable(pair(edges))
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
