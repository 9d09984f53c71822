"""Cosine search, weighted reciprocal-rank fusion, and the retrieval routes.

Every operator takes all topics of a question at once: a topic is a row, and ranks are per topic,
so a fan-out is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.filters import among, compile_filter
from fascicle.operators.lexical import LexicalIndex, bm25_topk, gate, rank_topk, topic_weights
from fascicle.operators.positions import positions

POOL = 20
RRF_K = 10
MAX_TOPICS = 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either vector is zero."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, filter=None) -> DataFrame:
    """topic_id, chunk_id, cosine, rank over vectors(chunk_id, embedding, ...), exact.

    queries(topic_id, query) is a handful of rows and is broadcast; each task keeps k rows a topic,
    so the shuffle is k rows a task. The filter runs in the scan.
    """
    scored = vectors.where(compile_filter(filter, vectors)).select("chunk_id", "embedding").crossJoin(F.broadcast(queries.select("topic_id", "query")))
    scored = scored.select("topic_id", "chunk_id", cosine(F.col("embedding"), F.col("query")).alias("cosine")).where("cosine is not null")
    return rank_topk(scored, "cosine", k)


def rrf(semantic: DataFrame, lexical: DataFrame, weights: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """topic_id, chunk_id, score, sem_rank, lex_rank, cosine, bm25, rank: sum of w / (rrf_k + rank).

    Ties: the better semantic rank, then the better lexical rank, then the smaller chunk_id.
    """
    from pyspark.sql import Window as W

    none = F.lit(None)
    both = semantic.select("topic_id", "chunk_id", F.col("rank").alias("s"), none.cast("int").alias("l"), "cosine", none.cast("double").alias("bm25")).unionByName(
        lexical.select("topic_id", "chunk_id", none.cast("int").alias("s"), F.col("rank").alias("l"), none.cast("double").alias("cosine"), "bm25")
    )
    one = both.groupBy("topic_id", "chunk_id").agg(F.min("s").alias("sem_rank"), F.min("l").alias("lex_rank"), F.max("cosine").alias("cosine"), F.max("bm25").alias("bm25"))
    one = one.join(F.broadcast(weights.select("topic_id", "w_sem", "w_lex")), "topic_id")
    part = lambda w, r: F.coalesce(F.col(w) / (rrf_k + F.col(r)), F.lit(0.0))
    one = one.withColumn("score", part("w_sem", "sem_rank") + part("w_lex", "lex_rank")).drop("w_sem", "w_lex")
    order = W.partitionBy("topic_id").orderBy(F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fill_content(ranked: DataFrame, chunks: DataFrame, columns=("page_content",)) -> DataFrame:
    """Late materialisation: texts are read for ranked ids only; an id without a chunk keeps its row.

    ranked is k rows a topic. They are computed once, on the driver, and their ids reach the
    scan of chunks as literals, which skips row groups that hold none.
    """
    rows = ranked.collect()
    ids = sorted({r["chunk_id"] for r in rows if r["chunk_id"] is not None})
    found = chunks.where(among(F.col("chunk_id"), ids)).select("chunk_id", *columns)
    return found.join(F.broadcast(chunks.sparkSession.createDataFrame(rows, ranked.schema)), "chunk_id", "right")


def hybrid(chunks: DataFrame, vectors: DataFrame, index: LexicalIndex | None, topics: DataFrame, queries: DataFrame, k: int, filter=None) -> DataFrame:
    """Fused ranks of each topic(topic_id, search); queries(topic_id, query) holds its vector.

    A topic falls back to its first k semantic rows where there is no index, its gate is shut, or
    BM25 finds nothing. The fallback is part of the plan: without lexical rows the fused order is
    the semantic one.
    """
    pool = max(k, POOL)
    semantic = cosine_topk(vectors, queries, pool, filter)
    if index is None:
        return semantic.where(F.col("rank") <= k).select("topic_id", "chunk_id", F.lit(None).cast("double").alias("score"), F.col("rank").alias("sem_rank"), F.lit(None).cast("int").alias("lex_rank"), "cosine", F.lit(None).cast("double").alias("bm25"), "rank")
    weights = topic_weights(gate(topics, index))
    opened = topics.join(F.broadcast(weights.where("open").select("topic_id")), "topic_id", "left_semi")
    lexical = bm25_topk(index, opened, pool, filter, chunks)
    missing = topics.select("topic_id").join(F.broadcast(weights), "topic_id", "left")
    weights = missing.select("topic_id", F.coalesce("w_sem", F.lit(0.75)).alias("w_sem"), F.coalesce("w_lex", F.lit(0.25)).alias("w_lex"))
    return rrf(semantic, lexical, weights, k)


def merge_topics(fused: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """chunk_id and ordinal over all topics in topic order; a chunk found twice keeps its first place."""
    from pyspark.sql import Window as W

    first = fused.groupBy("chunk_id").agg(F.min(F.struct("topic_id", "rank")).alias("at"))
    # At most MAX_TOPICS * k rows: one small sort gives the ordinals.
    return first.select("chunk_id", F.col("at.topic_id").alias("topic_id"), F.row_number().over(W.orderBy("at.topic_id", "at.rank")).alias("ordinal"))


def layout_order(df: DataFrame) -> list[Column]:
    """Order of a page: date, page, heading by Unicode collation, chunk; nulls count as zero."""
    have = set(df.columns)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    heading = F.collate(F.coalesce(F.col("heading"), F.lit("")), "UNICODE") if "heading" in have else F.lit("")
    return [zero("dateInt"), zero("pageNumber"), heading, zero("chunkIndex"), *([F.col("chunk_id")] if "chunk_id" in have else [])]


def layout_positions(chunks: DataFrame) -> DataFrame:
    """chunks with `position`, their place (from 0) in layout order over the whole table.

    Places come from a range sort with prefix counts, so an issue may be of any size. The rows are
    materialised: give the columns that the order and the result need, not the texts.
    """
    keys = layout_order(chunks)
    named = chunks.withColumns({f"__key{k}": c for k, c in enumerate(keys)})
    placed = positions(named, [F.col(f"__key{k}").asc() for k in range(len(keys))])
    return placed.select(*chunks.columns, "position")


def get_by_filter(chunks: DataFrame, filter) -> DataFrame:
    """All chunks of a filter in layout order; a filter is required, as the result is unbounded."""
    if not filter:
        raise ValueError("a filter is required")
    found = chunks.where(compile_filter(filter, chunks))
    return found.orderBy(*layout_order(found))


def get_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of distinct non-null ids(chunk_id)."""
    return chunks.join(ids.where("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_semi")
