"""The rare-token inverted index and BM25 over it.

The index is four tables: lex_docs(chunk_id, length), lex_postings(token, chunk_id, tf, length),
lex_df(token, df) and lex_stats (one row). Terms are counted inside the row. Document frequencies are
the only aggregate over all tokens, and it is combined before the shuffle. Tokens too common for the
index are dropped by a broadcast. A saved index moves no postings: each task sorts its own by token
and writes them as a file, so a question's tokens prune every file to a few pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fascicle.functions.filters import among, compile_filter
from fascicle.functions.text import gate_tokens, lexical_text, lexical_tokens, tokens
from fascicle.sources.tables import _hadoop, cut, spread

K1, B = 1.2, 0.75
RARE_RATIO = 0.01
#: Common tokens up to so many are broadcast (about 100 tokens a kilobyte).
COMMON_ROWS = 200_000
INDEX_VERSION = 4


@dataclass
class LexicalIndex:
    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    #: What postings are made of where the index was built: rows without df, and df by token.
    rows: DataFrame | None = None
    df: DataFrame | None = None


def _runs(sorted_tokens: Column) -> Column:
    """array<struct<token, tf>> of sorted tokens: a run of equal tokens is one token's frequency."""

    def of(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        each = lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).alias("tf")))
        return F.when(F.size(t) > 0, F.get(F.transform(F.array(starts), each), F.lit(0)))

    return F.get(F.transform(F.array(sorted_tokens), of), F.lit(0))


def chunk_runs(chunks: DataFrame, strip_header: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, the columns `keep`, length, and runs: array<struct<token, tf>> (null without a token).

    chunks: chunk_id, page_content, heading. Counting happens inside the row, so it needs no shuffle.
    """
    t = F.sort_array(tokens(lexical_text(F.col("page_content"), F.col("heading"), strip_header)))
    rows = spread(chunks.select("chunk_id", *keep, "page_content", "heading")).select("chunk_id", *keep, t.alias("t"))
    return rows.select("chunk_id", *keep, F.size("t").alias("length"), _runs(F.col("t")).alias("runs"))


def exploded(runs: DataFrame, *keep: str) -> DataFrame:
    """token, chunk_id, the columns `keep`, tf, length: one row a run."""
    one = runs.select("chunk_id", *keep, "length", F.explode("runs").alias("run"))
    return one.select("run.token", "chunk_id", *keep, "run.tf", "length")


def term_frequencies(chunks: DataFrame, strip_header: bool = False) -> DataFrame:
    """chunk_id, token, tf, length, first (true for one token of a chunk). chunks: chunk_id, page_content, heading.

    A chunk without a token has one row with a null token.
    """
    runs = chunk_runs(chunks, strip_header).select("chunk_id", "length", F.posexplode_outer("runs").alias("at", "run"))
    return runs.select("chunk_id", "run.token", "run.tf", "length", (F.coalesce("at", F.lit(0)) == 0).alias("first"))


def index_stats(spark: SparkSession, n: int, lengths: int, rare_ratio: float | None) -> DataFrame:
    """One row: version, n, avg_length, rare_ratio."""
    row = (INDEX_VERSION, n, lengths / n if n else 1.0, None if rare_ratio is None else float(rare_ratio))
    return spark.createDataFrame([row], "version int, n long, avg_length double, rare_ratio double")


def build_index(chunks: DataFrame, rare_ratio: float | None = RARE_RATIO, strip_header: bool = False) -> LexicalIndex:
    """Index of chunks. rare_ratio prunes tokens whose df / n is not below it (None keeps all).

    Texts are tokenised once: the runs of each chunk are cut to the shared folder as Parquet, and everything
    else derives from them. A token is common if rare_ratio * n chunks or more hold it, so there are
    at most (mean distinct tokens of a chunk) / rare_ratio of them, whatever the corpus: they are
    counted and broadcast while under COMMON_ROWS, and joined by a shuffle beyond.
    """
    runs = cut(chunk_runs(chunks, strip_header))
    row = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest("length", F.lit(1)).cast("long")), F.lit(0)).alias("lengths")).first()
    known = exploded(runs)
    df = cut(known.groupBy("token").agg(F.count("*").alias("df")))
    if rare_ratio is not None:
        top = F.col("df") >= rare_ratio * max(row["n"], 1)
        common, df = df.where(top).select("token"), df.where(~top)
        known = known.join(F.broadcast(common) if common.count() <= COMMON_ROWS else common, "token", "left_anti")
    # Rows of a token meet once, for its frequency and for the sorted table.
    postings = known.select("token", "chunk_id", "tf", F.count("*").over(Window.partitionBy("token")).alias("df"), "length")
    return LexicalIndex(runs.select("chunk_id", "length"), postings, index_stats(chunks.sparkSession, row["n"], row["lengths"], rare_ratio), known, df)


def save_index(index: LexicalIndex, path: str, collection: str, day=None, start=None, end=None) -> None:
    """Four Parquet tables under path; the stats row says what the index covers and is written last."""
    index.docs.write.mode("overwrite").parquet(f"{path}/lex_docs")
    rows = index.postings.drop("df") if index.rows is None else index.rows
    df = index.postings.select("token", "df").distinct() if index.df is None else index.df
    rows.sortWithinPartitions("token", "chunk_id").write.mode("overwrite").parquet(f"{path}/lex_postings")
    df.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/lex_df")
    named = {"collection": collection, "date": day, "date_from": start, "date_to": end}
    index.stats.select("*", *(F.lit(v).cast("string").alias(k) for k, v in named.items()), F.current_timestamp().alias("built_at")).write.mode("overwrite").parquet(f"{path}/lex_stats")


#: Loaded indexes of this process and when they were saved, by application, path and collection.
_LOADED: dict[tuple[str, str, str], tuple[int, LexicalIndex]] = {}


def saved_at(spark: SparkSession, path: str) -> int:
    """When the index at path was completed (its statistics are written last); 0 where there is none."""
    fs, at = _hadoop(spark, f"{path}/lex_stats/_SUCCESS")
    return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else 0


def load_index(spark: SparkSession, path: str, collection: str, fresh: bool = False) -> LexicalIndex | None:
    """The saved index; None where there is none, or its version or collection is another one.

    A process validates an index once for each time it is saved; `fresh` does so again.
    """
    key = (spark.sparkContext.applicationId, path, collection)
    when = saved_at(spark, path)
    if fresh or _LOADED.get(key, (0,))[0] != when:
        _LOADED.pop(key, None)
    if key not in _LOADED:
        try:
            spark.catalog.refreshByPath(path)
            stats = spark.read.parquet(f"{path}/lex_stats")
            row = stats.first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or "") or "UNABLE_TO_INFER_SCHEMA" in (e.getCondition() or ""):
                return None
            raise
        if row is None or row["version"] != INDEX_VERSION or row["collection"] != collection:
            return None
        rows, df = (spark.read.parquet(f"{path}/{t}") for t in ("lex_postings", "lex_df"))
        postings = rows.join(df, "token").select("token", "chunk_id", "tf", "df", "length")
        _LOADED[key] = when, LexicalIndex(spark.read.parquet(f"{path}/lex_docs"), postings, stats, rows, df)
    return _LOADED[key][1]


def forget_indexes() -> None:
    """Drop what load_index remembers."""
    _LOADED.clear()


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, df: Column, length: Column, n: Column, avg_length: Column) -> Column:
    """One token's share of a chunk's score."""
    return idf(df, n) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.greatest(length, F.lit(1)) / F.greatest(avg_length, F.lit(1.0))))


def of_tokens(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """Postings of the tokens of asked(token, ...): a handful, so they are literals that reach the scan."""
    found = sorted({r["token"] for r in asked.select("token").distinct().collect()})
    return index.postings.where(among(F.col("token"), found))


def bm25_topk(index: LexicalIndex, topics: DataFrame, k: int, filter=None, metadata: DataFrame | None = None) -> DataFrame:
    """topic_id, chunk_id, bm25, rank: the k best chunks for each of topics(topic_id, search).

    topics is a handful of questions, so its tokens are broadcast against the postings. The
    filter narrows postings through metadata(chunk_id, ...); n and the average length stay global.
    """
    asked = topics.select("topic_id", F.explode(lexical_tokens(F.col("search"))).alias("token")).distinct()
    hits = of_tokens(index, asked).join(F.broadcast(asked), "token")
    if filter:
        hits = hits.join(metadata.where(compile_filter(filter, metadata)).select("chunk_id"), "chunk_id", "left_semi")
    hits = hits.crossJoin(F.broadcast(index.stats.select("n", "avg_length")))
    score = F.sum(bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("avg_length")))
    return rank_topk(hits.groupBy("topic_id", "chunk_id").agg(score.alias("bm25")).where("bm25 > 0"), "bm25", k)


def rank_topk(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best rows of each topic with their rank; ties go to the smaller chunk_id.

    A filter on row_number, so only k rows a topic and partition are shuffled.
    """
    order = Window.partitionBy("topic_id").orderBy(F.desc(by), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gate(topics: DataFrame, index: LexicalIndex, ratio: float = RARE_RATIO) -> DataFrame:
    """topic_id, token, df, n, status for each content token of each topic.

    status: selected (1 <= df and df / n < ratio), common, or no-match. df comes from an index
    built without pruning, or from a pruned one where common tokens are missing (no-match).
    """
    asked = topics.select("topic_id", F.posexplode(gate_tokens(F.col("search"))).alias("ord", "token"))
    df = of_tokens(index, asked).groupBy("token").agg(F.count("*").alias("df"))
    out = asked.join(df, "token", "left").crossJoin(F.broadcast(index.stats.select("n")))
    df = F.coalesce("df", F.lit(0))
    status = F.when(df == 0, "no-match").when(df < ratio * F.greatest("n", F.lit(1)), "selected").otherwise("common")
    return out.select("topic_id", "ord", "token", df.alias("df"), "n", status.alias("status"))


def fusion_weights(df: Column, n: Column, ratio: float = RARE_RATIO) -> tuple[Column, Column]:
    """(semantic, lexical) weights for the rarest selected token's df; null df: none selected."""
    top = ratio * F.greatest(n, F.lit(1))
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (df - 3) / F.when(top > 3, top - 3).otherwise(1.0)))
    ease = (1 - F.exp(-8 * x)) / (1 - F.exp(F.lit(-8.0)))
    semantic = F.when(df.isNull(), 0.75).when((df <= 3) | (top <= 3), 0.25).otherwise(0.25 + 0.5 * ease)
    return semantic, 1 - semantic


def topic_weights(gated: DataFrame, ratio: float = RARE_RATIO) -> DataFrame:
    """topic_id, token, df, open, w_sem, w_lex: the rarest selected token decides, first one wins."""
    picked = F.when(F.col("status") == "selected", F.struct("df", "ord", "token"))
    out = gated.groupBy("topic_id").agg(F.min(picked).alias("r"), F.max("n").alias("n"))
    sem, lex = fusion_weights(F.col("r.df"), F.col("n"), ratio)
    return out.select("topic_id", F.col("r.token").alias("token"), F.col("r.df").alias("df"), F.col("r").isNotNull().alias("open"), sem.alias("w_sem"), lex.alias("w_lex"))
