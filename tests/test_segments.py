"""Index segments against an index built anew; ingestion of issues that arrive in parts."""

import random

from pyspark.sql import functions as F

from fascicle.functions.filters import among
from fascicle.operators import segments
from fascicle.operators.lexical import bm25_topk, build_index, load_index, save_index
from fascicle.sources import tables
from fascicle.streaming.logs import ingest_stream

CHUNK = "chunk_id string, page_content string, heading string, date string, source string, pageNumber int, chunkIndex int"
WORDS = [f"word{k}" for k in range(200)]


def made(rng, date, n, text=None):
    return [(f"{date}-{k}", text if text is not None else " ".join(rng.choices(WORDS, k=30)) + f" only{k}", f"H{k % 3}", date, "s.pdf", k % 4, k) for k in range(n)]


def same(spark, path, rows):
    """The segments' postings, documents and statistics are those of a full build."""
    got, want = segments.open_segments(spark, path, 0.2), build_index(spark.createDataFrame(rows, CHUNK), 0.2)
    for t in ("postings", "docs"):
        a, b = getattr(got, t), getattr(want, t)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert got.stats.collect() == want.stats.collect()
    topics = spark.createDataFrame([(0, "word3 only7"), (1, "word9")], "topic_id int, search string")
    assert bm25_topk(got, topics, 5).collect() == bm25_topk(want, topics, 5).collect()


def test_replaced_dates_equal_a_rebuild(spark, tmp_path):
    rng, path, live = random.Random(2), str(tmp_path / "ix"), {}
    assert segments.open_segments(spark, path) is None
    for k, date in enumerate(["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-02", "2026-01-04", "2026-01-01"]):
        live[date] = made(rng, date, 20 + 5 * k)
        segments.replace_dates(spark.createDataFrame(live[date], CHUNK), path)
    same(spark, path, sum(live.values(), []))
    segments.replace_dates(spark.createDataFrame([], CHUNK), path, ["2026-01-03"])  # a tombstone alone
    live["2026-01-03"] = []
    live["odd"] = [("e1", "", "", "odd", None, None, 0), ("e2", None, None, "odd", None, None, 1), ("n", "word1", "h", None, None, None, 2)]
    segments.replace_dates(spark.createDataFrame(live["odd"], CHUNK), path)
    same(spark, path, sum(live.values(), []))
    before = segments.manifest(spark, path)
    after = segments.compact(spark, path, 2)
    assert len({x["segment"] for x in after.values()}) < len({x["segment"] for x in before.values()}) and set(after) == set(before)
    same(spark, path, sum(live.values(), []))
    assert segments.vacuum(spark, path) > 0
    same(spark, path, sum(live.values(), []))


def test_only_the_replaced_date_is_tokenised(spark, tmp_path):
    """The new segment holds the replaced date alone, and the other dates' texts are not even there to read."""
    rng, path = random.Random(4), str(tmp_path / "ix")
    first = [r for d in ("2026-01-01", "2026-01-02") for r in made(rng, d, 10)]
    old = segments.replace_dates(spark.createDataFrame(first, CHUNK), path)
    again = made(rng, "2026-01-02", 12)
    new = segments.replace_dates(spark.createDataFrame(again, CHUNK), path)
    assert new["2026-01-01"] == old["2026-01-01"] and new["2026-01-02"]["chunks"] == 12
    written = spark.read.parquet(f"{path}/docs/segment={new['2026-01-02']['segment']}")
    assert {r[0] for r in written.select("date").distinct().collect()} == {"2026-01-02"} and written.count() == 12
    same(spark, path, first[:10] + again)


def test_ten_times_the_size(spark, tmp_path):
    """Ten times the rows: the manifest stays one entry a date, and the index is still exact."""
    rng, path = random.Random(5), str(tmp_path / "ix")
    rows = {f"2026-02-{d:02d}": made(rng, f"2026-02-{d:02d}", 300) for d in range(1, 11)}
    for part in (list(rows)[:6], list(rows)[4:]):
        segments.replace_dates(spark.createDataFrame(sum((rows[d] for d in part), []), CHUNK), path)
    assert len(segments.manifest(spark, path)) == 10
    same(spark, path, sum(rows.values(), []))


def test_a_date_over_two_batches_keeps_all_chunks(spark, tmp_path):
    """One file a trigger: two parts of one issue, then a corrected page; table and index follow."""
    source, table, index = (str(tmp_path / x) for x in ("in", "table", "ix"))
    rng = random.Random(6)
    rows = made(rng, "2026-03-01", 8)
    pages = lambda *n: [r for r in rows if r[5] in n]
    fixed = [(r[0], "corrected words here", *r[2:]) for r in pages(2)]

    def arrive(part):
        spark.createDataFrame(part, CHUNK).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, table, str(tmp_path / "ck"), lambda b: b, index).awaitTermination()

    arrive(pages(0, 1))
    arrive(pages(2, 3))
    run()
    stored = lambda: sorted((r["chunk_id"], r["page_content"]) for r in spark.read.parquet(table).collect())
    assert stored() == sorted((r[0], r[1]) for r in rows)
    same(spark, index, rows)
    arrive(fixed)
    run()
    want = pages(0, 1, 3) + fixed
    assert stored() == sorted((r[0], r[1]) for r in want)
    same(spark, index, want)


def test_a_saved_index_is_never_served_stale(spark, tmp_path):
    rng, path = random.Random(7), str(tmp_path / "saved")
    save_index(build_index(spark.createDataFrame(made(rng, "2026-01-01", 10), CHUNK)), path, "c")
    assert load_index(spark, path, "c").docs.count() == 10
    save_index(build_index(spark.createDataFrame(made(rng, "2026-01-01", 30), CHUNK)), path, "c")
    assert load_index(spark, path, "c").docs.count() == 30 and load_index(spark, path, "c").stats.first()["n"] == 30
    assert load_index(spark, path, "other") is None and load_index(spark, str(tmp_path / "none"), "c") is None


def test_a_saved_index_moves_no_postings(spark, tmp_path):
    """Each task sorts what it has; the saved rows and frequencies are those of the index built in memory."""
    rng, path = random.Random(8), str(tmp_path / "saved")
    index = build_index(spark.createDataFrame(made(rng, "2026-01-01", 40), CHUNK), 0.5)
    plan = index.rows.sortWithinPartitions("token", "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    save_index(index, path, "c")
    got = load_index(spark, path, "c", fresh=True).postings
    assert sorted(map(tuple, got.select(index.postings.columns).collect())) == sorted(map(tuple, index.postings.collect())) and got.count()
    pruned = got.where(among(F.col("token"), [f"only{k}" for k in range(25)]))._jdf.queryExecution().executedPlan().toString()
    assert pruned.count("only24") >= 2 and got.where(among(F.col("token"), [f"only{k}" for k in range(25)])).count() == 25 and not got.where(among(F.col("token"), [])).count()


def test_one_large_file_is_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    """A row group is one task's; beyond SMALL_BYTES a single file was left as it was."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(6).write.parquet(str(tmp_path / "six"))
    one, six = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "six"))
    monkeypatch.setattr(tables, "SMALL_BYTES", 3000)
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    assert tables.spread(one).rdd.getNumPartitions() >= 4 and tables.spread(one).count() == 1000
    assert tables.spread(six).rdd.getNumPartitions() == six.rdd.getNumPartitions()
