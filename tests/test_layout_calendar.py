"""Layout geometry, the calendar's states, stores and streams on hand-made tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from fascicle.operators import calendar, curation, layout, stores
from fascicle.operators.lexical import fusion_weights


def item(text, x, y, size, width=0.0, page=1):
    return ("s", page, 1000.0, 0, text, float(x), float(y), float(size), float(width))


def pages(spark, items):
    return spark.createDataFrame([(*i[:3], k, *i[4:]) for k, i in enumerate(items)], layout.ITEM_SCHEMA)


def test_two_columns_and_hyphen(spark):
    items = [
        item("First story heading", 40, 900, 20, 200), item("Second story heading", 500, 900, 20, 200),
        item("left body be-", 40, 880, 9, 150), item("gins here", 40, 868, 9, 150), item("right body", 500, 880, 9, 150), item("in", 500, 860, 9, 10),
    ]
    got = {r["heading"]: r["body"] for r in layout.articles_of(pages(spark, items)).collect()}
    assert got == {"First story heading": "left body begins here", "Second story heading": "right body"}


def test_stacked_heading_kicker_and_no_heading(spark):
    items = [item("BIG NEWS", 40, 925, 9, 60), item("A long title", 40, 900, 20, 150), item("over two lines", 40, 878, 20, 150), item("body text follows here", 40, 860, 9, 150)]
    got = layout.articles_of(pages(spark, items)).collect()
    assert [(r["heading"], r["body"]) for r in got] == [("BIG NEWS: A long title over two lines", "body text follows here")]
    plain = layout.articles_of(pages(spark, [item("just some body text on a page", 40, 800, 9, 150, page=4)])).collect()
    assert [(r["heading"], r["body"]) for r in plain] == [("Page 4 other text", "just some body text on a page")]


def test_intervening_heading(spark):
    items = [item("Upper story title", 40, 900, 20, 200), item("Lower story title", 40, 700, 20, 200), item("belongs to the lower", 40, 680, 9, 150), item("belongs to the upper", 40, 880, 9, 150)]
    got = {r["heading"]: r["body"] for r in layout.articles_of(pages(spark, items)).collect()}
    assert got == {"Upper story title": "belongs to the upper", "Lower story title": "belongs to the lower"}


def test_progress_states(spark):
    day = lambda d: date(2026, 1, d)
    found = spark.createDataFrame([(day(d), f"in/a{d}.pdf", 1.0, 10) for d in range(1, 8)], "date date, source string, sourceMtimeMs double, sourceSize long")
    states = [None, "missing", "pending", "complete", "in_progress", "stale", "complete"]
    old = spark.createDataFrame([(day(k + 1), f"old/a{k + 1}.pdf", 1.0, 10 if k == 6 else 9, s, 5, 3, 2) for k, s in enumerate(states) if s] + [(day(9), "in/gone.pdf", 1.0, 1, "complete", 5, 3, 2)], calendar.PROGRESS_SCHEMA)
    got = calendar.sync(old, found, "2026-01-01", "2026-01-10")
    assert [r["status"] for r in got.orderBy("date").collect()] == ["pending", "pending", "pending", "stale", "stale", "pending", "complete", "missing", "missing", "missing"]
    again = calendar.sync(got, found, "2026-01-01", "2026-01-10")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.select(*again.columns).collect()))
    queue, counts = calendar.batch(got, 2)
    assert [r["date"].day for r in queue.collect()] == [1, 2] and tuple(counts.first()) == (6, 4)
    s = calendar.summary(got).first()
    assert not s["complete"] and s["vectorCount"] == 2 and [d.day for d in s["missing"]] == [8, 9, 10]
    assert calendar.mark(got, "2026-01-01", status="complete").where("status = 'complete'").count() == 2
    assert calendar.reset(got).where("status = 'pending'").count() == 7
    assert calendar.resume_page({"status": "in_progress", "nextPage": 4}) == (4, False) and calendar.resume_page({"status": "stale", "nextPage": 4}) == (1, True)


def test_health_report(spark):
    rows = [(date(2026, 1, d), "f", 1.0, 1, s, 5, 3, 2) for d, s in enumerate(("complete", "missing", "in_progress", "in_progress", "pending"), 1)]
    vectors = spark.range(3)
    said = lambda v, r: calendar.health_report(v, spark.createDataFrame(r, calendar.PROGRESS_SCHEMA), "news").first().asDict()
    busy = said(vectors, rows)
    assert (busy["ok"], busy["vectorCount"], busy["ingestComplete"], busy["date"], busy["pending"], busy["missing"], busy["error"]) == (True, 3, False, date(2026, 1, 3), 1, 1, None)
    done = said(vectors, rows[:2])
    assert done["ingestComplete"] is True and done["date"] is None and done["pending"] is None
    empty = said(vectors.where("false"), rows)
    assert not empty["ok"] and not empty["indexReady"] and empty["error"] == 'Collection "news" is empty' and empty["ingestComplete"] is None
    assert said(vectors, [])["ingestComplete"] is False


def test_empty_progress_is_not_complete(spark):
    empty = spark.createDataFrame([], calendar.PROGRESS_SCHEMA)
    assert calendar.summary(empty).first()["complete"] is False


def test_weights(spark):
    rows = spark.createDataFrame([(None,), (3,), (9,), (10,)], "df long").select("df", fusion_weights(F.col("df"), F.lit(1000))[0].alias("w")).collect()
    assert [round(r["w"], 4) for r in rows] == [0.75, 0.25, 0.7496, 0.75]


def test_stores(spark):
    at = lambda m: datetime(2026, 1, 1, 0, m)
    m = spark.createDataFrame([("s", "u", "user", "first question", at(0), 1), ("s", "u", "assistant", "reply", at(1), 2)], "sessionId string, userId string, role string, content string, createdAt timestamp, messageId long")
    r = stores.sessions(m).first()
    assert (r["title"], r["preview"], r["messageCount"]) == ("first question", "reply", 2)
    assert stores.session_messages(m, "s", "other").count() == 0
    late = spark.createDataFrame([("s", "six", 6), ("s", "four", 4)], "sessionId string, summary string, summaryAtCount int")
    assert stores.latest_summaries(late).first()["summary"] == "six"
    assert stores.sanitize({"JWT": "x", "a": {"b": {"c": {"d": {"e": 1}}}}, "s": "y" * 600})["JWT"] == "[redacted]"
    assert stores.sanitize({"k": "v" * 499, "l": list(range(50))})["l"] == list(range(40))
    users = spark.createDataFrame([], "googleId string, email string, name string, picture string, lastLoginAt timestamp, loginCount long")
    sign = spark.createDataFrame([("g", "e", None, "p", at(3))], "googleId string, email string, name string, picture string, at timestamp")
    assert stores.upsert_users(users, sign).first()["loginCount"] == 1


def test_relevance_order_and_page_curation(spark):
    rows = [(k, "s", 1, "t", "National", r, "s", ["x"], datetime(2026, 1, 1)) for k, r in enumerate(("high", "low", "medium"))]
    a = spark.createDataFrame(rows, "id int, source string, pageNumber int, title string, section string, examRelevance string, summary string, examTags array<string>, createdAt timestamp")
    assert [r["examRelevance"] for r in curation.search(a).collect()] == ["medium", "low", "high"]
    assert [r["examRelevance"] for r in curation.search(a, rank_relevance=True).collect()] == ["high", "medium", "low"]
    prepared = spark.createDataFrame([("s", 1, 0, "H", "b" * 60, "news"), ("s", 2, 0, "H", "b" * 60, "states")], "source string, pageNumber int, index int, heading string, text string, section string")

    def client(page):
        if page[0]["pageNumber"] == 2:
            raise RuntimeError("down")
        return [{"index": 0, "keep": True, "section": "??", "examRelevance": "low", "title": "T", "summary": "", "refinedBody": "w " * 150, "examTags": ["A"], "reason": ""}, {"index": 9, "keep": True}]

    got = curation.curate_pages(curation.eligible(prepared), client).collect()
    assert [(r["title"], r["section"], r["examRelevance"], r["wordCount"]) for r in got] == [("T", "National", "medium", 150)]


def test_index_files_and_stream(spark, tmp_path, sf):
    from fascicle.operators.lexical import build_index, load_index, save_index
    from fascicle.sources import corpus
    from fascicle.streaming.logs import read_stream, store_stream

    index = build_index(corpus.chunks(spark, sf).where("chunk_id < 20"), 0.5)
    save_index(index, str(tmp_path / "i"), "c")
    assert load_index(spark, str(tmp_path / "i"), "other") is None
    assert load_index(spark, str(tmp_path / "i"), "c").postings.count() == index.postings.count()
    lines = spark.createDataFrame([("m" * 5000, '{"jwt": 1}')], "message string, meta string")
    lines.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        store_stream(read_stream(spark, str(tmp_path / "in"), lines.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(row) == 1 and len(row[0]["message"]) == 4001 and row[0]["meta"] == '{"jwt":"[redacted]"}'
