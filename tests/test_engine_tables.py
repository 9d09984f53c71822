"""Tables, listings, stores, progress documents and the question lifecycle on hand-made inputs."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fascicle.functions import text
from fascicle.operators import calendar, curation, layout, lexical, retrieval, stores
from fascicle.plans.ask import Engine, hash_embedder
from fascicle.sources import corpus, progress, tables

AT = datetime(2026, 1, 1)


def test_listing_and_parsing_files(spark, tmp_path):
    """Folder scan, a parser over whole files, and pages from a start page on."""
    (tmp_path / "sub").mkdir()
    for name, content in (("x-05-01-2026.pdf", b"%PDF one"), ("sub/2026-01-05.pdf", b"%PDF two"), ("notes.pdf", b"%PDF"), ("a.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    files = tables.list_files(spark, str(tmp_path))
    assert files.count() == 3
    found, skipped = calendar.discover(files)
    assert [(r["date"], r["source"].rsplit("/", 1)[1]) for r in found.collect()] == [(date(2026, 1, 5), "x-05-01-2026.pdf")]
    assert [r["name"] for r in skipped.collect()] == ["notes.pdf"]

    def parse(path, content):
        for page in (1, 2, 3):
            yield {"source": path.rsplit("/", 1)[1], "pageNumber": page, "page_width": 600.0, "item_no": 0, "text": f"Page body {page} of {len(content)}", "x": 40.0, "y": 800.0, "size": 9.0, "width": 100.0}

    items = tables.read_items(spark, str(tmp_path), parse)
    assert items.count() == 6  # two files at the top level
    assert {r["pageNumber"] for r in layout.articles_of(items, start_page=2).collect()} == {2, 3}


def test_pdf_check(spark):
    rows = [(b"%PDF-1", 6, None), (b"xx", 2, "Application/PDF"), (b"xx", 2, "text/plain"), (b"", 0, "application/pdf"), (b"%PDF", 51 * 1024 * 1024, None)]
    df = spark.createDataFrame(rows, "content binary, length long, kind string")
    assert [r["ok"] for r in df.select(tables.is_pdf(F.col("content"), F.col("length"), F.col("kind")).alias("ok")).collect()] == [True, True, False, False, False]


def test_tables_open_append_copy_and_drop(spark, tmp_path):
    path = str(tmp_path / "articles")
    schema = "id int, section string"
    assert tables.open_table(spark, path, schema).count() == 0
    tables.append(spark.createDataFrame([(1, "a"), (2, "b")], schema), path)
    tables.append(spark.createDataFrame([(3, "b")], schema), path)
    assert tables.open_table(spark, path, schema).count() == 3
    copied = tables.replace_copy(tables.open_table(spark, path, schema), path)  # over the very table it reads
    assert sorted(map(tuple, copied.collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        tables.drop_table(spark, path, protected=("articles",))
    tables.drop_table(spark, path)
    assert not (tmp_path / "articles").exists()


def test_scan_cache_and_dates(spark, tmp_path, sf):
    chunks = corpus.chunks(spark, sf)
    assert "embedding" not in tables.scan(chunks).columns
    one = tables.cached_scan(chunks, {"pageNumber": 3})
    assert one is tables.cached_scan(chunks, {"pageNumber": 3}) and one.storageLevel.useMemory
    tables.clear_scans()
    assert not one.storageLevel.useMemory
    path = str(tmp_path / "chunks")
    tables.write_chunks(chunks, path)
    tables.drop_dates(spark, path, ["2026-01-05"])
    left = spark.read.parquet(path)
    assert left.where("date = '2026-01-05'").count() == 0 and left.count() == chunks.where("date <> '2026-01-05'").count()
    ids = spark.createDataFrame([(3,), (3,), (None,), (99_999,)], "chunk_id long")
    assert retrieval.get_by_ids(chunks, ids).count() == 1


def test_embedding_retries(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        if len(texts) == 2:
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame([(k, "x" * k) for k in range(3)], "chunk_id long, page_content string").coalesce(1)
    got = tables.embed_chunks(chunks, embed, batch=3, pause=0.01).collect()
    assert [(r["chunk_id"], r["embedding"]) for r in got] == [(0, [0.0]), (1, [1.0]), (2, [2.0])]
    with pytest.raises(Exception, match="busy"):
        tables.embed_chunks(chunks, embed, batch=2, attempts=2, wait=0.0).collect()


def test_progress_documents(spark, tmp_path):
    path = str(tmp_path / "p.json")
    assert progress.load_progress(spark, path) is None
    rows = [(date(2026, 1, 1), "a.pdf", 1.0, 9, "complete", 4, 5, 7), (date(2026, 1, 2), None, None, None, "missing", None, None, None)]
    table = spark.createDataFrame(rows, calendar.PROGRESS_SCHEMA)
    saved = progress.save_progress(table, path)
    assert saved["complete"] and saved["vectorCount"] == 7 and saved["version"] == progress.VERSION
    assert sorted(map(tuple, progress.load_progress(spark, path).collect())) == sorted(rows)
    progress.save_progress(calendar.mark(table, "2026-01-01", status="stale"), path)  # over the old one
    assert not json.loads((tmp_path / "p.json").read_text())["complete"] and not (tmp_path / "p.json.tmp").exists()
    for damaged in ('{"version": 1, "files": {}}', '{"version": 2, "files": 3}', "[1]"):
        (tmp_path / "p.json").write_text(damaged)
        (tmp_path / ".p.json.crc").unlink(missing_ok=True)
        assert progress.load_progress(spark, path) is None
    progress.save_json(spark, path, {"a": 1})
    (tmp_path / "p.json").write_text("{half")  # against its checksum
    assert progress.load_progress(spark, path) is None
    (tmp_path / ".p.json.crc").unlink()
    assert progress.load_progress(spark, path) is None and progress.load_run(spark, path) is None
    progress.save_run(spark, path, source="s", nextPage=3, complete=False)
    run = progress.load_run(spark, path)
    articles = spark.createDataFrame([("s", p, p) for p in (1, 2, 3, 4)] + [("t", 4, 9)], "source string, pageNumber int, id int")
    page, left = curation.resume(articles, "s", run)
    assert page == 3 and sorted(r["id"] for r in left.collect()) == [1, 2, 9]
    assert curation.resume(articles, "s", run, start=2)[0] == 2
    page, left = curation.resume(articles, "s", run, resumed=False)
    assert page == 1 and [r["id"] for r in left.collect()] == [9]


def test_index_of_another_kind_and_cache(spark, tmp_path, sf):
    path = str(tmp_path / "index")
    assert lexical.load_index(spark, path, "c") is None
    lexical.save_index(lexical.build_index(corpus.chunks(spark, sf), 0.05), path, "c", start="2026-01-01")
    assert lexical.load_index(spark, path, "other") is None
    index = lexical.load_index(spark, path, "c")
    assert lexical.load_index(spark, path, "c") is index and lexical.load_index(spark, path, "c", fresh=True) is not index
    lexical.forget_indexes()
    empty = lexical.build_index(corpus.chunks(spark, sf).where("false"))
    assert empty.postings.count() == 0 and tuple(empty.stats.select("n", "avg_length").first()) == (0, 1.0)
    blank = spark.createDataFrame([(1, "", ""), (2, "one word", "")], "chunk_id long, page_content string, heading string")
    built = lexical.build_index(blank, None)
    assert tuple(built.stats.select("n", "avg_length").first()) == (2, 1.5) and sorted(map(tuple, built.docs.collect())) == [(1, 0), (2, 2)]


def test_turns_and_owners(spark):
    none = spark.createDataFrame([], stores.MESSAGE_SCHEMA)
    rows, session, new = stores.append_turn(none, "u", " What? ", "  ", [{"id": k, "excerpt": "e" * 500} for k in range(25)], AT)
    assert new and [r["content"] for r in rows.orderBy("messageId").collect()] == ["What?", "(No answer)"]
    kept = json.loads(rows.where("role = 'assistant'").first()["sources"])
    assert len(kept) == 20 and len(kept[0]["excerpt"]) == 400 and kept[0]["heading"] == ""
    s = stores.sessions(rows).first()
    assert (s["title"], s["preview"], s["messageCount"]) == ("What?", "What?", 2)
    more, same, new = stores.append_turn(rows, "u", "And?", "So.", None, AT, session=session)
    assert not new and same == session and stores.sessions(rows.unionByName(more)).first()["messageCount"] == 4
    assert [r["messageId"] for r in stores.session_messages(rows.unionByName(more), session, "u").collect()] == [1, 2, 3, 4]
    for bad, error in ((("v", "q"), LookupError), (("u", " "), ValueError), (("", "q"), PermissionError)):
        with pytest.raises(error):
            stores.append_turn(rows, *bad, "a", None, AT, session=session)
    everyone = stores.sessions(rows)
    assert stores.rename_session(everyone, session, " New ").first()["title"] == "New"
    with pytest.raises(ValueError):
        stores.rename_session(everyone, session, " ")
    gone = stores.delete_session(everyone, rows, session)
    assert gone[0].count() == gone[1].count() == 0


def test_public_views(spark):
    users = spark.createDataFrame([("g", "", None, None, None, 0)], "googleId string, email string, name string, picture string, lastLoginAt timestamp, loginCount long")
    u = stores.public_users(users).first()
    assert (u["id"], u["sub"], u["email"], u["emailVerified"], u["provider"], u["loginCount"], u["createdAt"]) == ("g", "g", None, False, "google", 1, None)
    s = stores.public_sessions(spark.createDataFrame([(5, None, AT)], "sessionId long, title string, createdAt timestamp")).first()
    assert (s["id"], s["title"], s["preview"], s["messageCount"], s["lastMessageAt"]) == ("5", "New chat", "", 0, AT)
    a = curation.public_articles(spark.createDataFrame([(7, "t", "National", "high", None, 3, "s")], "id int, title string, section string, examRelevance string, summary string, pageNumber int, source string")).first()
    assert (a["id"], a["summary"], a["examTags"], a["wordCount"], a["updatedAt"]) == ("7", "", [], 0, None)
    assert spark.createDataFrame([(" Me@X ",), (None,)], "e string").select(stores.is_publisher(F.col("e"), ["me@x", " "]).alias("r")).collect()[0]["r"]


def test_article_order_total_and_sections(spark):
    rows = [(k, "s", 1 + k % 2, "t", "National", "high", datetime(2026, 1, 1 + k)) for k in range(6)]
    a = spark.createDataFrame(rows, "id int, source string, pageNumber int, title string, section string, examRelevance string, createdAt timestamp").withColumns({"summary": F.lit("x"), "examTags": F.array(F.lit("y"))})
    page = curation.search(a, limit=2, skip=2).collect()
    assert [(r["id"], r["ordinal"], r["total"]) for r in page] == [(0, 2, 6), (5, 3, 6)]  # newest first within a page
    assert curation.search(a, skip=9).count() == 0 and curation.total(a, q="nothing").first()["total"] == 0
    assert [r["id"] for r in curation.by_source(a, "s").collect()] == [0, 2, 4, 1, 3, 5]
    assert [r["id"] for r in curation.front_page(a).collect()] == [4, 2, 0]
    assert curation.discover_section(a, "National").count() == 6
    with pytest.raises(ValueError):
        curation.discover_section(a, "Gossip")


def test_pages_that_fail_are_told_apart(spark):
    prepared = curation.eligible(spark.createDataFrame([("s", p, 0, "H", "b" * 60, "news") for p in (1, 2, 3)], "source string, pageNumber int, index int, heading string, text string, section string"))

    def client(page):
        number = page[0]["pageNumber"]
        if number == 2:
            raise RuntimeError("429 Too Many Requests")
        if number == 3:
            raise ValueError("bad request")
        return [{"index": 0, "keep": True, "section": "sport", "examRelevance": "high", "title": "T", "summary": "", "refinedBody": "w " * 150, "examTags": None, "reason": ""}]

    verdicts = curation.page_verdicts(prepared, client, attempts=2, wait=0.0)
    report = curation.curation_report(prepared, curation.curate(prepared, verdicts.where("error is null")), verdicts)
    got = {r["pageNumber"]: tuple(r)[2:] for r in report.collect()}
    assert got == {1: (1, 1, 0, None), 2: (1, 0, 1, "429 Too Many Requests"), 3: (1, 0, 1, "bad request")}
    assert curation.is_retryable(RuntimeError("ECONNRESET")) and not curation.is_retryable(ValueError("bad"))


def test_messages_and_passages(spark):
    df = spark.createDataFrame([("p", None), (None, [("a",), (None,), ("b",)]), (None, None)], "plain string, parts array<struct<text:string>>")
    assert [r["r"] for r in df.select(text.message_text(F.col("parts"), F.col("plain")).alias("r")).collect()] == ["p", "ab", ""]
    raw = "```text\n a \t b\n\n\n\nc ```"
    one = spark.createDataFrame([(raw,)], "t string").select(text.clean_passage(F.col("t")).alias("r")).first()["r"]
    assert one == text.passage(raw) == "a b\n\nc" and text.passage(None) == ""


def test_answers_stream_and_passages_are_cleaned(spark, sf):
    chunks = corpus.chunks(spark, sf).where("chunk_id < 40")
    embed, asked, events, seen = hash_embedder(), [], [], []

    def writer(prompt, temperature, max_tokens):
        asked.append((temperature, max_tokens))
        return iter(["two ", "words"])

    def embedded(texts):
        seen.extend(texts)
        return embed(texts)

    llm = lambda p: "```\nA  passage\n```" if p.startswith("passage") else '{"queries": [{"search": "thanea", "vague": true}]}'
    rows = [(r["chunk_id"], embed([r["page_content"]])[0]) for r in chunks.collect()]
    engine = Engine(chunks, spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), None, embedded, llm, writer)
    out = engine.ask("thanea?", mode="research", on_event=events.append)
    assert out["answer"] == "two words" and out["route"] == "hyde+hybrid" and seen == ["A passage"] and asked == [(0.35, 2048)]
    assert [e["text"] for e in events if e["type"] == "token"] == ["two ", "words"]
    engine.ask("thanea?", on_event=events.append)
    assert asked[-1] == (0.2, 1024) and sum(e["type"] == "token" for e in events) == 2


def test_issues_arrive_as_a_stream(spark, tmp_path):
    """Pages of two issues, then a corrected one: its date is replaced, the other stays."""
    from fascicle.operators.chunking import chunk_articles
    from fascicle.streaming.logs import ingest_stream

    def arrive(rows):
        spark.createDataFrame(rows, layout.ITEM_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        items = spark.readStream.schema(layout.ITEM_SCHEMA).parquet(str(tmp_path / "in"))
        ingest_stream(items, str(tmp_path / "out"), str(tmp_path / "ck"), to_chunks).awaitTermination()

    def to_chunks(batch):
        return chunk_articles(layout.articles_of(batch).withColumn("date", F.to_date(F.regexp_extract("source", r"(\d{4}-\d{2}-\d{2})", 1))))

    page = lambda day, words: (f"x-{day}.pdf", 1, 600.0, 0, words, 40.0, 800.0, 9.0, 200.0)
    arrive([page("2026-01-01", "first issue text here"), page("2026-01-02", "second issue text here")])
    arrive([page("2026-01-02", "corrected text of the second issue")])
    arrive([page("2026-01-03", "a third issue with text")])
    got = {str(r["date"]): r["page_content"].rsplit("\n", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2026-01-01": "first issue text here", "2026-01-02": "corrected text of the second issue", "2026-01-03": "a third issue with text"}
