"""Registered queries of the retrieval engine, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fascicle.functions import dates, text
from fascicle.functions.filters import build_filter, coerce_columns, coerce_filters, compile_filter
from fascicle.operators import calendar, cells, chunking, curation, grams, layout, lexical, retrieval, segments, stores
from fascicle.operators.positions import positions
from fascicle.sources import corpus
from fascicle.sources.tables import health, shared_folder, spread

QUESTION = "What did the erthe andre say about thanea onthe in 2024?"
TOPICS = [(0, "erthe ingth andre of the"), (1, "thanea onthe reporting"), (2, "erst 2024 tionhe ingst")]
RATIO = lexical.RARE_RATIO


def _topics(spark, rows=TOPICS):
    return spark.createDataFrame(rows, "topic_id int, search string")


def _query_vectors(spark, sf_dir, n=3):
    v = corpus.vectors(spark, sf_dir)
    return v.where(F.col("chunk_id") < n).select(F.col("chunk_id").cast("int").alias("topic_id"), F.col("embedding").alias("query"))


def q01_tokenize_tf(spark, d):
    tf = lexical.term_frequencies(corpus.chunks(spark, d))
    return tf.groupBy("token").agg(F.sum("tf").cast("long").alias("cf"), F.count("*").alias("df"))


def q02_filter_eq_in_range(spark, d):
    tree = {"$or": [{"$and": [{"date": {"$eq": "2026-01-05"}}, {"section": {"$in": ["news", "World", "states", "sport"]}}]}, {"dateInt": {"$gte": 20260110, "$lt": 20260112}, "pageNumber": {"$gt": 3, "$lte": 9}}, {"pageNumber": {"$eq": "3"}}, {"absent": 1}]}
    c = corpus.chunks(spark, d)
    return c.where(compile_filter(tree, c)).select("chunk_id", "date", "pageNumber", "section")


def q03_date_parts(spark, d):
    c = corpus.chunks(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 10 == 0, "2026-02-30").otherwise(F.col("date")).alias("raw"))
    day = dates.iso_date(F.col("raw"))
    return c.select("chunk_id", day.isNotNull().alias("valid"), dates.date_int(day).cast("long").alias("date_int"), F.date_add(day, 3).cast("string").alias("plus3"))


def q04_layout_order(spark, d):
    """The whole table in layout order; the order is the column `position`."""
    c = corpus.chunks(spark, d).select("chunk_id", "dateInt", "pageNumber", "heading", "chunkIndex")
    return retrieval.layout_positions(c).select("chunk_id", "dateInt", "pageNumber", "heading", "position")


def q05_filtered_get(spark, d):
    return retrieval.get_by_filter(corpus.chunks(spark, d), {"$and": [{"pageNumber": 7}, {"dateInt": {"$lte": 20260120}}]}).select("chunk_id", "dateInt", "pageNumber", "heading")


def q06_inverted_index(spark, d):
    index = lexical.build_index(corpus.chunks(spark, d))
    return index.postings.select("token", "chunk_id", F.col("tf").cast("long").alias("tf"), "df")


def q07_rare_tokens(spark, d):
    return lexical.build_index(corpus.chunks(spark, d)).postings.groupBy("token").agg(F.max("df").alias("df"))


def _index(spark, d):
    """The saved index of a corpus, built by the first query of an application that asks for it."""
    path = f"{shared_folder(spark)}/lexical-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    index = lexical.load_index(spark, path, d)
    if index is None:
        lexical.save_index(lexical.build_index(corpus.chunks(spark, d)), path, d)
        index = lexical.load_index(spark, path, d, fresh=True)
    return index


def q08_bm25_topk(spark, d):
    out = lexical.bm25_topk(_index(spark, d), _topics(spark, [(0, QUESTION)]), 10)
    return out.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


def q09_gate(spark, d):
    index = lexical.build_index(corpus.chunks(spark, d), rare_ratio=None)
    return lexical.gate(_topics(spark), index).select("topic_id", "token", "df", "n", "status")


def q10_cosine_topk(spark, d):
    out = retrieval.cosine_topk(corpus.vectors(spark, d), _query_vectors(spark, d, 1), 20, {"label": {"$in": [0, 1, 2, 3, 4]}})
    return out.select("chunk_id", F.round("cosine", 5).alias("cosine"))


def q11_fusion_weights(spark, d):
    n = corpus.chunks(spark, d).agg(F.count("*").alias("n"))
    grid = spark.range(0, 41).select(F.when(F.col("id") < 40, F.col("id")).alias("df")).crossJoin(F.broadcast(n))
    sem, lex = lexical.fusion_weights(F.col("df"), F.col("n"))
    return grid.select("df", F.round(sem, 6).alias("w_sem"), F.round(lex, 6).alias("w_lex"))


def _hybrid(spark, d, rows, k=10, tree=None):
    chunks = corpus.chunks(spark, d)
    index = _index(spark, d)
    topics = _topics(spark, rows)
    return chunks, retrieval.hybrid(chunks, corpus.vectors(spark, d), index, topics, _query_vectors(spark, d, len(rows)), k, tree)


def q12_hybrid_rrf(spark, d):
    _, out = _hybrid(spark, d, [(0, QUESTION)])
    return out.select("chunk_id", F.round("score", 6).alias("score"), F.col("sem_rank").cast("long").alias("sem_rank"), F.col("lex_rank").cast("long").alias("lex_rank"), F.col("rank").cast("long").alias("rank"))


def q13_multi_topic_dedupe(spark, d):
    _, fused = _hybrid(spark, d, TOPICS, 5)
    return retrieval.merge_topics(fused).select("chunk_id", "topic_id", F.col("ordinal").cast("long").alias("ordinal"))


def q14_late_materialise(spark, d):
    chunks, fused = _hybrid(spark, d, TOPICS, 5)
    out = retrieval.fill_content(retrieval.merge_topics(fused), chunks, ("page_content", "pageNumber"))
    return out.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "pageNumber", F.coalesce(F.length("page_content"), F.lit(0)).cast("long").alias("n_chars"))


def q15_pack_sentences(spark, d):
    c = spread(corpus.chunks(spark, d).select("chunk_id", "page_content")).select("chunk_id", F.posexplode(chunking.packed(F.col("page_content"))).alias("at", "piece"))
    return c.select("chunk_id", "at", text.word_count(F.col("piece")).alias("n_words"), F.sha2("piece", 256).alias("digest"))


def q16_sentence_counts(spark, d):
    return corpus.chunks(spark, d).select("chunk_id", F.size(text.sentences(F.col("page_content"))).cast("long").alias("n_sentences"), text.is_complete_sentence(F.col("page_content")).alias("complete"))


def q17_chunk_roundtrip(spark, d):
    c = corpus.chunks(spark, d)
    stored = text.format_chunk(F.col("heading"), F.col("page_content"), F.col("pageNumber"), F.col("pageNumber") + 2, F.col("date"))
    return c.select("chunk_id", text.parse_chunk(stored, F.lit(None)).alias("p")).select("chunk_id", "p.heading", F.col("p.chunk_index").cast("long").alias("chunk_index"), F.col("p.chunk_total").cast("long").alias("chunk_total"), "p.excerpt")


def q18_word_count(spark, d):
    return corpus.chunks(spark, d).select("chunk_id", text.word_count(F.col("page_content")).cast("long").alias("n_words"))


def q19_section_counts(spark, d):
    return curation.section_counts(corpus.curated(spark, d))


def q20_article_page(spark, d):
    """Page two of a search over titles, whole summaries and tags, with ordinals and the total."""
    found = curation.search(corpus.curated(spark, d), q="^[a-m][^\\n]*th|src2$", limit=20, skip=5)
    return found.select("id", "section", "examRelevance", "pageNumber", F.unix_seconds("createdAt").alias("created"), "ordinal", "total")


def q21_sessions(spark, d):
    s = stores.sessions(corpus.messages(spark, d))
    return s.select("sessionId", "userId", "title", F.length("preview").cast("long").alias("preview_chars"), "messageCount", F.unix_seconds("lastMessageAt").alias("last_at"))


def q22_last_summary(spark, d):
    """Every assistant message stands for a summary write; the writes come in no order."""
    m = corpus.messages(spark, d).where("role = 'assistant'").select("sessionId", F.col("content").alias("summary"), ((F.col("messageId") * 7) % 11).alias("summaryAtCount"))
    return stores.latest_summaries(m)


def q23_log_search(spark, d):
    from pyspark.sql import Window as W

    found = stores.search_logs(corpus.logs(spark, d), level="error", q='"k": 1', limit=50)
    return found.select("id", "level", "source", "message", F.row_number().over(W.orderBy(F.desc("createdAt"), F.desc("id"))).cast("long").alias("ordinal"))


def q24_log_counts(spark, d):
    kept = stores.retained(corpus.logs(spark, d), F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return kept.groupBy("level").agg(F.count("*").alias("n"))


def q25_normalize_section(spark, d):
    raw = F.when(F.col("chunk_id") % 5 == 0, F.lit("Op_Ed")).when(F.col("chunk_id") % 5 == 1, F.upper("section")).otherwise(F.concat(F.lit(" "), "section"))
    return corpus.chunks(spark, d).groupBy(curation.normalize_section(raw).alias("section")).agg(F.count("*").alias("n"))


def _curation(spark, d):
    """(prepared articles, verdicts): whole texts, headed by their first three words; the quality label is the verdict."""
    c = corpus.chunks(spark, d)
    title = F.substring_index("page_content", " ", 3)
    prepared = curation.eligible(c.select(F.col("heading").alias("source"), "pageNumber", F.col("chunk_id").alias("index"), title.alias("heading"), F.col("page_content").alias("text"), "section"))
    labels = corpus.read(spark, d, "labels").where("doc_id is not null").select("doc_id", (F.col("quality") == 1).alias("keep"))
    relevance = F.when(F.col("doc_id") % 4 == 0, "HIGH").when(F.col("doc_id") % 4 == 1, "low").when(F.col("doc_id") % 4 == 2, "none").otherwise("odd")
    verdicts = c.join(labels, c.chunk_id == labels.doc_id).select(
        F.col("heading").alias("source"), "pageNumber", F.col("chunk_id").alias("index"), "keep", F.lit("op ed").alias("section"), relevance.alias("examRelevance"), F.lit("").alias("title"), F.col("page_content").alias("summary"), F.col("page_content").alias("refinedBody"), F.array(F.lit("A "), F.lit("")).alias("examTags"), F.lit(None).cast("string").alias("reason")
    )
    return prepared, verdicts


def q26_curation_gate(spark, d):
    kept = curation.curate(*_curation(spark, d))
    return kept.select("source", "pageNumber", "title", "section", "examRelevance", F.array_join("examTags", ",").alias("tags"), F.length("summary").cast("long").alias("summary_chars"), F.col("wordCount").cast("long").alias("wordCount"), F.sha2("refinedBody", 256).alias("body"))


def _days(spark, d):
    """Every day of events as a day of the calendar (each second one has no file), with counts of event types."""
    e = corpus.read(spark, d, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind).alias(kind)
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 2)
    return e.groupBy(day.alias("date")).agg(F.count("*").alias("n"), *(n(k) for k in ("view", "signup", "error", "click", "purchase")))


def _found(spark, d):
    return _days(spark, d).select("date", F.concat(F.lit("in/Issue-"), F.date_format("date", "dd-MM-yyyy"), F.lit(".pdf")).alias("source"), F.lit(1.0).cast("double").alias("sourceMtimeMs"), F.col("n").alias("sourceSize"))


def _progress(spark, d):
    """Days with more errors than sign-ups have a history; with more clicks than views their file has not changed."""
    size = F.when(F.col("click") > F.col("view"), F.col("n")).otherwise(F.lit(1)).cast("long")
    status = F.when(F.col("purchase") > F.col("view"), "complete").otherwise("in_progress")
    old = _days(spark, d).where("error > signup").select("date", F.concat(F.lit("in/Issue-"), F.date_format("date", "dd-MM-yyyy"), F.lit(".pdf")).alias("source"), F.lit(1.0).cast("double").alias("sourceMtimeMs"), size.alias("sourceSize"), status.alias("status"), F.lit(16).alias("totalPages"), F.lit(4).alias("nextPage"), F.lit(7).cast("long").alias("vectorCount"))
    return calendar.sync(old, _found(spark, d), "2026-01-01", "2026-02-10")


def q27_calendar_spine(spark, d):
    return _progress(spark, d).select(F.col("date").cast("string").alias("date"), "status", F.col("nextPage").cast("long").alias("next_page"), "vectorCount")


def q28_status_counts(spark, d):
    return calendar.status_counts(_progress(spark, d))


def q29_file_batch(spark, d):
    from pyspark.sql import Window as W

    queue = calendar.batch(_progress(spark, d), limit=5, start="2026-01-03")[0]
    return queue.select(F.col("date").cast("string").alias("date"), "status", F.row_number().over(W.orderBy("date")).cast("long").alias("ordinal"))


def q30_filename_dates(spark, d):
    c = corpus.chunks(spark, d)
    day = F.col("date").cast("date")
    name = F.when(F.col("chunk_id") % 4 == 0, F.concat(F.lit("a\\b/Issue-"), F.date_format(day, "dd-MM-yyyy"), F.lit(".pdf"))).when(F.col("chunk_id") % 4 == 1, F.concat("date", F.lit(".PDF"))).when(F.col("chunk_id") % 4 == 2, F.lit("x-31-02-2026.pdf")).otherwise(F.lit("notes.pdf"))
    return c.select("chunk_id", dates.base_name(name).alias("name"), dates.date_from_name(name).cast("string").alias("date"))


def q31_coerce_filters(spark, d):
    c = corpus.chunks(spark, d)
    raw = {"date": F.lit(None).cast("string"), "dateFrom": F.lit("2026-01-15"), "dateTo": F.when(F.col("chunk_id") % 6 == 0, "2026-02-30").otherwise(F.col("date")), "pageNumber": F.when(F.col("chunk_id") % 3 == 0, "0").otherwise(F.col("pageNumber").cast("string")), "section": F.upper("section"), "whole": F.when(F.col("chunk_id") % 2 == 0, "true")}
    return c.select("chunk_id", *(v.alias(k) for k, v in coerce_columns(raw).items()))


def q32_json_repair(spark, d):
    c = corpus.chunks(spark, d)
    good = F.concat(F.lit("Sure:\n```json\n{\"a\": "), F.col("chunk_id").cast("string"), F.lit(', "b": [1, 2]}\n``` done'))
    bad = F.concat(F.lit("{\"a\": "), F.col("heading"))
    body = text.json_body(F.when(F.col("chunk_id") % 3 == 0, bad).otherwise(good))
    return c.select("chunk_id", F.get_json_object(body, "$.a").alias("a"), body.isNotNull().alias("valid"))


def _items(spark, d):
    """Page items from HTML headings and paragraphs: one text run a line, headings large."""
    p = corpus.read(spark, d, "pages").select(F.col("page_id"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<(?:h[1-3]|p|li)[^>]*>[^<]{3,}"), F.lit(0)).alias("runs"))
    p = p.select("page_id", F.posexplode("runs").alias("at", "run"))
    head = F.col("run").rlike("(?i)^<h")
    run = F.regexp_replace(F.col("run"), "^<[^>]*>", "")
    return p.select(F.lit("pages").alias("source"), (F.col("page_id") + 1).cast("int").alias("pageNumber"), F.lit(600.0).alias("page_width"), F.col("at").alias("item_no"), run.alias("text"), F.lit(40.0).alias("x"), (2000.0 - 24.0 * F.col("at")).alias("y"), F.when(head, 18.0).otherwise(9.0).alias("size"), F.lit(0.0).alias("width"))


def q33_layout_articles(spark, d):
    return layout.articles_of(_items(spark, d)).select("source", "pageNumber", "article_no", "heading", F.length("body").alias("body_chars"))


def q34_line_segments(spark, d):
    return layout.lines_of(_items(spark, d)).select("pageNumber", "line_no", "text", "col")


def q35_log_stream_equals_batch(spark, d):
    """The streaming counts over the table's file, read to its end."""
    import uuid

    from fascicle.streaming.logs import level_counts

    source = corpus.read(spark, d, "events")
    lines = spark.readStream.schema(source.schema).parquet(d + "/events.parquet*").select(F.col("ts").cast("timestamp").alias("createdAt"), F.col("event_type").alias("level"))
    name = f"counts_{uuid.uuid4().hex}"
    kept = f"{shared_folder(spark)}/{name}"
    level_counts(lines).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("date").cast("string").alias("day"), "level", "n")


def q36_front_page(spark, d):
    """Both routes over all articles: the front page, and its fallback where no article is on one."""
    a = corpus.curated(spark, d)
    none = a.withColumn("section", F.when(F.col("section") == "Front Page", "National").otherwise(F.col("section")))
    route = lambda df, name: curation.front_page(df).select("id", "examRelevance", "pageNumber", "createdAt", F.lit(name).alias("route"))
    both = route(a, "own").unionByName(route(none, "fallback"))
    # One list a route: what a landing page shows, with places from 1.
    return positions(both, curation.listing(), ["route"]).select("route", "id", "examRelevance", "pageNumber", (F.col("position") + 1).alias("ordinal"))


def q37_discover_counts(spark, d):
    return curation.discover_counts(corpus.curated(spark, d))


def q38_archive(spark, d):
    from pyspark.sql import Window as W

    stored = _days(spark, d).where("click > purchase").select("date", F.concat(F.lit("s-"), F.col("date").cast("string")).alias("filename"), F.lit(9).cast("long").alias("sizeBytes"))
    out = calendar.archive(_progress(spark, d), stored)
    return out.select(F.col("date").cast("string").alias("date"), "filename", "sizeBytes", F.col("totalPages").cast("long").alias("totalPages"), F.row_number().over(W.orderBy(F.desc("date"))).cast("long").alias("ordinal"))


def q39_user_upsert(spark, d):
    """All events are sign-ins: those before the 16th are in the stored table, the others are upserted."""
    e = corpus.read(spark, d, "events").select(F.col("user_id").cast("string").alias("googleId"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x")).alias("email"), F.when(F.col("event_type") == "signup", F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("picture"), F.col("ts").cast("timestamp").alias("at"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    old = e.where(F.col("at") < cut).groupBy("googleId").agg(F.min("email").alias("email"), F.lit("old").alias("name"), F.lit("p").alias("picture"), F.max("at").alias("lastLoginAt"), F.count("*").alias("loginCount"))
    out = stores.upsert_users(old, e.where(F.col("at") >= cut))
    return out.select("googleId", "email", "name", "picture", "loginCount", F.unix_micros("lastLoginAt").alias("last_at"))


def q40_health(spark, d):
    return health(corpus.vectors(spark, d))


def q41_section_report(spark, d):
    return curation.section_counts(corpus.curated(spark, d), by_count=True)


def q42_sanitized_meta(spark, d):
    meta = F.to_json(F.struct(F.lit("x").alias("JWT"), F.col("props").alias("props"), F.array(F.lit(1), F.lit(2)).alias("list")))
    return corpus.read(spark, d, "events").select("event_id", stores.sanitized(meta).alias("meta"))


def q43_scalar_texts(spark, d):
    """Normalised text, cleaned passage, tidied heading and lexical text of whole texts, as digests."""
    c = corpus.chunks(spark, d)
    sha = lambda x: F.sha2(x, 256)
    fenced = F.concat(F.lit("```text\n"), "page_content", F.lit("\n\n\n\nend \t x\n```"))
    heading = F.concat(F.lit("‘A title’ of. The 1234567 "), "heading")
    return c.select(
        "chunk_id", sha(text.normalize(F.col("page_content"))).alias("normal"), sha(text.clean_passage(fenced)).alias("passage"), text.cleanup_heading(heading).alias("heading"),
        sha(text.context(F.col("date"), F.col("pageNumber"), F.col("section"), F.col("page_content"))).alias("context"), sha(text.lexical_text(F.col("page_content"), F.lit("Page 3 other text"))).alias("lexical"),
    )


def q44_filtered_bm25(spark, d):
    """BM25 under a metadata filter: df, n and lengths stay global."""
    chunks = corpus.chunks(spark, d)
    out = lexical.bm25_topk(_index(spark, d), _topics(spark), 10, {"pageNumber": {"$lte": 6}}, chunks)
    return out.select("topic_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


def q45_topic_weights(spark, d):
    """The gate of three topics and the fusion weights that follow."""
    out = lexical.topic_weights(lexical.gate(_topics(spark), _index(spark, d)))
    return out.select("topic_id", "token", "df", "open", F.round("w_sem", 6).alias("w_sem"), F.round("w_lex", 6).alias("w_lex"))


def q46_get_by_ids(spark, d):
    """Chunks of every question's numbers, null and unknown ones among them."""
    ids = corpus.read(spark, d, "benchmark").select(F.when(F.col("item_id") > 0, F.col("item_id") * 3).alias("chunk_id"))
    return retrieval.get_by_ids(corpus.chunks(spark, d), ids.unionByName(ids)).select("chunk_id", "date", "section")


def q47_discover_files(spark, d):
    """One issue a date from a listing with both name forms, odd names and other kinds of files."""
    c = corpus.chunks(spark, d)
    day = F.col("date").cast("date")
    name = F.when(F.col("chunk_id") % 4 == 0, F.concat(F.lit("in/x-"), F.date_format(day, "dd-MM-yyyy"), F.lit(".pdf"))).when(F.col("chunk_id") % 4 == 1, F.concat(F.lit("in/"), "date", F.lit(".PDF"))).when(F.col("chunk_id") % 4 == 2, F.concat(F.lit("in/"), "date", F.lit(".txt"))).otherwise(F.lit("in/notes.pdf"))
    files = c.select(name.alias("path"), F.timestamp_seconds(F.col("dateInt")).alias("modificationTime"), F.lit(10).cast("long").alias("length")).distinct()
    found, skipped = calendar.discover(files)
    named = skipped.groupBy("name").agg(F.count("*").alias("n"))
    return found.select(F.col("date").cast("string").alias("date"), "source", F.col("sourceMtimeMs").cast("long").alias("mtime")).unionByName(named.select(F.lit(None).cast("string").alias("date"), F.col("name").alias("source"), F.col("n").cast("long").alias("mtime")))


def q48_resolve_issue(spark, d):
    """The file to serve for every day of the calendar, a blank date and things that are no date."""
    asked = _progress(spark, d).select(F.col("date").cast("string").alias("date"))
    odd = spark.sql("SELECT * FROM VALUES (''), ('2026-02-30'), ('today'), ('2031-05-06') AS t(date)")
    return calendar.resolve(asked.unionByName(odd), _progress(spark, d), "https://store.example/issues", "latest.pdf").select("date", "valid", "filename", "url", "remoteUrl", F.col("totalPages").cast("long").alias("totalPages"), "sizeBytes")


def q49_calendar_summary(spark, d):
    """Whether all present files are complete, the vectors, and the missing dates."""
    return calendar.summary(_progress(spark, d)).select("complete", "vectorCount", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def q50_curation_report(spark, d):
    """Raw, kept and dropped articles of each page."""
    prepared, verdicts = _curation(spark, d)
    return curation.curation_report(prepared, curation.curate(prepared, verdicts)).select("source", "pageNumber", "raw", "kept", "dropped")


def q51_public_sessions(spark, d):
    """Sessions and messages as their owner sees them."""
    m = corpus.messages(spark, d)
    s = stores.public_sessions(stores.sessions(m)).select("id", "title", F.length("preview").cast("long").alias("chars"), F.col("messageCount").cast("long").alias("n"))
    return s.unionByName(stores.public_messages(m).select("id", F.col("role").alias("title"), F.length("content").cast("long").alias("chars"), F.lit(1).cast("long").alias("n")))


def q52_compact_sources(spark, d):
    """The first sources of an answer that drew on every chunk of a page, with short excerpts."""
    c = corpus.chunks(spark, d)
    # An answer keeps its first sources and the heads of their texts: nothing else is gathered.
    place = F.row_number().over(Window.partitionBy("date", "pageNumber").orderBy("chunk_id"))
    c = c.withColumn("page_content", F.substring("page_content", 1, stores.EXCERPT)).withColumn("place", place).where(F.col("place") <= stores.MOST_SOURCES)
    one = F.struct("chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.col("heading")).alias("heading"), "pageNumber", "date", "section", F.col("page_content").alias("excerpt"))
    pages = c.groupBy("date", "pageNumber").agg(F.array_sort(F.collect_list(one)).alias("sources"))
    out = pages.select("date", "pageNumber", F.posexplode(stores.compact_sources(F.col("sources"))).alias("at", "s"))
    return out.select("date", "pageNumber", F.col("at").cast("long").alias("at"), "s.id", "s.heading", F.length("s.excerpt").cast("long").alias("chars"))


def q53_recent_sessions(spark, d):
    """A user's sessions, newest first, and the messages of all sessions in order."""
    from pyspark.sql import Window as W

    s = stores.recent_sessions(stores.sessions(corpus.messages(spark, d)), "u3", 100)
    return s.select("sessionId", "title", F.row_number().over(W.orderBy(F.desc("lastMessageAt"), "sessionId")).cast("long").alias("ordinal"))


def q54_public_articles(spark, d):
    """Article cards of every article: defaults stand where a field is absent."""
    out = curation.public_articles(corpus.curated(spark, d))
    return out.select("id", "title", "section", F.length("summary").cast("long").alias("chars"), F.size("examTags").cast("long").alias("tags"), F.col("wordCount").cast("long").alias("wordCount"), F.unix_seconds("createdAt").alias("created"))


def q55_built_filters(spark, d):
    """Chunks under filters that are built from a model's raw answers: ranges, one day, page and section."""
    c = corpus.chunks(spark, d)
    raw = [{"dateFrom": "2026-01-20", "dateTo": "2026-01-08", "section": " Sports "}, {"date": "2026-01-11", "section": "gossip"}, {"dateFrom": "2026-01-09", "dateTo": "2026-01-09", "pageNumber": "5"}, {"dateTo": "2026-01-02", "pageNumber": 2.5}]
    found = [c.where(compile_filter(build_filter(coerce_filters(r)), c)).select(F.lit(k).alias("filter"), "chunk_id", "date", "pageNumber", "section") for k, r in enumerate(raw)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def q56_hybrid_fallbacks(spark, d):
    """A topic whose gate is shut falls back to its semantic rows; another one beside it does not."""
    _, out = _hybrid(spark, d, [(0, "the of and into"), (1, "thanea onthe reporting")], 8)
    return out.select("topic_id", "chunk_id", F.round("score", 6).alias("score"), F.col("sem_rank").cast("long").alias("sem_rank"), F.col("lex_rank").cast("long").alias("lex_rank"), F.col("rank").cast("long").alias("rank"))


def q57_stored_chunks(spark, d):
    """Stored chunks of every document as an article: ids, places and texts."""
    c = corpus.chunks(spark, d)
    articles = c.select(F.lit("issue").alias("source"), F.col("date").cast("date").alias("date"), "pageNumber", "section", F.concat("heading", F.lit(" "), F.col("chunk_id").cast("string")).alias("heading"), F.col("page_content").alias("body"))
    out = chunking.chunk_articles(articles)
    return out.select("chunk_id", F.col("date").cast("string").alias("date"), "dateInt", "pageNumber", "pageStart", "section", "heading", F.col("chunkIndex").cast("long").alias("chunkIndex"), F.col("chunkTotal").cast("long").alias("chunkTotal"), F.sha2("page_content", 256).alias("content"))


def q58_console_lines(spark, d):
    """Sources of log lines, and pieces of texts joined over cut words."""
    e = corpus.read(spark, d, "events")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("[page/"), F.col("user_id").cast("string"), F.lit("] opened"))).when(F.col("event_type") == "error", F.lit("api listening on 80")).when(F.col("event_type") == "click", F.lit("RAG ready")).otherwise(F.col("event_type"))
    pieces = F.array(F.lit(" In  an an"), F.concat(F.lit("other "), F.col("event_type")), F.lit(""), F.lit("Next"))
    return e.select("event_id", text.console_source(line).alias("source"), text.join_pieces(pieces).alias("joined"))


def q59_public_users(spark, d):
    """Accounts as their owners see them, from every event as a sign-in."""
    e = corpus.read(spark, d, "events").select(F.col("user_id").cast("string").alias("googleId"), F.lit("").alias("email"), F.when(F.col("event_type") == "signup", F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("picture"), F.col("ts").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "googleId string, email string, name string, picture string, lastLoginAt timestamp, loginCount long")
    return stores.public_users(stores.upsert_users(none, e)).select("id", "email", "emailVerified", "name", "picture", "provider", "loginCount", F.unix_micros("lastLoginAt").alias("last_at"))


def q60_articles_by_source(spark, d):
    """Every source's articles in page order, oldest first on a page."""
    a = corpus.curated(spark, d).select("source", "id", "pageNumber", "createdAt")
    return positions(a, curation.page_order(), ["source"]).select("source", "id", (F.col("position") + 1).alias("ordinal"))


def q61_marked_progress(spark, d):
    """Progress after one date is marked complete, and after all present files start over."""
    p = _progress(spark, d)
    done = calendar.mark(p, "2026-01-07", status="complete", nextPage=17, vectorCount=99)
    both = done.withColumn("after", F.lit("mark")).unionByName(calendar.reset(p).withColumn("after", F.lit("reset")))
    return both.select("after", F.col("date").cast("string").alias("date"), "status", F.col("nextPage").cast("long").alias("next_page"), "vectorCount", F.col("totalPages").cast("long").alias("totalPages"))


def q62_recurated_pages(spark, d):
    """What stays of all articles when one source is curated again from page 9 on."""
    _, left = curation.resume(corpus.curated(spark, d), "src3.pdf", {"nextPage": 9})
    return left.select("id", "source", "pageNumber")


def _segmented(spark, d):
    """A folder of index segments with a history: headings alone first, then whole texts in three
    replacements of dates, one of which comes twice, and a compaction between them."""
    path = f"{shared_folder(spark)}/segments-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    if segments.manifest(spark, path):
        return path
    c = corpus.chunks(spark, d)
    early, middle, late = F.col("date") < "2026-01-11", F.col("date").between("2026-01-11", "2026-01-20"), F.col("date") > "2026-01-20"
    segments.replace_dates(c.withColumn("page_content", F.when(early, F.col("page_content")).otherwise(F.col("heading"))), path)
    segments.replace_dates(c.where(late).withColumn("page_content", F.reverse("page_content")), path)
    segments.replace_dates(c.where(late), path)
    segments.compact(spark, path, 2)
    segments.replace_dates(c.where(middle), path)
    return path


def q63_segment_tokens(spark, d):
    """Rare tokens of an index whose dates were replaced: those of an index built anew."""
    return segments.rare_tokens(spark, _segmented(spark, d))


def q64_segment_bm25(spark, d):
    """BM25 of three topics over the live segments."""
    out = lexical.bm25_topk(segments.open_segments(spark, _segmented(spark, d)), _topics(spark), 10)
    return out.select("topic_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


def q65_summary_stream(spark, d):
    """Every chat's rolling summary, from the table read as a stream of files in any order."""
    import uuid

    from fascicle.streaming import summaries

    own = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    # A table has no order of arrival: its whole span of time is the delay within which messages may come.
    span = corpus.messages(spark, d).agg(F.unix_seconds(F.max("createdAt")) - F.unix_seconds(F.min("createdAt"))).first()[0] or 0
    schema = corpus.read(spark, d, "conversations").schema
    provider, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(provider, summaries.ROCKSDB)
    try:
        lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(d + "/conversations.parquet*")
        writes = summaries.refreshes(corpus.messages_of(lines), delay=f"{span} seconds")
        summaries.store_refreshes(writes, f"{own}/writes", f"{own}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    stored = spark.read.schema(summaries.WRITES).parquet(f"{own}/writes")
    return summaries.current(stored).select(F.col("sessionId").cast("long").alias("sessionId"), "summary", F.col("summaryAtCount").cast("long").alias("summaryAtCount"))


def _cells(spark, d):
    """The vectors in cells, indexed by the first query of an application that asks for them."""
    path = f"{shared_folder(spark)}/cells-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    try:
        return cells.Cells(spark, path)
    except LookupError:
        cells.write_cells(corpus.vectors(spark, d), path, 32)
        return cells.Cells(spark, path)


def q66_cell_search(spark, d):
    """Three exact cosine searches under a filter that skip cells by triangle bounds."""
    found = _cells(spark, d).search(_query_vectors(spark, d, 3), 20, {"label": {"$in": [0, 1, 2, 3, 4]}})
    return found.rows.select("topic_id", "chunk_id", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


#: Expressions with needed trigrams in a row, in alternatives, around repeats, and without any.
EXPRESSIONS = ("thanea.*onthe", "(erthe|ingth)[a-z]+ andre", "fr article 1[0-9]?$", "^..$", "src2|erst(ion)?he", "repo(rt)+ing", "ab|zz", "qqqq?x")


def q67_regex_search(spark, d):
    """Articles that regular expressions find through trigram postings."""
    a = corpus.curated(spark, d)
    path = f"{shared_folder(spark)}/grams-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    grams.write_grams(a, path, curation.searched_texts())
    found = [curation.matching(a, q=x, grams=path).select(F.lit(k).alias("expression"), "id", "section") for k, x in enumerate(EXPRESSIONS)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def q68_deep_page(spark, d):
    """A page of all articles so deep that places find it, not a sort of all before it."""
    found = curation.search(corpus.curated(spark, d), limit=100, skip=150, deep=100)
    return found.select("id", "section", "examRelevance", "pageNumber", F.unix_seconds("createdAt").alias("created"), "ordinal", "total")


def q69_issue_source(spark, d):
    """Articles of issue files behind a data source, with dates and pages pushed into it.

    The files are made of all test pages, a hundred an issue; the folder is read back from page 2 on.
    """
    import uuid

    from fascicle.sources import issues

    folder = f"{shared_folder(spark)}/issues-{uuid.uuid4().hex}"
    page = F.col("pageNumber") - 1
    items = _items(spark, d).withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), F.floor(page / 100).cast("int"))).withColumn("pageNumber", (page % 100 + 1).cast("int"))
    issues.write_line_issues(items, folder)
    found = issues.read_issues(spark, folder, issues.LineIssue).where("pageNumber >= 2")
    return layout.articles_of(found).select("source", "pageNumber", "article_no", "heading", F.length("body").alias("body_chars"))


def q70_closed_windows(spark, d):
    """Daily counts of log lines from a source that delivers each line twice, for the days that are over."""
    import uuid

    from fascicle.streaming import logs

    own = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    schema = corpus.read(spark, d, "events").schema
    lines = lambda: spark.readStream.schema(schema).parquet(d + "/events.parquet*").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("createdAt"), F.col("event_type").alias("level"))
    logs.store_windows(logs.closed_windows(lines().unionByName(lines())), f"{own}/out", f"{own}/checkpoint").awaitTermination()
    out = spark.read.schema("start timestamp, level string, n long").parquet(f"{own}/out")
    return out.select(F.to_date("start").cast("string").alias("day"), "level", "n")


def q71_live_counts(spark, d):
    """Kept articles by section, counted by a stream: all at first under wrong sections, then curated
    again, source by source, in two more batches, the second from page 1 and page 9 on."""
    import uuid

    from fascicle.streaming import counts

    own = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    a = corpus.curated(spark, d).select("source", "pageNumber", "section", F.lit(True).alias("kept"), F.lit(1).alias("fromPage"))
    early = F.col("pageNumber") < 9
    wrong = a.withColumn("section", F.when(early & (F.col("source") >= "src3"), F.col("section")).otherwise(F.lit("Sports")))
    for part in (wrong, a.where("source < 'src3'"), a.where("source >= 'src3'").where(~early).withColumn("fromPage", F.lit(9))):
        part.write.mode("append").parquet(f"{own}/in")
        verdicts = spark.readStream.schema(counts.VERDICTS).parquet(f"{own}/in")
        counts.count_stream(verdicts, f"{own}/changes", f"{own}/checkpoint").awaitTermination()
    return counts.section_counts(spark, f"{own}/changes")


def q72_health_report(spark, d):
    """What the archive says of itself while files are still to be read, and for a collection without vectors."""
    v, p = corpus.vectors(spark, d), _progress(spark, d)
    both = calendar.health_report(v, p, "news").unionByName(calendar.health_report(v.where("label > 99"), p, "none"))
    return both.withColumns({"date": F.col("date").cast("string"), "nextPage": F.col("nextPage").cast("long"), "totalPages": F.col("totalPages").cast("long")})


def queries():
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q12_hybrid_rrf(spark, sf_dir)
