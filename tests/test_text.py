"""Hand-worked goldens of text functions, chunk packing and filters."""

import pytest
from pyspark.sql import functions as F

from fascicle.functions import dates, text
from fascicle.functions.filters import build_filter, coerce_filters, compile_filter, section_filter
from fascicle.operators import chunking
from fascicle.operators.chunking import chunk_articles, pack_sentences, packed, split_sentences
from fascicle.plans.ask import Engine, answer_mode, decompose, hash_embedder, json_object, resolve


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, "Rs. 1,20,000 up 3.5% in café 2024 rsvp ₹ 1,234.5", text.tokens) == ["1,20,000", "up", "3.5%", "in", "caf", "2024", "vp", "1,234.5"]
    assert one(spark, "What about the 2024 paper?", text.gate_tokens) == ["2024"]
    assert one(spark, "landslide in 2024 is 1,200 big", text.lexical_tokens) == ["landslide", "1,200", "big", "landslides"]


def test_packing(spark):
    assert pack_sentences("It grew 3.5% in the U.P. state. Next.", 200, 20) == ["It grew 3. 5% in the U. P. state. Next."]
    assert pack_sentences("a b c. d e f. g h i. j k l.", 6, 2) == ["a b c. d e f.", "d e f. g h i.", "g h i. j k l."]
    long = " ".join("w" * 12) + "."
    got = pack_sentences(long + " b c d. e f g.", 10, 2)
    assert len(got) == 3 and got[0] == got[1] == long
    assert pack_sentences("") == [] and pack_sentences("...") == ["..."]
    assert one(spark, None, packed) == []
    for t in ("One. Two! Three? ", "a.b.c", "x”. y", "  q\n\nr. "):
        assert one(spark, t, text.sentences) == split_sentences(t)


def test_chunk_text(spark):
    def fmt(h, b, d):
        return spark.createDataFrame([(h, b, d)], "h string, b string, d string").select(text.format_chunk(F.col("h"), F.col("b"), F.lit(2), F.lit(3), F.col("d")).alias("r")).first()["r"]

    assert fmt("H", "H", None) == "heading - H\nchunk 2/3"
    assert fmt("H", "H body", "2026-01-02") == "date - 2026-01-02\nheading - H\nchunk 2/3\n\nbody"
    assert fmt(" ", "b", None) == "heading - (untitled)\nchunk 2/3\n\nb"
    got = one(spark, fmt("H", "some  body", "2026-01-02"), lambda c: text.parse_chunk(c, F.lit(None)))
    assert (got["heading"], got["chunk_index"], got["chunk_total"], got["excerpt"]) == ("H", 2, 3, "some body")
    stored = fmt("Title", "body", "2026-01-02")
    lex = lambda strip: spark.createDataFrame([(stored, "Title")], "c string, h string").select(text.lexical_text(F.col("c"), F.col("h"), strip).alias("r")).first()["r"]
    assert lex(False) == f"Title\nTitle\n{stored}" and lex(True) == "Title\nTitle\nbody"


def test_small_functions(spark):
    assert one(spark, "q" * 61, text.title_from_question) == "q" * 57 + "…"
    assert one(spark, " ", text.title_from_question) == "New chat"
    assert one(spark, "```json\n{\"a\": [1]}\n``` x", text.json_body) == '{"a": [1]}'
    assert one(spark, "{nope}", text.json_body) is None
    assert one(spark, "[rag] hi", text.console_source) == "rag"
    joined = spark.range(1).select(text.join_pieces(F.array(F.lit("In an an"), F.lit("other step"), F.lit("Next"))).alias("r")).first()["r"]
    assert joined == "In an another stepNext".replace("stepNext", "step Next")
    assert str(one(spark, "a\\b/Issue-05-01-2026.pdf", dates.date_from_name)) == "2026-01-05"
    assert one(spark, "31-02-2026.pdf", dates.date_from_name) is None
    assert one(spark, "a b.pdf", lambda c: dates.public_url("https://h/b", c)) == "https://h/b/a%20b.pdf"


def test_filters(spark):
    f = coerce_filters({"dateFrom": "2026-02-02", "dateTo": "2026-01-15", "section": "Sports", "pageNumber": 0, "whole": "true"})
    assert (f["dateFrom"], f["dateTo"], f["section"], f["pageNumber"], f["whole"]) == ("2026-01-15", "2026-02-02", "sport", None, True)
    assert coerce_filters({"dateFrom": "2026-01-15", "dateTo": "2026-01-15"})["date"] == "2026-01-15"
    assert coerce_filters({"date": "2026-02-30"})["date"] is None and coerce_filters(None)["whole"] is False
    assert section_filter("sports")["section"]["$in"] == ["sport", "SPORT", "Sport", "sports", "SPORTS", "Sports"]
    assert build_filter(f)["$and"][0]["$and"][0] == {"dateInt": {"$gte": 20260115}}
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "n int, s string")
    assert df.where(compile_filter({"n": {"$gt": 0, "$lt": 2}}, df)).count() == 1
    assert df.where(compile_filter({"$or": [{"s": "b"}, {"n": {"$in": [2, "x"]}}]}, df)).count() == 2
    assert df.where(compile_filter({"absent": 1}, df)).count() == 0 and df.where(compile_filter({"n": "1"}, df)).count() == 0
    with pytest.raises(ValueError):
        compile_filter({"n": {"$near": 1}}, df)


def test_requests():
    assert answer_mode("Turbo and Short") == "turbo_short" and answer_mode(None, True) == "turbo_research" and answer_mode("odd") == "normal"
    assert resolve("q", 0)[1] == 3 and resolve("q", 99)[1] == 20 and resolve("q", "2.5")[1] == 2 and resolve("q", 5, turbo=True)[1] == 10
    with pytest.raises(ValueError):
        resolve(" ")
    assert json_object("x {\"a\": 1} y") == {"a": 1} and json_object("{") is None
    d = decompose("q", lambda p: '{"standalone": "s", "queries": ["A  b", {"query": "a B"}, {"search": "c", "vague": true}], "filters": {"pageNumber": 7}}')
    assert d.topics == [{"search": "A b", "vague": False}, {"search": "c", "vague": True}] and d.filters["pageNumber"] == 7 and d.standalone == "s"
    assert decompose("q", lambda p: 1 / 0).topics == [{"search": "q", "vague": False}]


def test_engine(spark, sf):
    from fascicle.operators.lexical import build_index
    from fascicle.sources import corpus

    chunks = corpus.chunks(spark, sf).where("chunk_id < 40")
    embed = hash_embedder()
    rows = [(r["chunk_id"], embed([r["page_content"]])[0]) for r in chunks.collect()]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    events = []
    engine = Engine(chunks, vectors, build_index(chunks), embed)
    out = engine.ask("thanea erthe", k=4, on_event=lambda e: events.append(e["type"]))
    assert len(out["ids"]) == 4 and out["route"] == "hybrid" and events[-2:] == ["result", "done"]
    whole = Engine(chunks, vectors, None, embed, lambda p: '{"queries": ["page 3"], "filters": {"pageNumber": 3, "whole": true}}').ask("all of page 3")
    assert whole["route"] == "get" and whole["ids"] == [r["chunk_id"] for r in chunks.where("pageNumber = 3").orderBy("dateInt", "chunk_id").collect()]


def test_chunk_table_is_idempotent(spark, tmp_path):
    from fascicle.sources.tables import write_chunks

    articles = spark.createDataFrame([("s", "2026-01-01", 1, "news", "H", "One two. Three four."), ("s", "2026-01-02", 1, None, "G", None)], "source string, date string, pageNumber int, section string, heading string, body string").withColumn("date", F.to_date("date"))
    chunks = chunk_articles(articles, 3, 0)
    for _ in range(2):
        write_chunks(chunks, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 3 and back.select("chunk_id").distinct().count() == 3


def test_packing_holds_few_texts_at_a_time():
    """A batch is taken in slices: never more of it than PART texts are Python objects."""
    import pyarrow as pa

    texts, asked = pa.array([f"One {k}. " * (k % 300) for k in range(150)] + [None]), []

    class Batch:
        def __len__(self):
            return len(texts)

        def slice(self, at, n):
            asked.append(n)
            return texts.slice(at, n)

    assert chunking.packed_texts(Batch()).to_pylist() == [chunking.pack_sentences(x or "") for x in texts.to_pylist()]
    assert len(asked) == 3 and max(asked) <= chunking.PART and chunking.packed_texts(texts.slice(0, 0)).to_pylist() == []
