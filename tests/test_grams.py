"""Trigram search against a scan, for expressions of every kind."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fascicle.operators import curation, grams, stores

#: Fifty expressions; those marked in FREE need no trigram.
EXPRESSIONS = [
    "flood", "FLOOD", "river bank", "^minister", "court$", "fl[ou]od", "fl.od", "flo+d", "floods?", "(river|court) rules",
    "(flood|rain)(s|ing)?", "min(i)ster", "(?:abc|def)ghi", "a.*flood.*z", "flood.*river|court", "[0-9]{4}", "19[0-9]{2} flood", "rain{2}", "(rain){2}", "(ab){3}",
    "x*", "", ".", "a|b", "ab", "(flood)?", "(flood)*river", "(flood)+", "\\bflood\\b", "\\d+ people",
    "people\\.", "flood\\s+in", "(?=flood)flood in", "(?!flood)rain", "(?<=the )court", "caf\u00e9", "CAF\u00c9", "\u65e5\u672c\u8a9e", "gr\u00fc\u00dfe", "a{2,3}bc",
    "(a|b)(c|d)(e|f)(g|h)(i|j)", "flood|^$", "co(u(r(t)))", "\\Qflood\\E", "[a-z&&[^b]]ood", "\\p{L}lood", "(?i)flood", "flo(?:od|at)ing", "zzzz", "the (river|court|flood|rain|minister) rules",
]
WORDS = "flood floods river bank minister court rules rain raining rainrain rainn 1987 2024 people. in the café CAFÉ 日本語 grüße GRÜßE ababab aabc aaabc ac bdf acegi floating FLOOD Flood\nin xx z".split(" ")


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(8)
    filler = ["".join(rng.choices("qjkvwyphm", k=7)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(WORDS if rng.random() < 0.3 else filler) for _ in range(n))
    rows = [(k, text(3), text(rng.randrange(12)) if k % 9 else None, [text(1), text(2)] if k % 5 else None, "National", "high") for k in range(1200)]
    rows += [(None, "flood", "flood", ["flood"], "National", "high"), (9000, "", "", [], "National", "low"), (9001, "f", "lood", ["flo", "od"], None, None), (9002, "😀flood😀", "x" * 40_000 + "flood", None, "Edit", "low")]
    return spark.createDataFrame(rows, "id long, title string, summary string, examTags array<string>, section string, examRelevance string").cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect() if r["id"] is not None)


def test_fifty_expressions_equal_a_scan(spark, articles, tmp_path):
    path = str(tmp_path / "ix")
    half = F.col("id") % 2 == 0
    grams.write_grams(articles.where(half), path, curation.searched_texts())
    grams.write_grams(articles.where(~half), path, curation.searched_texts(), append=True)
    scans = [articles.where(F.lit(False)).select(F.lit("").alias("q"), "id")]
    some = 0
    assert len(EXPRESSIONS) == 50
    for q in EXPRESSIONS:
        scans.append(curation.matching(articles, q=q).select(F.lit(q).alias("q"), "id"))
    want = {}
    whole = scans[0]
    for s in scans[1:]:
        whole = whole.unionByName(s)
    for r in whole.collect():
        want.setdefault(r["q"], []).append(r["id"])
    for q in EXPRESSIONS:
        found = grams.candidates(spark, path, q) if q else None
        some += found is not None
        allowed = None if found is None else {r["id"] for r in found.collect()}
        hits = sorted(i for i in want.get(q, []) if i is not None)
        assert allowed is None or set(hits) <= allowed, q
    assert some >= 20  # the others need no trigram, or only such that most rows hold
    for q in ("flood.*river|court", "(rain){2}", "(?<=the )court", "ab", "zzzz", "\\p{L}lood"):
        assert ids(curation.matching(articles, q=q, grams=path)) == sorted(i for i in want.get(q, []) if i is not None)
    assert ids(curation.matching(articles, "National", q="rainn", grams=path)) == ids(curation.matching(articles, "National", q="rainn"))


def test_what_expressions_need():
    need = grams.required
    assert need("flood") == ("and", ("flo", "loo", "ood"))
    assert need("(flood|rain)s") == ("or", (("and", ("flo", "loo", "ood", "ods")), ("and", ("rai", "ain", "ins"))))
    assert need("abc.*def") == ("and", ("abc", "def")) and need("abc+d") == "abc" and need("ABC") == "abc"
    assert all(need(x) is True for x in ("", "ab", "x*", "a|flood", "(flood)*", "[abc]{3}", "\\p{L}lood", "\\vab", "(?x)flood", "(unclosed", "[a-z&&[^b]]ood"))
    assert need("(a|b)(c|d)(e|f)(g|h)(i|j)") is not True
    assert grams.grams_of(need("(?=flood)the")) == {"flo", "loo", "ood", "the"}
    assert re.compile("x") and grams.narrowed(need("flood"), {"flo": 9, "loo": 1, "ood": 5}, {"loo"}) == ("and", ("ood", "flo"))


def test_log_search_through_grams(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("id"))
    logs = spark.range(3000).select("id", F.lit("error").alias("level"), F.lit("api").alias("source"), F.concat(F.lit("Request "), F.col("id").cast("string"), F.lit(" failed")).alias("message"), F.lit("r").alias("requestId"), at.alias("createdAt"))
    grams.write_grams(logs, str(tmp_path / "ix"), [F.col("message")])
    for q in ("request 29[0-9]{2} f", "2911", "29(11|12) failed", "11 FAILED"):
        assert ids(stores.search_logs(logs, q=q, grams=str(tmp_path / "ix"), limit=300)) == ids(stores.search_logs(logs, q=q, limit=300))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, title string, summary string, examTags array<string>, section string, examRelevance string")
    grams.write_grams(none, str(tmp_path / "ix"), curation.searched_texts())
    assert curation.matching(none, q="flood", grams=str(tmp_path / "ix")).count() == 0
