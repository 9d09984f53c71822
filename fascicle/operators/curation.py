"""Curation of articles: eligibility, section names, the gate on a model's verdicts, and reports."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.text import strip, text_or_empty, word_count
from fascicle.operators.grams import narrowed_rows
from fascicle.operators.positions import page, positions

# The sections an article may end in, in their order.
SECTIONS = ("Front Page", "National", "Regional", "Edit", "Op-Ed", "Business", "Foreign", "Sports", "Science")
# Other names of the sections.
ALIASES = (
    ("front page", "Front Page"),
    ("frontpage", "Front Page"),
    ("front", "Front Page"),
    ("main", "Front Page"),
    ("main page", "Front Page"),
    ("national", "National"),
    ("india", "National"),
    ("news", "National"),
    ("regional", "Regional"),
    ("states", "Regional"),
    ("state", "Regional"),
    ("city", "Regional"),
    ("delhi", "Regional"),
    ("telangana", "Regional"),
    ("chennai", "Regional"),
    ("edit", "Edit"),
    ("editorial", "Edit"),
    ("editorials", "Edit"),
    ("op ed", "Op-Ed"),
    ("oped", "Op-Ed"),
    ("op-ed", "Op-Ed"),
    ("opinion", "Op-Ed"),
    ("opinions", "Op-Ed"),
    ("viewpoint", "Op-Ed"),
    ("business", "Business"),
    ("economy", "Business"),
    ("economics", "Business"),
    ("investor", "Business"),
    ("foreign", "Foreign"),
    ("world", "Foreign"),
    ("international", "Foreign"),
    ("sports", "Sports"),
    ("sport", "Sports"),
    ("science", "Science"),
    ("science technology", "Science"),
    ("education", "National"),
    ("environment", "Science"),
    ("climate", "Science"),
    ("ecology", "Science"),
    ("technology", "Science"),
    ("faith", "Regional"),
)
RELEVANCE = ("high", "medium", "low")


def normalize_section(section: Column, fallback: Column | str = "National") -> Column:
    """One of SECTIONS for any label; unknown labels take the fallback."""
    raw = strip(text_or_empty(section))
    key = strip(F.regexp_replace(F.lower(raw), r"[\s_-]+", " "))
    names = F.create_map(*map(F.lit, chain.from_iterable(ALIASES)))
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(raw.isin(*SECTIONS), raw).otherwise(F.coalesce(F.try_element_at(names, key), fallback))


def eligible(articles: DataFrame) -> DataFrame:
    """articles(source, pageNumber, index, heading, text, section) worth a verdict, with body.

    Headings that only label left-over text or letters are out, as are bodies under 50 characters.
    The body is the text without the first copy of its heading.
    """
    h = strip(text_or_empty(F.col("heading")))
    t = text_or_empty(F.col("text"))
    at = F.instr(t, h)
    without = F.when((h != "") & (at > 0), F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(h), F.length(t)))).otherwise(t)
    body = strip(F.regexp_replace(without, r"\s+", " "))
    junk = h.rlike(r"(?i)^page\s*\d+\s+other text$") | h.rlike(r"(?i)^letters?\s+to\s+the\s+editor$")
    return articles.withColumns({"heading": h, "body": body}).where(~junk & (h != "") & (F.length(body) >= 50))


def curate(prepared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Kept articles. verdicts (by source, pageNumber, index): keep, section, examRelevance, title,
    summary, refinedBody, examTags, reason. Verdicts on unknown articles are dropped.

    Out: not kept, relevance none, low relevance with under 200 characters, any body under 80.
    Low relevance that stays becomes medium; so does an unknown one.
    """
    v = verdicts.select("source", "pageNumber", "index", "keep", F.col("section").alias("v_section"), "examRelevance", "title", "summary", "refinedBody", "examTags", "reason")
    j = prepared.join(v, ["source", "pageNumber", "index"])
    body = strip(text_or_empty(F.col("refinedBody")))
    given = F.lower(F.coalesce(F.when(F.col("examRelevance") != "", F.col("examRelevance")), F.lit("medium")))
    keep = F.coalesce("keep", F.lit(False)) & (given != "none") & ~((given == "low") & (F.length(body) < 200)) & (F.length(body) >= 80)
    tags = F.slice(F.filter(F.transform(F.coalesce("examTags", F.array().cast("array<string>")), lambda t: F.lower(strip(text_or_empty(t)))), lambda t: t != ""), 1, 12)
    title = F.when(text_or_empty(F.col("title")) != "", F.col("title")).otherwise(F.col("heading"))
    return j.where(keep).select(
        "source", "pageNumber", F.col("heading").alias("originalHeading"), F.col("section").alias("originalSection"), F.substring(strip(title), 1, 240).alias("title"),
        normalize_section(F.col("v_section"), normalize_section(F.col("section"))).alias("section"), F.when(given == "high", "high").otherwise("medium").alias("examRelevance"),
        F.substring(strip(text_or_empty(F.col("summary"))), 1, 800).alias("summary"), body.alias("refinedBody"), tags.alias("examTags"), word_count(body).alias("wordCount"), F.substring(strip(text_or_empty(F.col("reason"))), 1, 300).alias("keptReason"),
    )


VERDICT_SCHEMA = "source string, pageNumber int, `index` int, keep boolean, section string, examRelevance string, title string, summary string, refinedBody string, examTags array<string>, reason string, error string"
# Answers of a client that are worth another try.
RETRYABLE = r"429|Too Many Requests|fetch failed|ECONNRESET|ETIMEDOUT|Empty AI|not JSON"
RETRY_STATUS = (429, 500, 502, 503, 504)


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status", None) or getattr(getattr(error, "response", None), "status", None)
    return status in RETRY_STATUS or bool(re.search(RETRYABLE, str(error), re.I))


def page_verdicts(prepared: DataFrame, client, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """Verdicts of one client call for each page, pages in parallel (VERDICT_SCHEMA).

    client(list of article dicts) -> list of verdict dicts with an index; it must be picklable. A
    call that fails in a way that may pass is tried again with doubling waits. A page whose call
    fails for good gives one row without an index that holds the error, so an outage can be told
    from a page without relevant articles and never fails the job.
    """
    names = [c.split()[0].strip("`") for c in VERDICT_SCHEMA.split(", ")]

    def page(pdf):
        import time

        import pandas as pd

        pdf = pdf.sort_values("index")
        key, known = [pdf["source"].iloc[0], pdf["pageNumber"].iloc[0]], set(pdf["index"])
        for k in range(attempts):
            try:
                found = [v for v in client(pdf.to_dict("records")) if v.get("index") in known]
                rows = [[*key, v["index"], *(v.get(n) for n in names[3:-1]), None] for v in found]
                break
            except Exception as e:  # noqa: BLE001  an injected client may raise anything
                rows = [[*key, None, *[None] * (len(names) - 4), str(e)[:400]]]
                if k == attempts - 1 or not is_retryable(e):
                    break
                time.sleep(wait * 2**k)
        return pd.DataFrame(rows, columns=names).astype({"index": "Int32"})

    return prepared.groupBy("source", "pageNumber").applyInPandas(page, VERDICT_SCHEMA)


def curate_pages(prepared: DataFrame, client, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """Kept articles by one client call a page; pages that failed keep nothing (see page_verdicts)."""
    return curate(prepared, page_verdicts(prepared, client, attempts, wait).where("error is null"))


def curation_report(prepared: DataFrame, kept: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row for each page of prepared: raw, kept and dropped articles, and the page's error if its call failed."""
    out = prepared.groupBy("source", "pageNumber").agg(F.count("*").alias("raw"))
    out = out.join(kept.groupBy("source", "pageNumber").agg(F.count("*").alias("kept")), ["source", "pageNumber"], "left")
    out = out.select("source", "pageNumber", "raw", F.coalesce("kept", F.lit(0)).alias("kept")).withColumn("dropped", F.col("raw") - F.col("kept"))
    if verdicts is None:
        return out.withColumn("error", F.lit(None).cast("string"))
    return out.join(verdicts.where("error is not null").select("source", "pageNumber", "error"), ["source", "pageNumber"], "left")


def section_counts(articles: DataFrame, by_count: bool = False) -> DataFrame:
    """section, count over SECTIONS: in their order without empty ones, or largest first.

    The sections are nine literals, so the join is a broadcast of nine rows; articles are counted
    before it.
    """
    spark = articles.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(SECTIONS)], "ord int, section string")
    counts = articles.groupBy("section").agg(F.count("*").alias("count"))
    if by_count:
        return counts.orderBy(F.desc("count"), "section")
    return counts.join(F.broadcast(names), "section").orderBy("ord").select("section", "count")


def discover_counts(articles: DataFrame) -> DataFrame:
    """Sections for a landing page: the front page always, others where they have articles."""
    spark = articles.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(SECTIONS)], "ord int, section string")
    counts = articles.groupBy("section").agg(F.count("*").alias("n"))
    out = names.join(counts, "section", "left").select("ord", "section", F.coalesce("n", F.lit(0)).alias("count"))
    return out.where((F.col("count") > 0) | (F.col("section") == SECTIONS[0])).orderBy("ord").drop("ord")


def listing(relevance_ranked: bool = False, pages: bool = True) -> list[Column]:
    """Order of article lists: relevance descending, page, newest first, id.

    Relevance sorts as text (medium, low, high) unless it is to rank as high, medium, low.
    """
    by = F.array_position(F.array(*map(F.lit, RELEVANCE)), F.col("examRelevance")) if relevance_ranked else F.desc("examRelevance")
    return [by, *([F.asc("pageNumber")] if pages else []), F.desc("createdAt"), F.asc("id")]


def front_page(articles: DataFrame) -> DataFrame:
    """Front-page articles in list order; where there are none, page 1 with high or medium relevance,
    most relevant and newest first."""
    front = articles.where(F.col("section") == SECTIONS[0])
    some = front.limit(1).select(F.lit(True).alias("__some"))
    page1 = articles.where((F.col("pageNumber") == 1) & F.col("examRelevance").isin("high", "medium"))
    # `some` has at most one row, so the anti join is a broadcast of one flag. Page 1 is constant in its rows.
    return front.unionByName(page1.join(F.broadcast(some), F.lit(True), "left_anti")).orderBy(*listing())


def searched_texts() -> list[Column]:
    """What a search looks at, as texts to index with grams.write_grams."""
    return [F.col("title"), F.col("summary"), F.array_join("examTags", "\n")]


def matching(articles: DataFrame, section: str | None = None, relevance: str | None = None, q: str | None = None, grams: str | None = None) -> DataFrame:
    """Articles of a section and relevance whose title, summary or a tag q matches: a regular
    expression without regard to case. grams: the folder of a trigram index of all these articles,
    which spares texts that cannot match."""
    c = F.lit(True)
    if section:
        c = c & (F.col("section") == section)
    if relevance:
        c = c & (F.col("examRelevance") == relevance)
    if q and q.strip():
        hit = lambda x: F.coalesce(x.rlike(f"(?i){q.strip()}"), F.lit(False))
        c = c & (hit(F.col("title")) | hit(F.col("summary")) | F.coalesce(F.exists("examTags", hit), F.lit(False)))
        articles = narrowed_rows(articles, grams, q.strip())
    return articles.where(c)


#: Pages that end beyond this place are found by places instead of a sort that keeps all rows before them.
DEEP = 10_000


def search(articles: DataFrame, section: str | None = None, relevance: str | None = None, q: str | None = None, limit: int = 50, skip: int = 0, rank_relevance: bool = False, grams: str | None = None, deep: int = DEEP) -> DataFrame:
    """A page of matching articles in list order, each with its ordinal in the whole list (from 0) and
    the list's total. An empty page has no row; total() still counts.

    A page that ends beyond place `deep` is cut out of the places of all matches (ids and sort keys
    only, ids must be unique); its articles are then read by their ids.
    """
    from pyspark.sql import Window as W

    found, skip, limit = matching(articles, section, relevance, q, grams), max(int(skip or 0), 0), min(max(int(limit or 50), 1), 100)
    if skip + limit > deep:
        placed = positions(found.select("id", "examRelevance", "pageNumber", "createdAt"), listing(rank_relevance))
        count = placed.agg(F.count("*").alias("total")).first()["total"]
        own = page(placed, limit, skip).select("id", F.col("position").alias("ordinal")).collect()
        ids = [r["id"] for r in own]
        own = articles.sparkSession.createDataFrame(own, placed.select("id", F.col("position").alias("ordinal")).schema)
        rows = articles.where(F.col("id").isin(ids) if ids else F.lit(False)).join(F.broadcast(own), "id")
        return rows.select(*articles.columns, "ordinal", F.lit(count).cast("long").alias("total")).orderBy("ordinal")
    order = listing(rank_relevance)
    found_page = found.orderBy(*order).offset(skip).limit(limit)
    # 100 rows at most, numbered in one task; the total is one row.
    found_page = found_page.withColumn("ordinal", (F.row_number().over(W.orderBy(*order)) - 1 + skip).cast("long"))
    return found_page.crossJoin(F.broadcast(total(articles, section, relevance, q, grams))).orderBy("ordinal")


def total(articles: DataFrame, section: str | None = None, relevance: str | None = None, q: str | None = None, grams: str | None = None) -> DataFrame:
    """One row: total, the number of matching articles."""
    return matching(articles, section, relevance, q, grams).agg(F.count("*").alias("total"))


def discover_section(articles: DataFrame, section: str) -> DataFrame:
    """All articles of one section, which must be one of SECTIONS, in list order."""
    if section not in SECTIONS:
        raise ValueError(f"use one of {', '.join(SECTIONS)}")
    return matching(articles, section).orderBy(*listing())


def page_order() -> list[Column]:
    """Order of a source's articles: page, oldest first, id."""
    return [F.asc("pageNumber"), F.asc("createdAt"), F.asc("id")]


def by_source(articles: DataFrame, source: str | None = None) -> DataFrame:
    found = articles.where(F.col("source") == source) if source else articles
    return found.orderBy(*page_order())


def public_articles(articles: DataFrame) -> DataFrame:
    """What readers may see of articles, with defaults for what is absent."""
    have = dict(articles.dtypes)
    given = lambda c, kind, default=None: F.coalesce(F.col(c), default) if c in have and default is not None else F.col(c) if c in have else (default if default is not None else F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    return articles.select(
        F.col("id").cast("string").alias("id"), "title", "section", "examRelevance", given("summary", "string", F.lit("")).alias("summary"), given("refinedBody", "string").alias("refinedBody"),
        given("examTags", "array<string>", none).alias("examTags"), "pageNumber", given("wordCount", "int", F.lit(0)).alias("wordCount"), "source", given("createdAt", "timestamp").alias("createdAt"), given("updatedAt", "timestamp").alias("updatedAt"),
    )


def without_pages_from(articles: DataFrame, source: str, page: int | None = None) -> DataFrame:
    """What stays when a source is curated again from a page on (or entirely)."""
    gone = F.col("source") == source
    gone = gone & (F.col("pageNumber") >= page) if page is not None else gone
    return articles.where(~F.coalesce(gone, F.lit(False)))


def resume(articles: DataFrame, source: str, run: dict | None = None, start: int | None = None, resumed: bool = True) -> tuple[int, DataFrame]:
    """(first page to curate, the articles that stay) of a source.

    run is a saved run (sources.progress). A start page wins over the run's next page. A resumed
    run keeps what lies before its first page; a fresh one starts over.
    """
    page = max(int(start or (run or {}).get("nextPage") or 1), 1) if resumed else max(int(start or 1), 1)
    return page, without_pages_from(articles, source, page if resumed and page > 1 else None)
