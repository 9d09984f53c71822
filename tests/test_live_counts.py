"""Live counts of curated articles against counts from scratch, after each of ten batches."""

import random

from fascicle.streaming import counts


def scratch(live):
    """(sections, pages) of {source: [(page, section, kept)]}."""
    sections, pages = {}, {}
    for source, rows in live.items():
        for page, section, kept in rows:
            if kept:
                sections[section] = sections.get(section, 0) + 1
            raw, k = pages.get((source, page), (0, 0))
            pages[source, page] = raw + 1, k + kept
    return sections, {k: (*v, v[0] - v[1]) for k, v in pages.items()}


def batch_of(rng, live):
    """Verdicts on some sources, and what is then true."""
    rows = []
    for source in rng.sample(["a", "b", "c", "hot"], rng.randrange(1, 4)):
        start = rng.choice([1, 1, 3, 9])
        new = [(rng.randrange(start, 12), rng.choice(["National", "Sports", "Edit"]), rng.random() < 0.7) for _ in range(rng.choice([0, 1, 30, 300 if source == "hot" else 5]))]
        live[source] = [r for r in live.get(source, []) if r[0] < start] + new
        rows += [(source, page, section, kept, start) for page, section, kept in new] or [(source, None, None, None, start)]
    return rows


def test_ten_batches(spark, tmp_path):
    rng, live, path = random.Random(4), {}, str(tmp_path / "changes")
    for k in range(10):
        rows = batch_of(rng, live)
        spark.createDataFrame(rows + [(None, 1, "Edit", True, 1)], counts.VERDICTS).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(counts.VERDICTS).parquet(str(tmp_path / "in"))
        counts.count_stream(stream, path, str(tmp_path / "ck")).awaitTermination()
        sections, pages = scratch(live)
        assert {r["section"]: r["count"] for r in counts.section_counts(spark, path).collect()} == sections
        assert {(r["source"], r["pageNumber"]): (r["raw"], r["kept"], r["dropped"]) for r in counts.page_report(spark, path).collect()} == pages
        if k == 5:
            counts.apply_batch(spark.createDataFrame(rows, counts.VERDICTS), k, path)  # the batch runs again
            counts.compact(spark, path, 4)
            assert {r["section"]: r["count"] for r in counts.section_counts(spark, path).collect()} == sections


def test_no_batch_yet(spark, tmp_path):
    assert counts.section_counts(spark, str(tmp_path / "none")).count() == 0
    assert counts.page_report(spark, str(tmp_path / "none")).count() == 0
