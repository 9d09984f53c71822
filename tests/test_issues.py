"""Issue files as a data source: batch and stream agree, and what is not wanted is not parsed."""

import json
import os
import time
from datetime import date

import pytest

from fascicle.sources import issues


def watched(folder):
    """An opener that leaves a mark for each file that is opened and page that is parsed (local, so that workers get it by value)."""
    os.makedirs(folder, exist_ok=True)
    marks = str(folder)

    class Watched(issues.LineIssue):
        def __init__(self, content):
            import json

            super().__init__(content)
            self.name = json.loads(self.lines[0])[0][1]
            self.mark(f"{self.name}-open")

        def mark(self, what):
            import os

            open(os.path.join(marks, what), "w").close()

        def items(self, page):
            self.mark(f"{self.name}-{page}")
            return super().items(page)

    return Watched


def put(folder, name, label, pages=4, at=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        for p in range(pages):
            f.write(json.dumps([[600.0, f"{label}" if not p and not k else f"{label} {p + 1} {k}", 40.0, 900.0 - k, 9.0, 0.0] for k in range(3)]) + "\n")
    if at:
        os.utime(path, (at, at))


@pytest.fixture
def folder(tmp_path):
    for d in range(1, 5):
        put(tmp_path / "in", f"Issue-{d:02d}-01-2026.pdf", f"d{d}", at=1_700_000_000 + d)
    put(tmp_path / "in" / "more", "2026-01-09.PDF", "d9", pages=1, at=1_700_000_009)
    for odd in ("notes.pdf", "2026-02-30.pdf", "2026-01-02.txt"):
        put(tmp_path / "in", odd, "odd")
    return str(tmp_path / "in")


def test_pushed_dates_and_pages(spark, folder, tmp_path):
    marks = tmp_path / "marks"
    df = issues.read_issues(spark, folder, watched(marks), shares=2).where("date > DATE'2026-01-01' AND date <= DATE'2026-01-03' AND pageNumber >= 3")
    got = {(r["source"], r["date"], r["pageNumber"]) for r in df.collect()}
    assert got == {(f"Issue-0{d}-01-2026.pdf", date(2026, 1, d), p) for d in (2, 3) for p in (3, 4)}
    assert set(os.listdir(marks)) == {f"d{d}-{x}" for d in (2, 3) for x in ("open", 3, 4)}


@pytest.mark.parametrize("where", ["pageNumber = 2", "pageNumber IN (1, 4)", "date = DATE'2026-01-09'", "date IN (DATE'2026-01-01', DATE'2026-01-04') AND pageNumber < 2", "text LIKE '% 3 1'", "pageNumber > 9", "NOT (pageNumber = 1)", "true"])
def test_pushdown_changes_no_row(spark, folder, where):
    df = issues.read_issues(spark, folder, issues.LineIssue)
    whole = [r for r in df.collect()]
    assert len(whole) == 4 * 4 * 3 + 3
    plain = spark.createDataFrame(whole, issues.ISSUE_SCHEMA)
    assert sorted(map(tuple, df.where(where).collect())) == sorted(map(tuple, plain.where(where).collect()))


def test_stream_agrees_with_batch_and_goes_on(spark, folder, tmp_path):
    marks, out = tmp_path / "marks", str(tmp_path / "out")

    def run():
        items = issues.read_issues(spark, folder, watched(marks), start_page=2, stream=True)
        items.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(issues.ISSUE_SCHEMA).parquet(out).collect()))

    batch = lambda: sorted(map(tuple, issues.read_issues(spark, folder, issues.LineIssue, start_page=2).collect()))
    assert run() == batch() and not any(m.endswith("-1") for m in os.listdir(marks))
    put(folder, "Issue-05-01-2026.pdf", "d5", at=time.time())
    for m in os.listdir(marks):
        os.remove(marks / m)
    assert run() == batch()
    assert {m.split("-")[0] for m in os.listdir(marks)} == {"d5"}
    assert run() == batch()


def test_ten_times_the_files(spark, tmp_path):
    """Ten times the files: a date still opens one file."""
    for k in range(40):
        put(tmp_path / "in", f"x-2026-0{k // 20 + 1}-{k % 20 + 1:02d}.pdf", f"f{k}", pages=2)
    marks = tmp_path / "marks"
    df = issues.read_issues(spark, str(tmp_path / "in"), watched(marks)).where("date = DATE'2026-02-07'")
    assert df.count() == 6 and len([m for m in os.listdir(marks) if m.endswith("open")]) == 1


def test_written_issues_come_back(spark, tmp_path):
    rows = [(date(2026, 1, 1 + k % 3), 1 + 2 * (k % 4), 600.0, k, f"t{k}", 1.0, 2.0, 9.0, None) for k in range(60)]
    df = spark.createDataFrame(rows, "date date, pageNumber int, page_width double, item_no int, text string, x double, y double, size double, width double")
    at = "file://" + str(tmp_path / "made")
    issues.write_line_issues(df, at)
    got = issues.read_issues(spark, at, issues.LineIssue).select("date", "pageNumber", "text").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[1], r[4]) for r in rows)
    assert issues.read_issues(spark, str(tmp_path / "none"), issues.LineIssue).count() == 0
