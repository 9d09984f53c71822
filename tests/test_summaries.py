"""Summary refreshes as a stateful stream against a plain fold over each session."""

import random
from datetime import datetime, timedelta

import pytest

from fascicle.streaming import summaries

MESSAGES = "sessionId string, userId string, role string, content string, createdAt timestamp, messageId long"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, summaries.ROCKSDB)
    yield
    spark.conf.set(key, before)


def chat(session, n, start=START, first=1):
    rng = random.Random(f"{session}{first}")
    roles = ["user" if k % 2 == 0 or rng.random() < 0.1 else "assistant" for k in range(n)]
    return [(session, "u", r, rng.choice([f"{r} says  {k}\n", f"word {k} " * 200, ""]), start + timedelta(minutes=first + k), first + k) for k, r in enumerate(roles)]


def plain(rows):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted({(r[5], r[2], r[3]) for r in rows if r[0] == s})
        summary, count, _ = summaries.fold(("", 0, ""), own, summaries.offline)
        if summary:
            out[s] = summary, count
    return out


class Run:
    """A folder that files arrive in, and the stream that reads it on."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.at, self.how, self.files = spark, tmp_path, how, 0

    def arrive(self, rows):
        self.files += 1
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(self.at / "in"))
        query = summaries.store_refreshes(summaries.refreshes(stream, **self.how), str(self.at / "out"), str(self.at / "ck"))
        query.awaitTermination()
        return query

    def current(self):
        rows = summaries.current(self.spark.read.schema(summaries.WRITES).parquet(str(self.at / "out"))).collect()
        return {r["sessionId"]: (r["summary"], r["summaryAtCount"]) for r in rows}


def test_late_and_repeated_messages_give_the_batch_result(spark, rocks, tmp_path):
    rows = chat("a", 14) + chat("b", 9) + chat("only questions", 1)
    run, rng = Run(spark, tmp_path, delay="1 hour"), random.Random(3)
    mixed = rng.sample(rows, len(rows))
    run.arrive(mixed[:10] + [(None, "u", "user", "x", START, 1), ("a", "u", "user", "x", None, 99)])
    run.arrive(mixed[5:18])
    assert run.current() == plain(mixed[:18])
    run.arrive(mixed[16:])
    assert run.current() == plain(rows)
    run.arrive(rows)  # everything once more
    assert run.current() == plain(rows)


def test_what_the_watermark_passed_is_folded_and_idle_sessions_end(spark, rocks, tmp_path):
    """The first messages leave the state when time has passed; an idle session leaves it altogether."""
    run = Run(spark, tmp_path, delay="10 minutes", idle=timedelta(days=2))
    first = chat("a", 6)
    run.arrive(first)
    later = chat("b", 2, START + timedelta(days=1))
    run.arrive(later)
    run.arrive(chat("b", 2, START + timedelta(days=1), 5))
    more = chat("a", 4, START + timedelta(days=1), 7)
    run.arrive(more)
    assert run.current()["a"] == plain(first + more)["a"]
    for k in (5, 9):
        last = run.arrive(chat(f"c{k}", 2, START + timedelta(days=k)))
    held = last.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    again = chat("a", 3, START + timedelta(days=9), 50)
    run.arrive(again)
    assert run.current()["a"] == plain(again)["a"]
    assert held <= 12


def test_a_model_that_says_nothing_keeps_the_old_summary():
    said = iter(["first", "  ", "third"])
    rows = [(k, "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 7)]
    assert summaries.fold(("", 0, ""), rows[:4], lambda *a: next(said)) == ("first", 4, "")
    assert summaries.fold(("", 0, ""), [(1, "assistant", "no question"), (2, "system", "x")], summaries.offline) == ("", 2, "")
    assert summaries.clip("a " * 900, 10) == "a a a a a…"
