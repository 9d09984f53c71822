"""At-least-once log input: repeated files change nothing, and the state ends."""

from datetime import datetime, timedelta

from fascicle.streaming.logs import closed_windows, store_windows

LINES = "id string, createdAt timestamp, level string"
START = datetime(2024, 1, 1)


class Run:
    def __init__(self, spark, tmp_path):
        self.spark, self.at, self.state = spark, tmp_path, []

    def arrive(self, rows):
        self.spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        lines = self.spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(self.at / "in"))
        query = store_windows(closed_windows(lines, delay="2 hours"), str(self.at / "out"), str(self.at / "ck"))
        query.awaitTermination()
        if query.lastProgress:
            self.state.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))

    def stored(self):
        rows = self.spark.read.schema("start timestamp, level string, n long").parquet(str(self.at / "out")).collect()
        return sorted((r["start"], r["level"], r["n"]) for r in rows)


def day(k, copies=1):
    rows = [(f"{k}-{h}", START + timedelta(days=k, hours=h), "error" if h % 3 else "info") for h in range(24)]
    return rows * copies


def test_repeated_lines_and_files_count_once(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.arrive(day(0, 2) + [(None, START, "error"), ("x", None, "error")])
    assert run.stored() == []
    run.arrive(day(0)[22:] + day(1))  # the end of a file comes again with the next one
    run.arrive(day(1)[23:] + day(2))
    assert run.stored() == [(START + timedelta(days=k), level, n) for k in (0, 1) for level, n in (("error", 16), ("info", 8))]


def test_state_stays_flat_over_thirty_days(spark, tmp_path):
    run = Run(spark, tmp_path)
    for k in range(0, 30, 5):
        rows = [r for d in range(k, k + 5) for r in day(d)]
        run.arrive(rows + rows[-2:])
    assert len(run.stored()) == 29 * 2 and len({s for s, _, _ in run.stored()}) == 29
    assert max(run.state) <= 12 and run.state[-1] <= run.state[0] + 2
