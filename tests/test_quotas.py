"""Calls to a service with a quota: their rate, and what a killed run leaves to do."""

import os

import pytest

from fascicle.sources import quotas

CHUNK = "chunk_id string, page_content string"


def service(log, fail_on=None, once=None):
    """An embedder that writes down when it was called and for what; it fails on a text, always or once."""
    os.makedirs(log, exist_ok=True)

    def embed(texts):
        import os
        import time
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{time.time()}\n" + "\n".join(texts))
        if fail_on in texts:
            raise RuntimeError("killed")
        if once in texts and not os.path.exists(f"{log}.once"):
            open(f"{log}.once", "w").close()
            raise RuntimeError("try again")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def calls(log):
    out = []
    for name in os.listdir(log):
        at, *texts = open(f"{log}/{name}").read().split("\n")
        out.append((float(at), texts))
    return sorted(out)


def rows(spark, n):
    return spark.createDataFrame([(f"c{k:04d}", f"t{k}" if k % 7 else None) for k in range(n)], CHUNK)


def test_calls_stay_within_the_quota(spark, tmp_path):
    """32 lanes: in no second more calls begin than the quota allows, retries included."""
    log, df = str(tmp_path / "log"), rows(spark, 320).repartition(9)
    assert quotas.embed_within_quota(df, str(tmp_path / "out"), service(log, once="t9"), per_second=20, lanes=32, batch=5, wait=0.01) == 64
    times = [t for t, _ in calls(log)]
    assert len(times) == 65
    for k, t in enumerate(times):
        assert sum(t <= x < t + 1.0 for x in times[k:]) <= 20 + 4  # clocks and starts of tasks
    got = {r["chunk_id"]: list(r["embedding"]) for r in quotas.vectors_of(df, str(tmp_path / "out")).collect()}
    assert got == {f"c{k:04d}": [float(len(f"t{k}")) if k % 7 else 0.0, 1.0] for k in range(320)}


def test_a_killed_run_embeds_no_batch_twice(spark, tmp_path):
    log, out, df = str(tmp_path / "log"), str(tmp_path / "out"), rows(spark, 60)
    with pytest.raises(Exception, match="killed"):
        quotas.embed_within_quota(df, out, service(log, fail_on="t31"), per_second=500, lanes=2, batch=5, attempts=1)
    done = [tuple(t) for _, t in calls(log) if "t31" not in t]
    assert 0 < len(done) < 12
    again = str(tmp_path / "again")
    made = quotas.embed_within_quota(df.repartition(5), out, service(again), per_second=500, lanes=3, batch=5)
    second = [tuple(t) for _, t in calls(again)]
    assert made == len(second) == 12 - len(done) and not set(second) & set(done)
    assert quotas.vectors_of(df, out).count() == 60
    assert quotas.embed_within_quota(df, out, service(again), per_second=500, lanes=3, batch=5) == 0


def test_no_chunks(spark, tmp_path):
    assert quotas.embed_within_quota(rows(spark, 0), str(tmp_path / "out"), service(str(tmp_path / "log")), per_second=5) == 0
