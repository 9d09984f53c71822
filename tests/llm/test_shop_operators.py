"""Cohort matrix, spelling variants and the mix against brute force, on odd rows and over several batches."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fascicle.llm import cohort_retention as cohort
from fascicle.llm import mix_sources, spelling_groups

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, users long, late string, start int"
CLIENTS = "client_id long, source string, cohort int"
DOCS = "doc_id long, text string, source string, size string, position int, word string"
crc = lambda x: zlib.crc32(str(x).encode())
NULLS = ("client_id",)


def clicks(n=1500, seed=5):
    rng, out = random.Random(seed), []
    for k in range(n):
        ts = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(120 * 86400 * 10**6))
        client = rng.choice([7] * 60 + list(range(300)))
        out.append((k, ts, ts + timedelta(hours=rng.randrange(900)), client, rng.choice(["error", "view", "click", None]), rng.choice([None, 1.005, -2.5, float("nan"), float("inf"), 3.0]), "{}", 1, "x", 2))
    start = datetime(2024, 1, 10, 5, 0, 0, 1)
    week = timedelta(days=7)
    exact = [(start, "error"), (start + week - timedelta(microseconds=1), "view"), (start + week, "view"), (start - timedelta(microseconds=1), "view")]
    out += [(9000 + k, ts, ts, 500, kind, 1.0, "{}", 1, "x", 2) for k, (ts, kind) in enumerate(exact)]
    out += [(9100, None, start, 1, "error", 1.0, "{}", 1, "x", 2), (9101, start, start, None, "error", 1.0, "{}", 1, "x", 2), (9102, start, None, 501, "error", 1.0, "{}", 1, "x", 2), (None, start, start, 502, "error", 1.0, "{}", 1, "x", 2)]
    out += [(9200, datetime(1969, 12, 30, 1), datetime(1970, 1, 1), 503, "error", 1.0, "{}", 1, "x", 2)]
    return out + out[:50]


def brute_cells(rows, sources, keep):
    """Cells of the rows that keep(row) knows, with every client's cohort."""
    seen, start, share = {r for r in rows if r[1] is not None and r[3] is not None and keep(r)}, {}, defaultdict(int)
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for r in seen:
        if r[4] == "error":
            start[r[3]] = min(start.get(r[3], 1 << 62), us(r[1]))
    for r in seen:
        if r[3] in start and us(r[1]) >= start[r[3]]:
            v = r[5]
            ok = v is not None and v == v and abs(v) != float("inf")
            share[r[3], start[r[3]] // cohort.WEEK, (us(r[1]) - start[r[3]]) // cohort.WEEK] += int((100 * v + 0.5) // 1) if ok else 0
    return share, {c: s // cohort.WEEK for c, s in start.items()}


def brute_retention(rows, sources, cut):
    def early(r):
        h = crc(r[0]) if r[0] is not None else 1
        return r[2] is not None and r[2] + timedelta(days=h % 100 if h % 3 == 0 else 0) < cut

    states = [brute_cells(rows, sources, early), brute_cells(rows, sources, lambda r: True)]
    moved = {c for c in states[0][1] if states[0][1][c] != states[1][1][c]}
    out = defaultdict(lambda: [0, 0, 0, 0])
    for k, (share, _) in enumerate(states):
        for (c, week, period), cents in share.items():
            cell = out[k, sources.get(c) or "", week, period]
            for i, v in enumerate((1, crc(c), c in moved, cents)):
                cell[i] += v
    return {(*k, *v) for k, v in out.items()}, moved


def dedupe_nan(rows):
    """Rows with one NaN object, so that sets treat equal rows as equal."""
    nan = float("nan")
    return [tuple(nan if isinstance(v, float) and v != v else v for v in r) for r in rows]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_retention_brute(spark, zone):
    rows = dedupe_nan(clicks())
    sources = {c: ["web", "app", None][c % 3] for c in range(30)}
    people = [(c, s, 1) for c, s in sources.items()] + [(None, "web", 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {tuple(r) for r in cohort.retention(spark.createDataFrame(rows, CLICKS), spark.createDataFrame(people, CLIENTS)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want, moved = brute_retention(rows, sources, datetime(2024, 2, 1))
    assert len(moved) > 3 and got == want


def test_retention_batches_equal_rebuild(spark):
    """Three batches of deltas in a row give the cells, starts and shares of a state from scratch."""
    schema = "client_id long, at long, starts boolean, cents long"
    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.randrange(30 * cohort.DAY), rng.random() < 0.1, rng.randrange(100)) for _ in range(2000)]
    people = spark.createDataFrame([(c, "web" if c % 2 else None) for c in range(15)], "client_id long, segment string")
    part = lambda a, b: spark.createDataFrame(rows[a:b], schema)
    state = cohort.materialise(part(0, 600), people)
    for a, b in ((600, 1000), (1000, 1010), (1010, 2000)):
        state, cells, _ = cohort.advance(state, part(a, b), people)
        want = cohort.materialise(part(0, b), people)
        bare = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
        assert bare(cells, "segment", "cohort", "period", "users", "users_crc32", "cents") == bare(want.cells, "segment", "cohort", "period", "users", "users_crc32", "cents")
        assert bare(state.starts, "client_id", "start") == bare(want.starts, "client_id", "start")
        assert bare(state.shares, "client_id", "cohort", "period", "cents") == bare(want.shares, "client_id", "cohort", "period", "cents")


def test_retention_empty(spark):
    none, nobody = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohort.retention(none, nobody).collect() == []
    rows = [r for r in clicks(50) if r[0] is not None and r[0] < 50]
    assert cohort.retention(spark.createDataFrame(rows, CLICKS), nobody).where("segment <> ''").count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_spelling(rows):
    import re

    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc(f"{'' if doc is None else doc}:{run}")
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, count = {}, {}
    for w in n:
        close = [v for v in n if near(v, w)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def spelled(rng):
    """Words with variants of falling counts, so that chains of several forms arise."""
    base = ["alphabet", "ÀÉÿzzz", "oooooo", "oooooooo", "abababab", "München", "documents", "×÷×÷×÷"]
    texts = []
    for w in base:
        n = 700
        while n >= 5:
            texts += [w] * n
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]])
            n //= 5
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_spelling_brute(spark, seed):
    rng = random.Random(seed)
    words = spelled(rng)
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40]) + rng.choice([" ", "1", "😀", "\n"])) for k in range(40)]
    rows += [(None, None), (3, ""), (None, "alphabet " * 9), (5, "x" * 30_000), *[rows[1]] * 3]
    got = spelling_groups.spelling_groups(spark.createDataFrame([(a, b, "s", "1", 2, "w") for a, b in rows], DOCS))
    got = {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_spelling(rows)
    assert max(Counter(r[2] for r in got).values()) >= 3


def test_spelling_empty_and_chains(spark):
    assert spelling_groups.spelling_groups(spark.createDataFrame([], DOCS)).count() == 0
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w37"), ("b", "a")]
    got = dict(map(tuple, spelling_groups.roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert len(got) == len(links) and set(got.values()) == {"w37"}


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, free = {}, set(size)
    while free:
        rate = (sum(size.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 3 * size[s]}
        if not over:
            return fixed | {s: weight[s] * rate for s in free}
        fixed |= {s: 3 * size[s] for s in over}
        free -= over
    return fixed


def mixed(spark, rows):
    out = mix_sources.mix(spark.createDataFrame([(*r, "1", 2, "w") for r in rows], DOCS))
    return [tuple(r) for r in out.select("doc_id", "source", "size", "source_size", "target", "taken").collect()]


def test_mix_holds_its_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * int(rng.paretovariate(0.9) * 5 % 5000), rng.choice(["big"] * 8 + ["a", "é", "Z", "tiny" if k < 9 else "a", None])) for k in range(6000)]
    rows += [(None, None, "a"), (1, "", None), (2, "x\tx\x0bx x", "only"), *[rows[5]] * 4]
    got = mixed(spark, rows)
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(mixed(spark, rng.sample(rows, len(rows))), key=repr)
    size, taken, largest = Counter(), Counter(), Counter()
    for doc, s, n, total, _, t in got:
        size[s] += n
        taken[s] += t
        largest[s] = max(largest[s], n)
        assert t % max(n, 1) == 0 and t <= 3 * n
    want = brute_targets(size)
    for _, s, _, total, target, _ in got:
        assert total == size[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
    assert abs(sum(want.values()) - sum(size.values())) < 1e-3
    for s in size:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1)
        if size[s] > 20_000:
            assert abs(taken[s] - want[s]) <= 0.02 * want[s]


def test_mix_copies_are_drawn_evenly(spark):
    """Places and fractions far beyond a double's digits; copies add up and differ by one at most."""
    rows = spark.range(1000).select((F.col("id") + (1 << 40)).alias("p"))
    for expected in (0.0, 0.25, 1.0, 2.9999, 3.0):
        n = [r[0] for r in rows.orderBy("p").select(mix_sources.copies(F.lit(expected), F.col("p"), F.lit(12345))).collect()]
        assert abs(sum(n) - 1000 * expected) <= 1 and max(n) - min(n) <= 1 and max(n) <= 3


def test_mix_empty_and_wordless(spark):
    assert mixed(spark, []) == []
    assert {r[2:] for r in mixed(spark, [(1, None, "a"), (2, " ", None)])} == {(0, 0, 0.0, 0)}
    assert sorted(r[5] for r in mixed(spark, [(1, "a b c", "x")])) == [3]


def test_mix_hot_source_of_one_size(spark):
    """A third of all rows has one source and one size: places are dealt over many partitions."""
    rows = [(k, "one two", "hot") for k in range(3000)] + [(k, "w " * (k % 50), f"s{k % 7}") for k in range(6000)]
    taken, target = Counter(), {}
    for _, s, _, _, t, n in mixed(spark, rows):
        taken[s] += n
        target[s] = t
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken)


def test_embeddings_with_repeated_ids_count_their_own_links(spark):
    """Two different vectors under one id: links are the vectors', the id only names components."""
    from fascicle.llm import embed_pstable

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (9, [0.7, -0.7])]
    out = embed_pstable.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in out.collect())
    assert [g[:2] for g in got] == [(0, 1), (0, 1), (1, 1), (1, 2), (2, 1), (3, 2), (4, 2), (9, 0)]
    assert {g[2] for g in got if g[0] in (1, 2, 3, 4)} == {1} and {g[2] for g in got if g[0] == 0} == {None} and (9, 0, 9, True) in got


def test_chat_of_very_many_turns(spark):
    """One role's run of 30 000 turns, some longer than a page: offsets and texts are exact and the work stays linear."""
    import hashlib
    import time

    from fascicle.llm import chat_format

    rows = [(1, k, "assistant", f"turn {k} é😀 [INST]" if k % 5000 else "y" * 70_000 + f"<|{k}") for k in range(30_000)] + [(1, 30_000, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    got = chat_format.digest(chat_format.format_conversations(df)).first()
    assert time.perf_counter() - began < 120
    said = "".join(r[3] for r in rows[:-1])
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (30_001, len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
    assert got["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
