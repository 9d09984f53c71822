"""Cohort retention matrix, kept up to date by signed deltas.

A client belongs to the week of its first start event; its later events count in weeks since then.
State 0 is materialised: each client's start, each client's share of each period, and the cells
that sum these shares. Late rows may move a start back. advance() takes back the shares of clients
whose start moved, adds them anew under the new start from all their events, adds increments for
all other clients with late rows, and sums old cells and signed deltas; no other client's events
are read again.

Scale. An event table is joined with one start a client, and combined by client and period before
the next shuffle, so a client that holds a third of all rows is split by adaptive execution and
leaves one row a period and task. Nothing that grows with the input reaches the driver, a
broadcast or one task.

Rows. Equal rows count once; rows without a time or a client are dropped; rows without an arrival
are late; null and non-finite values are worth 0 cents; a client's segment is the smallest of its
sources, '' where there is none. Empty tables give no cells. Further columns only tell rows apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import durable, shared_folder

DAY = 86_400_000_000
WEEK = 7 * DAY
START_KIND = "error"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp as its calendar shows it, whatever the session's zone."""
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * DAY + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + second


def weeks(span: Column) -> Column:
    """Whole weeks of a span in microseconds, rounded down, exactly."""
    return ((span - F.pmod(span, F.lit(WEEK))) / WEEK).cast("long")


def events(clicks: DataFrame, cut: Column) -> DataFrame:
    """client_id, at, starts, cents, late: distinct clicks, as a table in the shared folder.

    A click of which 3 divides the crc32 of its number arrives that many days (modulo 100) later
    than it says; late ones arrive at `cut` or after it.
    """
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    arrived = F.col("arrived_at") + F.when(h % 3 == 0, F.make_dt_interval((h % 100).cast("int"))).otherwise(F.make_dt_interval(F.lit(0)))
    value = F.col("value").cast("double")
    cents = F.when(F.isnan(value) | (F.abs(value) > 9e16), 0).otherwise(F.floor(100 * value + 0.5))
    rows = clicks.where("ts IS NOT NULL AND client_id IS NOT NULL").distinct()
    rows = rows.select("client_id", micros(F.col("ts")).alias("at"), F.coalesce(F.col("kind") == START_KIND, F.lit(False)).alias("starts"), F.coalesce(cents.cast("long"), F.lit(0)).alias("cents"), F.coalesce(arrived >= cut, F.lit(True)).alias("late"))
    path = f"{shared_folder(clicks.sparkSession)}/retention-{uuid.uuid4().hex}"
    rows.write.partitionBy("late").parquet(path)
    return clicks.sparkSession.read.schema(rows.schema).parquet(path)


def first_starts(rows: DataFrame) -> DataFrame:
    """client_id, start: the first start event of each client that has one."""
    return rows.where("starts").groupBy("client_id").agg(F.min("at").alias("start"))


def shares(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """client_id, cohort, period, cents: what each client adds to each period from its start on."""
    own = rows.join(starts, "client_id").where("at >= start")
    # One struct as key: rows are combined in their tasks and dealt again by client and period, so
    # adaptive execution may split a client's rows in the join.
    key = F.struct("client_id", weeks(F.col("start")).alias("cohort"), weeks(F.col("at") - F.col("start")).alias("period"))
    return own.groupBy(key.alias("key")).agg(F.sum("cents").alias("cents")).select("key.*", "cents")


def signed(own: DataFrame, segments: DataFrame, users: Column, cents: Column, moved: Column) -> DataFrame:
    """One row a share: what it adds to (or takes from) its cell."""
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    return own.join(segments, "client_id", "left").select(
        F.coalesce("segment", F.lit("")).alias("segment"), "cohort", "period", users.cast("long").alias("users"), (users * crc).cast("long").alias("users_crc32"), moved.cast("long").alias("moved"), cents.cast("long").alias("cents")
    )


def cells_of(rows: DataFrame, *more: str) -> DataFrame:
    """Cells that sum signed rows; cells without a user are dropped."""
    sums = [F.sum(c).alias(c) for c in ("users", "users_crc32", "moved", "cents")]
    return rows.groupBy(*more, "segment", "cohort", "period").agg(*sums).where("users > 0")


@dataclass
class State:
    """A materialised matrix: rows known so far, starts, shares, and the cells (moved is 0)."""

    rows: DataFrame
    starts: DataFrame
    shares: DataFrame
    cells: DataFrame


def materialise(rows: DataFrame, segments: DataFrame) -> State:
    """The state of all given rows, from scratch."""
    starts = durable(first_starts(rows))
    own = durable(shares(rows, starts))
    return State(rows, starts, own, durable(cells_of(signed(own, segments, F.lit(1), F.col("cents"), F.lit(0)))))


def advance(state: State, late: DataFrame, segments: DataFrame) -> tuple[State, DataFrame, DataFrame]:
    """(state with the late rows, its cells with moved, moved of the old state's cells).

    The last has the columns of cells with users 0: add it to the old cells to see in them who moved.
    """
    fresh = first_starts(late).withColumnRenamed("start", "now")
    met = fresh.join(state.starts, "client_id", "left").where("start IS NULL OR now < start")
    gone = F.coalesce(weeks(F.col("start")) != weeks(F.col("now")), F.lit(False))
    shifted = durable(met.select("client_id", "now", F.col("start").isNotNull().alias("known"), gone.alias("gone")))
    old = state.shares.join(shifted.where("known"), "client_id")
    again = durable(shares(state.rows.unionByName(late), shifted.select("client_id", F.col("now").alias("start"))))
    same = state.starts.join(shifted, "client_id", "left_anti")
    more = shares(late, same)
    there = state.shares.select("client_id", "cohort", "period", F.lit(True).alias("there"))
    more = durable(more.join(there, ["client_id", "cohort", "period"], "left").select("client_id", "cohort", "period", "cents", F.col("there").isNull().alias("new")))

    moves = again.join(shifted.select("client_id", "gone"), "client_id")
    deltas = signed(old, segments, F.lit(-1), -F.col("cents"), F.lit(0))
    deltas = deltas.unionByName(signed(moves, segments, F.lit(1), F.col("cents"), F.col("gone").cast("int")))
    deltas = deltas.unionByName(signed(more, segments, F.col("new").cast("int"), F.col("cents"), F.lit(0)))
    cells = durable(cells_of(state.cells.unionByName(deltas)))
    left = signed(old.where("gone"), segments, F.lit(0), F.lit(0), F.lit(1))

    kept = state.shares.join(shifted, "client_id", "left_anti").unionByName(more.drop("new")).groupBy("client_id", "cohort", "period").agg(F.sum("cents").alias("cents"))
    starts = same.unionByName(shifted.select("client_id", F.col("now").alias("start")))
    nxt = State(state.rows.unionByName(late), starts, kept.unionByName(again), cells.withColumn("moved", F.lit(0).cast("long")))
    return nxt, cells, left


def segments_of(clients: DataFrame) -> DataFrame:
    """client_id, segment: one row a client."""
    return clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("source").alias("segment"))


def retention(clicks: DataFrame, clients: DataFrame, cut: str = "2024-02-01 00:00:00") -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of states 0 and 1.

    State 0 is materialised from the clicks that arrive before `cut`; state 1 is state 0 advanced
    by all others. moved counts a cell's users whose cohort differs between the two states.
    """
    rows = events(clicks, F.lit(cut).cast("timestamp_ntz"))
    segments = durable(segments_of(clients))
    before = materialise(rows.where("NOT late").drop("late"), segments)
    _, after, left = advance(before, rows.where("late").drop("late"), segments)
    both = before.cells.unionByName(left).withColumn("state", F.lit(0)).unionByName(after.withColumn("state", F.lit(1)))
    return cells_of(both, "state").select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")
