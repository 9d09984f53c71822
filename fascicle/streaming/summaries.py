"""Rolling summaries of chats, refreshed behind the answers by a keyed stateful stream.

A session's state is its memory (summary, messages counted, last message folded in) and the
messages that may still be preceded by others. Each batch folds what the watermark has passed into
the memory, in order, and then writes the summary that the waiting messages would make of it. So a
summary is there at once, and a late message only makes a later write with a larger count; writes
are appended, and the largest count wins (stores.latest_summaries), so replayed batches and
repeated messages change nothing.

Timers. A session that says nothing for `idle` after its last message is over: its timer drops the
state. Messages after that begin a new memory, whose writes carry a later `started`.

Scale. State is bounded by the messages within the watermark's delay and one memory for each live
session; it lies in the state store, whose checkpoint is in the shared folder. Sessions are the
keys; texts are clipped before they are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Most characters of a summary, a question and an answer that a summary is made of.
SUMMARY_CHARS, QUESTION_CHARS, ANSWER_CHARS = 1600, 800, 1200
NO_SUMMARY = "(none)"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WRITES = "sessionId string, userId string, summary string, summaryAtCount long, started timestamp"

Summarise = Callable[[str, str, str], str]


def clip(text: str | None, most: int) -> str:
    """White space runs become one space; what is longer than `most` ends in an ellipsis."""
    flat = " ".join((text or "").split())
    return flat if len(flat) <= most else flat[:most].strip() + "…"


def offline(previous: str, question: str, answer: str) -> str:
    """A deterministic stand-in for a model: heads of the newest turn before what was there."""
    head = f"{clip(question, 40)} / {clip(answer, 40)}"
    return head if previous == NO_SUMMARY else f"{head} | {previous}"


def fold(memory: tuple, messages: list[tuple], summarise: Summarise) -> tuple:
    """memory after messages(messageId, role, content), which are in order.

    memory: summary, count of messages, the question that waits for an answer. An answer without a
    question before it counts, but makes no summary; an empty result keeps the old summary.
    """
    summary, count, question = memory
    for _, role, content in messages:
        count += 1
        if role == "user":
            question = clip(content, QUESTION_CHARS)
        elif role == "assistant" and question:
            made = clip(summarise(summary or NO_SUMMARY, question, clip(content, ANSWER_CHARS)), SUMMARY_CHARS)
            summary, question = made or summary, ""
    return summary, count, question


class Refresh(StatefulProcessor):
    """One session: messages in, summary writes out."""

    def __init__(self, summarise: Summarise, idle_ms: int) -> None:
        self.summarise, self.idle = summarise, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "summary string, count long, question string, upto long, started long, last long")
        self.waiting = handle.getMapState("waiting", "id long", "role string, content string, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.memory.get() if self.memory.exists() else None
        summary, count, question, upto, started, last = known or ("", 0, "", None, None, 0)
        for r in rows:
            at = r["at"]
            # A message that is folded in already came twice; one that is not newer than it came too late.
            if upto is None or r["messageId"] > upto:
                self.waiting.updateValue((r["messageId"],), (r["role"], clip(r["content"], max(QUESTION_CHARS, ANSWER_CHARS)), at))
            started, last = at if started is None else started, max(last, at)
        if started is None:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], *v) for k, v in self.waiting.iterator())
        # Only a prefix in message order is folded, so that nothing overtakes a message that waits.
        ready = 0
        while ready < len(waiting) and waiting[ready][3] <= passed:
            ready += 1
        bare = [(k, role, content) for k, role, content, _ in waiting]
        summary, count, question = fold((summary, count, question), bare[:ready], self.summarise)
        for k, *_ in bare[:ready]:
            self.waiting.removeKey((k,))
            upto = k
        self.memory.update((summary, count, question, upto, started, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle)
        now = fold((summary, count, question), bare[ready:], self.summarise)
        if now[0]:
            yield Row(sessionId=key[0], userId=key[1], summary=now[0], summaryAtCount=now[1], started=started)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.memory.clear()
        self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def refreshes(messages: DataFrame, summarise: Summarise = offline, delay: str = "1 hour", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """Summary writes (WRITES) of a stream of messages(sessionId, userId, role, content, createdAt, messageId).

    Rows without a session, user, number or time are dropped. Order within a session is messageId's.
    The session's state store must be RocksDB (ROCKSDB as spark.sql.streaming.stateStore.providerClass).
    """
    whole = messages.dropna(subset=["sessionId", "userId", "messageId", "createdAt"])
    rows = whole.select(F.col("sessionId").cast("string").alias("sessionId"), F.col("userId").cast("string").alias("userId"), "role", "content", F.col("messageId").cast("long").alias("messageId"), F.col("createdAt").cast("timestamp").alias("createdAt"))
    rows = rows.withWatermark("createdAt", delay).withColumn("at", F.unix_millis("createdAt"))
    made = rows.groupBy("sessionId", "userId").transformWithState(Refresh(summarise, idle // timedelta(milliseconds=1)), WRITES.replace("started timestamp", "started long"), "Append", "EventTime")
    return made.withColumn("started", F.timestamp_millis("started"))


def store_refreshes(writes: DataFrame, path: str, checkpoint: str):
    """Append the writes; each micro-batch owns a folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return writes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(writes: DataFrame) -> DataFrame:
    """sessionId, summary, summaryAtCount: the newest memory of each session at its largest count."""
    from fascicle.operators.stores import latest_summaries

    newest = writes.groupBy("sessionId").agg(F.max("started").alias("started"))
    return latest_summaries(writes.join(newest, ["sessionId", "started"], "left_semi"))
