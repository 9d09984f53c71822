"""Chats, users and logs as append-only tables with derived views.

Rows are never updated in place: messages, sign-ins, summaries and log lines are appended, and
the current session, user or summary is an aggregate over them.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.text import collapse, strip, text_or_empty, title_from_question
from fascicle.operators.grams import narrowed_rows

LOG_DAYS = 14
# What stands for an absent answer and title.
NO_ANSWER = "(No answer)"
NEW_CHAT = "New chat"
# Sources that an answer keeps, and characters of their excerpts.
MOST_SOURCES, EXCERPT = 20, 400
# Metadata keys that are redacted, without regard to case.
SECRET_KEYS = ("authorization", "idtoken", "accesstoken", "refreshtoken", "password", "secret", "cookie", "jwt", "credential")


def sessions(messages: DataFrame) -> DataFrame:
    """One row a session from messages(sessionId, userId, role, content, createdAt, messageId).

    Title: first question; preview: last message that says something, 200 characters at most.
    """
    at = F.struct("createdAt", "messageId")
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", at))
    last = F.max_by("content", F.when(F.coalesce(F.col("content") != NO_ANSWER, F.lit(True)), at))
    return messages.groupBy("sessionId", "userId").agg(title_from_question(first).alias("title"), F.substring(collapse(last), 1, 200).alias("preview"), F.count("*").alias("messageCount"), F.max("createdAt").alias("lastMessageAt"))


def recent_sessions(all_sessions: DataFrame, user: str, limit: int = 50) -> DataFrame:
    return all_sessions.where(F.col("userId") == user).orderBy(F.desc("lastMessageAt"), "sessionId").limit(min(max(int(limit or 50), 1), 100))


def session_messages(messages: DataFrame, session, user) -> DataFrame:
    """A session's messages, oldest first; another user's session has none."""
    return messages.where((F.col("sessionId") == session) & (F.col("userId") == user)).orderBy("createdAt", "messageId")


MESSAGE_SCHEMA = "sessionId string, userId string, role string, content string, sources string, meta string, createdAt timestamp, messageId long"


def append_turn(messages: DataFrame, user: str, question: str, answer: str | None, sources: list[dict] | None, at, session: str | None = None, meta: dict | None = None) -> tuple[DataFrame, str, bool]:
    """(the two rows to append, the session's id, whether it is new) for a question and its answer.

    A session that is named must be the user's own; without a name a new one begins. Title,
    preview, count and time of the session follow from its messages (see sessions).
    """
    if not user:
        raise PermissionError("a user is required to keep a chat")
    if not str(question or "").strip():
        raise ValueError("a question is required")
    own = messages.where((F.col("sessionId") == session) & (F.col("userId") == user)) if session else None
    last = own.agg(F.max("messageId")).first()[0] if session else 0
    if last is None:
        raise LookupError("no such session of this user")
    name = session or uuid.uuid4().hex
    rows = [
        (name, user, "user", str(question).strip(), None, None, at, last + 1),
        (name, user, "assistant", str(answer or "").strip() or NO_ANSWER, json.dumps(short_sources(sources)), json.dumps(meta) if meta else None, at, last + 2),
    ]
    return messages.sparkSession.createDataFrame(rows, MESSAGE_SCHEMA), name, session is None


def short_sources(sources: list[dict] | None) -> list[dict]:
    """compact_sources() for one answer's sources on the driver."""
    return [
        {"id": s.get("id"), "heading": s.get("heading") or "", "pageNumber": s.get("pageNumber"), "date": s.get("date"), "section": s.get("section") or "", "excerpt": str(s.get("excerpt") or "")[:EXCERPT]}
        for s in (sources or [])[:MOST_SOURCES]
    ]


def _or(df: DataFrame, name: str, kind: str, *others) -> Column:
    """The column, else the first of others that is there and not null; null of its kind otherwise."""
    have = [F.col(o) if isinstance(o, str) and o in df.columns else o for o in (name, *others) if not isinstance(o, str) or o in df.columns]
    return (F.coalesce(*have) if have else F.lit(None)).cast(kind).alias(name)


def _said(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A string column in which empty counts as absent."""
    there = F.when(F.col(name) != "", F.col(name)) if name in df.columns else F.lit(None).cast("string")
    return (F.coalesce(there, default) if default is not None else there).alias(name)


def public_sessions(all_sessions: DataFrame) -> DataFrame:
    """What a session's owner sees of it, with defaults for what is absent."""
    s = all_sessions
    return s.select(F.col("sessionId").cast("string").alias("id"), _said(s, "title", F.lit(NEW_CHAT)), _said(s, "preview", F.lit("")), _or(s, "messageCount", "long", F.lit(0)), _or(s, "lastMessageAt", "timestamp", "updatedAt", "createdAt"), _or(s, "createdAt", "timestamp"), _or(s, "updatedAt", "timestamp"))


def public_messages(messages: DataFrame) -> DataFrame:
    """What a session's owner sees of its messages."""
    m = messages
    return m.select(F.col("messageId").cast("string").alias("id"), F.col("sessionId").cast("string").alias("sessionId"), "role", "content", _said(m, "sources"), _said(m, "meta"), _or(m, "createdAt", "timestamp"))


def public_users(users: DataFrame) -> DataFrame:
    """What users see of their account, with defaults for what is absent."""
    u = users
    return u.select(
        _or(u, "id", "string", "googleId"), F.col("googleId").alias("sub"), "googleId", _said(u, "email"), _or(u, "emailVerified", "boolean", F.lit(False)), _said(u, "name"), _said(u, "picture"), _said(u, "provider", F.lit("google")),
        F.when(F.col("loginCount") > 0, F.col("loginCount")).otherwise(1).cast("long").alias("loginCount"), _or(u, "lastLoginAt", "timestamp"), _or(u, "createdAt", "timestamp"), _or(u, "updatedAt", "timestamp"),
    )


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """sessionId, summary, summaryAtCount: the write with the largest count wins, whatever the order.

    Late writes with a smaller count never take effect, so refreshes can run at any time and twice.
    """
    text = F.max_by("summary", F.struct("summaryAtCount", "summary"))
    return summaries.groupBy("sessionId").agg(F.substring(text, 1, 2000).alias("summary"), F.max("summaryAtCount").alias("summaryAtCount"))


def rename_session(all_sessions: DataFrame, session, title: str) -> DataFrame:
    if not title or not title.strip():
        raise ValueError("a title is required")
    return all_sessions.withColumn("title", F.when(F.col("sessionId") == session, title.strip()[:120]).otherwise(F.col("title")))


def delete_session(all_sessions: DataFrame, messages: DataFrame, session) -> tuple[DataFrame, DataFrame]:
    return all_sessions.where(F.col("sessionId") != session), messages.where(F.col("sessionId") != session)


def compact_sources(sources: Column) -> Column:
    """The first 20 sources with excerpts of 400 characters at most; absent headings are empty."""
    short = lambda s: F.struct(s["chunk_id"].alias("id"), text_or_empty(s["heading"]).alias("heading"), s["pageNumber"].alias("pageNumber"), s["date"].alias("date"), text_or_empty(s["section"]).alias("section"), F.substring(text_or_empty(s["excerpt"]), 1, EXCERPT).alias("excerpt"))
    return F.transform(F.slice(sources, 1, MOST_SOURCES), short)


def upsert_users(users: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """users after sign_ins(googleId, email, name, picture, at): new ones start at one sign-in,
    known ones take the newest non-null profile fields and count on."""
    new = sign_ins.groupBy("googleId").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"n_{c}") for c in ("email", "name", "picture")), F.max("at").alias("n_at"), F.count("*").alias("n_count"))
    j = users.join(new, "googleId", "full")
    return j.select("googleId", *(F.coalesce(f"n_{c}", c).alias(c) for c in ("email", "name", "picture")), F.greatest("lastLoginAt", "n_at").alias("lastLoginAt"), (F.coalesce("loginCount", F.lit(0)) + F.coalesce("n_count", F.lit(0))).alias("loginCount"))


def is_publisher(email: Column, allowed: list[str]) -> Column:
    return F.lower(strip(text_or_empty(email))).isin([a.strip().lower() for a in allowed if a.strip()])


def search_logs(logs: DataFrame, source=None, level=None, request=None, q=None, limit: int = 80, grams: str | None = None) -> DataFrame:
    """Newest log rows that match; q is a regular expression over the message without regard to case.
    grams: the folder of a trigram index of all messages."""
    c = F.lit(True)
    for name, v in (("source", source), ("level", level), ("requestId", request)):
        c = c & (F.col(name) == v) if v else c
    if q:
        c = c & F.col("message").rlike(f"(?i){q}")
        logs = narrowed_rows(logs, grams, q)
    return logs.where(c).orderBy(F.desc("createdAt"), F.desc("id")).limit(min(max(int(limit or 80), 1), 300))


def retained(logs: DataFrame, now: Column, days: int = LOG_DAYS) -> DataFrame:
    return logs.where(F.col("createdAt") > now - F.make_dt_interval(F.lit(days)))


# Limits of stored metadata.
META_DEPTH, META_ITEMS, META_STRING, META_JSON, META_PREVIEW = 4, 40, 500, 24_000, 400


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def sanitize(value, room: int = META_DEPTH):
    """Metadata without secrets, cut to the limits; `room` is how many levels may still follow."""
    match value:
        case dict() | list() | str() if room < 0:
            return "[…]"
        case str():
            return value[:META_STRING] + "…" * (len(value) > META_STRING)
        case list():
            return [sanitize(v, room - 1) for v in value[:META_ITEMS]]
        case dict():
            kept = {k: sanitize(v, room - 1) for k, v in value.items() if k.lower() not in SECRET_KEYS}
            whole = {k: kept.get(k, "[redacted]") for k in value}
            long = len(text := compact(whole)) > META_JSON
            return {"truncated": True, "preview": text[:META_PREVIEW]} if long else whole
    return "[…]" if room < 0 and value is not None else value


def sanitized(meta: Column) -> Column:
    """sanitize() on JSON text; text that is no JSON is null. Recursive, so an Arrow UDF."""

    @F.arrow_udf("string")
    def of(a: pa.Array) -> pa.Array:
        def one(x):
            try:
                return compact(sanitize(json.loads(x)))
            except (TypeError, ValueError):
                return None

        return pa.array([one(x) for x in a.to_pylist()], pa.string())

    return of(meta)
