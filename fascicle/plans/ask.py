"""From a question to an answer: decomposition, routing, retrieval and the prompt.

Language and embedding models are injected as plain callables; the stand-ins below are
deterministic and need no network. All topics of a question are retrieved by one plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.functions.filters import build_filter, coerce_filters, empty_filters
from fascicle.functions.text import context, parse_chunk, passage as cleaned
from fascicle.operators.lexical import LexicalIndex
from fascicle.operators.retrieval import MAX_TOPICS, fill_content, get_by_filter, hybrid, merge_topics

NORMAL, SHORT, RESEARCH = "normal", "turbo_short", "turbo_research"
# K, temperature and answer length of each mode.
MODES = {
    NORMAL: {"k": 3, "turbo": False, "stream": False, "temperature": 0.2, "max_tokens": 1024},
    SHORT: {"k": 10, "turbo": True, "stream": False, "temperature": 0.2, "max_tokens": 1024},
    RESEARCH: {"k": 10, "turbo": True, "stream": True, "temperature": 0.35, "max_tokens": 2048},
}
SYNONYMS = {SHORT: SHORT, "short": SHORT, "turbo_and_short": SHORT, RESEARCH: RESEARCH, "research": RESEARCH, "turbo_and_research": RESEARCH, NORMAL: NORMAL, "default": NORMAL}


def answer_mode(mode=None, turbo=None) -> str:
    """The mode named, else the one an older turbo flag means."""
    named = SYNONYMS.get(re.sub(r"[-\s]+", "_", str(mode or "").strip().lower()))
    if named:
        return named
    if turbo is True or turbo in ("research", RESEARCH):
        return RESEARCH
    return SHORT if turbo in ("short", SHORT) else NORMAL


def resolve(question: str, k=None, mode=None, turbo=None) -> tuple[str, int, str]:
    """(question, k, mode). Turbo modes fix k; otherwise it is clamped to 1..20 and 0 means default."""
    q = str(question or "").strip()
    if not q:
        raise ValueError("a question is required")
    name = answer_mode(mode, turbo)
    cfg = MODES[name]
    try:
        given = float(k) if k not in (None, "") else 0.0
    except (TypeError, ValueError):
        given = 0.0
    return q, cfg["k"] if cfg["turbo"] else int(min(max(given or cfg["k"], 1), 20)), name


def json_object(text: str) -> dict | None:
    """The outermost object in a model's answer, fences ignored; None if it does not parse."""
    raw = str(text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S | re.I)
    found = re.search(r"\{.*\}", fenced[1] if fenced else raw, re.S)
    try:
        out = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


@dataclass
class Decomposition:
    standalone: str
    topics: list[dict]
    filters: dict = field(default_factory=empty_filters)


def decompose(question: str, llm: Callable[[str], str] | None, summary: str = "") -> Decomposition:
    """Topics, standalone question and filters from a model; the question itself if anything fails."""
    plain = Decomposition(question, [{"search": question, "vague": False}])
    try:
        got = json_object(llm(f"Conversation summary:\n{summary or '(none)'}\n\nCurrent user message:\n{question}")) if llm else None
    except Exception:  # noqa: BLE001  a model that fails leaves the question as it is
        return plain
    if not got or not isinstance(got.get("queries"), list):
        return plain
    flat = lambda v: " ".join(str(v or "").split())
    topics: dict[str, dict] = {}
    for item in got["queries"]:
        search = flat(item if isinstance(item, str) else (item.get("search") or item.get("query")) if isinstance(item, dict) else "")
        if search and len(topics) < MAX_TOPICS:
            topics.setdefault(search.lower(), {"search": search, "vague": isinstance(item, dict) and bool(item.get("vague"))})
    raw = got["filters"] if isinstance(got.get("filters"), dict) else got["queries"][0] if got["queries"] and isinstance(got["queries"][0], dict) else {}
    return Decomposition(flat(got.get("standalone")) or question, list(topics.values()) or plain.topics, coerce_filters(raw))


def hash_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic offline stand-in: signed hashed words."""

    def embed(texts):
        out = []
        for t in texts:
            v = [0.0] * size
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            out.append(v if any(v) else [1.0, *v[1:]])
        return out

    return embed


@dataclass
class Engine:
    chunks: DataFrame
    vectors: DataFrame
    index: LexicalIndex | None
    embed: Callable[[list[str]], list[list[float]]]
    llm: Callable[[str], str] | None = None
    #: Writes answers: writer(prompt, temperature=, max_tokens=) -> text, or an iterable of pieces of it.
    writer: Callable[..., str | Iterable[str]] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def retrieve(self, d: Decomposition, k: int) -> tuple[DataFrame, str]:
        """(ranked chunks with text in reading order, route).

        whole with any filter reads everything the filter admits, in layout order. A vague topic without a
        filter is embedded as a passage that a model writes; everything else is hybrid search.
        """
        tree = build_filter(d.filters)
        if d.filters["whole"] and tree:
            return get_by_filter(self.chunks, tree), "get"
        route, texts = "hybrid", []
        for t in d.topics:
            passage = ""
            if t["vague"] and not tree and self.llm:
                try:
                    passage = cleaned(self.llm(f"passage: {t['search']}"))
                except Exception:  # noqa: BLE001  without a passage the topic itself is embedded
                    passage = ""
            route = "hyde+hybrid" if passage else route
            texts.append(passage or t["search"])
        rows = [(n, t["search"], v) for n, (t, v) in enumerate(zip(d.topics, self.embed(texts)))]
        topics = self.spark.createDataFrame(rows, "topic_id int, search string, query array<double>")
        fused = hybrid(self.chunks, self.vectors, self.index, topics.select("topic_id", "search"), topics.select("topic_id", "query"), k, tree)
        have = [c for c in ("page_content", "date", "pageNumber", "section", "heading") if c in self.chunks.columns]
        return fill_content(merge_topics(fused), self.chunks, have).orderBy("ordinal"), route

    def sources(self, found: DataFrame) -> DataFrame:
        parsed = parse_chunk(F.col("page_content"), F.col("heading"))
        return found.select("chunk_id", parsed.alias("p"), "pageNumber", "date", "section").select("chunk_id", "p.*", "pageNumber", "date", "section")

    def write(self, prompt: str, mode: str, on_event=lambda e: None) -> str:
        """An answer with the mode's temperature and length; in a streamed mode each piece is an event."""
        if not self.writer:
            return self.llm(prompt)
        cfg = MODES[mode]
        out = self.writer(prompt, temperature=cfg["temperature"], max_tokens=cfg["max_tokens"])
        pieces = []
        for piece in [out] if isinstance(out, str) else out:
            pieces.append(piece)
            if cfg["stream"] and piece:
                on_event({"type": "token", "text": piece})
        return "".join(pieces)

    def ask(self, question: str, k=None, mode=None, turbo=None, summary: str = "", on_event=lambda e: None) -> dict:
        """Answer and sources of a question. At most k rows a topic reach the driver unless the
        question asks for a whole page or section."""
        q, top, name = resolve(question, k, mode, turbo)
        on_event({"type": "status", "step": "decompose"})
        d = decompose(q, self.llm, summary)
        on_event({"type": "status", "step": "search"})
        found, route = self.retrieve(d, top)
        rows = found.withColumn("context", context(F.col("date"), F.col("pageNumber"), F.col("section"), F.col("page_content"))).collect()
        on_event({"type": "status", "step": "answer"})
        text = "\n\n".join(r["context"] for r in rows)
        answer = self.write(f"answer ({name}): {d.standalone}\n\n{text}", name, on_event) if self.writer or self.llm else (rows[0]["page_content"][:200] if rows else "")
        result = {"answer": answer, "mode": name, "route": route, "topics": d.topics, "filters": d.filters, "ids": [r["chunk_id"] for r in rows]}
        on_event({"type": "result", **result})
        on_event({"type": "done"})
        return result
