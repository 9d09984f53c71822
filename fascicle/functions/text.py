"""Scalar text functions as Column expressions.

Regular expressions stay inside the subset on which Java, RE2 and ECMAScript agree; \\w is ASCII.
Lengths count code points.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a question.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "from", "by", "as", "at", "is", "was", "were", "be", "been", "are", "it", "its",
    "this", "that", "these", "those", "with", "about", "what", "which", "who", "whom", "how", "why", "when", "where", "did", "does", "do", "not",
    "no", "but", "if", "so", "than", "then", "also", "into", "over", "after", "before", "can", "will", "would", "could", "should", "may", "might",
    "must", "has", "had", "have", "their", "they", "them", "his", "her", "our", "your", "say", "says", "said", "telling", "tell", "told", "paper",
    "papers", "study", "studies", "chunk", "heading",
)

# A word or number of the lexical index, and a sentence.
TOKEN = r"(?i)(?:₹|rs\.?|inr|\$)\s*\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d{1,3}(?:,\d{2,3})+(?:\.\d+)?%?|\d+(?:\.\d+)?%|\w+"
SENTENCE = "[^.!?]+(?:[.!?]+(?:[\"”']+)?\\s*|$)"
# How a token with a currency begins.
CURRENCY = ("₹", "rs", "inr", "$")
# Fixed value: how often a heading counts.
HEADING_REPEAT = 2


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (ASCII) at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    """White space runs become one space; both ends are trimmed."""
    return strip(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def word_count(c: Column) -> Column:
    t = strip(text_or_empty(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def is_complete_sentence(c: Column) -> Column:
    return strip(text_or_empty(c)).rlike("[.!?][\"”']?\\s*$")


def sentences(c: Column) -> Column:
    """Sentences of a text, ends kept. Decimals and initials split too."""
    t = collapse(c)
    parts = F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0))
    parts = F.when(F.size(parts) == 0, F.array(t)).otherwise(parts)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def normalize(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words and numbers; grouped numbers keep commas and percent signs, currency marks go."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN), F.lit(0))
    bare = lambda x: F.regexp_replace(x, r"₹|\brs\.?|\binr\b|\$|\s+", "")
    # What is taken away stands at a token's beginning, so few tokens meet the expression.
    clean = lambda x: F.when(reduce(lambda a, b: a | b, (x.startswith(m) for m in CURRENCY)), bare(x)).otherwise(x)
    return F.filter(F.transform(F.transform(found, F.lower), clean), lambda x: x != "")


def is_year(c: Column) -> Column:
    return c.rlike(r"^(?:19|20)\d{2}$")


def is_grouped_number(c: Column) -> Column:
    return c.rlike(r"^\d{1,3}(?:,\d{2,3})+(?:\.\d+)?%?$|^\d+(?:\.\d+)?%$")


def gate_tokens(question: Column) -> Column:
    """Distinct content tokens; years only where nothing else is left."""
    raw = F.filter(tokens(question), lambda x: ~x.isin(*STOPWORDS))
    content = F.filter(raw, lambda x: ~is_year(x))
    return F.array_distinct(F.when(F.size(content) > 0, content).otherwise(raw))


def lexical_tokens(question: Column) -> Column:
    """Gate tokens and a simple plural of each word of four letters or more."""
    base = gate_tokens(question)
    plural = F.filter(base, lambda x: (F.length(x) > 3) & ~x.endswith("s") & ~is_year(x) & ~is_grouped_number(x))
    return F.array_union(base, F.transform(plural, lambda x: F.concat(x, F.lit("s"))))


def is_weak_heading(h: Column) -> Column:
    h = strip(text_or_empty(h))
    return (h == "") | (h == "(untitled)") | h.rlike(r"(?i)^page\s+\d+\s+other\s+text$")


def _after_header(content: Column, has_date: bool) -> tuple[Column, Column, Column]:
    """(heading line, chunk line, body) of a stored text; absent lines are empty."""
    date = r"(?:date - [^\n]*\n)?" if has_date else ""
    # Everything is optional, so the expression ends where the header does and never looks at the body.
    m = rf"^{date}(heading - [^\n]*(?:\n|$))?((?i:chunk)\s+\d+\s*/\s*\d+[^\S\n]*(?:\n|$))?\n*"
    body = F.substring(content, F.length(F.regexp_extract(content, m, 0)) + 1, F.length(content))
    return F.regexp_extract(content, m, 1), F.regexp_extract(content, m, 2), strip(body)


def lexical_text(content: Column, heading: Column, strip_header: bool = False) -> Column:
    """What the lexical index reads: the heading (twice unless weak) and then the body.

    By default only a heading line on the very first line counts as header, so a date line makes the
    whole header part of the body; strip_header drops a date line too.
    """
    line, _, body = _after_header(text_or_empty(content), strip_header)
    own = strip(F.regexp_replace(line, "^heading - ", ""))
    h = F.when(own != "", own).otherwise(strip(text_or_empty(heading)))
    body = F.nullif(body, F.lit(""))
    times = F.when(h == "", 0).when(is_weak_heading(h), 1).otherwise(HEADING_REPEAT)
    return F.array_join(F.array_compact(F.concat(F.array_repeat(h, times), F.array(body))), "\n")


def clip(c: Column, size: int) -> Column:
    """Collapsed text of at most size characters, an ellipsis marking what was cut."""
    t = collapse(c)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(strip(F.substring(t, 1, size)), F.lit("…")))


def format_chunk(heading: Column, body: Column, index: Column, total: Column, date: Column) -> Column:
    """date, heading and chunk lines, a blank line, and the body without a repeated title."""
    h = strip(text_or_empty(heading))
    h = F.when(h == "", "(untitled)").otherwise(h)
    b = strip(text_or_empty(body))
    led = b.startswith(F.concat(h, F.lit("\n"))) | b.startswith(F.concat(h, F.lit(" ")))
    b = F.when(b == h, "").when(led, strip(F.substring(b, F.length(h) + 1, F.length(b)))).otherwise(b)
    i = F.greatest(F.lit(1), F.coalesce(index, F.lit(1)))
    n = F.greatest(i, F.coalesce(total, i))
    dated = F.when(date.isNotNull() & (date.cast("string") != ""), F.concat(F.lit("date - "), date.cast("string")))
    head = F.concat_ws("\n", dated, F.concat(F.lit("heading - "), h), F.concat(F.lit("chunk "), i.cast("string"), F.lit("/"), n.cast("string")))
    return F.when(b == "", head).otherwise(F.concat(head, F.lit("\n\n"), b))


def parse_chunk(content: Column, heading: Column, index: Column | None = None, total: Column | None = None) -> Column:
    """struct(heading, chunk_index, chunk_total, excerpt): the inverse of format_chunk.

    Values in the text win over those given.
    """
    line, chunk, body = _after_header(text_or_empty(content), True)
    own = strip(F.regexp_replace(line, "^heading - ", ""))
    h = F.when(own != "", own).otherwise(strip(text_or_empty(heading)))
    number = lambda k, given: F.coalesce(F.regexp_extract(chunk, r"(\d+)\s*/\s*(\d+)", k).try_cast("int"), given if given is not None else F.lit(None).cast("int"))
    return F.struct(F.when(h == "", "(untitled)").otherwise(h).alias("heading"), number(1, index).alias("chunk_index"), number(2, total).alias("chunk_total"), clip(body, 220).alias("excerpt"))


def title_from_question(q: Column) -> Column:
    t = collapse(q)
    return F.when(t == "", "New chat").when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("…"))).otherwise(t)


def clean_passage(c: Column) -> Column:
    """A model's passage without code fences, extra blanks and more than two newlines in a row."""
    t = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"(?i)^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def cleanup_heading(c: Column) -> Column:
    """No runs of five digits or more, no prose glued on after a quoted title."""
    t = F.regexp_replace(text_or_empty(c), r"\b\d{5,}\b", " ")
    return collapse(F.regexp_replace(t, r"(['’])\s+[a-z][a-z'-]*\.\s+[A-Z].*$", "$1"))


def join_pieces(pieces: Column) -> Column:
    """Pieces joined by a space, or by nothing where a word was cut in two."""
    clean = F.filter(F.transform(pieces, collapse), lambda x: x != "")
    glue = lambda a, x: F.when(a == "", x).when(a.rlike("[A-Za-z0-9]$") & x.rlike("^[a-z0-9]"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(clean, F.lit(""), glue)


def console_source(c: Column) -> Column:
    tag = F.regexp_extract(text_or_empty(c), r"(?i)^\[([a-z0-9._/-]+)\]", 1)
    return F.when(tag != "", tag).when(c.rlike("(?i)^API listening"), "server").when(c.rlike("(?i)^RAG ready"), "rag").otherwise("console")


def json_body(c: Column, arrays: bool = False) -> Column:
    """The outermost JSON object (or array) in a model's answer, fences ignored; null if none."""
    raw = strip(text_or_empty(c))
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", strip(fenced)).otherwise(raw)
    cut = F.regexp_extract(body, r"(?s)[{\[].*[}\]]" if arrays else r"(?s)\{.*\}", 0)
    return F.when((cut != "") & F.try_parse_json(cut).isNotNull(), cut)


def message_text(parts: Column, plain: Column | None = None) -> Column:
    """Text of a message: plain if given, else the texts of array<struct<text>> one after the other."""
    joined = F.array_join(F.transform(parts, lambda p: text_or_empty(p["text"])), "")
    return F.coalesce(plain, joined, F.lit("")) if plain is not None else F.coalesce(joined, F.lit(""))


def passage(value: str | None) -> str:
    """clean_passage() for one text on the driver."""
    t = re.sub(r"(?i)^\s*```[a-z]*\s*", "", str(value or ""))
    t = re.sub(r"[ \t]+", " ", re.sub(r"\s*```\s*$", "", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def context(date: Column, page: Column, section: Column, content: Column) -> Column:
    """A retrieved text as it stands in the prompt."""
    return F.concat(F.lit("date "), text_or_empty(date), F.lit(" | page "), text_or_empty(page), F.lit(" | section "), text_or_empty(section), F.lit("\n"), text_or_empty(content))
