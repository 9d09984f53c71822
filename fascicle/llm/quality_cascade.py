"""Quality rules as a short-circuit cascade, native expressions only.

Each rule rejects a document by measures of its text. The cascade takes a random sample of the
corpus, estimates each rule's cost (the unit costs of its measures times the sample's characters,
words and lines) and selectivity (share of the sample that it rejects), orders the rules by
rejection per cost, and compiles them to one CASE chain, so that a later, dearer measure is only
computed for documents that the earlier rules kept. The order never changes the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import let

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: About so many rows are sampled to order the rules.
SAMPLE_ROWS = 2000
#: Cost of each measure in nanoseconds a character, a word and a line (measured once; only ratios matter).
UNIT_COST = {
    "n_words": (40.0, 60.0, 0.0),
    "n_repeat_words": (40.0, 1500.0, 0.0),
    "word_chars": (12.0, 0.0, 0.0),
    "n_symbols": (10.0, 0.0, 0.0),
    "n_dup_lines": (8.0, 0.0, 400.0),
    "n_lines": (8.0, 0.0, 200.0),
    "n_upper": (15.0, 0.0, 0.0),
}


def split_words(text: Column) -> Column:
    """Words of non-null text; the array [''] where there is none."""
    return F.split(F.btrim(text, F.lit(SPACE)), SPACE_RUN)


def count_words(words: Column) -> Column:
    return F.when(F.get(words, F.lit(0)) == "", F.lit(0)).otherwise(F.size(words)).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are told apart by a 64-bit hash of their words, within one text only.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), total))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def without(t: Column, chars: str) -> Column:
    """Bytes of t without some ASCII characters."""
    return F.octet_length(t) - sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """The measures that rules use, as expressions; null texts count as empty. Whole texts."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    words = let(split_words(t), lambda w: F.struct(count_words(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    return {
        "n_words": let(split_words(t), count_words),
        "words": words,
        "n_repeat_words": words["n_repeat_words"],
        "word_chars": (F.length(t) - (F.octet_length(t) - without(t, SPACE))).cast("long"),
        "n_symbols": (F.octet_length(t) - without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.octet_length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """reject maps the measures to a boolean Column that is true for documents to reject.

    uses: the measures that it needs, which give its cost.
    """

    name: str
    reject: Callable[[dict[str, Column]], Column]
    uses: tuple[str, ...]


RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 20, ("n_words",)),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], ("n_words", "n_repeat_words")),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"], ("n_symbols", "n_words")),
    Rule("duplicate_lines", lambda m: (m["n_dup_lines"] > 2) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]), ("n_dup_lines", "n_lines")),
    Rule("word_length", lambda m: (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]), ("word_chars", "n_words")),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 60 * m["word_chars"], ("n_upper", "word_chars")),
)


def estimates(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[float, float, Rule]]:
    """(share rejected, nanoseconds a document, rule) for each rule, from about `rows` rows of docs.

    Rows are drawn at random with the same chance each, whatever their key; every task sends one
    row of sums. Both numbers are the same in every run over the same input splits.
    """
    n = docs.count()
    sample = docs.select(F.col(text).alias("t")).sample(min(1.0, rows / max(n, 1)), seed)
    m = measures(F.col("t"))
    sizes = [F.avg(F.length(F.coalesce("t", F.lit("")))), F.avg(m["n_words"]), F.avg(m["n_lines"])]
    shares = [F.avg(F.coalesce(r.reject(m), F.lit(False)).cast("double")) for r in rules]
    got = [x or 0.0 for x in sample.agg(*(c.alias(f"c{k}") for k, c in enumerate([*sizes, *shares]))).first()]
    cost = lambda r: 1.0 + sum(u * x for name in r.uses for u, x in zip(UNIT_COST[name], got))
    return [(share, cost(r), r) for share, r in zip(got[3:], rules)]


def plan(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, both estimated on a sample; equal ones cheaper first, then as listed."""
    return [r for _, _, r in sorted(estimates(docs, rules, text, rows), key=lambda x: (-x[0] / x[1], x[1]))]


def verdict(rules, m: dict[str, Column]) -> Column:
    """True where no rule rejects; later rules are not evaluated where an earlier one rejects."""
    if not rules:
        return F.lit(True)
    first, *rest = rules
    chain = F.when(first.reject(m), False)
    for r in rest:
        chain = chain.when(r.reject(m), False)
    return chain.otherwise(True)


def filter_documents(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Rows of docs that no rule rejects, columns unchanged.

    Null and empty texts have no word and are rejected by the default rules. Repeated rows all stay
    or all go. Measures are computed as the chain reaches them.
    """
    return docs.where(verdict(plan(docs, rules, text), measures(F.col(text))))


def quality_report(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measures, base_failed and kept for each row of docs; repeated rows each get theirs.

    The report holds every measure of every row, so here the chain only combines them.
    """
    m = measures(F.col(text))
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper"]
    out = docs.select(F.col(key), m["words"].alias("__w"), *(m[n].alias(n) for n in names))
    out = out.select(key, F.col("__w.n_words").alias("n_words"), *names, F.col("__w.n_repeat_words").alias("n_repeat_words"))
    c = {n: F.col(n) for n in out.columns}
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    kept = ~failed & verdict(plan(docs, rules, text), c)
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
