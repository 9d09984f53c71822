"""Regular-expression search through trigram postings, with an exact recheck.

Whatever a regular expression matches must contain certain runs of letters. `required` reads the
parsed expression and returns which trigrams any match needs, as AND and OR over trigrams; an
expression that needs none (or uses syntax that engines read differently) needs a scan. Postings
(trigram, id) then give the candidate rows, and only these are matched with the expression itself,
so the result equals a scan's.

Scale. Each file of postings is sorted by trigram, and a query's trigrams are literals that prune the scan; of a
conjunction only the rarest trigrams are read. Trigrams that more than MOST_SHARE of a batch's rows
hold filter nothing and are left out (there are at most (mean distinct trigrams of a row) /
MOST_SHARE of them). Up to LITERALS candidates reach the scan of the rows as literals; more are
joined. Batches may be appended; each knows what it left out.

Rows. Null texts have no trigram. Letters A-Z count as a-z; other letters as themselves, as in the
match. Ids are unique or rows of one id are candidates together. Null ids are never found.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.functions.filters import among
from fascicle.sources.tables import _hadoop, cut, durable, spread

MOST_SHARE = 0.25
#: Trigrams read for one conjunction; alternatives spelled out; candidates that become literals.
RAREST, SPELLED, LITERALS = 4, 16, 1000

#: A requirement: True (anything), a trigram, or ("and" | "or", parts).
Need = bool | str | tuple


def _both(kind: str, parts: list[Need]) -> Need:
    """AND or OR of parts, flattened; True parts vanish from an AND and make an OR True."""
    if kind == "or" and True in parts:
        return True
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else (kind, tuple(kept))


def _holds(texts: set[str]) -> Need:
    """One of texts is in the match."""
    return _both("or", [_both("and", [t[k : k + 3] for k in range(len(t) - 2)]) for t in sorted(texts)])


def _sequence(items) -> tuple[set[str] | None, Need]:
    """(all texts that items can match, or None; what a match needs).

    A run of parts with known texts is spelled out; a part without known texts ends it.
    """
    run, needs, whole = {""}, [], True

    def end(next_run: set[str]) -> None:
        nonlocal run, whole
        needs.append(_holds(run))
        run, whole = next_run, False

    def spell(texts: set[str]) -> None:
        nonlocal run
        if len(run) * len(texts) > SPELLED:
            end({""})
        run = {a + b for a, b in product(run, texts)} if len(texts) <= SPELLED else run

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            c = chr(value)
            spell({c.lower() if c < "\x80" else c})
        elif name in ("AT", "ASSERT_NOT"):
            pass  # of no width
        elif name == "ASSERT":
            texts, need = _sequence(value[1])
            needs.append(need if texts is None else _holds(texts))
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            texts, need = _sequence(value[-1] if name == "SUBPATTERN" else value)
            if texts is None:
                needs.append(need)
                end({""})
            else:
                spell(texts)
        elif name == "BRANCH":
            each = [_sequence(v) for v in value[1]]
            texts = set().union(*(t for t, _ in each if t is not None))
            if all(t is not None for t, _ in each) and len(texts) <= SPELLED:
                spell(texts)
            else:
                needs.append(_both("or", [n if t is None else _holds(t) for t, n in each]))
                end({""})
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            texts, need = _sequence(inner)
            if least == 0 and most == 1 and texts is not None and len(texts) < SPELLED:
                spell(texts | {""})
            elif least == 0 or texts is None:
                needs.append(need if least else True)
                end({""})
            elif least == most and len(texts) ** least <= SPELLED and least <= 64:
                for _ in range(least):
                    spell(texts)
            else:  # once at its beginning and once at its end
                spell(texts)
                end(texts if len(texts) <= SPELLED else {""})
        elif name == "IN" and len(value) <= SPELLED and all(str(kind) == "LITERAL" for kind, _ in value):
            spell({chr(c).lower() if c < 128 else chr(c) for _, c in value})
        else:
            end({""})
    if whole:
        return run, _both("and", needs)
    return None, _both("and", [*needs, _holds(run)])


def required(pattern: str) -> Need:
    """The trigrams (A-Z as a-z) that every text matching pattern, without regard to case, must hold.

    True where nothing is known: no run of three letters, or syntax outside the common core.
    """
    import re._parser as parser

    odd = r"\\[^dDwWsSbBnrt.^$|?*+(){}\[\]\\/\"'#&~:;,!=<>@%_ -]|\(\?(?!:|=|!|<=|<!|i\))|&&|\[[^\]]*\["
    if re.search(odd, pattern):
        return True
    try:
        texts, need = _sequence(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return True
    return need if texts is None else _both("and", [need, _holds(texts)])


def grams_of(need: Need) -> set[str]:
    if isinstance(need, tuple):
        return set().union(*map(grams_of, need[1]))
    return set() if need is True else {need}


def narrowed(need: Need, df: dict[str, int], dropped: set[str]) -> Need:
    """need without trigrams that are not indexed, and of each conjunction its rarest trigrams only."""
    if not isinstance(need, tuple):
        return True if need in dropped else need
    kind, parts = need
    parts = [narrowed(p, df, dropped) for p in parts]
    if kind == "and":
        plain = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (df.get(g, 0), g))[:RAREST]
        parts = plain + [p for p in parts if not isinstance(p, str)]
    return _both(kind, parts)


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_grams(texts: list[Column]) -> Column:
    """Distinct trigrams of several texts, none of which spans two of them."""
    each = [F.coalesce(F.regexp_extract_all(_folded(t), F.lit("(?s)(?=(...))"), F.lit(1)), F.array().cast("array<string>")) for t in texts]
    return F.array_distinct(F.concat(*each))


def write_grams(rows: DataFrame, path: str, texts: list[Column], key: str = "id", append: bool = False) -> None:
    """Index the texts (string columns) of rows under path; append adds a batch of further rows."""
    mode = "append" if append else "overwrite"
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *(t.alias(f"t{k}") for k, t in enumerate(texts)))
    own = cut(spread(named).select("id", text_grams([F.col(f"t{k}") for k in range(len(texts))]).alias("grams")))
    flat = own.select(F.explode("grams").alias("gram"), "id")
    df = durable(flat.groupBy("gram").agg(F.count("*").alias("n")))
    top = F.col("n") > MOST_SHARE * own.count()
    common = df.where(top).select("gram")
    flat = flat.join(F.broadcast(common), "gram", "left_anti")
    # Each task sorts its own postings: nothing moves, and a query's trigrams prune each file to a few pages.
    flat.sortWithinPartitions("gram", "id").write.mode(mode).parquet(f"{path}/grams")
    df.where(~top).repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{path}/df")
    common.write.mode(mode).parquet(f"{path}/dropped")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """id of all rows that may match; None where the expression needs a scan of all."""
    need = required(pattern)
    asked = sorted(grams_of(need))
    if not asked:
        return None
    read = lambda t: spark.read.parquet(f"{path}/{t}").where(among(F.col("gram"), asked))
    dropped = {r["gram"] for r in read("dropped").collect()}
    df = {r["gram"]: r["n"] for r in read("df").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    need = narrowed(need, df, dropped)
    asked = sorted(grams_of(need))
    if not asked:
        return None
    place = {g: k for k, g in enumerate(asked)}
    # Which of the asked trigrams each row holds, as bits of as many longs as it takes.
    bit = lambda g: F.expr(f"shiftleft(1L, {place[g] % 63})")
    word = lambda k: F.expr(f"bit_or(CASE {' '.join(f'WHEN gram = {_quoted(g)} THEN shiftleft(1L, {place[g] % 63})' for g in asked if place[g] // 63 == k)} ELSE 0L END)")
    words = (len(asked) + 62) // 63
    held = read("grams").where(among(F.col("gram"), asked)).groupBy("id").agg(*(word(k).alias(f"w{k}") for k in range(words)))

    def holds(n: Need) -> Column:
        if n is True:
            return F.lit(True)
        if isinstance(n, str):
            return F.col(f"w{place[n] // 63}").bitwiseAND(bit(n)) != 0
        return reduce((lambda a, b: a & b) if n[0] == "and" else (lambda a, b: a | b), map(holds, n[1]))

    return held.where(holds(need)).select("id")


def _quoted(text: str) -> str:
    """A SQL literal of any text, by its code points."""
    return "concat(" + ", ".join(f"decode(unhex('{c.encode().hex()}'), 'UTF-8')" for c in text) + ")"


def narrowed_rows(rows: DataFrame, path: str | None, pattern: str, key: str = "id") -> DataFrame:
    """rows that may match pattern by the index at path; all rows without an index or a needed trigram."""
    found = candidates(rows.sparkSession, path, pattern) if path else None
    if found is None:
        return rows
    found = durable(found)
    if found.count() <= LITERALS:
        ids = [r["id"] for r in found.collect()]
        return rows.where(among(F.col(key), ids))
    return rows.join(found.withColumnRenamed("id", key), key, "left_semi")


def drop_grams(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)
