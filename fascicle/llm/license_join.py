"""License scan: exact set-similarity containment join, native expressions only.

A text block is a window of BLOCK consecutive words, at any start. A block matches a template if it
holds at least THRESHOLD of the template's distinct tokens.

Join. Template tokens are ordered by their document frequency over the whole corpus, rarest first.
A block that shares `a` tokens with a template of n tokens, as a match needs, holds one of the
template's first n - a + 1 tokens in that order (prefix filter) and at least a tokens (length
filter). An index maps each such token to its templates and its place there; a match at place i of
the template and j of the block leaves min(n - i, size - j) tokens at most (positional filter).
Pairs that pass are counted exactly.

Only texts that hold an indexed token are cut into blocks, and only blocks that start at a
template token count, as any other block holds no more than the next one that does. Blocks with
the same tokens are one. The index is bounded by the templates, not by the corpus: it is built from
literals and broadcast. Texts are never shuffled; what is shuffled is a row for each match of a
text that holds an indexed token, by a number of the text's own, so hot sources cannot skew it.

Finding an indexed token and counting frequencies takes a substring search for each token, so the
cost of a text grows with the number of template tokens (a few dozen templates).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import durable, let

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK = 48
THRESHOLD = 0.9

#: Phrases whose places count as base matches.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public notice texts (label, text); the distinct words of each are its template.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license"),
)


def spaced_words(text: Column) -> Column:
    """' w1 w2 ' of the text's words with A-Z lower-cased, each between single spaces; '  ' where there is none.

    lower() also changes letters beyond ASCII, which no template holds; the Kelvin sign, the only
    one that it makes an ASCII letter, is replaced first.
    """
    t = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(t, GAP, " ")), F.lit(" "))


def holds(spaced: Column, words: str) -> Column:
    return F.contains(spaced, F.lit(f" {words} "))


def token_order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> list[str]:
    """The templates' tokens by document frequency over all of docs, rarest first, ties by token.

    One row of counts a task is shuffled.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    spaced = docs.select(spaced_words(F.col(text)).alias("s"))
    counts = spaced.agg(*(F.count_if(holds(F.col("s"), w)) for w in vocabulary)).first()
    return sorted(vocabulary, key=lambda w: (counts[vocabulary.index(w)], w))


def blocks(words: Column, order: list[str], prefix: list[int], block: int = BLOCK) -> Column:
    """Distinct token sets of the blocks that hold a token of `prefix`, as ranks in `order`, rarest first."""
    vocabulary = F.array(*map(F.lit, order))
    ranked = F.transform(words, lambda w, i: F.struct(i.alias("at"), (F.array_position(vocabulary, w) - 1).cast("int").alias("rank")))
    places = F.filter(ranked, lambda x: x["rank"] >= 0)

    def cut(places: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            inside = F.filter(F.slice(places, k + 1, F.lit(block)), lambda y: y["at"] < x["at"] + block)
            return F.array_sort(F.array_distinct(F.transform(inside, lambda y: y["rank"])))

        return F.array_distinct(F.filter(F.transform(places, one), lambda b: F.arrays_overlap(b, F.array(*map(F.lit, prefix)))))

    return let(places, cut)


def matches(texts: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """row, labels (array), share (the largest): for each row of texts(row, words) with a matching block."""
    rank, index = {w: k for k, w in enumerate(order)}, []
    for label, t in templates:
        tokens = sorted({rank[w] for w in t.split()})
        least = ceil(threshold * len(tokens) - 1e-9)
        index += [(token, i, label, tokens, least) for i, token in enumerate(tokens[: len(tokens) - least + 1])]
    prefix = sorted({token for token, *_ in index})
    rows = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(i).alias("i"), F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens"), F.lit(least).alias("least")) for t, i, label, tokens, least in index))
    # One row for each prefix token of a template: bounded by the templates.
    index = texts.sparkSession.range(1).select(F.inline(rows))
    cut = texts.select("row", F.explode(blocks(F.col("words"), order, prefix, block)).alias("b"))
    cut = cut.select("row", "b", F.posexplode("b").alias("j", "token"))
    pairs = cut.join(F.broadcast(index), "token")
    pairs = pairs.where((F.size("b") >= F.col("least")) & (F.least(F.size("tokens") - F.col("i"), F.size("b") - F.col("j")) >= F.col("least")))
    both = F.size(F.array_intersect("b", "tokens"))
    found = pairs.where(both >= F.col("least")).select("row", "label", (both / F.size("tokens").cast("double")).alias("share"))
    return found.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))


def places(spaced: Column, phrase: str) -> Column:
    """struct(n, first, last) of the places of a phrase, words from 0; null where it has none."""
    own = phrase.split()
    # Each word gets a space of its own on both sides, so adjacent places never share one.
    apart = F.replace(spaced, F.lit(" "), F.lit("  "))
    count = lambda part: F.size(F.filter(F.split(part, " +"), lambda w: w != "")).cast("long")

    def of(parts: Column) -> Column:
        last = count(spaced) - len(own) - count(F.element_at(parts, -1))
        return F.struct((F.size(parts) - 1).cast("long").alias("n"), count(F.get(parts, F.lit(0))).alias("first"), last.alias("last"))

    return F.when(holds(spaced, phrase), let(F.split(apart, f" {'  '.join(own)} "), of))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    score: 1 where a base phrase stands, else the largest containment found (0 where none reaches
    the threshold). Null and empty texts have no word. Repeated rows, and rows with a null key, each
    get their result; an empty table gives no row. Equal frequencies are ordered by token, which
    never changes a result. Columns but the key and the text are not read.
    """
    order = token_order(docs, templates, text)
    rank = {w: k for k, w in enumerate(order)}
    prefix = set()
    for _, t in templates:
        tokens = sorted(set(t.split()), key=rank.get)
        prefix.update(tokens[: len(tokens) - ceil(threshold * len(tokens) - 1e-9) + 1])
    s = F.col("s")
    # One search for each indexed token or phrase; the words of other texts are only counted.
    some = F.lit(False)
    for w in [*sorted(prefix), *(p for p, _ in PHRASES)]:
        some = some | holds(s, w)
    n_words = F.when(s == "  ", F.lit(0)).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) - 1).cast("long")
    own = docs.select(F.col(key).alias("__key"), spaced_words(F.col(text)).alias("s"))
    own = durable(own.select("__key", n_words.alias("n_words"), F.when(some, s).alias("s"), F.monotonically_increasing_id().alias("row")))

    rest = own.where("s is null").select(
        "__key", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )

    found = own.where("s is not null")
    hits = matches(found.select("row", F.split(F.btrim("s"), " ").alias("words")), order, templates, threshold)
    found = found.select("*", *(places(s, p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES))).join(hits, "row", "left")
    field = lambda name: [F.col(f"p{k}.{name}") for k in range(len(PHRASES))]
    base_labels = F.array(*(F.when(F.col(f"p{k}").isNotNull(), label) for k, (_, label) in enumerate(PHRASES)))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    n_base = sum((F.coalesce(c, F.lit(0)) for c in field("n")), F.lit(0)).cast("long")
    found = found.select(
        "__key", "n_words", n_base.alias("n_base"), F.least(*field("first")).alias("first_word"), F.greatest(*field("last")).alias("last_word"),
        listed(base_labels).alias("base_labels"), listed(F.concat(base_labels, F.coalesce("labels", F.array()))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
    return rest.unionByName(found).withColumnRenamed("__key", key)
