"""Language identification with a bit-sliced Bloom filter of language masks.

One table serves all languages: slot s holds a bitmask with bit l set if any n-gram of language l
hashes to s. The AND of an n-gram's HASHES slots is the mask of all languages whose filter holds
the n-gram, so one look-up answers for every language at once. A text's n-grams give a popcount
for each language; each is corrected for that filter's false-positive rate, and the largest
corrected share decides.

Learning takes a bounded, documented sample (see fit); a table has 2**BITS slots whatever the
corpus. A mask holds 64 languages; beyond that there is one table for each 64.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.toxicity_nbsvm import LONGEST, sample_ids

SIZES = (3, 4)
HASHES = 3
BITS = 16
#: N-grams kept for each language: the most frequent ones, equally many for each.
GRAMS = 1200
#: About so many documents of each language are learned from.
SAMPLE_PER_LANG = 600
#: At most about so many in all, each of LONGEST bytes at most.
SAMPLE = 6000
#: Values of lang that are learned: those with the most documents, so that dirty values cannot grow the model.
MOST_LANGS = 256
MASK = 64
PIECE = 1 << 20
UNKNOWN = "und"


def gram_hashes(text: str, sizes: tuple[int, ...] = SIZES):
    """64-bit hashes of the n-grams (code points, lower case) of a whole text, piece by piece."""
    low = f" {text.lower()} "
    for at in range(0, len(low), PIECE):
        a = np.frombuffer(low[at : at + PIECE + max(sizes) - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = a
        for n in range(2, max(sizes) + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + a[n - 1 :]
            if n in sizes:
                yield (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]
    false_rate: np.ndarray
    sizes: tuple[int, ...] = SIZES

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the bitmasks of all languages whose filter holds it, one a table."""
        slots = [slot(h, k) for k in range(HASHES)]
        return [np.bitwise_and.reduce([t[s] for s in slots]) for t in self.tables]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its corrected share of n-grams); of equal shares the language first by name."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        hits, total = np.zeros(len(self.langs)), 0
        for h in gram_hashes(text, self.sizes):
            total += len(h)
            for at, mask in zip(range(0, len(self.langs), MASK), self.masks(h)):
                n = min(MASK, len(self.langs) - at)
                if n <= 8:
                    seen = np.bincount(mask, minlength=1 << n)
                    hits[at : at + n] += [seen[(np.arange(len(seen)) >> k & 1) > 0].sum() for k in range(n)]
                else:
                    hits[at : at + n] += [np.count_nonzero(mask >> mask.dtype.type(k) & mask.dtype.type(1)) for k in range(n)]
        true = np.clip((hits - self.false_rate * total) / (1 - self.false_rate), 0, total)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / total)


def slot(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(64 - BITS - k * (48 // HASHES))) & np.uint64((1 << BITS) - 1)


def train(texts: list[str], langs: list[str], sizes: tuple[int, ...] = SIZES, grams: int = GRAMS) -> Model:
    """Fill each language's filter with its `grams` most frequent n-grams of each size.

    Frequency counts the documents that hold an n-gram.
    """
    names, by = sorted(set(langs)), {}
    for t, lang in zip(texts, langs):
        by.setdefault(lang, []).append(t)
    tables, fill = [], []
    for at in range(0, len(names), MASK):
        own = names[at : at + MASK]
        kind = np.dtype(f"u{next(b for b in (1, 2, 4, 8) if 8 * b >= len(own))}")
        table = np.zeros(1 << BITS, kind)
        for k, name in enumerate(own):
            for n in sizes:
                counts: Counter[int] = Counter()
                for t in by[name]:
                    seen = [np.unique(h) for h in gram_hashes(t, (n,))]
                    counts.update(np.unique(np.concatenate(seen)).tolist() if len(seen) > 1 else seen[0].tolist() if seen else [])
                top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:grams]
                h = np.array([x[0] for x in top], np.uint64)
                for j in range(HASHES):
                    table[slot(h, j)] |= kind.type(1 << k)
        tables.append(table)
        fill += [np.count_nonzero(table >> kind.type(k) & kind.type(1)) / len(table) for k in range(len(own))]
    return Model(names, tables, np.minimum(np.array(fill) ** HASHES, 0.99), sizes)


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, train_fold: Column | None = None) -> Model:
    """Learn from documents with a language. Null languages and texts are ignored.

    per_lang bounds the sample: about so many ids of each language, chosen by a hash of the id;
    of repeated ids the smallest text counts. MOST_LANGS bounds the languages. An empty table gives
    a model that answers und.
    """
    known = docs.where("lang is not null and doc_id is not null").where(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    known = known.where(train_fold) if train_fold is not None else known
    ids = sample_ids(known.select("doc_id", "lang"), "lang", "doc_id", per_lang, MOST_LANGS, SAMPLE).distinct()
    # Bounded by per_lang for each language, so the broadcast is safe at any size of the corpus.
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["doc_id"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) for each whole text; und for null texts and texts without a letter.

    A letter is what Unicode calls one. Repeated rows get equal results; no other column is read.
    """

    @F.arrow_udf("lang_pred string, score double")
    def of(a: pa.Array) -> pa.Array:
        got = [model.predict(x) for x in a.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["lang_pred", "score"])

    return of(text)
