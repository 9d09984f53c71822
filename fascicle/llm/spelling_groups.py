"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Symmetric-delete join. Every word emits itself and its distinct single deletions; two words can
only be one insertion, deletion or replacement apart if they share such a key, so an equi-join on
the keys finds all pairs, and an exact check of the distance keeps the near ones. A key is shared
by at most the words that one letter more makes of it, whatever the corpus. Each word's form is
then an aggregate over its near words, and roots follow by doubling: a word's ancestor is replaced
by its ancestor's ancestor until nothing changes. Forms grow at least RATIO-fold in count from word
to word, so chains are short (log of the largest count) and rounds are the log of that.

Scale. Occurrences are counted in their tasks before they are shuffled; from there on the job grows
with the vocabulary, not with the texts. A root that a third of all words lead to is split by
adaptive execution, as each round joins plain tables. Nothing but counts reaches the driver.

Rows. Null texts have no word; a null doc_id counts as empty text where it is hashed. Repeated rows
count each time. Whole texts are read. An empty table has no word. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import ascii_lower, durable

RUN = r"[A-Za-zÀ-ÿ]+"
#: Least code points and occurrences of a word; how many times as frequent a form is.
LENGTH, COUNT, RATIO = 6, 5, 5
#: Of a run of which this divides the hash, one letter is lost.
LOSS = 199


def without(word: Column, at: Column) -> Column:
    """word without its code point at `at` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, one row for each run of letters of each text, after the loss of letters."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hit = runs.select("run", h.alias("h"))
    return hit.select(F.when(F.col("h") % LOSS == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, least: int = COUNT) -> DataFrame:
    """word, n of words of at least `length` code points that occur `least` times or more."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keys(words: DataFrame) -> DataFrame:
    """word, n, key: the word itself and its distinct single deletions."""
    cut = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without(F.col("word"), i))
    return words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, other_n: every word beside each word exactly one edit from it, both ways round."""
    k = durable(keys(words))
    other = k.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = k.select("key", "word").join(other, "key").where("word <> other")
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n").distinct()


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, if it is `ratio` times as frequent."""
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    out = words.join(best, "word", "left")
    far = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """word, root for each word of linked(word, form): the end of its chain of forms."""
    now = durable(linked.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        nxt = durable(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("rose")))
        if not nxt.where("rose").limit(1).count():
            return nxt.select("word", "root")
        now = nxt.select("word", "root")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    words = durable(vocabulary(occurrences(docs, doc_id, text)))
    found = durable(forms(words))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
