r"""Chat formatting with relational operators and Spark expressions only.

Template. A block is OPEN role newline text CLOSE; adjacent turns of one role share a block, their
texts parted by NEXT. Roles and texts are escaped so that no control string can arise from
data, and dropping the escaping backslashes restores them (a newline in a role is NEWLINE):

    backslash      -> two backslashes
    <|  </s>  [INST]  [/INST]  <s>  -> a backslash after the first character

Loss mask. For each block an array of (start, length) in code points from the block's start; only
assistant texts are under it, without the NEXT between them. A block's own start is the
sum of the lengths of the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import let

OPEN, NEXT, CLOSE, NEWLINE = "<|turn|>", "<|next|>", "<|end|>\n", "<|nl|>"
#: Texts whose offsets are summed together, and characters of a page of a block.
RUN, PAGE = 512, 65_536
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _sums(sizes: Column, first: Column) -> Column:
    """first, first + sizes[0], ...: as many as there are sizes. It copies what it has for each one: for short arrays."""
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def starts_of(sizes: Column, first: Column) -> Column:
    """Where texts of these sizes begin, NEXT between them: sums within parts of RUN, and over the parts' totals."""
    whole = F.transform(sizes, lambda n: n + len(NEXT))
    parts = let(whole, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / RUN).cast("int")), lambda k: F.slice(w, k * RUN + 1, RUN)))
    total = lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n)
    return let(parts, lambda p: F.flatten(F.zip_with(p, _sums(F.transform(p, total), first), lambda own, at: _sums(own, at))))


def cut(block: Column, spans: Column) -> Column:
    """The texts of spans(start, length) of a block. A span is looked for in the pages that hold it,
    as counting characters from the block's start for each one would take the square of its length."""
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length(block) / PAGE).cast("int")), lambda k: F.substring(block, k * PAGE + 1, F.lit(PAGE)))

    def one(p: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PAGE).cast("int")
        last = F.floor((s["start"] + F.greatest(s["length"], F.lit(1)) - 1) / PAGE).cast("int")
        return F.substring(F.array_join(F.slice(p, first + 1, last - first + 1), ""), s["start"] - first * PAGE + 1, s["length"])

    few = F.transform(spans, lambda s: F.substring(block, s["start"] + 1, s["length"]))
    return F.when(F.size(spans) <= 2, few).otherwise(let(pages, lambda p: F.transform(spans, lambda s: one(p, s))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array<array<struct<start, length>>> (one array a block).

    turns: conv_id, turn, role, text, in any order; rows are ordered by turn, then role and text
    (nulls first), so ties and repeated rows have one order and each is kept. Null roles and texts
    count as empty. A null conv_id is a conversation of its own.
    """
    sorted_turns = F.sort_array(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(sorted_turns.alias("turns"))

    def merge(t: Column) -> Column:
        """Blocks: struct(role, array of escaped texts), one for each run of a role."""
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i - 1)["role"] != F.get(t, i)["role"]))
        texts = lambda a, b: F.transform(F.slice(t, a + 1, b - a), lambda x: escape(x["text"]))
        return let(starts, lambda s: F.transform(s, lambda a, k: F.struct(F.get(t, a)["role"].alias("role"), texts(a, F.coalesce(F.get(s, k + 1), F.size(t))).alias("texts"))))

    blocks = grouped.select("conv_id", let(F.col("turns"), merge).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), F.replace(escape(b["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    write = lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))

    def spans(b: Column) -> Column:
        none = F.array().cast("array<struct<start:int,length:int>>")
        sizes = F.transform(b["texts"], lambda x: F.length(x))
        many = let(sizes, lambda n: F.zip_with(starts_of(n, F.length(head(b))), n, lambda at, x: F.struct(at.alias("start"), x.alias("length"))))
        return F.when(b["role"] != "assistant", none).otherwise(many)

    return blocks.select("conv_id", F.array_join(F.transform("blocks", write), "").alias("formatted"), F.transform("blocks", spans).alias("loss_mask"))


def _blocks(formatted: Column) -> Column:
    """Blocks of a formatted string, each with its CLOSE; control strings never occur in data."""
    return F.transform(F.filter(F.split(formatted, CLOSE.replace("|", r"\|")), lambda x: x != ""), lambda x: F.concat(x, F.lit(CLOSE)))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, from the formatted string alone."""

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(len(OPEN) + 1), F.length(b) - (len(OPEN) + len(CLOSE)))
        cut = F.instr(body, "\n")  # the first one: a newline in a role is written as NEWLINE
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substring(body, cut + 1, F.length(body)), NEXT.replace("|", r"\|"))
        return let(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(_blocks(formatted), turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    under = F.zip_with(_blocks(formatted), mask, lambda b, m: F.transform(cut(b, m), unescape))
    return F.flatten(under)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted strings and their masks."""
    t = F.transform(read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "")
    out = formatted.select("conv_id", "formatted", t.alias("t"), loss.alias("loss"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), sha(F.array_join("t", "")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
