"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that ends its encoding; the encoding
of a prefix is that token after the encoding of the shorter prefix. A token t may end a prefix if
it is a suffix of it and the token that ends the rest and t stay apart under the merge rules
(a valid pair). Storing that last token for each prefix gives

* exact appends: new bytes only add entries,
* truncation at any byte: drop entries,
* re-encoding near an edit: entries before it stay, and entries after it are taken over as soon as
  the last tokens agree with the old ones over the longest token's length.

Texts are cut by the tokenizer's pattern first; each match is encoded on its own and remembered in
a bounded per-process table, as natural text repeats its matches.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import per_process

#: Entries kept in each of the match and chunk tables of a process.
TABLE = 700_000
#: Token pairs whose validity is remembered.
PAIRS = 400_000


class Vocabulary:
    """Ranks of byte strings, and what the dynamic programme needs of them."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._last_merge(token, r)):
                self.halves[r] = pair
                self.joined[pair] = r
        # Tokens that no merge sequence makes never occur, except as a whole match.
        self.usable = {t: r for t, r in self.rank.items() if len(t) == 1 or r in self.halves}
        self.apart_known: dict[tuple[int, int], bool] = {}
        import ahocorasick

        # Bytes stand as the 256 first characters; each end of a text yields its tokens, longest first.
        self.endings = ahocorasick.Automaton()
        for t, r in self.usable.items():
            self.endings.add_word(t.decode("latin-1"), (len(t), r))
        self.endings.make_automaton()

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, by merging with lower ranks only."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2 or parts[0] not in self.rank or parts[1] not in self.rank:
            return None
        return self.rank[parts[0]], self.rank[parts[1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly the two (remembered, bounded)."""
        known = self.apart_known.get((left, right))
        if known is None:
            if len(self.apart_known) >= PAIRS:
                self.apart_known.clear()
            known = self.apart_known[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """As apart.

        Undoes the merges next to the boundary, latest first. If at some point the two tokens
        at the boundary have a merge that comes before the one undone last, BPE would have joined
        them across the boundary.
        """
        limit = 1 << 62  # merges from this rank on have been undone
        while True:
            r = self.joined.get((left, right))
            if r is not None and r < limit:
                return False
            # Undo the later of the two tokens' own merges; on a tie of ranks the left one is later.
            go_left = left > right if left in self.halves and right in self.halves else left in self.halves
            if go_left:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                # Equal ranks on the left are merged first, so a merge of this very rank counts.
                limit, right = right + 1, self.halves[right][0]
            else:
                return True


class PrefixEncoder:
    """Encoding of a growing or edited byte string (one match of the pattern)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        done, apart = len(self.data), self.v.apart
        self.data += more
        last = self.last
        last += [-1] * len(more)
        # Tokens that end in the new bytes may start in the old ones.
        at = max(0, done - self.v.longest + 1)
        for end, (n, r) in self.v.endings.iter(self.data[at:].decode("latin-1")):
            end += at + 1
            if end > done and last[end] < 0 and (n == end or apart(last[end - n], r)):
                last[end] = r

    def _ending(self, end: int) -> int:
        """The one token that is a suffix of the prefix and stays apart from what ends the rest."""
        for n in range(min(end, self.v.longest), 0, -1):
            r = self.v.usable.get(self.data[end - n : end])
            if r is not None and (n == end or self.v.apart(self.last[end - n], r)):
                return r
        raise ValueError("a byte has no token")

    def truncate(self, size: int) -> None:
        self.data, self.last = self.data[:size], self.last[: size + 1]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in place of data[start:stop]; returns how many prefixes were encoded anew."""
        old_last, tail, shift = self.last, self.data[stop:], len(new) - (stop - start)
        self.truncate(start)
        self.append(new)
        done, same = len(new), 0
        self.data += tail
        for end in range(start + len(new) + 1, len(self.data) + 1):
            self.last.append(self._ending(end))
            done += 1
            same = same + 1 if self.last[end] == old_last[end - shift] else 0
            if same >= self.v.longest:
                self.last.extend(old_last[end - shift + 1 :])
                break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes[self.last[end]])
        return out[::-1]


#: One character of each kind that a pattern may tell apart.
KINDS = "aZé中7½.,'’-_#\u0301😀\u200d"


def cuts_at_spaces(find) -> bool:
    """Whether texts may be cut before single spaces and newlines, as far as probes of all kinds of characters show.

    Probes put up to two characters of every kind on both sides of the space. A pattern that any
    probe tells apart (one whose match crosses a space, say) is matched on whole texts.
    """
    for left in ("", *KINDS, "s.", "a7", "'s", ".a", "中a", "7."):
        for space in " \n":
            for right in (*KINDS, *(a + b for a in KINDS for b in "a7.' \n")):
                if find(left + space + right) != find(left) + find(space + right):
                    return False
    return True


class Tokenizer:
    """Encodes whole texts: pattern matches, each by PrefixEncoder, with bounded tables."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.v, self.find = Vocabulary(lines), regex.compile(pattern).findall
        self.cuts = cuts_at_spaces(self.find)
        self.matches: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...] | None] = {}

    def match_ids(self, match: str) -> tuple[int, ...]:
        ids = self.matches.get(match)
        if ids is None:
            raw = match.encode()
            whole = self.v.rank.get(raw)
            ids = (whole,) if whole is not None else tuple(PrefixEncoder(self.v, raw).ids())
            if len(self.matches) >= TABLE:
                self.matches.clear()
            if len(match) <= 64:
                self.matches[match] = ids
        return ids

    def chunk_ids(self, chunk: str) -> tuple[int, ...] | None:
        """Ids of a chunk that starts at white space or the text's start; None if it ends in it."""
        ids = None
        if not chunk[-1:].isspace():
            ids = tuple(chain.from_iterable(map(self.match_ids, self.find(chunk))))
        if len(self.chunks) >= TABLE:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.

        A pattern that never matches across a single space or newline between words, but for taking it
        as its first character (see cuts_at_spaces), has chunks cut before them encoded apart. A text
        with longer runs of white space, and any text of another pattern, is matched as a whole.
        """
        if self.cuts and "\0" not in text:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            try:
                try:
                    return list(chain.from_iterable(map(self.chunks.__getitem__, chunks)))
                except KeyError:
                    known = self.chunks
                    return list(chain.from_iterable([known[c] if c in known else self.chunk_ids(c) for c in chunks]))
            except TypeError:  # some chunk ends in white space
                pass
        return [i for m in self.find(text) for i in self.match_ids(m)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


def encode(text: Column, lines: bytes, pattern: str) -> Column:
    """array<int> of the ids of each whole text; null counts as empty."""
    vocabulary = _shared(lines)

    @F.arrow_udf("array<int>")
    def of(a: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary, pattern)
        return pa.array([t.encode(x or "") for x in a.to_pylist()], pa.list_(pa.int32()))

    return of(text)


def decode(ids: Column, lines: bytes, pattern: str) -> Column:
    """binary: the bytes of each id list; null counts as empty."""
    vocabulary = _shared(lines)

    @F.arrow_udf("binary")
    def of(a: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary, pattern)
        return pa.array([t.decode(x or []) for x in a.to_pylist()], pa.binary())

    return of(ids)


def round_trip(text: Column, lines: bytes, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids."""
    vocabulary = _shared(lines)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(a: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary, pattern)
        decimal = per_process(("decimal", len(t.v.bytes)), lambda: {r: str(r) for r in t.v.bytes})
        n, i, d = [], [], []
        for x in a.to_pylist():
            ids = t.encode(x or "")
            n.append(len(ids))
            i.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            d.append(sha256(t.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def _shared(lines: bytes):
    """The vocabulary file's bytes, sent to each executor once; its size is that of the file."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(lines)


def _tokenizer(vocabulary, pattern: str) -> Tokenizer:
    lines = vocabulary.value
    return per_process(("bpe", len(lines), hash(lines), pattern), lambda: Tokenizer(lines, pattern))


def encoding_report(docs: DataFrame, lines: bytes, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    Null and empty texts have no token. Repeated rows, and rows with a null key, each get theirs; an
    empty table gives no row. Columns but the key and the text are not read.
    """
    return docs.select(F.col(key), round_trip(F.col(text), lines, pattern).alias("r")).select(key, "r.*")
