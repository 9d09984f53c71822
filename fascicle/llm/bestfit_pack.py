"""Bounded-space online best-fit packing of tokenised documents into fixed-length sequences.

Each task packs the pieces of its own partition as they come, with at most OPEN open bins. Free
space indexes the open bins: a bitset has bit f set where some open bin has f tokens free, so the
best fit for a piece of n tokens is the lowest set bit at or above n. A piece that fits nowhere opens
a bin; beyond OPEN bins the fullest closes first. No shuffle, no sort, memory bounded by OPEN;
a lost task is repeated from its own input and gives the same rows.
"""

from __future__ import annotations

import os
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import per_process

CAPACITY = 4096
OPEN = 256
END = 1
#: Segments whose ids a process remembers, and bytes of text that it cuts at a time.
TABLE = 500_000
STEP = 2 << 20


class Packer:
    """place(n) gives (bin, offset) for a piece of n tokens."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, f: int) -> int:
        b = self.free[f].pop()
        if not self.free[f]:
            self.bits &= ~(1 << f)
        self.open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            f, b = self.capacity, self.made
            self.made += 1
        if left := f - n:
            self.free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return b, self.capacity - f


WHITE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)


def _classes() -> np.ndarray:
    """Class of each byte; what is not ASCII is OTHER."""
    c = np.full(256, OTHER, np.uint8)
    c[:128] = MARK
    c[[9, 10, 11, 12, 13, 32]] = WHITE
    for first, last, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT), ("'", "'", APOSTROPHE)):
        c[ord(first) : ord(last) + 1] = kind
    return c


def _cuts() -> np.ndarray:
    """cut[a * 6 + b]: whether a byte of class a and one of class b are always in matches of their own.

    The tokenizer's matches are contractions (which start at an apostrophe), letter runs, single
    digits and mark runs; white space is dropped. Its normaliser composes letters with marks beyond
    ASCII only. So a cut is safe before white space (which stays with what follows), and between two
    ASCII classes but after an apostrophe that letters follow; never beside OTHER, and not between
    marks.
    """
    cut = np.zeros((6, 6), bool)
    cut[1:, WHITE] = True
    for a in (LETTER, DIGIT):
        cut[a, [LETTER, DIGIT, MARK, APOSTROPHE]] = True
        cut[a, a] = False
    cut[MARK, [LETTER, DIGIT]] = cut[APOSTROPHE, DIGIT] = True
    return cut.ravel()


CLASS, CUT = _classes(), _cuts()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


class Encoder:
    """Ids of texts by a dictionary of segments, each encoded by the library once a process.

    Bytes of many texts are cut into segments at once (see _cuts), the segments are numbered by
    Arrow's dictionary encoding, and ids are gathered by segment number; only segments that the
    process has not met reach the library. Segments without a byte of class OTHER are lower-cased
    first, as the tokenizer would. A text that holds a special token's string is encoded whole.
    """

    def __init__(self, spec: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share a machine's cores
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(spec)
        self.t.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.last = {i for w, i in self.t.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.made, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment. Words make one match each, so many go to the library as one text."""
        got: list[list[int]] = [[]] * len(segments)
        ask = lambda texts: [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        rest = []
        words = [k for k, s in enumerate(segments) if s.isalpha() and max(s) <= "\xff" or rest.append(k)]
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            (ids,) = ask([" ".join(segments[k] for k in some)])
            ends = [k + 1 for k, i in enumerate(ids) if i in self.last]
            if len(ends) == len(some):
                for k, a, b in zip(some, [0, *ends], ends):
                    got[k] = ids[a:b]
            else:
                rest += some
        for k, ids in zip(rest, ask([segments[k] for k in rest])):
            got[k] = ids
        return got

    def _learn(self, new: list[bytes]) -> None:
        """Entries for segments that have none."""
        base = self.made
        self.made += len(new)
        got = self._ids([s.decode("utf-8", "replace").lstrip(" ") for s in new])
        self.known.update(zip(new, range(base, base + len(new))))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], ids, np.zeros(len(self.flat), np.uint32)))
        else:
            self.flat[self.used : self.used + len(ids)] = ids
        if base + len(new) > len(self.at):
            more = np.zeros(len(self.at) + len(new), np.int64)
            self.at, self.size = np.concatenate((self.at, more)), np.concatenate((self.size, more))
        self.at[base : base + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[base : base + len(new)] = sizes
        self.used += len(ids)

    def _segments(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(starts, segments) of bytes; bounds, where texts begin or end, are always cuts."""
        kind = CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        cut[bounds] = cut[0] = cut[-1] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        low = LOWER[raw]
        odd = np.flatnonzero(kind == OTHER)
        for k in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
            low[starts[k] : starts[k + 1]] = raw[starts[k] : starts[k + 1]]
        return starts, pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low)])

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.t.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each text of a binary or string array; null counts as empty."""
        texts = texts.cast(pa.binary()).fill_null(b"") if texts.null_count else texts.cast(pa.binary())
        if not len(texts):
            return []
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        bounds = ends - ends[0]
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        starts, segments = self._segments(raw, bounds)
        coded = segments.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.made + len(names) > TABLE or self.used > 16 * TABLE:
            self._clear()
        known = self.known
        self._learn(new := [s for s in names if s not in known])
        entry = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        for s in new:
            if len(s) > 64:
                del known[s]
        size = self.size[entry]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[entry] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        end = np.concatenate(([0], end))[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist())]
        for s in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                out[k] = self._whole(texts[k].as_py())
        return out


def steps(texts: pa.Array):
    """(first row, slice) of texts, each slice about STEP bytes; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(size) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield a, texts.slice(a, b - a)


def parts(text: bytes) -> list[bytes]:
    """A text cut before white space into parts of STEP bytes at most, where it has white space."""
    out, at = [], 0
    while len(text) - at > STEP:
        cut = max(text.rfind(b" ", at + 1, at + STEP), text.rfind(b"\n", at + 1, at + STEP))
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def pack(docs: DataFrame, spec: str, capacity: int = CAPACITY, open_bins: int = OPEN, end: int = END, text: str = "text", key: str = "doc_id", tokens: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids binary).

    spec: the tokenizer's JSON. A document is its ids and then `end`; a null or empty text is the
    end id alone. Only documents beyond the capacity are cut, into full pieces and a rest. Rows
    with a null key and repeated rows are packed each on its own; an empty table gives no row. Of
    bins with equally little space the one filled last takes the piece. Other columns are not read.
    Sequence ids are unique over all partitions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if tokens else [])]
    tail = np.array([end], np.uint32)

    def encoded(encoder, texts):
        if len(texts) == 1 and (raw := texts.cast(pa.binary())[0].as_py()) and len(raw) > STEP:
            return [np.concatenate([i for p in parts(raw) for i in encoder.encode(pa.array([p], pa.binary()))])]
        return encoder.encode(texts)

    def run(batches):
        spec = shared.value
        encoder = per_process(("pack", len(spec), hash(spec)), lambda: Encoder(spec))
        packer, first = Packer(capacity, open_bins), TaskContext.get().partitionId() << 36
        for b in batches:
            for row, texts in steps(b.column(1)):
                rows, of = [], []
                for k, ids in enumerate(encoded(encoder, texts), row):
                    ids = np.concatenate((ids, tail))
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        bin_, offset = packer.place(len(part))
                        of.append(k)
                        rows.append((piece, at, len(part), crc32(part), first + bin_, offset, *((part.tobytes(),) if tokens else ())))
                if rows:
                    cols = [pa.array(c, pa.int32() if i == 0 else pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *cols], names)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if tokens else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
