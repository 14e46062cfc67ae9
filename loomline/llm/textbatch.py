"""Texts of an Arrow column as one long array of code points.

The Python side of the operators in this package works on whole Arrow batches: the texts of a
batch lie end to end in one numpy array, and character classes, words, lines and hashes are array
expressions over it. No loop runs over characters, words or rows. Spark partitions the rows and
does all joining, grouping and sorting; these helpers only turn one batch into another.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time; keeps a Python worker's arrays small whatever Spark's batch size is.
SLICE_BYTES = 1 << 20

LETTER, MARK, NUMBER, SPACE, OTHER, IGNORED = 0, 1, 2, 3, 4, 5
_TOP = 0x110000


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point. IGNORED: format characters such as zero-width spaces and joiners."""
    major = {"L": LETTER, "M": MARK, "N": NUMBER, "Z": SPACE}
    table = np.full(_TOP, OTHER, np.uint8)
    for x in (*range(0x33000), *range(0xE0000, 0xE0200)):  # the rest has no letters, marks, numbers or spaces
        table[x] = IGNORED if (c := unicodedata.category(chr(x))) == "Cf" else major.get(c[0], OTHER)
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return table


#: Letters without a canonical decomposition and the plain letters that stand for them.
PLAIN_LETTERS = {"ı": "i", "ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "t"}


@functools.lru_cache(1)
def folded() -> np.ndarray:
    """Code point without case and accents, for every code point; what has no such form stays as it is."""
    table = np.arange(_TOP, dtype=np.uint32)
    for x in range(0x80, 0x3000):
        base = unicodedata.normalize("NFKD", chr(x).lower())[0]
        table[x] = ord(PLAIN_LETTERS.get(base, base).lower()[0])
    for x in range(0xFF00, 0xFFF0):
        table[x] = ord(unicodedata.normalize("NFKC", chr(x)).lower()[0])
    table[65:91] += 32
    return table


@functools.lru_cache(64)
def _table_of(signs: str) -> np.ndarray:
    table = np.zeros(_TOP, bool)
    table[[ord(c) for c in signs]] = True
    return table


class TextBatch:
    """Code points ``cp`` of n texts; text k is ``cp[starts[k]:starts[k + 1]]``. A null text counts as empty."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(texts) else b""
        self.n = len(texts)
        self.raw = np.frombuffer(raw, np.uint8)
        lead = (self.raw & 0xC0) != 0x80
        before = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(lead, out=before[1:])
        self.starts = before[offsets - offsets[0]] if self.n else np.zeros(1, np.int64)
        self.byte_at = np.append(np.flatnonzero(lead), len(self.raw))
        self.cp = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(self.cp) != self.starts[-1]:
            raise ValueError("texts are not valid UTF-8")

    @functools.cached_property
    def cls(self) -> np.ndarray:
        return char_classes()[self.cp]

    @functools.cached_property
    def fold(self) -> np.ndarray:
        return folded()[self.cp]

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """Number of the text that a code point belongs to."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))

    @functools.cached_property
    def first(self) -> np.ndarray:
        """True at the first code point of each text that has any."""
        out = np.zeros(len(self.cp) + 1, bool)
        out[self.starts[:-1]] = True
        return out[:-1]

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flags are set in each text."""
        return self.sum_in(flags, self.starts[:-1], self.starts[1:])

    def among(self, signs: str) -> np.ndarray:
        """True for code points that are one of the signs."""
        return _table_of(signs)[self.cp]

    @staticmethod
    def sum_in(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of the values in each span."""
        if values.dtype == bool and len(start) * 8 < len(values):
            at = np.flatnonzero(values)
            return np.searchsorted(at, end) - np.searchsorted(at, start)
        total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
        np.cumsum(values, out=total[1:])
        return total[end] - total[start]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each longest stretch of members that lies in one text."""
        if not len(member):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        prev = np.empty_like(member)
        prev[0], prev[1:] = False, member[:-1]
        begin = member & (~prev | self.first)
        after = np.empty_like(member)
        after[-1], after[:-1] = True, ~member[1:] | self.first[1:]
        return np.flatnonzero(begin), np.flatnonzero(member & after) + 1

    def words(self) -> Words:
        """Stretches of letters and digits. Marks and invisible characters do not end a word."""
        keep = (self.cls == LETTER) | (self.cls == NUMBER)
        inside = keep | (self.cls == MARK) | (self.cls == IGNORED)
        start, end = self.runs(inside)
        some = self.sum_in(keep, start, end) > 0
        return Words(self, start[some], end[some], keep)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True for values that are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Words:
    def __init__(self, batch: TextBatch, start: np.ndarray, end: np.ndarray, keep: np.ndarray):
        self.batch, self.start, self.end, self.keep = batch, start, end, keep

    @functools.cached_property
    def doc(self) -> np.ndarray:
        return self.batch.doc[self.start] if len(self.start) else np.zeros(0, np.int32)

    @functools.cached_property
    def length(self) -> np.ndarray:
        """Letters and digits of each word."""
        return TextBatch.sum_in(self.keep, self.start, self.end)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """64-bit hash of each word without case, accents, marks and invisible characters; ss counts as one s, as in ß."""
        b = self.batch
        use = self.keep.copy()
        if len(use):
            use[1:] &= ~((b.fold[1:] == 115) & (b.fold[:-1] == 115) & ~b.first[1:])
        return hash_spans(b.fold, use, self.start, self.end)


def hash_spans(values: np.ndarray, use: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the used values of each span: a sum of scrambled values, each turned by its rank in the span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(use, out=before[1:])
    at = np.flatnonzero(use)
    lo, hi = before[start], before[end]
    rank = np.arange(len(at)) - np.repeat(lo, hi - lo) if len(at) == int((hi - lo).sum()) else None
    if rank is None:  # used values outside all spans
        inside = np.zeros(len(values) + 1, np.int8)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        return hash_spans(values, use & (np.cumsum(inside[:-1]) > 0), start, end)
    with np.errstate(over="ignore"):
        terms = mix(values[at].astype(np.uint64) + (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        return mix(total[hi] - total[lo] + (hi - lo).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, TextBatch]]:
    """The batches in pieces of about SLICE_BYTES of text, each with the code points of its texts."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows + 1, np.int64)
        texts = batch.column(column)
        np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), out=sizes[1:])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            part = batch.slice(at, to - at)
            yield part, TextBatch(part.column(column))
            at = to
