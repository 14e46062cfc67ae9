"""Byte-pair encoding with public vocabularies, as array expressions over Arrow batches.

1. Code points get classes; a finite automaton says where a piece begins. Its states are found with a
   scan over transition functions, which compose associatively, so no regular expression and no loop
   over characters is needed.
2. Equal pieces are stored once (Arrow's dictionary encoding) as arrays of symbols.
3. Adjacent pairs are joined with the merge ranks; in each round every piece gets its lowest-ranked
   merge applied, until no pair has a rank.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomline.llm.textbatch import LETTER, NUMBER, TextBatch, char_classes

#: Pieces whose ids a Python worker remembers; beyond that it starts anew. Only speed depends on it.
REMEMBERED_PIECES = 200_000
#: Pieces of more symbols than this are merged rank by rank and not round by round, which gives the same ids.
LONG_PIECE = 512
NO_RANK = np.int32(2**31 - 1)


@functools.lru_cache(1)
def _split_classes() -> np.ndarray:
    """0 letter, 1 digit, 2 blank, 3 other white space, 4 anything else. Format characters are of the last kind."""
    cls = char_classes()
    out = np.full(len(cls), 4, np.uint8)
    out[cls == LETTER], out[cls == NUMBER] = 0, 1
    out[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    out[[0x1C, 0x1D, 0x1E, 0x1F]] = 4
    out[32] = 2
    return out


# Symbols: the five classes, 5: apostrophe before s t m d, 6: before re ve ll.
# States: 0 nothing open, 1 letters, 2 digits, 3 signs, 4 blank that joins what follows, 5: one letter of a
# contraction to come, 6: two letters to come.
_NEXT = np.zeros((7, 7), np.uint8)  # [symbol, state] -> state
for _state in range(7):
    _NEXT[:5, _state] = (1, 2, 4, 0, 3)
    _NEXT[5:, _state] = 3 if _state in (3, 4) else (5, 6)
    if _state > 4:
        _NEXT[:, _state] = _state - 1 if _state == 6 else 0


@functools.lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All transition functions that compositions of symbols give: number of each symbol's function
    (plain, then as the first symbol of a text), table of compositions, and values by state."""
    plain = [tuple(map(int, row)) for row in _NEXT]
    fresh = [(f[0],) * 7 for f in plain]  # the first symbol of a text comes after state 0, whatever was before
    number = {tuple(range(7)): 0}
    for f in plain + fresh:
        number.setdefault(f, len(number))
    grown = 0
    while grown < len(number):
        grown = len(number)
        for f in list(number):
            for g in plain + fresh:
                number.setdefault(tuple(g[x] for x in f), len(number))
    every = list(number)
    after = np.array([[number[tuple(g[x] for x in f)] for f in every] for g in every], np.uint8)  # [g, f]: f, then g
    return np.array([number[f] for f in plain + fresh], np.uint8), after, np.array(every, np.uint8)


def scan(symbols: np.ndarray, first: np.ndarray, block: int = 256) -> np.ndarray:
    """State before each symbol: prefixes of the product of the symbols' transition functions.

    Composition is associative and the functions that occur are few, so each is a number and a
    composition is a look-up. Products are formed within blocks, all blocks at once, and then across blocks.
    """
    code, after, value = _functions()
    n = len(symbols)
    rows = -(-n // block)
    own = code[symbols + 7 * first.astype(np.uint8)]
    own = np.concatenate([own, np.zeros(rows * block - n, np.uint8)]).reshape(rows, block).T.copy()
    flat, width = after.reshape(-1), len(after)
    inner = np.empty((block, rows), np.uint8)
    total = np.zeros(rows, np.uint8)
    for k in range(block):
        inner[k] = total
        total = flat[own[k].astype(np.intp) * width + total]
    entry = np.zeros(rows, np.uint8)
    step = 1
    while step < rows:  # doubling
        total[step:] = flat[total[step:].astype(np.intp) * width + total[:-step]]
        step *= 2
    entry[1:] = value[total[:-1], 0]
    state = value[inner, entry[None]]
    return np.where(first, 0, state.T.reshape(-1)[:n])


def piece_starts(text: TextBatch) -> np.ndarray:
    """Code point positions where a piece begins, by the split pattern of the byte-level vocabularies.

    Pieces are contractions, letters, digits or signs with at most one blank before them, and white space;
    the last blank before something else belongs to that.
    """
    cp, n = text.cp, len(text.cp)
    if not n:
        return np.zeros(0, np.int64)
    sym = _split_classes()[cp]
    quote = np.flatnonzero((cp == 39) & ~np.append(text.first[1:], True))
    one = cp[quote + 1]
    here = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~text.first[here], cp[here], 0)
    sym[quote[np.isin(one, [115, 116, 109, 100])]] = 5
    sym[quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = 6
    state = scan(sym, text.first)
    white = (sym == 2) | (sym == 3)
    last = np.append(text.first[1:], True)
    next_white = np.append(white[1:], False) | last  # white space follows, or the text ends
    was_white = np.concatenate([[False], white[:-1]]) & ~text.first
    content = ~white & (state < 5) & ~((sym == 0) & (state == 1) | (sym == 1) & (state == 2) | (sym >= 4) & (state == 3)) & (state != 4)
    blank = white & (~was_white | ~next_white)
    return np.flatnonzero(content | blank | text.first)


class Vocabulary:
    """Ids and merge ranks of a byte-level vocabulary: a ``.json`` of tokenizers or a ``.tiktoken`` of ranks."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            model = json.load(open(path, encoding="utf-8"))["model"]
            names = {c: bytes([b]) for b, c in _byte_letters().items()}
            spell = lambda s: b"".join(names[c] for c in s)
            ids = model["vocab"]
            self.byte_id = np.array([ids[_byte_letters()[b]] for b in range(256)], np.int32)
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
            self.spelling = {i: spell(s) for s, i in ids.items() if all(c in names for c in s)}
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
            pairs = {(ranks[t[:k]], ranks[t[k:]]): (r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
            self.spelling = {r: t for t, r in ranks.items()}
        key = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.rank, self.merged = (np.array([v[k] for v in pairs.values()], np.int32)[order] for k in (0, 1))
        ranks, first = np.unique(self.rank, return_index=True)
        self.ids_of_ranks = ranks, self.merged[first]
        self.known: dict[bytes, np.ndarray] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join pairs of symbols with the merges: rank (or NO_RANK) and place in the merge table."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK), at

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of pieces laid end to end, merged until no pair has a rank; and the new sizes."""
        piece = np.repeat(np.arange(len(sizes)), sizes)
        done_sizes = np.array(sizes, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank, at = self.pair_ranks(symbols[:-1], symbols[1:])
            rank[piece[:-1] != piece[1:]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(piece)))
            active = np.repeat(lowest < NO_RANK, length)
            done.append((piece[~active], symbols[~active]))
            hit = active & (rank == np.repeat(lowest, length))
            # Of overlapping hits (a a a) every second one counts, from the left.
            chained = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(chained):
                index = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
                hit &= (index - start) % 2 == 0
            where = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[where] = self.merged[at[where]]
            keep = active
            keep[where + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        owner = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
        values = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        done_sizes = np.bincount(owner, minlength=len(sizes)) if len(sizes) else done_sizes
        return values[order], done_sizes

    def merge_long(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``merge`` gives, with work in proportion to the symbols: pairs wait by rank, the lowest rank is applied
        wherever it stands, and only the pairs beside a merge get new ranks. A merge of a symbol always has a higher
        rank than the merge that made the symbol, so ranks are met in order."""
        n = len(symbols)
        symbols, alive = symbols.astype(np.int64), np.ones(n, bool)
        ends = np.cumsum(sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1], left[ends - sizes] = -1, -1
        rank = np.full(n, NO_RANK, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """New ranks of the pairs that begin at these places."""
            rank[at] = NO_RANK
            at = at[right[at] >= 0]
            rank[at] = self.pair_ranks(symbols[at], symbols[right[at]])[0]
            at = at[rank[at] < NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            value, first = np.unique(rank[at], return_index=True)
            for r, places in zip(value.tolist(), np.split(at, first[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            number = np.arange(len(at))  # of overlapping pairs (a a a) every second one counts, from the left
            alone = np.append(True, right[at[:-1]] != at[1:])
            at = at[(number - np.maximum.accumulate(np.where(alone, number, 0))) % 2 == 0]
            gone = right[at]
            symbols[at] = self.ids_of_ranks[1][np.searchsorted(self.ids_of_ranks[0], r)]
            alive[gone] = False
            right[at] = right[gone]
            follows = right[at] >= 0
            left[right[at][follows]] = at[follows]
            before = left[at]
            note(np.unique(np.concatenate([at, before[before >= 0]])))
        piece = np.repeat(np.arange(len(sizes)), sizes)
        return symbols[alive].astype(np.int32), np.bincount(piece[alive], minlength=len(sizes))

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces laid end to end, and how many each has. Known pieces come from memory."""
        spelled = pieces.cast(pa.large_binary()).to_pylist()
        missing = [p for p in spelled if p not in self.known]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED_PIECES:
                self.known.clear()
                missing = spelled
            for long_, merge in ((False, self.merge), (True, self.merge_long)):
                some = [p for p in missing if (len(p) > LONG_PIECE) == long_]
                if some:
                    sizes = np.fromiter(map(len, some), np.int64, len(some))
                    ids, counts = merge(self.byte_id[np.frombuffer(b"".join(some), np.uint8)], sizes)
                    self.known.update(zip(some, np.split(ids, np.cumsum(counts)[:-1])))
        parts = [self.known[p] for p in spelled]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes

    def pieces(self, text: TextBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Distinct pieces with the number of each occurrence, and where each text's occurrences begin."""
        start = piece_starts(text)
        offsets = text.byte_at[np.append(start, len(text.cp))].astype(np.int64)
        all_pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(text.raw)])
        return all_pieces.dictionary_encode(), np.searchsorted(start, text.starts)

    def encode(self, text: TextBatch) -> pa.ListArray:
        """Ids of each text; an empty text has an empty list."""
        pieces, begin = self.pieces(text)
        ids, sizes = self.encode_pieces(pieces.dictionary)
        at = np.asarray(pieces.indices)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
        total = np.append(0, np.cumsum(sizes[at])) if len(at) else np.zeros(1, np.int64)
        flat = lists.take(pieces.indices).flatten() if len(at) else pa.array([], pa.int32())
        return pa.ListArray.from_arrays(pa.array(total[begin], pa.int32()), flat)

    def count(self, text: TextBatch) -> np.ndarray:
        """Number of tokens of each text."""
        pieces, begin = self.pieces(text)
        _, sizes = self.encode_pieces(pieces.dictionary)
        at = np.asarray(pieces.indices)
        total = np.append(0, np.cumsum(sizes[at])) if len(at) else np.zeros(1, np.int64)
        return total[begin[1:]] - total[begin[:-1]]

    def piece_offsets(self, text: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset of each piece in its text, and where each text's pieces begin in that list."""
        start = piece_starts(text)
        begin = text.byte_at[text.starts]
        return text.byte_at[start] - begin[text.doc[start]] if len(start) else start, np.searchsorted(start, text.starts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.spelling[i] for i in ids).decode("utf-8", "replace")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others take the code points from 256 on in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python worker."""
    return Vocabulary(path)


def default_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    """Place of a vocabulary file; the folder must be readable on every executor."""
    return f"{folder}/{name}"
