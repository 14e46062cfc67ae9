"""Evaluation texts inside training text, found by spaced-seed hashing.

A mask lays a window over consecutive words and ignores some of them, so a window of training text
gets the hash of a window of an item also when an ignored word was replaced. Items and corpus are
joined on these hashes; every pair of row and item with enough hits is then verified by ungapped alignments
of its words around the hits, which tolerate other words up to a share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.textbatch import TextBatch, mix, slices, within
from loomline.session import cut

#: 1: the word counts, 0: any word may stand there. All masks span the shortest passage.
MASKS = ((1, 1, 0, 1, 1), (1, 0, 1, 1, 1))
#: Other words that may lie between two hits of one alignment, and the largest share of other words in it.
GAP_WORDS, MOST_MISMATCHES = 3, 0.4
#: Items that a seed may occur in without being common. Common seeds pair rows only with items that could match by them alone.
COMMON_ITEMS = 64
#: Words of pairs that are verified at a time.
PAIR_WORDS = 1 << 20
#: Seeds of the items up to this number are sent to every task (8 bytes each) to drop other windows at once.
BROADCAST_SEEDS = 2_000_000


def seeds(words: np.ndarray, doc: np.ndarray, mask: Sequence[int], number: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window under a mask that lies in one text."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(words) - span + 1
    at = np.flatnonzero(doc[span - 1 :] == doc[:n])
    out = np.full(len(at), number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, used in enumerate(mask):
            if used:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return at, out.view(np.int64)


def _lists(doc: np.ndarray, values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Values sorted by doc as one list for each of the rows."""
    lo, hi = np.searchsorted(doc, rows), np.searchsorted(doc, rows, "right")
    keep = np.isin(doc, rows)
    offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[keep]))


def _item_seeds(masks: Sequence[Sequence[int]]):
    """Items with their words, and with the place and hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in slices(batches, "text"):
            words = text.words()
            begin = np.searchsorted(words.doc, np.arange(text.n))
            found = [seeds(words.hash, words.doc, m, k) for k, m in enumerate(masks)]
            at, value = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            every = np.arange(text.n)
            doc = words.doc[at]
            place = pa.StructArray.from_arrays([pa.array(at - begin[doc], pa.int32()), pa.array(value)], ["place", "seed"])
            windows = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, every), len(doc)), pa.int32()), place)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), _lists(words.doc, words.hash.view(np.int64), every), windows], ["item_id", "words", "windows"])

    return run


def _hit_rows(schema: pa.Schema, masks: Sequence[Sequence[int]], reach: int, known):
    """Rows with hits: their distinct seeds, and their words up to ``reach`` around the hits. Words left out between
    are one 0. With known seeds only those count, and only rows with enough of them to match any item that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in slices(batches, "text"):
            words = text.words()
            n = len(words.doc)
            found = [seeds(words.hash, words.doc, m, k) for k, m in enumerate(masks)]
            at, value = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if known is not None:
                wanted, places, least = known.value
                hit = within(value, wanted)
                at, value = at[hit], value[hit]
            pair = np.unique(np.rec.fromarrays([words.doc[at], value])) if len(at) else np.rec.fromarrays([at, value])
            rows, first = np.unique(pair["f0"], return_index=True)
            if known is not None and len(rows):
                index = np.searchsorted(wanted, pair["f1"])
                rows = rows[np.add.reduceat(places[index], first) >= np.minimum.reduceat(least[index], first)]
            if not len(rows):
                continue
            begin, end = np.searchsorted(words.doc, rows), np.searchsorted(words.doc, rows, "right")
            mark = np.zeros(n + 1, np.int64)
            at = at[np.isin(words.doc[at], rows)]
            lo, hi = begin[np.searchsorted(rows, words.doc[at])], end[np.searchsorted(rows, words.doc[at])]
            np.add.at(mark, np.maximum(at - reach, lo), 1)
            np.add.at(mark, np.minimum(at + reach + len(masks[0]), hi), -1)
            near = np.cumsum(mark[:n]) > 0
            gap = ~near & np.append(False, near[:-1])
            value_of = np.where(near, words.hash.view(np.int64), 0)
            keep = near | gap
            cols = [part.column(c).take(pa.array(rows)) for c in ("tbl", "id")]
            chosen = np.isin(pair["f0"], rows)
            yield pa.RecordBatch.from_arrays([*cols, _lists(words.doc[keep], value_of[keep], rows), _lists(pair["f0"][chosen], pair["f1"][chosen], rows)], schema=schema)

    return run


def _matches(a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of all equal pairs of two arrays, some at a time."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    total = np.append(0, np.cumsum(hi - lo))
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        n = (hi - lo)[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = order[np.arange(n.sum()) - np.repeat(total[start:stop] - total[start], n) + np.repeat(lo[start:stop], n)]
        yield i, j
        start = stop


def aligned(row: np.ndarray, row_pair: np.ndarray, item: np.ndarray, item_pair: np.ndarray, masks=MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Which item words of each pair are found in its row: in alignments, and in runs of as many equal words as masks span.

    The words of all pairs lie end to end, with the pair's number. Hits of a pair on one diagonal with at most
    GAP_WORDS words between are one alignment, from its first to its last window; it counts if at most
    MOST_MISMATCHES of its words differ. All hits of all places take part, also where a text repeats itself.
    """
    span = len(masks[0])
    found, exact = np.zeros(len(item), bool), np.zeros(len(item), bool)
    row_begin, item_begin = np.searchsorted(row_pair, item_pair), np.searchsorted(item_pair, item_pair)
    for number, mask in enumerate((*masks, (1,) * span)):
        a, x = seeds(row, row_pair, mask, number)
        b, y = seeds(item, item_pair, mask, number)
        with np.errstate(over="ignore"):
            x, y = mix(x.view(np.uint64) + row_pair[a].astype(np.uint64)), mix(y.view(np.uint64) + item_pair[b].astype(np.uint64))
        if number == len(masks):
            at = b[np.isin(y, x)]
            for k in range(span):
                exact[at + k] = True
        for i, j in _matches(x, y):
            place = b[j]
            shift = (a[i] - row_begin[place]) - (place - item_begin[place])
            code = np.rec.fromarrays([item_pair[place], shift, place])
            code = code[np.argsort(code, order=("f0", "f1", "f2"))] if len(code) else code
            p, d, w = code["f0"], code["f1"], code["f2"]
            if not len(p):
                continue
            new = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (w[1:] - w[:-1] > span + GAP_WORDS))
            begin = w[new]
            size = w[np.append(np.flatnonzero(new)[1:] - 1, len(w) - 1)] + span - begin
            group = np.repeat(np.arange(len(begin)), size)
            offset = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
            word = begin[group] + offset
            same = item[word] == row[row_begin[word] + d[new][group] + word - item_begin[word]]
            good = np.bincount(group, ~same, len(begin)) <= MOST_MISMATCHES * size
            found[word[same & good[group]]] = True
    return found, exact


def _verify(schema: pa.Schema, masks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(np.asarray(pc.list_value_length(whole.column("words"))))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIR_WORDS, "right")))
                batch = whole.slice(at, to - at)
                at = to
                (row, row_pair), (item, item_pair) = ((np.asarray(c.flatten()).view(np.uint64), np.repeat(np.arange(len(c)), np.asarray(pc.list_value_length(c)))) for c in (batch.column("words"), batch.column("item_words")))
                found, exact = aligned(row, row_pair, item, item_pair, masks)
                n = [np.bincount(item_pair, w, batch.num_rows) for w in (np.ones(len(item)), found, exact)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("tbl", "id", "item_id")] + [pa.array(x.astype(np.int32)) for x in n], schema=schema)

    return run


def leaks(corpus: DataFrame, items: DataFrame, min_share: float = 0.5, masks=MASKS) -> DataFrame:
    """Pairs of corpus rows and evaluation items that the row holds whole or in good part, also with words replaced.

    corpus: ``tbl STRING, id BIGINT, text STRING``; items: ``item_id BIGINT, text STRING``; other columns
    are ignored. Result: ``tbl, id, item_id, item_words, matched_words, run_words``, one row for each pair whose
    alignments hold at least ``min_share`` of the item's words; ``run_words`` counts those in stretches of at
    least as many equal words as the masks span. Words are compared without case, accents, punctuation,
    spacing and invisible characters.

    Null, empty and blank texts hold nothing and match nothing. An item of fewer words than a mask spans (five)
    has no passage and is never found. Rows repeated under one id give one pair. Empty tables give an empty result.

    The seeds of the items are counted; up to BROADCAST_SEEDS of them go to all tasks, which then emit only rows
    with enough hits, and the join with the items' windows is a broadcast too. Above that both are shuffled. A
    seed of more than COMMON_ITEMS items makes no pairs, except with items that have so many common windows
    that these alone could match; any other item that matches has a window that is not common. There is no cap
    on hits, partners or candidates.
    """
    span = len(masks[0])
    if any(len(m) != span for m in masks):
        raise ValueError("masks must span equally many words")
    spark = corpus.sparkSession
    item = cut(items.select("item_id", "text").mapInArrow(_item_seeds(masks), "item_id bigint, words array<bigint>, windows array<struct<place:int,seed:bigint>>"))
    # A window's alignment holds at most span + GAP_WORDS further words, so a pair that passes has hits at this many places.
    least = F.ceil(F.size("words") * F.lit(min_share) / (span + GAP_WORDS)).cast("int")
    places = item.select("item_id", least.alias("least"), F.explode("windows").alias("w")).select("item_id", "least", "w.seed", "w.place")
    spread = places.groupBy("seed").agg(F.count_distinct("item_id").alias("n_items"))
    places = places.join(spread, "seed").withColumn("common", F.col("n_items") > COMMON_ITEMS)
    many = places.groupBy("item_id").agg(F.count_distinct(F.when(F.col("common"), F.col("place"))).alias("n_common"))
    places = places.join(many, "item_id").where("not common or n_common >= least")
    needed = F.when(F.col("n_common") >= F.col("least"), F.col("least")).otherwise(F.col("least") - F.col("n_common"))
    places = cut(places.select("item_id", "seed", "place", F.greatest(F.lit(1), needed).alias("least")))
    longest = item.agg(F.max(F.size("words"))).first()[0] or 0

    known = None
    one_item = places.groupBy("seed", "item_id", "least").agg(F.count_distinct("place").cast("int").alias("n"))
    if places.count() <= BROADCAST_SEEDS:
        rows = one_item.groupBy("seed").agg(F.max("n").alias("n"), F.min("least").alias("least")).orderBy("seed").toPandas()
        known = spark.sparkContext.broadcast((rows["seed"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["least"].to_numpy(np.int64)))
        places = F.broadcast(places)
    lists = pa.list_(pa.int64())
    schema = pa.schema([("tbl", pa.string()), ("id", pa.int64()), ("words", lists), ("seeds", lists)])
    hits = cut(corpus.select("tbl", "id", "text").mapInArrow(_hit_rows(schema, masks, longest, known), "tbl string, id bigint, words array<bigint>, seeds array<bigint>"))
    pairs = (
        hits.select("tbl", "id", F.explode("seeds").alias("seed")).join(places, "seed").groupBy("tbl", "id", "item_id", "least").agg(F.count_distinct("place").alias("hits"))
        .where(F.col("hits") >= F.col("least")).select("tbl", "id", "item_id")
    )
    texts = hits.select("tbl", "id", "words").distinct()
    pairs = pairs.join(texts, ["tbl", "id"]).join(item.select("item_id", F.col("words").alias("item_words")), "item_id").select("tbl", "id", "item_id", "words", "item_words")
    out = pa.schema([("tbl", pa.string()), ("id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("matched_words", pa.int32()), ("run_words", pa.int32())])
    checked = pairs.mapInArrow(_verify(out, masks), "tbl string, id bigint, item_id bigint, item_words int, matched_words int, run_words int")
    passed = checked.where((F.col("item_words") >= span) & (F.col("matched_words") >= F.col("item_words") * F.lit(min_share)))
    return passed.groupBy("tbl", "id", "item_id", "item_words").agg(F.max("matched_words").alias("matched_words"), F.max("run_words").alias("run_words"))
