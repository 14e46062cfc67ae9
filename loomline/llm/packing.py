"""Filling fixed-capacity containers with texts, neighbouring texts together.

Each text's hashed word vector is projected to a few dimensions; its cell on a grid gives its place on a
Hilbert curve. The texts are range-partitioned and sorted by that place, and each task packs its stretch of
the curve. Pieces that do not fill a container are packed again over wider stretches, until few are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bpe import default_path, vocabulary
from loomline.llm.textbatch import TextBatch, mix, slices
from loomline.session import cut

DIMENSIONS, BITS = 4, 10
#: Tokens that a task packs at a time; also the stretch of the curve whose texts may share a container.
STRETCH_TOKENS = 4_000_000
#: Items that are packed together; the best place among their open containers is found for each.
WINDOW_ITEMS = 2_000


def projections(text: TextBatch) -> np.ndarray:
    """Few-dimensional projection of each text's hashed bag of words: the mean over its words of a random
    vector of each word, which is what a random projection of the normalised hash vector gives."""
    words = text.words()
    out = np.zeros((text.n, DIMENSIONS))
    count = np.maximum(np.bincount(words.doc, minlength=text.n), 1)
    for k in range(DIMENSIONS):
        sign = (mix(words.hash + np.uint64(k + 1)) >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5
        out[:, k] = np.bincount(words.doc, sign, text.n) / np.sqrt(count)
    return out


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n x d) of so many bits each, by bit transposition."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve_places(texts: DataFrame, id_column: str, text: str, path: str = default_path()) -> DataFrame:
    """``doc_id, tokens BIGINT, place BIGINT``: size of each text and its place on the curve. A null or empty
    text has no tokens and the place of the origin."""
    rows = texts.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            grid = np.clip((projections(t) / 2.0 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vocabulary(path).count(t)), pa.array(hilbert_index(grid))], ["doc_id", "tokens", "place"])

    return rows.mapInArrow(run, "doc_id bigint, tokens bigint, place bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: larger items first, each into the fullest container that still has room.

    Open containers are kept by the room they have left, so an item costs one look-up among ``capacity`` sizes.
    """
    number = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = 0  # bit r is set if a container has room r
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = occupied >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            c = by_room[room].pop()
            if not by_room[room]:
                occupied &= ~(1 << room)
        else:
            room, c, made = capacity, made, made + 1
        number[i] = c
        left = room - s
        by_room[left].append(c)
        occupied |= 1 << left
    return number


def _pack_stretch(capacity: int, keep_below: float | None):
    """Packs a task's stretch window by window; with ``keep_below`` the items of containers filled less than that
    go on (container null) to the next round."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = 0

        def packed(window: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            number = best_fit(window["size"].to_numpy(), capacity)
            used = np.bincount(number, window["size"].to_numpy()).astype(np.int64)
            window = window.assign(used=used[number], container=[f"{task:05d}-{made + k:07d}" for k in number.tolist()])
            made += len(used)
            if keep_below is not None:
                window.loc[window["used"] < keep_below * capacity, "container"] = None
            return window

        rest: list[pd.DataFrame] = []
        waiting = tokens = 0
        for frame in frames:
            rest.append(frame)
            waiting += len(frame)
            tokens += int(frame["size"].sum())
            if waiting >= WINDOW_ITEMS or tokens >= STRETCH_TOKENS:
                yield packed(pd.concat(rest, ignore_index=True))
                rest, waiting, tokens = [], 0, 0
        if rest:
            yield packed(pd.concat(rest, ignore_index=True))

    return run


def pack(places: DataFrame, pack_name: str, capacity: int) -> DataFrame:
    """Containers of one capacity: ``pack_name, capacity_tokens, container_id, doc_id, part, token_start, tokens,
    container_tokens, unused_tokens``.

    A text no larger than the capacity is one part. A larger text is split: its full parts fill containers of
    their own and the remainder is packed like a text. Texts without tokens take no room and share containers.
    Every part is in exactly one container. Repeated ids are packed each on its own. An empty table gives no
    containers.

    Stretches of the curve are cut by place and id, so equal texts, whatever their number, spread over tasks.
    Three rounds pack what earlier rounds left in containers that were not full. A task's stretch has about as many
    tokens in each, so with less left it is wider. The last round leaves at most one container per task that is not
    well filled.
    """
    if capacity < 1:
        raise ValueError("a container needs room")
    # A number for each row: ids may repeat or be missing.
    places = cut(places.withColumn("row", F.monotonically_increasing_id()))
    n_full = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(F.lit(0))
    rest = F.col("tokens") - n_full * capacity
    parts = places.select("row", "doc_id", "place", "tokens", n_full.alias("full"), rest.alias("rest"))
    whole = parts.where("full > 0").select("row", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    whole = whole.select(F.concat(F.lit("full-"), F.col("row"), F.lit("-"), F.col("part")).alias("container"), "doc_id", "part", (F.col("part") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("size"), F.lit(capacity).cast("long").alias("used"))
    open_ = parts.where("full = 0 or rest > 0").select("doc_id", F.col("full").alias("part"), (F.col("full") * capacity).alias("token_start"), F.col("rest").alias("size"), "place")
    schema = "doc_id bigint, part bigint, token_start bigint, size bigint, place bigint, used bigint, container string"
    done = [whole]
    for number in range(3):
        left = open_.agg(F.sum("size")).first()[0] or 0  # what earlier rounds left, so later stretches are wider
        tasks = int(max(1, min(left // STRETCH_TOKENS, 100_000)))
        sorted_ = open_.repartitionByRange(tasks, "place", "doc_id", "part").sortWithinPartitions("place", "doc_id", "part")
        packed = cut(sorted_.mapInPandas(_pack_stretch(capacity, 0.98 if number < 2 else None), schema))
        done.append(packed.where("container is not null").select(F.concat(F.lit(f"r{number}-"), "container").alias("container"), "doc_id", "part", "token_start", "size", "used"))
        open_ = packed.where("container is null").drop("used", "container")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.lit(pack_name).alias("pack_name"), F.lit(capacity).alias("capacity_tokens"), F.concat(F.lit(f"{pack_name}-"), "container").alias("container_id"), "doc_id", "part", "token_start",
        F.col("size").alias("tokens"), F.col("used").alias("container_tokens"), (F.lit(capacity) - F.col("used")).alias("unused_tokens"),
    )


def pack_all(texts: DataFrame, id_column: str, text: str, sizes: DataFrame, path: str = default_path()) -> DataFrame:
    """Containers of every row of ``pack_name, capacity_tokens``, a short table of container sizes."""
    places = cut(curve_places(texts, id_column, text, path))
    out = None
    for row in sizes.select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").collect():
        one = pack(places, row.pack_name, row.capacity_tokens)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else pack(places.limit(0), "", 1)


def fill_summary(packed: DataFrame) -> DataFrame:
    """Containers, tokens and unused room of each capacity."""
    one = packed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"))
    return one.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity_tokens") - F.col("tokens")).alias("unused_tokens"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.col("capacity_tokens")), 6).alias("fill"),
    )
