"""Corpus building: first-wins deduplication, byte and row budgets, fills and mixes over ordered sources.

Order is meaning here: every table has an explicit ordinal, and 'before' means a smaller one. Prefix sums
over a whole source are formed from the sums of its ranges, so no task sees a source whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import content_digest, utf8_prefix
from loomline.session import cut


def first_wins(rows: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """The first row of each digest in the given order, which must be unique and without nulls. Rows without a digest stay.

    Only digests and ordinals are grouped, with partial minima, so a digest that a third of all rows share is
    one row per task; the rows themselves then meet their own ordinals in an even join.
    """
    keys = F.struct(*(F.col(c) for c in order))
    own = F.coalesce(F.col(digest).cast("string"), F.concat_ws("|", F.lit("row"), *(F.col(c).cast("string") for c in order)))
    firsts = rows.groupBy(own.alias("d")).agg(F.min(keys).alias("k")).select(*(F.col(f"k.{c}").alias(c) for c in order))
    return rows.join(firsts, list(order), "left_semi")


def prefix_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the same keys.

    The rows are cut into ranges of (keys, order); each range gets the total of the ranges before it, and a
    running sum within. A source that holds most rows spreads over many ranges.
    """
    ranged = cut(rows.withColumn("__v", value).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "__range").agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__range", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*keys, "__range"]).withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(within), F.lit(0)))
    return out.drop("__v", "__before", "__range")


def sized(rows: DataFrame, keys: Sequence[str], ord_: str, text: str, min_chars: int, dedup_prefix: int | None, separator_bytes: int) -> DataFrame:
    """``keys, ord_, n_bytes, digest`` of the texts that are long enough, written once. What follows works on these
    narrow rows; texts are neither shuffled nor checkpointed."""
    digest = content_digest(F.col(text), dedup_prefix) if dedup_prefix != 0 else F.lit(None).cast("string")
    rows = rows.where(F.length(text) >= min_chars)
    return cut(rows.select(*keys, ord_, (F.octet_length(text) + separator_bytes).cast("long").alias("n_bytes"), digest.alias("digest")))


def budget_of(sizes: DataFrame, keys: Sequence[str], target: int | float) -> int:
    """Bytes of each source's budget: a whole number as it is, a share of an even part of all bytes."""
    if isinstance(target, int):
        return target
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    return int(total * target / max(sizes.select(*keys).distinct().count(), 1))


def _filled(placed: DataFrame, rows: DataFrame, keys: Sequence[str], ord_: str, text: str, target: int, separator_bytes: int, slack: int, cut_mode: str) -> DataFrame:
    """Narrow rows with the bytes before them that are written, and how many of their own are."""
    placed = placed.withColumn("target_bytes", F.lit(target).cast("long"))
    if cut_mode == "stop":
        body = F.col("n_bytes") - separator_bytes
        return placed.where((F.col("prev_bytes") + body <= target) | (F.col("prev_bytes") == 0)).withColumn("written_bytes", body)
    room = F.col("target_bytes") - F.col("prev_bytes")
    kept = placed.where(F.col("prev_bytes") < target - slack)
    if cut_mode == "bytes":
        return kept.withColumn("written_bytes", F.least("n_bytes", room))
    whole = kept.where(F.col("n_bytes") <= room).withColumn("written_bytes", F.col("n_bytes"))
    # The last text of each source is cut at a character: only these texts are looked at again.
    last = kept.where(F.col("n_bytes") > room).join(rows.select(*keys, ord_, F.col(text).alias("__text")), [*keys, ord_])
    cut_ = F.octet_length(utf8_prefix(F.col("__text"), (room - separator_bytes).cast("int"))) + separator_bytes
    return whole.unionByName(last.withColumn("written_bytes", cut_.cast("long")).drop("__text"))


def fill_budget(rows: DataFrame, keys: Sequence[str], ord_: str, text: str, target_bytes: int | float, *, min_chars: int = 160, dedup_prefix: int | None = None, separator_bytes: int = 1, slack: int = 4, cut_mode: str = "utf8") -> DataFrame:
    """Rows written to each source's byte budget, in order: long enough, first of their digest, until the budget is full.

    ``keys, ord_, n_bytes, prev_bytes`` (written before)``, target_bytes, written_bytes``. A whole ``target_bytes`` is
    each source's budget, a share that part of an even part of all bytes. The last text is cut at a character, with
    ``cut_mode`` 'bytes' at a byte; 'stop' writes only whole texts and stops before the first that overflows (unless
    it is the first). Digests are of whole texts, or of ``dedup_prefix`` first characters; 0 leaves copies in.
    ``payloads`` has the texts.
    """
    sizes = sized(rows, keys, ord_, text, min_chars, dedup_prefix, separator_bytes)
    firsts = sizes if dedup_prefix == 0 else first_wins(sizes, "digest", [*keys, ord_])
    target = budget_of(firsts, keys, target_bytes)
    placed = prefix_sum(firsts.drop("digest"), keys, [ord_], F.col("n_bytes"), "prev_bytes")
    return _filled(placed, rows, keys, ord_, text, target, separator_bytes, slack, cut_mode)


def payloads(filled: DataFrame, rows: DataFrame, keys: Sequence[str], ord_: str, text: str, separator_bytes: int = 1) -> DataFrame:
    """The texts of filled rows as they are written; only these rows' texts meet their budgets."""
    both = filled.join(rows.select(*keys, ord_, F.col(text).alias("payload")), [*keys, ord_])
    whole = F.col("written_bytes") >= F.octet_length("payload") + separator_bytes
    return both.withColumn("payload", F.when(whole, F.col("payload")).otherwise(utf8_prefix(F.col("payload"), (F.col("written_bytes") - separator_bytes).cast("int"))))


def fill_mix(sources: Sequence[tuple[str, DataFrame, int | float]], ord_: str, text: str, *, min_chars: int = 160, dedup_prefix: int | None = None) -> DataFrame:
    """Sources filled one after the other, each to its own budget, no text twice across them.

    A later source skips the texts that an earlier one scanned before it was full, and no others. Only digests and
    sizes take part; the sources are few, and each is one step.
    """
    out, seen = None, None
    for name, rows, target in sources:
        rows = rows.withColumn("source_name", F.lit(name))
        sizes = sized(rows, ["source_name"], ord_, text, min_chars, dedup_prefix, 1)
        fresh = sizes if seen is None else sizes.join(seen, "digest", "left_anti")
        firsts = first_wins(fresh, "digest", ["source_name", ord_])
        placed = prefix_sum(firsts.drop("digest"), ["source_name"], [ord_], F.col("n_bytes"), "prev_bytes")
        filled = cut(_filled(placed, rows, ["source_name"], ord_, text, budget_of(sizes, ["source_name"], target), 1, 4, "utf8"))
        last = filled.agg(F.max(ord_)).first()[0]
        scanned = sizes.where(F.lit(False) if last is None else F.col(ord_) <= F.lit(last)).select("digest")
        seen = scanned if seen is None else seen.union(scanned)
        out = filled if out is None else out.unionByName(filled)
    return out


def fill_skip_tail(rows: DataFrame, ord_: str, n_bytes: str, target: int, head_share: float = 0.98) -> DataFrame:
    """First-fit fill: every row until the head share is reached; from there only rows that still fit.

    The head is a prefix sum. The tail, at most 2 % of the budget, is a few of them over what still fits: each step
    takes the rows up to the first that does not fit, and from there on only smaller ones are left. On the given
    tables the room shrinks by more than half a step. Rows are ordinals and sizes only.
    """
    rows = rows.select(ord_, n_bytes)
    rows = prefix_sum(rows.withColumn("__all", F.lit(1)), ["__all"], [ord_], F.col(n_bytes), "__prev").drop("__all")
    rows = cut(rows)
    head = rows.where(F.col("__prev") < target * head_share)
    at, used = head.agg(F.max(ord_), F.sum(n_bytes)).first()
    head = head.drop("__prev")
    if at is None or used >= target:
        return head
    room, after, out = target - used, at, head
    rows = rows.drop("__prev")
    while room > 0:  # in each step all rows up to the first that does not fit; from there on only smaller ones
        rows = rows.where((F.col(ord_) > after) & (F.col(n_bytes) <= room))
        fits = prefix_sum(rows.withColumn("__all", F.lit(1)), ["__all"], [ord_], F.col(n_bytes), "__prev").drop("__all")
        over = F.col("__prev") + F.col(n_bytes) > room
        fits = cut(fits.where(F.col("__prev") <= room))  # no row beyond can be taken in this step
        stop, before = fits.where(over).agg(F.min_by(F.struct(ord_, "__prev"), ord_)).first()[0] or (None, None)
        out = out.unionByName((fits if stop is None else fits.where(F.col(ord_) < stop)).drop("__prev"))
        if stop is None:
            break
        room -= before
        after = stop
    return out


def row_caps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], caps: Column) -> DataFrame:
    """The first rows of each key, up to its cap (null: no cap). Caps count rows that passed all filters before."""
    ranked = prefix_sum(rows, keys, order, F.lit(1), "__n")
    return ranked.where(caps.isNull() | (F.col("__n") < caps)).drop("__n")


def quota_and_cap(rows: DataFrame, config: str, order: Sequence[str], target: int) -> DataFrame:
    """At most an even share (rounded up) of each configuration, and at most the target in all, in order."""
    n = rows.select(config).distinct().count()
    some = row_caps(rows, [config], order, F.lit(-(-target // max(n, 1))))
    return row_caps(some.withColumn("__all", F.lit(1)), ["__all"], [config, *order], F.lit(target)).drop("__all")


def fill_statistics(rows: DataFrame, keys: Sequence[str], ord_: str, text: str, target_bytes: int | float, *, min_chars: int = 160, min_fill: float = 0.95) -> DataFrame:
    """Bytes, documents, copies skipped up to the last one written, and whether each source reached its minimum fill."""
    sizes = sized(rows, keys, ord_, text, min_chars, None, 1)
    firsts = first_wins(sizes, "digest", [*keys, ord_])
    target = budget_of(firsts, keys, target_bytes)
    filled = cut(_filled(prefix_sum(firsts.drop("digest"), keys, [ord_], F.col("n_bytes"), "prev_bytes"), rows, keys, ord_, text, target, 1, 4, "utf8"))
    out = filled.groupBy(*keys).agg(F.sum("written_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("documents"), F.max(ord_).alias("__last"))
    scanned = sizes.join(out.select(*keys, "__last"), list(keys)).where(F.col(ord_) <= F.col("__last")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__scanned"))
    out = out.join(scanned, list(keys)).withColumn("duplicates_skipped", F.col("__scanned") - F.col("documents")).drop("__last", "__scanned")
    return out.withColumn("ok", F.col("n_bytes") >= F.lit(int(target * min_fill)))


def copy_prefix(rows: DataFrame, ord_: str, text: str, n_bytes: int | float) -> DataFrame:
    """The first so many bytes (or that share) of the lines in order, each with its line end, the last cut at a character."""
    return fill_budget(rows.withColumn("__all", F.lit(1)), ["__all"], ord_, text, n_bytes, min_chars=0, dedup_prefix=0, slack=0).drop("__all")


def shards(rows: DataFrame, order: Sequence[str], size: int, prefix: str) -> DataFrame:
    """Shard name of each row, ``size`` rows to a shard in order."""
    ranked = prefix_sum(rows.withColumn("__all", F.lit(1)), ["__all"], order, F.lit(1), "__n").drop("__all")
    return ranked.withColumn("shard", F.format_string(f"{prefix}_%03d", F.floor(F.col("__n") / size).cast("int"))).drop("__n")
