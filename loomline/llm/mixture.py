"""Mixtures of sources with target shares, by subset sums over counts of record lengths.

Only counts go through the arithmetic: how many records of each exact length a bucket has. A bucket's budget
is met by whole repetitions, then by a proportional share of every length, then by a bounded-knapsack
program for what is left. Records are then drawn by seeded hash, as many of each length as planned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import cut

#: Hash slices that the records of one bucket and length are cut into, so that a hot length spreads over tasks.
SLICES = 1024
#: Tokens that are left to the knapsack program beside one longest record; all above is met by proportional shares.
EXACT_TOKENS = 1 << 18


def bounded_knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum comes as near below the budget as it can.

    Counts are split into powers of two; the reachable sums are the bits of one large integer, and for each
    sum the step is kept at which it was first reached, to trace the choice back. Exact for any counts; memory
    is four bytes for each token of the budget, whatever the number of lengths.
    """
    lengths, counts, budget = [int(x) for x in lengths], [int(x) for x in counts], int(budget)
    take = [0] * len(lengths)
    common = math.gcd(*(x for x, n in zip(lengths, counts) if x > 0 and n > 0)) if any(x > 0 and n > 0 for x, n in zip(lengths, counts)) else 0
    if budget <= 0 or not common:
        return take
    budget //= common
    mask = (1 << (budget + 1)) - 1
    n_bytes = budget // 8 + 1
    reach, steps, first = 1, [], np.full(8 * n_bytes, -1, np.int32)
    for k, (length, count) in enumerate(zip(lengths, counts)):
        length //= common
        left, size = min(count, budget // length) if length > 0 else 0, 1
        while left > 0:
            part = min(size, left)
            fresh = (reach << (length * part)) & mask & ~reach
            first[np.flatnonzero(np.unpackbits(np.frombuffer(fresh.to_bytes(n_bytes, "little"), np.uint8), bitorder="little"))] = len(steps)
            steps.append((k, part, length * part))
            reach |= fresh
            left -= part
            size *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at:
        k, part, tokens = steps[first[at]]
        take[k] += part
        at -= tokens
    return take


def plan_bucket(lengths: Sequence[int], counts: Sequence[int], budget: int, max_repeats: int) -> tuple[int, list[int]]:
    """Repetitions of the whole bucket, and how many records of each length get one more.

    All arithmetic is on Python's integers, which have no largest value. The budget is met by whole repetitions;
    then every length gives its share of the rest, rounded down, and the longest lengths one more while there is
    room; at most EXACT_TOKENS and one longest record are left to ``bounded_knapsack``. As more than the rest is in
    stock, the budget is missed by less than one longest record, and within the last part by the least that can be.
    """
    lengths, counts, budget, max_repeats = [int(x) for x in lengths], [int(x) for x in counts], int(budget), int(max_repeats)
    total = sum(x * n for x, n in zip(lengths, counts))
    extra = [0] * len(lengths)
    if total <= 0 or budget <= 0 or max_repeats <= 0:
        return 0, extra
    base = min(budget // total, max_repeats)
    left = budget - base * total
    if base == max_repeats or left <= 0:
        return base, extra
    share = max(0, left - EXACT_TOKENS)
    extra = [n * share // total if x > 0 else 0 for x, n in zip(lengths, counts)]
    left -= sum(x * n for x, n in zip(lengths, extra))
    by_length = sorted((k for k, x in enumerate(lengths) if x > 0), key=lambda k: lengths[k])
    for k in reversed(by_length):  # what rounding down left over
        if left - lengths[k] >= EXACT_TOKENS and extra[k] < counts[k]:
            extra[k] += 1
            left -= lengths[k]
    more = bounded_knapsack([lengths[k] for k in by_length], [counts[k] - extra[k] for k in by_length], left)
    for k, n in zip(by_length, more):
        extra[k] += n
    return base, extra


def bucket_name(value: Column) -> Column:
    """A source or operation without differences of case, outer blanks and hub prefix; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"^[a-z]+://", ""), F.lit(""))


def mixture(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mixture of ``axis, bucket, id, tokens`` records, buckets as ``bucket_name`` has them, to ``axis, bucket, target_share, max_repeats`` targets.

    First result: ``axis, bucket, id, tokens, repeats`` with each drawn record and how often it is used. Second:
    ``axis, bucket, target_share, max_repeats, available_tokens, budget_tokens, tokens, records, repeats,
    actual_share``, one row per target.

    ``total_tokens`` is each axis' total; by default the largest for which every bucket with records can give
    its share within its repeats. A bucket without records gives nothing; its share stays unfilled in the
    actual shares of the others, which sum to 1 over what was drawn. Records of buckets without a target, of
    no bucket and of no tokens are not drawn. Empty tables give empty mixtures. Repeated ids are records of
    their own as long as their rows differ in nothing but are counted each.

    The counts by length are sums formed before the shuffle. A bucket's plan sees its distinct lengths only,
    never its records. A length that is drawn whole or not at all needs no shuffle. Records of any other are cut
    into SLICES by hash, so that a hot length spreads over tasks; each slice has its quota and is ranked by itself.
    Shares are sums over the drawn rows.
    """
    targets = targets.select("axis", "bucket", "target_share", "max_repeats").distinct()
    wanted = targets.select("axis", "bucket", bucket_name(F.col("bucket")).alias("key"))
    used = records.select("axis", F.col("bucket").alias("key"), "id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).join(wanted, ["axis", "key"]).drop("key")
    used = cut(used.withColumn("h", F.xxhash64(F.lit(seed), "axis", "id")))
    lengths = used.groupBy("axis", "bucket", "tokens").agg(F.count(F.lit(1)).alias("n"))
    available = lengths.groupBy("axis", "bucket").agg(F.sum(F.col("tokens") * F.col("n")).alias("available_tokens"))
    sized = targets.join(available, ["axis", "bucket"], "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    if total_tokens is None:
        limit = F.floor(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")).cast("long")
        totals = sized.where("available_tokens > 0 and target_share > 0").groupBy("axis").agg(F.min(limit).alias("total"))
    else:
        totals = targets.select("axis").distinct().withColumn("total", F.lit(total_tokens).cast("long"))
    budgets = sized.join(totals, "axis", "left").withColumn("budget_tokens", F.coalesce(F.floor(F.col("total") * F.col("target_share")), F.lit(0)).cast("long")).drop("total")

    def plan(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tokens")
        base, extra = plan_bucket(frame["tokens"], frame["n"], frame["budget_tokens"].iloc[0], frame["max_repeats"].iloc[0])
        return pd.DataFrame({"axis": key[0], "bucket": key[1], "tokens": frame["tokens"], "n": frame["n"], "base": base, "extra": extra})

    sized_lengths = lengths.join(budgets.select("axis", "bucket", "budget_tokens", "max_repeats"), ["axis", "bucket"])
    plans = cut(sized_lengths.groupBy("axis", "bucket").applyInPandas(plan, "axis string, bucket string, tokens bigint, n bigint, base bigint, extra bigint"))

    partly = "extra > 0 and extra < n"
    planned = used.join(plans.where("base > 0 or extra > 0"), ["axis", "bucket", "tokens"])
    whole = planned.where(f"not ({partly})").withColumn("one", (F.col("extra") > 0).cast("long"))
    part = planned.where(partly).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    slice_ = Window.partitionBy("axis", "bucket", "tokens", "slice")
    before = F.coalesce(F.sum("m").over(Window.partitionBy("axis", "bucket", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = part.groupBy("axis", "bucket", "tokens", "extra", "slice").agg(F.count(F.lit(1)).alias("m")).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") - before)))
    # The join brings each slice together, so its ranks cost no further shuffle.
    drawn = part.join(quota.drop("extra", "m"), ["axis", "bucket", "tokens", "slice"])
    ranked = drawn.withColumn("one", (F.row_number().over(slice_.orderBy("h", "id")) <= F.col("quota")).cast("long"))
    rows = whole.unionByName(ranked.drop("slice", "quota")).select("axis", "bucket", "id", "tokens", (F.col("base") + F.col("one")).alias("repeats")).where("repeats > 0")

    reached = rows.groupBy("axis", "bucket").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("repeats"))
    shares = budgets.join(reached, ["axis", "bucket"], "left").na.fill(0, ["tokens", "records", "repeats"])
    total = F.sum("tokens").over(Window.partitionBy("axis"))
    shares = shares.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    return rows, shares.select("axis", "bucket", "target_share", "max_repeats", "available_tokens", "budget_tokens", "tokens", "records", "repeats", "actual_share")
