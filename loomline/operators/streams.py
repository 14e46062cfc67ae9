"""Token streams: windows, hold-outs, eligible blocks, n-gram continuation banks and their look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import let

#: Fixed values of the rolling fingerprint: two primes and two multipliers.
P1, P2, M1, M2 = 2_147_483_629, 2_147_483_587, 1_000_003, 916_191


def words(text: Column) -> Column:
    """Words between white space; an empty array for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"), lambda w: w != "")


def window_starts(n: Column, seq: int) -> Column:
    """Starts of windows of seq tokens and their successor that do not overlap."""
    last = n - seq - 2
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(seq + 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def holdout_size(n: Column, seq: int, share: float) -> Column:
    """Tokens of the held-out tail; null for a stream too short for one."""
    size = F.least(F.greatest(F.lit(32 * seq), F.floor(n * share)), F.floor(n / 5))
    return F.when(n >= 96 * seq, size)


def eligible_blocks(masks: DataFrame, keys: Sequence[str], mask: str, seq: int, least: int = 8) -> DataFrame:
    """Start of every block of seq + 1 tokens with enough supervised targets, and how many it has."""
    stride = seq + 1
    rows = masks.select(*keys, F.size(mask).alias("n"), F.posexplode(mask).alias("pos", "m"))
    rows = rows.where((F.floor(F.col("pos") / stride) < F.floor((F.col("n") - 1) / stride)) & (F.col("pos") % stride >= 1))
    out = rows.groupBy(*keys, F.floor(F.col("pos") / stride).alias("block")).agg(F.sum("m").alias("supervised"))
    return out.where(F.col("supervised") >= least).select(*keys, (F.col("block") * stride).cast("long").alias("start"), "supervised")


def shifted(ids: Column, mask: Column, start: Column, seq: int) -> Column:
    """Inputs and targets of a window; targets without supervision are -100."""
    x = F.slice(ids, start + 1, seq)
    y = F.zip_with(F.slice(ids, start + 2, seq), F.slice(mask, start + 2, seq), lambda t, m: F.when(m == 1, t).otherwise(-100))
    return F.struct(x.alias("x"), y.alias("y"))


def fingerprint(tokens: Column) -> Column:
    """Two polynomial hashes modulo primes, as one 62-bit number."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda s, t: F.struct(((s["a"] * M1 + t + 1) % P1).alias("a"), ((s["b"] * M2 + t + 1) % P2).alias("b"))
    return F.aggregate(F.transform(tokens, lambda t: t.cast("long")), zero, step, lambda s: s["a"] * P2 + s["b"])


def ngrams(df: DataFrame, keys: Sequence[str], tokens: str, order: int) -> DataFrame:
    """Rows ``context, next`` of every token with a full context, in each document."""
    one = lambda w, i: F.struct(F.slice(w, i, order).alias("context"), F.element_at(w, i + order).alias("next"))
    pairs = let(F.col(tokens), lambda w: F.when(F.size(w) > order, F.transform(F.sequence(F.lit(1), F.size(w) - order), lambda i: one(w, i))))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.context", "p.next")


def continuation_bank(pairs: DataFrame, top: int = 4, keys: Sequence[str] = ("context",)) -> DataFrame:
    """The most frequent continuations of each context, with count, rank and share of the kept counts.

    Counts are formed before the shuffle. Ties go to the smaller token.
    """
    return ranked(pairs.groupBy(*keys, "next").agg(F.count(F.lit(1)).alias("n")), top, keys)


def ranked(counts: DataFrame, top: int, keys: Sequence[str] = ("context",)) -> DataFrame:
    """The largest counts ``n`` of each context, with rank and share of the kept counts."""
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "next"))).where(F.col("rank") <= top)
    return ranked.withColumn("weight", F.col("n") / F.sum("n").over(w))


def look_up(contexts: DataFrame, bank: DataFrame, keys: Sequence[str] = ("context",)) -> DataFrame:
    """Continuations of each context row; rows without any stay with nulls."""
    return contexts.join(bank, list(keys), "left")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A permutation without replacement: each row's rank by a hash of seed, epoch and key."""
    from loomline.operators.corpus import prefix_sum

    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.lit(epoch), key)).withColumn("__all", F.lit(1))
    return prefix_sum(hashed, ["__all"], ["__h", key], F.lit(1), "draw").drop("__h", "__all")


def draw_of(*parts: Column | str | int) -> Column:
    """A number below 2**32 from a digest of the parts, the same wherever it is computed."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def balanced_draws(rows: DataFrame, label: str, key: str, draws: int, seed: int) -> DataFrame:
    """Draws with replacement: a class uniformly, then one of its rows. Ranks and draws are joined, never collected."""
    from loomline.operators.corpus import prefix_sum

    ranked = prefix_sum(rows.withColumn("__h", draw_of(seed, F.col(key))), [label], ["__h", key], F.lit(1), "rank").drop("__h")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    classes = sizes.withColumn("class_no", F.row_number().over(Window.orderBy(label)) - 1)  # one row per class
    n = classes.count()
    drawn = rows.sparkSession.range(draws).withColumn("class_no", (draw_of(seed, "class", F.col("id")) % max(n, 1)).cast("int"))
    drawn = drawn.join(classes, "class_no").withColumn("rank", draw_of(seed, "row", F.col("id")) % F.col("size"))
    return drawn.join(ranked, [label, "rank"]).drop("class_no", "size")


def block_split(n: Column, seq: int, share: float = 0.99) -> Column:
    """Tokens of the training part of a stream, whole blocks only, and how many blocks it has with their successor."""
    train = (F.floor(F.floor(n * share) / seq) * seq).cast("long")
    return F.struct(train.alias("train"), F.greatest(F.lit(0).cast("long"), F.floor((train - 1) / seq)).alias("blocks"))


def supervised_blocks(masks: DataFrame, keys: Sequence[str], mask: str, seq: int) -> DataFrame:
    """Blocks of seq tokens, one after the other, with any supervised target, and how many they have."""
    rows = masks.select(*keys, F.size(mask).alias("n"), F.posexplode(mask).alias("pos", "m")).where(F.col("pos") >= 1)
    rows = rows.where(F.floor((F.col("pos") - 1) / seq) < F.floor((F.col("n") - 1) / seq))
    out = rows.groupBy(*keys, F.floor((F.col("pos") - 1) / seq).alias("block")).agg(F.sum("m").alias("supervised"))
    return out.where("supervised > 0")


def random_windows(masks: DataFrame, key: str, mask: str, seq: int, draws: int, seed: int, least: int = 8) -> DataFrame:
    """Windows with random starts of each stream, without those of fewer than ``least`` supervised targets."""
    high = F.size(mask) - seq - 2
    rows = masks.where(high > 0).select(key, mask, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("start", draw_of(seed, F.col(key), F.col("draw")) % high)
    targets = F.slice(F.col(mask), (F.col("start") + 2).cast("int"), seq)
    return rows.withColumn("supervised", F.aggregate(targets, F.lit(0), lambda a, m: a + m)).where(F.col("supervised") >= least).drop(mask)


def lane(number: Column) -> Column:
    """Lane of a step when three lanes take three, one and one of five steps."""
    return F.when(number % 5 < 3, "main").when(number % 5 == 3, "coder").otherwise("agent")


def bank_slots(fp: Column, slots: int) -> Column:
    """Both candidate slots of a fingerprint in a bank of so many."""
    return F.struct((fp % slots).alias("a"), (fp.bitwiseXOR(F.call_function("div", fp, F.lit(slots))) % slots).alias("b"))


def is_evaluation(key: Column, seed: int, percent: int = 2) -> Column:
    """True for about so many of a hundred rows, by a digest of seed and key."""
    return draw_of(seed, key) % 100 < percent
