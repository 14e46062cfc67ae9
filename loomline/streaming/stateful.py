"""Structured Streaming forms of the stateful operators: running dedup, histories, stall guard, counts, knowledge ingest.

Histories, the stall guard and running counts are folds: each batch is joined with a small state table and worked on by
the batch operators, which cut long episodes into stretches. No task sees the rows of an episode as a whole, however
many of a batch it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.geometry import operation_name, summarize_action
from loomline.functions.text import content_digest
from loomline.operators import trajectories
from loomline.operators.deductive import FACT
from loomline.session import cut

#: A fold takes a batch and the state before it (null at first) and gives rows and the new state.
Fold = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def running_dedup(stream: DataFrame, text: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each text digest; with an event time, digests are forgotten after the delay."""
    rows = stream.withColumn("digest", content_digest(F.col(text)))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"]) if time else rows.dropDuplicates(["digest"])


def fold_batches(stream: DataFrame, fold: Fold, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows and last state of a fold over all batches of a stream that are there; both are written per batch.

    A batch that runs again after a failure reads the state of the batch before it and overwrites its own, so every
    row counts once. States of more than one batch ago are not read again.
    """

    done = []

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done.append(number)
        before = spark.read.parquet(f"{folder}/state/{number - 1}") if number else None
        rows, state = fold(batch, before)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        state.write.mode("overwrite").parquet(f"{folder}/state/{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    read = stream.sparkSession.read
    return read.parquet(f"{folder}/rows").drop("batch"), read.parquet(f"{folder}/state/{done[-1]}") if done else None


def _last_rows(rows: DataFrame, size: int) -> DataFrame:
    """The last rows of each ``__key`` by their place ``__n``."""
    ends = rows.groupBy("__key").agg(F.max("__n").alias("__top"))
    return rows.join(ends, "__key").where(F.col("__n") > F.col("__top") - size).drop("__top")


def _placed(batch: DataFrame, before: DataFrame | None, columns: list[str]) -> DataFrame:
    """Rows of the state, which come first, and of the batch, in the order of an episode's steps; written once."""
    new = batch.select(F.coalesce("episode_id", F.lit("")).alias("__key"), F.lit(False).alias("__old"), *columns)
    old = before.select("__key", F.lit(True).alias("__old"), *columns) if before is not None else None
    both = new if old is None else old.unionByName(new)
    return cut(trajectories.prefix_sum(both.withColumn("__new", (~F.col("__old")).cast("int")), ["__key"], ["__new", "step", "row_id"], F.lit(1).cast("long"), "__n").drop("__new"))


def history_fold(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each action with the summaries of up to eight earlier ones of its episode; the state is those eight of each."""
    summary = summarize_action(operation_name(F.col("operation")), F.col("coord"), F.col("coord2"), F.col("payload"))
    rows = _placed(batch.withColumn("summary", summary), before, ["row_id", "step", "summary"])
    out = trajectories.histories_of(rows, "summary")
    return out.where("not __old").select(F.col("__key").alias("episode_id"), "row_id", "step", "summary", "history"), _last_rows(rows, 8).select("__key", "row_id", "step", "summary")


def guard_fold(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Stall guard over ``episode_id, row_id, step, action, delta``. The state has the last six rows of each episode, as
    many as it takes to an end, and an episode that ended gives no more rows."""
    columns = ["row_id", "step", "action", "delta", "ended"]
    batch = batch.withColumn("ended", F.lit(False))
    if before is not None:
        over = before.where("ended").select(F.col("__key").alias("__over")).distinct()
        batch = batch.join(over, F.coalesce("episode_id", F.lit("")) == F.col("__over"), "left_anti")
    rows = _placed(batch, before, columns)
    guarded = cut(trajectories.stall_guard(rows.where("not ended").withColumnRenamed("__key", "key").withColumnRenamed("__n", "n"), "key", ["n"], F.col("action"), F.col("delta")))
    ends = guarded.where("stall >= 5").select(F.col("key").alias("__key"), F.lit(True).alias("__ends")).distinct()
    state = _last_rows(rows, 6).join(ends, "__key", "left").withColumn("ended", F.col("ended") | F.coalesce("__ends", F.lit(False)))
    return guarded.where("not __old").select(F.col("key").alias("episode_id"), "row_id", F.col("stall").cast("int").alias("stall"), "guard"), state.select("__key", *columns)


def count_fold(keys: list[str]) -> Fold:
    """Running counts of rows by key; the state is the counts so far, and a batch's rows are the counts it changed."""

    def fold(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        both = new if before is None else before.unionByName(new)
        state = cut(both.groupBy(*keys).agg(F.sum("n").alias("n")))
        return state.join(new.select(*keys), keys, "left_semi"), state

    return fold


def operation_counts(stream: DataFrame, time: str, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Actions per window of event time and operation. Rows later than the delay behind the watermark do not count."""
    rows = stream.withWatermark(time, delay)
    return rows.groupBy(F.window(time, window).alias("w"), operation_name(F.col("operation")).alias("op")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def ingest_facts(stream: DataFrame, path: str, checkpoint: str):
    """Append-only fact store from a stream of ``predicate, args``: each batch adds the facts the store does not have."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = batch.select("predicate", "args").distinct()
        try:
            new = new.join(spark.read.schema(FACT).parquet(path), ["predicate", "args"], "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
