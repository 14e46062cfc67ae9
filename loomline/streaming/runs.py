"""Streaming queries over the tables' files: each runs over what is there and ends, with its own checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.geometry import operation_name
from loomline.session import shared_folder, table
from loomline.streaming import stateful


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's files as a stream with the table's schema, whether the table is a file or a folder."""
    rows = table(spark, d, name)
    folder = f"{d}/{name}.parquet"
    files = rows.inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/{name}.parque[t]" if single else folder)


def finished(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Result of a stream once it has read all files: its sink is a Parquet folder beside its checkpoint."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def dedup(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a running deduplication keeps; digests are forgotten a month after their rows came in."""
    rows = stream(spark, d, "main_raw")
    return finished(stateful.running_dedup(rows, "text", "ingested_at", "30 days").select("digest")).agg(F.count(F.lit(1)).alias("kept"))


def histories(spark: SparkSession, d: str) -> DataFrame:
    """Every action with the summaries that its history holds."""
    rows, _ = stateful.fold_batches(stream(spark, d, "cu07_manifest"), stateful.history_fold, folder(spark))
    return rows.select("row_id", F.size("history").cast("long").alias("n"), F.array_join("history", "|").alias("history"))


def stall(spark: SparkSession, d: str) -> DataFrame:
    """Stall guard, batch by batch."""
    rows = stream(spark, d, "cu07_manifest").where("episode_id is not null")
    action = F.concat_ws(":", operation_name(F.col("operation")), F.coalesce("payload", F.lit("")))
    x = F.coalesce(F.try_element_at("coord", F.lit(1)), F.lit(0.0))
    rows = rows.withColumn("action", action).withColumn("delta", F.abs(x - F.lit(0.5)) / 50)
    guarded, _ = stateful.fold_batches(rows, stateful.guard_fold, folder(spark))
    return guarded.select("row_id", F.col("stall").cast("long").alias("stall"), "guard")


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each operation and source, counted batch by batch."""
    rows = stream(spark, d, "cu07_manifest").select(operation_name(F.col("operation")).alias("op"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("(none)")).alias("source"))
    _, state = stateful.fold_batches(rows, stateful.count_fold(["op", "source"]), folder(spark))
    return state.select("op", "source", "n")


def continuations(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent continuation of each pair of words, from counts that run batch by batch."""
    from loomline.operators import streams

    words = stream(spark, d, "eval_items").select(F.col("item_id").alias("doc"), streams.words(F.col("text")).alias("w"))
    pairs = streams.ngrams(words, ["doc"], "w", 2).select(F.array_join("context", " ").alias("context"), "next")
    _, state = stateful.fold_batches(pairs, stateful.count_fold(["context", "next"]), folder(spark))
    return streams.ranked(state, 1).select("context", "next", "n")


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each snapshot of a run has seen, as one row: batches told by their numbers, the last total."""
    at = folder(spark)

    def snapshot(batch: DataFrame, number: int) -> None:
        one = batch.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))
        one.write.mode("overwrite").parquet(f"{at}/progress/batch={number}")

    stream(spark, d, "main_raw").writeStream.foreachBatch(snapshot).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/progress").agg(F.sum("n").alias("n"), F.sum("with_text").alias("with_text"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Actions per day and operation by event time; each batch writes the windows it changed, the last one counts."""
    out = stateful.operation_counts(stream(spark, d, "cu07_manifest").where("recorded_at is not null"), "recorded_at")
    at = folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("start", "op").agg(F.max_by("n", "batch").alias("n"))
