"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; columns and filters are pushed into the scan by Spark."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, for checkpoints: the cluster's ``spark.checkpoint.dir``. Only where that is
    unset in a local session, as in tests, a folder of this process is set; a cluster without one is an error."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a re-read and no re-run."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_sample(df: DataFrame, id_column: str, rows: int, keep: Column | None = None) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of their ids, of which those that ``keep`` takes.

    The number of all rows comes from the files' footers, so the data are scanned once.
    """
    total = max(df.count(), 1)
    if total > rows:
        df = df.where(F.pmod(F.xxhash64(id_column), F.lit(total)) < int(rows * 0.95))
    return (df if keep is None else df.where(keep)).limit(rows)
