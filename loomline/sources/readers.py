"""Sources and sinks: ordered scans, mixed JSON lines, text folders, knowledge files, token streams, checked writes."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.functions.text import first_text


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """Adds the row's number in the given order, from 0, by range partitions."""
    from loomline.operators.corpus import prefix_sum

    return prefix_sum(df.withColumn("__all", F.lit(1)), ["__all"], list(order), F.lit(1).cast("long"), name).drop("__all")


def raw_text(df: DataFrame) -> Column:
    """Text of a raw row: ``text``, else ``content``, whichever the table has; '' if neither has any."""
    have = [F.col(c) for c in ("text", "content") if c in df.columns]
    return first_text(*have) if have else F.lit("")


def renamed(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Columns under their first name, taken from the first of their other names that has a value; names are trimmed."""
    df = df.toDF(*(c.strip() for c in df.columns))
    out = {to: first_text(*(F.col(f"`{c}`").cast("string") for c in of if c in df.columns)) if any(c in df.columns for c in of) else F.lit("") for to, of in names.items()}
    return df.select(*(c.alias(to) for to, c in out.items()))


#: Names that instruction tables use for their columns.
ALPACA = {"instruction": ("instruction", "talimat", "question"), "input": ("input", "giriş", "giris"), "output": ("output", "çıktı", "cikti", "answer")}
CODE = {"code": ("code", "whole_func_string", "func_code_string"), "summary": ("summary", "docstring", "func_documentation_string")}


def knowledge_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines of mixed JSON and text as ``kind, s, r, e, text``: triples by id or by subject, predicate and
    object, text records, and rejected lines. Blank lines are skipped."""
    v = F.trim("value")
    j = F.try_parse_json(v)
    field = lambda *names: F.coalesce(*(F.nullif(F.trim(F.try_variant_get(j, f"$.{n}", "string")), F.lit("")) for n in names))
    out = lines.where(v != "").select(
        v.alias("text"), v.startswith("{").alias("object"), j.isNotNull().alias("parsed"), field("s_label", "subject", "s_id").alias("s"), field("r_label", "predicate", "r_id").alias("r"), field("e_label", "object", "e_id").alias("e")
    )
    triple = F.col("s").isNotNull() & F.col("r").isNotNull() & F.col("e").isNotNull()
    kind = F.when(~F.col("object"), "text").when(F.col("parsed") & triple, "triple").otherwise("rejected")
    return out.select(kind.alias("kind"), "s", "r", "e", F.when(~F.col("object"), F.col("text")).alias("text"))


def text_folder(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """Lines of the first text files of a folder tree by name, with ``file`` and its number."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    names = rows.select("file").distinct().orderBy("file").limit(files)
    return rows.join(names, "file", "left_semi")


def shortest(rows: DataFrame, duration: str) -> DataFrame:
    """The row of the least duration; a missing one counts as the longest."""
    return rows.orderBy(F.coalesce(F.col(duration), F.lit(1e18))).limit(1)


def write_text(df: DataFrame, text: str, order: Sequence[str], path: str) -> int:
    """Lines in order as text files; the number of bytes of text."""
    df.orderBy(*order).select(F.col(text).alias("value")).write.mode("error").text(path)
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def write_facts(facts: DataFrame, path: str) -> None:
    facts.orderBy("predicate", "args").write.mode("error").json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromDDL("predicate string, args array<string>")).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object to a line; nulls are kept."""
    df.write.mode("error").option("ignoreNullFields", "false").json(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    from loomline.functions.chat import MESSAGE

    return spark.read.schema(StructType.fromDDL(f"sft_id bigint, source string, messages {MESSAGE}")).json(path)


_ATOM = "struct<predicate:string,args:array<string>>"


def write_memory(facts: DataFrame, rules: Sequence, path: str) -> None:
    """Facts in order and rules in theirs, as lines of JSON in two folders."""
    write_facts(facts, f"{path}/facts")
    rows = [(k, r.name, [(p.predicate, list(p.args)) for p in r.premises], (r.conclusion.predicate, list(r.conclusion.args))) for k, r in enumerate(rules)]
    facts.sparkSession.createDataFrame(rows, f"ord int, name string, premises array<{_ATOM}>, conclusion {_ATOM}").write.mode("error").json(f"{path}/rules")


def read_memory(spark: SparkSession, path: str) -> tuple[DataFrame, list]:
    """Facts and rules of a saved memory. Rules are as many as were written, which is a text's worth."""
    from loomline.operators.deductive import Atom, Rule

    rules = spark.read.schema(StructType.fromDDL(f"ord int, name string, premises array<{_ATOM}>, conclusion {_ATOM}")).json(f"{path}/rules").orderBy("ord").collect()
    atom = lambda a: Atom(a.predicate, tuple(a.args))
    return read_facts(spark, f"{path}/facts"), [Rule(tuple(map(atom, r.premises)), atom(r.conclusion), r.name) for r in rules]


def write_bank(bank: DataFrame, path: str) -> None:
    """Continuations by fingerprint, sorted within files, so that look-ups read few row groups."""
    bank.sortWithinPartitions("fp").write.mode("error").parquet(path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Continuations that count: of known tokens and with a weight."""
    return spark.read.parquet(path).where("next >= 0 and weight > 0")


def find_manifests(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Manifests of one pipeline version in a folder tree of JSON lines; lines that are none are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").schema(StructType.fromDDL("source string, n bigint, duration bigint, pipeline_version string")).json(path)
    return rows.where(F.col("pipeline_version") == version)


def task_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all JSON files below a folder with the file they lie in; what cannot be read is left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").schema(StructType.fromDDL(schema)).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def export_tokens(df: DataFrame, ids: str, path: str) -> None:
    """Token ids as little-endian 16-bit values in one binary column per row."""

    def pack(part: pd.Series) -> pd.Series:
        def one(x):
            values = np.asarray(x if x is not None else [], np.int64)
            if len(values) and (values.min() < 0 or values.max() > 65_535):
                raise ValueError("a token id does not fit 16 bits")
            return values.astype("<u2").tobytes()

        return part.map(one)

    df.withColumn("data", F.pandas_udf(pack, "binary")(F.col(ids))).drop(ids).write.mode("error").parquet(path)


def import_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token ids of 16-bit values. A value cut in half is an error."""
    unpack = F.pandas_udf(lambda part: part.map(lambda b: np.frombuffer(b, "<u2").astype(np.int32)), "array<int>")
    df = spark.read.parquet(path)
    df = df.where(F.when(F.octet_length("data") % 2 == 1, F.raise_error(F.lit("a token id is cut"))).otherwise(F.lit(True)))
    return df.withColumn("ids", unpack(F.col("data"))).drop("data")


def probe(df_of, name: str) -> dict:
    """Columns and types of a source, or its error, without an exception."""
    try:
        return {"source": name, "ok": True, "schema": df_of().schema.simpleString(), "error": None}
    except Exception as e:  # noqa: BLE001  whatever the source raises is the result
        return {"source": name, "ok": False, "schema": None, "error": f"{type(e).__name__}: {str(e)[:200]}"}


def stage(name: str, run, required: bool = True) -> dict:
    """Result of a stage with its outcome; only a required stage's error is raised."""
    try:
        return {"stage": name, "ok": True, "result": run(), "error": None}
    except Exception as e:  # noqa: BLE001
        if required:
            raise
        print(f"{name}: {e}", file=sys.stderr)
        return {"stage": name, "ok": False, "result": None, "error": str(e)[:500]}
