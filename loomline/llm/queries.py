"""Queries of the training-data operators over the project's tables, and SQL for those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import table


def _texts(spark: SparkSession, d: str, raw: str = "text", sft: str = "assistant") -> DataFrame:
    """main_raw and main_sft as ``tbl, id, text, lang``."""
    a = table(spark, d, "main_raw").select(F.lit("main_raw").alias("tbl"), F.col("ord").alias("id"), F.col(raw).alias("text"), "lang")
    b = table(spark, d, "main_sft").select(F.lit("main_sft").alias("tbl"), F.col("sft_id").alias("id"), F.col(sft).alias("text"), "lang")
    return a.unionByName(b)


def _profiles(spark: SparkSession, d: str):
    from loomline.llm.language import fit_profiles
    from loomline.llm.tokens import language_label

    labelled = table(spark, d, "main_raw").select(F.col("ord").alias("id"), language_label(F.col("lang")).alias("lang"), "text")
    return fit_profiles(table(spark, d, "lang_samples"), labelled)


def _languages(spark: SparkSession, d: str):
    from loomline.llm.language import detect_languages, without_code
    from loomline.llm.tokens import language_label

    profiles = _profiles(spark, d)
    texts = _texts(spark, d).select("tbl", "id", language_label(F.col("lang")).alias("label"), without_code(F.col("text")).alias("text"))
    return detect_languages(texts, ["tbl", "id", "label"], "text", profiles), profiles


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.language import wrong_labels

    detected, profiles = _languages(spark, d)
    return wrong_labels(detected, F.col("label"), profiles).select("tbl", "id", F.col("found.lang").alias("lang")).distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every text's segments with language and confidence."""
    detected, _ = _languages(spark, d)
    return detected.select("tbl", "id", F.explode("segments").alias("s")).select("tbl", "id", "s.*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows and items of ``p2_overlaps`` where runs of five equal words hold half of the item."""
    return p2_overlaps(spark, d).where("run_words * 2 >= item_words").select("tbl", "id", "item_id")


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every row with an item that it holds in good part, also with words replaced."""
    from loomline.llm.leaks import leaks

    return leaks(_texts(spark, d, sft="user"), table(spark, d, "eval_items"))


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both corpora with their slices; language labels of main_raw in one code style."""
    from loomline.llm.tokens import language_label, slice_name

    a = table(spark, d, "main_raw").select(F.lit("main_raw").alias("tbl"), F.col("ord").alias("id"), slice_name(F.col("source")).alias("source"), language_label(F.col("lang")).alias("lang"), slice_name(F.col("domain")).alias("domain"), "text")
    b = table(spark, d, "coder_raw").select(F.lit("coder_raw").alias("tbl"), F.col("ord").alias("id"), slice_name(F.col("source")).alias("source"), slice_name(F.col("lang")).alias("lang"), slice_name(F.col("domain")).alias("domain"), "text")
    return a.unionByName(b)


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token count of every row of both corpora."""
    from loomline.llm.tokens import count_tokens

    return count_tokens(_token_rows(spark, d), "text", ["tbl", "id", "source", "lang", "domain"])


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Token totals of every source, language, domain and combination."""
    from loomline.llm.tokens import count_tokens, token_totals

    return token_totals(count_tokens(_token_rows(spark, d), "text", ["source", "lang", "domain"]))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows sized by the tokens of their task and action, in both mixtures."""
    from loomline.llm.mixture import bucket_name, mixture
    from loomline.llm.tokens import count_tokens

    rows = table(spark, d, "cu07_manifest")
    rows = rows.select(F.col("row_id").alias("id"), bucket_name(F.col("source")).alias("source"), bucket_name(F.col("operation")).alias("operation"), F.concat_ws("\n", "task", "action_source").alias("text"))
    sized = count_tokens(rows, "text", ["id", "source", "operation"]).withColumnRenamed("n_tokens", "tokens")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("bucket")) for a in ("source", "operation")))
    records = sized.withColumn("x", F.explode(axes)).select("x.axis", "x.bucket", "id", "tokens")
    return mixture(records, table(spark, d, "mix_targets"))


def p4_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every drawn row of both mixtures with the number of times it is used."""
    return _mixture(spark, d)[0]


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source and operation."""
    return _mixture(spark, d)[1]


def _formatting_groups(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.formatting import encoded, formatting_records

    raw = formatting_records(table(spark, d, "main_raw"), "main_raw", "ord", ["text"], "text")
    sft = formatting_records(table(spark, d, "main_sft"), "main_sft", "sft_id", ["user", "assistant"], "user")
    return encoded([raw, sft])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.formatting import formatting_copies

    return formatting_copies(_formatting_groups(spark, d))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with the number of its copies, itself included."""
    from loomline.llm.formatting import formatting_classes

    return formatting_classes(_formatting_groups(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.answers import pair_defects

    return pair_defects(table(spark, d, "main_sft"), _profiles(spark, d)).select("sft_id", F.explode("defects").alias("defect")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a published rule and are mostly entries, cells or nothing to read; ``p7_statistics`` has the reasons."""
    from loomline.llm.quality import text_statistics

    measured = text_statistics(table(spark, d, "main_raw"), "ord", "text")
    return measured.where(F.col("kind").isin("list", "table", "junk")).select("ord", "kind").distinct()


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All statistics, kinds and failed rules of main_raw."""
    from loomline.llm.quality import text_statistics

    return text_statistics(table(spark, d, "main_raw"), "ord", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.tokens import encode

    return encode(table(spark, d, "documents"), "text", ["doc_id"])


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, for each capacity, with the room left unused."""
    from loomline.llm.packing import pack_all

    return pack_all(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused room of each capacity."""
    from loomline.llm.packing import fill_summary

    return fill_summary(p9_containers(spark, d))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    from loomline.llm.privacy import find_personal, fit_finder

    documents = table(spark, d, "documents")
    return find_personal(documents, "doc_id", "text", fit_finder(documents, "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.found").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    from loomline.llm.privacy import redacted

    return _personal(spark, d).select("doc_id", redacted(F.col("text"), F.col("found")).alias("text"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
