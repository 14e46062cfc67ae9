"""Round trips through the sources and sinks, dispatch by name, and suites of gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.functions.registry import Registry
from loomline.operators import deductive as r
from loomline.operators import gates, streams
from loomline.plans import chat
from loomline.plans import deductive as d_plans
from loomline.session import shared_folder, table
from loomline.sources import readers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def chat_lines(spark, d):
    """Conversations written as lines of JSON and read again."""
    at = _folder(spark)
    readers.write_json_lines(chat.conversations(spark, d).select("sft_id", "source", "messages"), at)
    back = readers.read_conversations(spark, at)
    return back.select("sft_id", "source", chat.c.signature(F.col("messages")).alias("signature"))


def token_files(spark, d):
    """Token ids of orders written as 16-bit values and read again, with the check of their size."""
    at = _folder(spark)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_partkey") % 65_536).cast("int"))).alias("ids"))
    readers.export_tokens(rows, "ids", at)
    back = readers.import_tokens(spark, at)
    return back.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def memory_file(spark, d):
    """Facts and rules saved, read again and closed."""
    at = _folder(spark)
    readers.write_memory(d_plans.facts(spark, d), [d_plans.LOCATED, d_plans.SERVES], at)
    facts, rules = readers.read_memory(spark, at)
    return d_plans.flat(r.infer(facts, rules).facts.select("predicate", "args"))


def bank_file(spark, d):
    """Best continuations of two parts by fingerprint, saved, read and looked up for every order."""
    at = _folder(spark)
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("w"))
    pairs = streams.ngrams(orders, ["l_orderkey"], "w", 2).withColumn("fp", streams.fingerprint(F.col("context")))
    readers.write_bank(streams.continuation_bank(pairs, 1, ["fp"]), at)
    bank = readers.read_bank(spark, at).select("fp", F.col("next").alias("best"))
    found = streams.look_up(pairs, bank, ["fp"])
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("contexts"), F.count(F.when(F.col("next") == F.col("best"), 1)).alias("right"))


def manifests(spark, d):
    """Manifests of all sources written, and those of one version found again; of each the shortest task."""
    at = _folder(spark)
    rows = table(spark, d, "cu07_manifest").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("task")).alias("duration"))
    rows = rows.withColumn("pipeline_version", F.when(F.col("n") % 2 == 0, "v0.7").otherwise("v0.6"))
    readers.write_json_lines(rows, at)
    return readers.find_manifests(spark, at, "v0.7").select("source", "n", "duration")


def dispatched(spark, d):
    """Functions of an allow-list, run by the name that a row gives; other names are errors."""
    calls = Registry()
    calls.register("double", lambda v: v * 2, "twice the value")
    calls.register("negate", lambda v: -v, "the value below zero")
    calls.register("square", lambda v: v * v, "the value times itself")
    name = F.element_at(F.array(*map(F.lit, ("double", "negate", "square", "erase"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    out = calls.dispatch(name, F.col("l_quantity").cast("double"))
    return table(spark, d, "lineitem").groupBy(name.alias("name"), out["ok"].alias("ok"), out["error"].alias("error")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(out["value"]), 2).alias("total"))


#: Bounds of the suite: metric, relation, bound.
SUITE = (("n", ">=", 40.0), ("with_text", ">=", 0.98), ("mean_chars", ">=", 700.0), ("mean_chars", "<=", 900.0))


def suite(spark, d):
    """Sources of the raw corpus against a suite of gates, with a message for every gate that fails."""
    rows = table(spark, d, "main_raw").groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.count("text") / F.count(F.lit(1))).alias("with_text"), F.avg(F.length("text")).alias("mean_chars"))
    return rows.select("source", F.array_join(gates.messages(SUITE), ";").alias("messages"))


def preflight(spark, d):
    """Checks of the generated conversations: that all hold, and the longest content."""
    from loomline.operators import generators

    m = generators.tool_loop(F.col("sft_id"))
    rows = table(spark, d, "main_sft").select(F.size(m).alias("n"), m[1]["content"].contains("<|tool_call|>").alias("calls"), (m[3]["role"] == "assistant").alias("ends"), F.length(m[1]["content"]).alias("chars"))
    return rows.agg(F.bool_and(F.col("n") == 4).alias("four"), F.bool_and("calls").alias("calls"), F.bool_and("ends").alias("ends"), F.max("chars").cast("long").alias("longest"))


QUERIES = {"chat_json_lines": chat_lines, "token_files": token_files, "memory_file": memory_file, "bank_file": bank_file, "manifest_discovery": manifests, "registered_functions": dispatched, "suite_violations": suite, "generator_preflight": preflight}

_ORDERS = "o AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS w FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, w, unnest(range(1, len(w) - 1)) AS i FROM o), p AS (SELECT l_orderkey, w[i:i + 1] AS context, w[i + 2] AS next FROM g)"

SQL = {
    "chat_json_lines": f"WITH {chat.MESSAGES} SELECT sft_id, source, {chat.SIG} AS signature FROM k",
    "token_files": "SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey % 65536) AS BIGINT) AS total FROM lineitem GROUP BY 1",
    "memory_file": d_plans.SQL["deductive_closure"],
    "bank_file": f"""WITH {_ORDERS}, c AS (SELECT context, next, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT context, next AS best FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS k FROM c) WHERE k = 1)
        SELECT l_orderkey, count(*) AS contexts, count(*) FILTER (next = best) AS right FROM p JOIN b USING (context) GROUP BY 1""",
    "manifest_discovery": "SELECT source, count(*) AS n, min(length(task)) AS duration FROM cu07_manifest WHERE source IS NOT NULL GROUP BY source HAVING count(*) % 2 = 0",
    "registered_functions": """WITH a AS (SELECT ['double', 'negate', 'square', 'erase'][l_linenumber % 4 + 1] AS name, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)
        SELECT name, name <> 'erase' AS ok, CASE WHEN name = 'erase' THEN 'not registered: erase' END AS error, count(*) AS n, round(sum(CASE name WHEN 'double' THEN v * 2 WHEN 'negate' THEN -v WHEN 'square' THEN v * v END), 2) AS total FROM a GROUP BY ALL""",
    "suite_violations": """WITH a AS (SELECT coalesce(source, '(none)') AS source, count(*) AS n, count(text) / count(*) AS w, avg(length(text)) AS m FROM main_raw GROUP BY 1)
        SELECT source, concat_ws(';', CASE WHEN NOT n >= 40 THEN 'n is not >= 40.0' END, CASE WHEN NOT w >= 0.98 THEN 'with_text is not >= 0.98' END, CASE WHEN NOT m >= 700 THEN 'mean_chars is not >= 700.0' END, CASE WHEN NOT m <= 900 THEN 'mean_chars is not <= 900.0' END) AS messages FROM a""",
    "generator_preflight": """SELECT true AS four, true AS calls, true AS ends, max(length('<|tool_call|>{"arguments":{"a":' || (sft_id * 17 + 3) % 997 || ',"b":' || (sft_id * 29 + 11) % 997 || '},"name":"add"}<|tool_end|>')) AS longest FROM main_sft""",
}
