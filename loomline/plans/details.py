"""Smaller operators over the tables: slices, licences, ingests, prompts, windows, screens and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.functions import chat as c
from loomline.functions import geometry as g
from loomline.functions import knowledge
from loomline.functions import text as t
from loomline.operators import corpus, gates, streams, trajectories
from loomline.operators.corpus import prefix_sum
from loomline.plans import chat, deductive
from loomline.plans.corpus import LINES, WS, lines
from loomline.plans.manifest import SQL as MANIFEST
from loomline.session import shared_folder, table
from loomline.sources import readers
from loomline.streaming import runs, stateful

SHARE = 0.5
#: Sources that count as freely licensed here; a blank one passes.
ALLOWED = ("code-python", "code-java", "no/such")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def code_slice(spark, d):
    """Code in one language up to a quarter of the budget, stopping before the first that overflows; copies stay in."""
    rows = table(spark, d, "coder_raw").where("text is not null").select("ord", F.lower(F.trim("lang")).alias("lang"), t.strip(F.col("text")).alias("code")).where("lang is not null")
    out = corpus.fill_budget(rows, ["lang"], "ord", "code", SHARE / 4, min_chars=60, dedup_prefix=0, separator_bytes=0, cut_mode="stop")
    return out.select("lang", "ord", F.col("written_bytes").cast("long").alias("written_bytes"))


def licensed(spark, d):
    """Code of allowed sources; a source that is blank or missing passes."""
    name = F.coalesce(F.lower(F.trim("source")), F.lit(""))
    rows = table(spark, d, "coder_raw").where((name == "") | name.isin(*ALLOWED))
    return rows.groupBy(name.alias("licence")).agg(F.count(F.lit(1)).alias("n"))


def ingested(spark, d):
    """Lines of the documents as knowledge records: accepted, rejected, and the facts they add."""
    rows = readers.knowledge_lines(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))
    meant = rows.select("kind", "s", "r", "e", knowledge.compiled(F.col("text")).alias("p"))
    taken = F.when(F.col("kind") == "text", F.col("p.kind") != "ERROR").otherwise(F.col("kind") == "triple")
    fact = F.when(F.col("kind") == "triple", F.concat_ws("|", "r", "s", "e")).when(F.col("p.kind") == "FACT", F.concat_ws("|", F.col("p.predicate"), F.array_join("p.args", "|")))
    return meant.agg(F.count(F.when(taken, 1)).alias("accepted"), F.count(F.when(~taken, 1)).alias("rejected"), F.count_distinct(fact).alias("facts_added"))


def synthesised(spark, d):
    """Complete facts that each document's lines give; a document without one is an error."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    v = F.try_parse_json("value")
    field = lambda n: F.trim(F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")))
    fact = F.when((field("subject") != "") & (field("predicate") != "") & (field("object") != ""), 1)
    out = rows.groupBy("doc_id").agg(F.count(fact).alias("facts"))
    return out.select("doc_id", "facts", (F.col("facts") > 0).alias("ok"), F.when(F.col("facts") == 0, "no complete fact").alias("error"))


def capped_trajectories(spark, d):
    """Steps of the first half of the episodes by name, six of each, to a share of the rows."""
    rows = table(spark, d, "cu07_manifest").where("episode_id is not null").select("episode_id", "step", "row_id")
    names = readers.with_ordinal(rows.select("episode_id").distinct(), ["episode_id"])
    first = names.where(F.col("ord") < int(names.count() * SHARE)).select("episode_id")
    some = corpus.row_caps(rows.join(first, "episode_id", "left_semi"), ["episode_id"], ["step", "row_id"], F.lit(6))
    return corpus.row_caps(some.withColumn("one", F.lit(1)), ["one"], ["episode_id", "step", "row_id"], F.lit(int(rows.count() * SHARE / 2))).select("episode_id", "row_id")


def legacy(spark, d):
    """Older rows with the payload their code has: valid labels only, numbered within their source."""
    rows = trajectories.valid_labels(table(spark, d, "cu07_manifest")).where("error is null and source is not null")
    rows = rows.withColumn("a", g.parsed_action(F.col("action_source"), F.lit(1920.0), F.lit(1080.0))).where("op not in ('KEY_DOWN', 'KEY_UP')")
    payload = F.when(F.col("op").isin("TYPE", "KEY", "SCROLL"), F.when(F.col("a.operation") == F.col("op"), F.col("a.payload"))).otherwise(F.lit(""))
    rows = rows.withColumn("text", F.coalesce(payload, F.lit(""))).where("op not in ('TYPE', 'KEY', 'SCROLL') or text <> ''")
    placed = prefix_sum(rows.select("source", "row_id", "op", "text"), ["source"], ["row_id"], F.lit(1).cast("long"), "n")
    return placed.select("row_id", "op", "text", F.concat_ws(":", F.lit("ground"), "source", "n").alias("episode"))


def token_prefix(spark, d):
    """Documents whose tokens lie in the first share of all, in order, with the tokens they give."""
    rows = table(spark, d, "documents").select("doc_id", F.size(streams.words(F.col("text"))).cast("long").alias("n")).where("n > 0")
    goal = int((rows.agg(F.sum("n")).first()[0] or 0) * SHARE)
    placed = prefix_sum(rows.withColumn("one", F.lit(1)), ["one"], ["doc_id"], F.col("n"), "before").where(F.col("before") < goal)
    return placed.select("doc_id", F.least(F.col("n"), F.lit(goal) - F.col("before")).alias("tokens"))


def screens(spark, d):
    """Elements of each order's screen that a search finds, and the plan for a goal."""
    role = F.element_at(F.array(*map(F.lit, ("button", "textbox", "link", "menu"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("Save file", "Search", "Open map", "Kaydet"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    e = F.struct(F.col("l_linenumber").cast("string").alias("id"), role.alias("role"), name.alias("name"), F.lit("").alias("value"), (F.col("l_suppkey") % 3 > 0).alias("enabled"), F.lit(True).alias("visible"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(e)).alias("e"))
    goal = F.when(F.col("l_orderkey") % 2 == 0, "please save it").otherwise("scroll up")
    found = knowledge.find_elements(F.col("e"), F.array(F.lit("button"), F.lit("link")), F.array(F.lit("save")))
    plan = knowledge.ui_plan(goal, F.col("e"))[0]
    return rows.select("l_orderkey", F.size(found).cast("long").alias("found"), plan["action"].alias("action"), plan["payload"].alias("payload"))


def image_sides(spark, d):
    side = g.fit_side((F.col("l_quantity") * 100).cast("int"), (F.col("l_linenumber") * 500).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", side["width"].alias("width"), side["height"].alias("height"))


def scores(spark, d):
    """Weighted score and perplexity of losses made from the order lines."""
    rows = table(spark, d, "lineitem")
    score = gates.weighted_score({"a": F.col("l_tax").cast("double"), "b": F.col("l_discount").cast("double")}, {"a": 3.0, "b": 1.0})
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(score), 8).alias("score"), F.round(F.max(F.round(gates.perplexity(F.col("l_quantity").cast("double") / 10), 6)), 4).alias("perplexity"))


def text_lines(spark, d):
    """Documents on one line each, written as text and read again from the folder."""
    at = _folder(spark)
    readers.write_text(lines(spark, d).where("line <> ''"), "line", ["doc_id"], at)
    back = readers.text_folder(spark, at)
    return back.groupBy(F.md5(F.col("value").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def task_tree(spark, d):
    """Rows written as JSON below a folder for each domain, and read again with the folder they lie in."""
    at = _folder(spark)
    rows = table(spark, d, "cu07_manifest").where("coalesce(domain, '') <> ''").select("row_id", "domain", F.regexp_replace("domain", "[^A-Za-z0-9]", "_").alias("folder"))
    rows.write.partitionBy("folder").json(at)
    back = readers.task_files(spark, at, "row_id bigint, domain string")
    return back.groupBy(F.regexp_extract("file", "folder=([^/]+)/", 1).alias("folder"), "domain").agg(F.count(F.lit(1)).alias("n"))


def fact_stream(spark, d):
    """Facts written in documents, ingested from a stream: the store has each once."""
    at = _folder(spark)
    facts = knowledge.written_facts(runs.stream(spark, d, "documents"), ["doc_id"], "text").select("predicate", "args")
    stateful.ingest_facts(facts, f"{at}/store", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/store").select("predicate", F.array_join("args", "|").alias("args"))


def call_lines(spark, d):
    """Tool calls of answers, formatted again, and prompts of tools put into the conversation."""
    spans = table(spark, d, "main_sft").select("sft_id", F.posexplode(c.tool_call_spans(F.col("assistant"))).alias("pos", "span"))
    call = c.tool_call(F.col("span"))
    return spans.where(call["ok"]).select("sft_id", F.col("pos").cast("long").alias("pos"), c.format_tool_call(call["name"], call["arguments"]).alias("line"))


def tool_prompts(spark, d):
    """Length of the first message of each conversation once the tools' prompt is put in or added to its system message."""
    m = c.add_tool_prompt(F.col("messages"), F.lit("Available tools: add"))
    return chat.conversations(spark, d).select("sft_id", F.size(m).cast("long").alias("messages"), F.length(m[0]["content"]).cast("long").alias("chars"))


def targets(spark, d):
    """Inputs and supervised targets of the first window of each order's tokens."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("int"))).alias("w")).where(F.size("w") >= 4)
    mask = F.transform("w", lambda x: (x % 2).cast("int"))
    pair = streams.shifted(F.col("w"), mask, F.lit(0), 3)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x).cast("long")
    return rows.select("l_orderkey", total(pair["x"]).alias("x"), total(pair["y"]).alias("y"))


QUERIES = {
    "code_language_slices": code_slice, "licensed_code": licensed, "record_ingest": ingested, "synthesised_facts": synthesised, "capped_trajectories": capped_trajectories, "legacy_rows": legacy, "token_prefix": token_prefix, "screen_search": screens, "image_sides": image_sides,
    "weighted_scores": scores, "text_lines": text_lines, "task_tree": task_tree, "stream_fact_ingest": fact_stream, "tool_call_lines": call_lines, "tool_prompts": tool_prompts, "shifted_targets": targets,
}

_K = f"WITH {chat.MESSAGES}"

SQL = {
    "code_language_slices": f"""WITH r AS (SELECT ord, lower(trim(lang)) AS lang, strlen(x) AS n_bytes FROM (SELECT ord, lang, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS x FROM coder_raw WHERE text IS NOT NULL) WHERE length(x) >= 60 AND lang IS NOT NULL),
        q AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY lang ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM r) SELECT lang, ord, CAST(n_bytes AS BIGINT) AS written_bytes FROM q WHERE prev + n_bytes <= (SELECT floor({SHARE / 4} * sum(n_bytes) / count(DISTINCT lang)) FROM r) OR prev = 0""",
    "licensed_code": f"SELECT coalesce(lower(trim(source)), '') AS licence, count(*) AS n FROM coder_raw WHERE coalesce(lower(trim(source)), '') IN ('', {', '.join(f'{a!r}' for a in ALLOWED)}) GROUP BY 1",
    "synthesised_facts": """WITH v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL), j AS (SELECT doc_id, CASE WHEN json_valid(v) THEN v END AS j FROM v), f AS (SELECT doc_id, count(*) FILTER (trim(coalesce(j->>'$.subject', '')) <> '' AND trim(coalesce(j->>'$.predicate', '')) <> '' AND trim(coalesce(j->>'$.object', '')) <> '') AS facts FROM j GROUP BY 1)
        SELECT doc_id, facts, facts > 0 AS ok, CASE WHEN facts = 0 THEN 'no complete fact' END AS error FROM f""",
    "capped_trajectories": f"""WITH r AS (SELECT episode_id, step, row_id, dense_rank() OVER (ORDER BY episode_id) AS e FROM cu07_manifest WHERE episode_id IS NOT NULL), n AS (SELECT floor(max(e) * {SHARE}) AS episodes, floor(count(*) * {SHARE} / 2) AS cap FROM r),
        s AS (SELECT episode_id, step, row_id, row_number() OVER (PARTITION BY episode_id ORDER BY step NULLS FIRST, row_id) AS k FROM r WHERE e <= (SELECT episodes FROM n)), u AS (SELECT *, row_number() OVER (ORDER BY episode_id, step NULLS FIRST, row_id) AS q FROM s WHERE k <= 6) SELECT episode_id, row_id FROM u WHERE q <= (SELECT cap FROM n)""",
    "legacy_rows": f"""WITH {MANIFEST["action_caps_per_op"].split("WITH ")[1].split(") SELECT op, row_id")[0]}), p AS ({MANIFEST["action_parse"]}), v AS (SELECT l.row_id, l.source, l.op, CASE WHEN l.op IN ('TYPE', 'KEY', 'SCROLL') THEN CASE WHEN p.operation = l.op THEN p.payload END ELSE '' END AS x FROM l LEFT JOIN p USING (row_id) WHERE l.error IS NULL AND l.source IS NOT NULL AND l.op NOT IN ('KEY_DOWN', 'KEY_UP'))
        SELECT row_id, op, coalesce(x, '') AS text, 'ground:' || source || ':' || (row_number() OVER (PARTITION BY source ORDER BY row_id) - 1) AS episode FROM v WHERE op NOT IN ('TYPE', 'KEY', 'SCROLL') OR coalesce(x, '') <> ''""",
    "token_prefix": f"""WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) AS n FROM documents), s AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM t WHERE n > 0), g AS (SELECT CAST(floor(sum(n) * {SHARE}) AS BIGINT) AS g FROM t)
        SELECT doc_id, least(n, g - b) AS tokens FROM s, g WHERE b < g""",
    "screen_search": """WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, ['button', 'textbox', 'link', 'menu'][l_linenumber % 4 + 1] AS role, ['Save file', 'Search', 'Open map', 'Kaydet'][l_partkey % 4 + 1] AS name, l_suppkey % 3 > 0 AS enabled FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (enabled AND role IN ('button', 'link') AND name = 'Save file') AS found, CASE WHEN l_orderkey % 2 = 1 THEN 'SCROLL' WHEN count(*) FILTER (enabled AND name IN ('Save file', 'Kaydet')) > 0 THEN 'CLICK' ELSE 'KEY' END AS action,
        CASE WHEN l_orderkey % 2 = 1 THEN 'UP' WHEN count(*) FILTER (enabled AND name IN ('Save file', 'Kaydet')) > 0 THEN NULL ELSE 'CTRL+S' END AS payload FROM e GROUP BY l_orderkey""",
    "image_sides": """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity * 100 AS INT) AS w, l_linenumber * 500 AS h FROM lineitem), f AS (SELECT *, least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h)) AS f FROM s)
        SELECT l_orderkey, l_linenumber, l_quantity, greatest(1, CAST(round_even(w * f, 0) AS INT)) AS width, greatest(1, CAST(round_even(h * f, 0) AS INT)) AS height FROM f""",
    "weighted_scores": "SELECT l_returnflag, round(avg((l_tax::DOUBLE * 3 + l_discount::DOUBLE) / 4), 8) AS score, round(max(round(exp(least(l_quantity::DOUBLE / 10, 20)), 6)), 4) AS perplexity FROM lineitem GROUP BY 1",
    "text_lines": f"WITH {LINES} SELECT md5(line) AS digest, count(*) AS n FROM lines WHERE line <> '' GROUP BY 1",
    "task_tree": "SELECT regexp_replace(domain, '[^A-Za-z0-9]', '_', 'g') AS folder, domain, count(*) AS n FROM cu07_manifest WHERE coalesce(domain, '') <> '' GROUP BY ALL",
    "tool_prompts": f"{_K} SELECT sft_id, CAST((s <> '')::INT + (u <> '')::INT + 1 + (s = '')::INT AS BIGINT) AS messages, CASE WHEN s <> '' THEN length(s) + 22 ELSE 20 END AS chars FROM k",
    "tool_call_lines": chat.SQL["chat_tool_calls"].replace("SELECT sft_id, pos, name, coalesce(", "SELECT sft_id, pos, '<|tool_call|>{\"name\":' || CAST(to_json(name) AS VARCHAR) || ',\"arguments\":' || args || '}<|tool_end|>' AS line FROM z WHERE coalesce(").replace(" AS ok FROM z", ""),
    "shifted_targets": """WITH o AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS w FROM lineitem GROUP BY 1 HAVING count(*) >= 4)
        SELECT l_orderkey, CAST(w[1] + w[2] + w[3] AS BIGINT) AS x, CAST(list_sum(list_transform(w[2:4], lambda v: CASE WHEN v % 2 = 1 THEN v ELSE -100 END)) AS BIGINT) AS y FROM o""",
}

SQL["stream_fact_ingest"] = deductive.SQL["written_facts"].replace("SELECT p AS predicate, a AS args, count(DISTINCT doc_id) AS documents FROM f GROUP BY ALL", "SELECT DISTINCT p AS predicate, a AS args FROM f")
_FIELD = lambda *names: "coalesce(" + ", ".join(f"nullif(trim(j->>'{n}'), '')" for n in names) + ")"
_LINES = deductive.COMPILED.split("n AS (SELECT", 1)[1]
SQL["record_ingest"] = f"""WITH v AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS v FROM documents), o AS (SELECT v, starts_with(v, '{{') AS obj, CASE WHEN starts_with(v, '{{') AND json_valid(v) THEN v END AS j FROM v WHERE v <> ''),
    tr AS (SELECT r || '|' || s || '|' || e AS fact FROM (SELECT {_FIELD('s_label', 'subject', 's_id')} AS s, {_FIELD('r_label', 'predicate', 'r_id')} AS r, {_FIELD('e_label', 'object', 'e_id')} AS e FROM o WHERE obj) WHERE s IS NOT NULL AND r IS NOT NULL AND e IS NOT NULL),
    s AS (SELECT v AS s FROM o WHERE NOT obj), n AS (SELECT{_LINES}, {deductive.MEANT}, c AS (SELECT (SELECT count(*) FROM tr) + (SELECT count(*) FROM meant WHERE kind <> 'ERROR') AS accepted)
    SELECT accepted, (SELECT count(*) FROM o) - accepted AS rejected, (SELECT count(*) FROM (SELECT fact FROM tr UNION SELECT predicate || '|' || args FROM meant WHERE kind = 'FACT')) AS facts_added FROM c"""
