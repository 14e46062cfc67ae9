"""Conversation queries over instruction pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import chat as c
from loomline.operators import corpus, generators, streams
from loomline.plans.corpus import CL, WS
from loomline.session import table

#: Caps are shares of the rows, so that they grow with them.
SHARE = 0.5
ST = lambda x: f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"
MESSAGES = f"""m AS (SELECT sft_id, coalesce(source, '(none)') AS source, {ST('system_prompt')} AS s, {ST('"user"')} AS u, {ST('assistant')} AS a, coalesce(train, true) AS t FROM main_sft),
    k AS (SELECT * FROM m WHERE a <> '')"""
SIG = "md5(concat_ws(chr(10), CASE WHEN s <> '' THEN 'system:' || s END, CASE WHEN u <> '' THEN 'user:' || u END, 'assistant:' || a))"
TOK = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


def conversations(spark, d):
    rows = table(spark, d, "main_sft")
    rows = rows.select("sft_id", F.coalesce("source", F.lit("(none)")).alias("source"), c.pairs_as_messages(F.col("system_prompt"), F.col("user"), F.col("assistant"), F.col("train")).alias("messages"))
    return rows.where(c.has_role(F.col("messages"), "assistant"))


def messages(spark, d):
    m = F.col("messages")
    return conversations(spark, d).select("sft_id", F.size(m).cast("long").alias("messages"), F.aggregate(m, F.lit(0), lambda a, x: a + F.length(x["content"])).cast("long").alias("chars"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"))


def dedup(spark, d):
    rows = conversations(spark, d).withColumn("digest", c.signature(F.col("messages")))
    return corpus.first_wins(rows, "digest", ["source", "sft_id"]).select("source", "sft_id")


def caps(spark, d):
    rows = conversations(spark, d).withColumn("digest", c.signature(F.col("messages")))
    rows = corpus.first_wins(rows, "digest", ["source", "sft_id"]).select("source", "sft_id")
    counted = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) * SHARE).alias("cap"))
    return corpus.row_caps(rows.join(counted, "source"), ["source"], ["sft_id"], F.col("cap")).select("source", "sft_id")


def calls(spark, d):
    spans = table(spark, d, "main_sft").select("sft_id", F.posexplode(c.tool_call_spans(F.col("assistant"))).alias("pos", "span"))
    call = c.tool_call(F.col("span"))
    return spans.select("sft_id", F.col("pos").cast("long").alias("pos"), call["name"].alias("name"), call["ok"].alias("ok"))


#: A turn of a written conversation: its role marker, then all up to the next one.
TURN = r"(?s)<\|(system|user|assistant|tool)\|>(.*?)(?=<\|(?:system|user|assistant|tool)\|>|\z)"


def written_turns(spark, d):
    """Conversations written in documents, as messages."""
    x = F.col("text")
    roles, contents = (F.regexp_extract_all(x, F.lit(TURN), g) for g in (1, 2))
    turns = F.zip_with(roles, contents, lambda r, v: c.message(r, v))
    return table(spark, d, "documents").where("text is not null").select("doc_id", c.clean_messages(turns).alias("messages")).where(F.size("messages") > 0)


def markers(spark, d):
    """Users and answers of each written conversation, and answers with a plan, a call and a final part."""
    m = F.col("messages")
    of = lambda role: F.size(F.filter(m, lambda x: x["role"] == role)).cast("long")
    roles = [of("user").alias("users"), of("assistant").alias("assistants")]
    return written_turns(spark, d).select("doc_id", *roles, *(c.marker_count(m, k).cast("long").alias(n) for n, k in (("plans", c.PLAN), ("calls", c.CALL), ("finals", c.FINAL))))


def masks(spark, d):
    m = F.col("messages")
    lengths = F.transform(m, lambda x: F.size(streams.words(x["content"])))
    return conversations(spark, d).select("sft_id", "source", c.mask_of(m, lengths).alias("mask"))


def mask_tokens(spark, d):
    return masks(spark, d).select("sft_id", F.size("mask").cast("long").alias("tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("supervised")).where("supervised > 0")


def windows(spark, d):
    return streams.eligible_blocks(masks(spark, d), ["sft_id"], "mask", 16)


def sft_blocks(spark, d):
    return streams.supervised_blocks(masks(spark, d), ["sft_id"], "mask", 16)


def random_windows(spark, d):
    return streams.random_windows(masks(spark, d).drop("source"), "sft_id", "mask", 16, 4, 5).select("sft_id", F.col("draw").cast("long").alias("draw"), F.col("start").cast("long").alias("start"), F.col("supervised").cast("long").alias("supervised"))


def encode_totals(spark, d):
    """Rows, tokens, supervised tokens and answers of the packed conversations, and whether ids and masks have one length."""
    m = F.col("messages")
    tokens = F.transform(m, lambda x: streams.words(x["content"]))
    rows = conversations(spark, d).select(F.size(c.mask_of(m, F.transform(tokens, F.size))).alias("n"), F.aggregate(c.mask_of(m, F.transform(tokens, F.size)), F.lit(0), lambda a, x: a + x).alias("s"), F.size(c.history_tokens(m, tokens)).alias("h"), F.size(F.filter(m, lambda x: x["role"] == "assistant")).alias("a"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("tokens"), F.sum("s").alias("supervised"), F.sum("a").alias("answers"), (F.sum("n") == F.sum("h")).alias("equal"))


def compacted(spark, d):
    m = c.compact_messages(F.col("messages"), 600)
    rows = conversations(spark, d).select("sft_id", m.alias("short"))
    return rows.select("sft_id", F.size("short").cast("long").alias("n_messages"), F.aggregate("short", F.lit(0), lambda a, x: a + F.length(x["content"])).cast("long").alias("chars"))


def next_roles(spark, d):
    turns = conversations(spark, d).select("sft_id", F.posexplode("messages").alias("pos", "m")).select("sft_id", "pos", "m.role", "m.content")
    return c.swe_messages(turns, ["sft_id"]).groupBy("role", F.regexp_extract("content", r"^(<\|\w+\|>)", 1).alias("marker")).agg(F.count(F.lit(1)).alias("n"))


def tool_loops(spark, d):
    m = generators.tool_loop(F.col("sft_id"))
    return table(spark, d, "main_sft").select("sft_id", m[0]["content"].alias("question"), m[1]["content"].alias("call"), m[3]["content"].alias("answer"))


def surfaces(spark, d):
    return table(spark, d, "main_sft").groupBy(generators.identity_surface(F.col("sft_id")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


def curriculum(spark, d):
    mode, lang, ir = generators.curriculum_mode(F.col("sft_id"))
    return table(spark, d, "main_sft").groupBy(mode.alias("mode"), lang.alias("language"), ir.alias("train_ir")).agg(F.count(F.lit(1)).alias("n"))


def debugging(spark, d):
    """A debugging trajectory for each row's number."""
    m = generators.debug_steps(F.col("sft_id"))
    return table(spark, d, "main_sft").select("sft_id", F.size(m).cast("long").alias("messages"), m[0]["content"].alias("question"), F.element_at(m, -1)["content"].alias("answer"))


def agent_rows(spark, d):
    """Written conversations that can train an agent: a user and an answer, counted in messages."""
    return markers(spark, d).where("users >= 1 and assistants >= 1").select("doc_id", "calls", (F.col("calls") >= 1).alias("with_tools"))


def knowledge_chats(spark, d):
    """Conversations of two messages and more with an answer, up to a share of them in order."""
    rows = conversations(spark, d).where(F.size("messages") >= 2).select("sft_id")
    cap = int(rows.count() * SHARE)
    return corpus.row_caps(rows.withColumn("one", F.lit(1)), ["one"], ["sft_id"], F.lit(cap)).select("sft_id")


def tool_chats(spark, d):
    """Conversations in which an answer calls a tool, with the tools in a system message in front."""
    m = F.col("messages")
    rows = conversations(spark, d).where(c.marker_count(m, c.CALL) > 0)
    tools = F.array_join(F.array_distinct(F.flatten(F.transform(m, lambda x: F.transform(c.tool_call_spans(x["content"]), lambda s: F.get_json_object(s, "$.name"))))), ",")
    out = rows.select("sft_id", c.with_tool_system(m, tools).alias("m"))
    return out.select("sft_id", F.size("m").cast("long").alias("messages"), F.col("m")[0]["role"].alias("first"))


def openai(spark, d):
    """Pairs as messages with tool calls: calls written in the answer become calls, then marked lines again."""
    x = F.col("assistant")
    calls = F.transform(c.tool_call_spans(x), lambda s: F.struct(F.struct(F.get_json_object(s, "$.name").alias("name"), F.get_json_object(s, "$.arguments").alias("arguments")).alias("function")))
    none = F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")
    turn = lambda role, content, calls_=none: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"), calls_.alias("tool_calls"))
    spoken = F.regexp_replace(x, r"(?s)<\|tool_call\|>.*?<\|tool_end\|>", "")
    rows = table(spark, d, "main_sft").where(x.isNotNull()).select("sft_id", F.array(turn("user", F.col("user")), turn("assistant", spoken, calls), turn("tool", F.col("system_prompt"))).alias("m"))
    out = rows.select("sft_id", F.posexplode(c.openai_messages(F.col("m"))).alias("pos", "x"))
    return out.select("sft_id", "x.role", F.md5(F.col("x.content").cast("binary")).alias("digest"))


def agentic(spark, d):
    """Pairs as traces with roles of their own: the system prompt as reasoning, the source as a tool's output."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.concat(F.lit("<answer>"), "assistant", F.lit("</answer>"))
    rows = table(spark, d, "main_sft").select("sft_id", F.array(turn("user", F.col("user")), turn("reasoning", F.col("system_prompt")), turn("tool_output", F.col("source")), turn("answer", answer)).alias("m"))
    out = rows.select("sft_id", F.explode(c.agentic_messages(F.col("m"))).alias("x"))
    return out.select("sft_id", "x.role", F.md5(F.col("x.content").cast("binary")).alias("digest"))


def histories(spark, d):
    m = F.col("messages")
    tokens = F.transform(m, lambda x: streams.words(x["content"]))
    return conversations(spark, d).select("sft_id", F.size(c.history_tokens(m, tokens)).cast("long").alias("tokens"))


QUERIES = {
    "sft_blocks": sft_blocks, "sft_random_windows": random_windows, "encode_totals": encode_totals, "knowledge_chats": knowledge_chats, "tool_chats": tool_chats, "chat_openai_messages": openai, "chat_agentic_messages": agentic,
    "agent_row_filter": agent_rows, "chat_history_tokens": histories,
    "chat_messages": messages, "chat_signature_dedup": dedup, "chat_row_caps": caps, "chat_tool_calls": calls, "chat_marker_counts": markers, "chat_mask_tokens_ws": mask_tokens, "sft_eligible_windows": windows,
    "chat_compact_context": compacted, "chat_position_roles": next_roles, "tool_loop_generator": tool_loops, "identity_surfaces": surfaces, "curriculum_histogram": curriculum, "debug_generator": debugging,
}

_MASK = f"""SELECT sft_id, list_concat([0], CASE WHEN s <> '' THEN list_concat([0], list_transform(range({TOK('s')}), lambda i: 0)) ELSE [] END, CASE WHEN u <> '' THEN list_concat([0], list_transform(range({TOK('u')}), lambda i: 0)) ELSE [] END,
    [0], list_transform(range({TOK('a')}), lambda i: CAST(t AS INT)), [CAST(t AS INT), CAST(t AS INT)]) AS mask FROM k"""

_STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
_SPAN = r"'(?s)<\|tool_call\|>(.*?)<\|tool_end\|>'"
_ROLE = r"'<\|(system|user|assistant|tool)\|>'"
_TURNS = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(text, {_ROLE}, 1)) AS role, {_STRIP("unnest(regexp_split_to_array(text, '<[|](?:system|user|assistant|tool)[|]>')[2:])")} AS v FROM documents WHERE text IS NOT NULL),
    counted AS (SELECT doc_id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'assistant' AND contains(v, '<|plan|>')) AS plans, count(*) FILTER (role = 'assistant' AND contains(v, '<|tool_call|>')) AS calls,
    count(*) FILTER (role = 'assistant' AND contains(v, '<|final|>')) AS finals FROM t WHERE v <> '' GROUP BY doc_id)"""


SQL = {
    "sft_blocks": f"""WITH {MESSAGES}, x AS ({_MASK}), y AS (SELECT sft_id, len(mask) AS n, unnest(mask) AS v, unnest(range(len(mask))) AS p FROM x)
        SELECT sft_id, CAST((p - 1) // 16 AS BIGINT) AS block, CAST(sum(v) AS BIGINT) AS supervised FROM y WHERE p >= 1 AND (p - 1) // 16 < (n - 1) // 16 GROUP BY sft_id, (p - 1) // 16 HAVING sum(v) > 0""",
    "sft_random_windows": f"""WITH {MESSAGES}, x AS ({_MASK}), w AS (SELECT sft_id, mask, unnest([0, 1, 2, 3]) AS draw FROM x WHERE len(mask) - 18 > 0), v AS (SELECT *, ('0x' || substr(md5('5:' || sft_id || ':' || draw), 1, 8))::BIGINT % (len(mask) - 18) AS start FROM w)
        SELECT sft_id, CAST(draw AS BIGINT) AS draw, start, CAST(list_sum(mask[start + 2:start + 17]) AS BIGINT) AS supervised FROM v WHERE list_sum(mask[start + 2:start + 17]) >= 8""",
    "encode_totals": f"WITH {MESSAGES}, x AS ({_MASK}) SELECT count(*) AS n_rows, CAST(sum(len(mask)) AS BIGINT) AS tokens, CAST(sum(list_sum(mask)) AS BIGINT) AS supervised, count(*) AS answers, true AS equal FROM x",
    "chat_marker_counts": f"WITH {_TURNS} SELECT doc_id, users, assistants, plans, calls, finals FROM counted",
    "agent_row_filter": f"WITH {_TURNS} SELECT doc_id, calls, calls >= 1 AS with_tools FROM counted WHERE users >= 1 AND assistants >= 1",
    "knowledge_chats": f"WITH {MESSAGES}, e AS (SELECT sft_id, row_number() OVER (ORDER BY sft_id) AS r, count(*) OVER () AS n FROM k WHERE s <> '' OR u <> '') SELECT sft_id FROM e WHERE r <= floor(n * {SHARE})",
    "tool_chats": f"""WITH {MESSAGES}, c AS (SELECT *, list_filter(list_transform(list_concat(regexp_extract_all(s, {_SPAN}, 1), regexp_extract_all(u, {_SPAN}, 1), regexp_extract_all(a, {_SPAN}, 1)), lambda j: CASE WHEN json_valid(j) THEN json_extract_string(j, '$.name') END), lambda n: n IS NOT NULL) AS names FROM k WHERE contains(a, '<|tool_call|>')),
        e AS (SELECT *, len(names) > 0 AND s = '' AS added FROM c) SELECT sft_id, CAST((s <> '')::INT + (u <> '')::INT + 1 + added::INT AS BIGINT) AS messages, CASE WHEN s <> '' OR added THEN 'system' WHEN u <> '' THEN 'user' ELSE 'assistant' END AS first FROM e""",
    "chat_openai_messages": f"""WITH b AS (SELECT sft_id, {CL('"user"')} AS u, {CL(f"regexp_replace(assistant, '(?s)<[|]tool_call[|]>.*?<[|]tool_end[|]>', '', 'g')")} AS a, {CL('system_prompt')} AS s, list_transform(regexp_extract_all(assistant, {_SPAN}, 1), lambda j: CASE WHEN json_valid(j) THEN j END) AS j FROM main_sft WHERE assistant IS NOT NULL),
        e AS (SELECT *, list_transform(list_filter(j, lambda x: coalesce(x->>'$.name', '') <> ''), lambda x: '<|tool_call|>{{"arguments":' || coalesce(CAST(json_extract(x, '$.arguments') AS VARCHAR), '{{}}') || ',"name":' || CAST(to_json(x->>'$.name') AS VARCHAR) || '}}<|tool_end|>') AS calls FROM b),
        o AS (SELECT sft_id, 'user' AS role, u AS v FROM e UNION ALL SELECT sft_id, 'assistant', CASE WHEN len(j) > 0 THEN {_STRIP("a || chr(10) || array_to_string(calls, chr(10))")} ELSE a END FROM e UNION ALL SELECT sft_id, 'tool', CASE WHEN s = '' OR starts_with(s, '<|tool_result|>') THEN s ELSE '<|tool_result|>{{"name":"tool","result":' || CAST(to_json(s) AS VARCHAR) || '}}<|tool_end|>' END FROM e)
        SELECT sft_id, role, md5(v) AS digest FROM o WHERE v <> ''""",
    "chat_agentic_messages": f"""WITH b AS (SELECT sft_id, {CL('"user"')} AS u, {CL('system_prompt')} AS s, {CL('source')} AS t, assistant, {CL('assistant')} AS a FROM main_sft),
        o AS (SELECT sft_id, 'user' AS role, u AS v FROM b WHERE u <> '' UNION ALL SELECT sft_id, 'assistant', '<|plan|>' || chr(10) || s || chr(10) || '<|plan_end|>' FROM b WHERE s <> '' UNION ALL SELECT sft_id, 'tool', '<|tool_result|>' || t || '<|tool_end|>' FROM b WHERE t <> ''
        UNION ALL SELECT sft_id, 'assistant', '<|final|>' || chr(10) || a FROM b WHERE assistant IS NOT NULL) SELECT sft_id, role, md5(v) AS digest FROM o""",
    "chat_tool_calls": f"""WITH x AS (SELECT sft_id, {_STRIP('unnest(sp)')} AS j, CAST(unnest(range(len(sp))) AS BIGINT) AS pos FROM (SELECT sft_id, regexp_extract_all(assistant, {_SPAN}, 1) AS sp FROM main_sft)), y AS (SELECT sft_id, pos, CASE WHEN json_valid(j) THEN j END AS j FROM x),
        z AS (SELECT sft_id, pos, j->>'$.name' AS name, coalesce(j->>'$.arguments', j->>'$.args', '{{}}') AS args FROM y) SELECT sft_id, pos, name, coalesce(regexp_full_match(name, '[A-Za-z_][\\w.\\-]*'), false) AND regexp_matches(args, '^\\s*\\{{') AS ok FROM z""",
    "chat_compact_context": f"""WITH {MESSAGES}, p AS (SELECT sft_id, (s <> '')::INT + (u <> '')::INT AS lead, least(length(s), 2000) + least(length(u), 2000) AS used, a, contains(a, '<|final|>') AS fin FROM k), q AS (SELECT *, 600 - used - 256 AS room FROM p)
        SELECT sft_id, CAST(lead + CASE WHEN fin OR room > 256 THEN 1 ELSE 0 END AS BIGINT) AS n_messages, CAST(used + CASE WHEN fin THEN least(length(a), 2200) WHEN room > 256 THEN least(length(a), 2400, room) ELSE 0 END AS BIGINT) AS chars FROM q""",
    "chat_position_roles": f"""WITH {MESSAGES}, o AS (SELECT 'system' AS role, regexp_extract(s, '^(<[|]\\w+[|]>)', 1) AS marker FROM k WHERE s <> '' UNION ALL SELECT 'user', regexp_extract(u, '^(<[|]\\w+[|]>)', 1) FROM k WHERE u <> '' UNION ALL SELECT 'assistant', '<|final|>' FROM k) SELECT role, marker, count(*) AS n FROM o GROUP BY ALL""",
    "debug_generator": "SELECT sft_id, CAST(sft_id // 128 % 6 + 3 AS BIGINT) AS messages, format('Fix {} (style {}).', n, sft_id // 32 % 4) AS question, '<|final|>' || n || ' is fixed.' AS answer FROM (SELECT sft_id, [" + ", ".join(f"'{x}'" for x in generators.DEBUG_CASES) + "][sft_id % 8 + 1] AS n FROM main_sft)",
    "chat_history_tokens": f"WITH {MESSAGES} SELECT sft_id, CAST(2 + CASE WHEN s <> '' THEN 1 + {TOK('s')} ELSE 0 END + CASE WHEN u <> '' THEN 1 + {TOK('u')} ELSE 0 END + 2 + {TOK('a')} AS BIGINT) AS tokens FROM k",
    "chat_messages": f"WITH {MESSAGES} SELECT sft_id, CAST((s <> '')::INT + (u <> '')::INT + 1 AS BIGINT) AS messages, length(s) + length(u) + length(a) AS chars, concat_ws(',', CASE WHEN s <> '' THEN 'system' END, CASE WHEN u <> '' THEN 'user' END, 'assistant') AS roles FROM k",
    "chat_signature_dedup": f"WITH {MESSAGES} SELECT source, sft_id FROM (SELECT source, sft_id, row_number() OVER (PARTITION BY {SIG} ORDER BY source, sft_id) AS r FROM k) WHERE r = 1",
    "chat_row_caps": f"WITH {MESSAGES} SELECT source, sft_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sft_id) AS q, count(*) OVER (PARTITION BY source) AS n FROM (SELECT source, sft_id, row_number() OVER (PARTITION BY {SIG} ORDER BY source, sft_id) AS r FROM k) WHERE r = 1) WHERE q <= ceil(n * {SHARE})",
    "chat_mask_tokens_ws": f"WITH {MESSAGES}, x AS ({_MASK}) SELECT sft_id, len(mask) AS tokens, CAST(list_sum(mask) AS BIGINT) AS supervised FROM x WHERE list_sum(mask) > 0",
    "sft_eligible_windows": f"""WITH {MESSAGES}, x AS ({_MASK}), y AS (SELECT sft_id, len(mask) AS n, unnest(mask) AS v, unnest(range(len(mask))) AS p FROM x)
        SELECT sft_id, CAST(p // 17 * 17 AS BIGINT) AS start, CAST(sum(v) AS BIGINT) AS supervised FROM y WHERE p // 17 < (n - 1) // 17 AND p % 17 >= 1 GROUP BY sft_id, p // 17 HAVING sum(v) >= 8""",
    "tool_loop_generator": """SELECT sft_id, CASE WHEN sft_id % 2 = 0 THEN format('{} ile {} sayısını topla.', a, b) ELSE format('Add {} and {}.', a, b) END AS question, '<|tool_call|>{"arguments":{"a":' || a || ',"b":' || b || '},"name":"add"}<|tool_end|>' AS call,
        '<|final|>' || CASE WHEN sft_id % 2 = 0 THEN format('Sonuç {}.', a + b) ELSE format('The result is {}.', a + b) END AS answer FROM (SELECT sft_id, (sft_id * 17 + 3) % 997 AS a, (sft_id * 29 + 11) % 997 AS b FROM main_sft)""",
    "identity_surfaces": "SELECT surface, count(*) AS n FROM (SELECT [" + ", ".join("'" + x.replace("'", "''") + "'" for x in generators.OPENINGS) + "][sft_id % 6 + 1] || ', ' || [" + ", ".join(f"'{x}'" for x in generators.ABILITIES) + "][sft_id // 6 % 6 + 1] || '. ' || [" + ", ".join(f"'{x}'" for x in generators.CLOSINGS) + "][sft_id // 36 % 6 + 1] AS surface FROM main_sft) GROUP BY surface",
    "curriculum_histogram": "SELECT CAST(sft_id % 24 AS INT) AS mode, CASE WHEN sft_id // 24 % 2 = 0 THEN 'tr' ELSE 'en' END AS language, sft_id // 48 % 2 = 0 AS train_ir, count(*) AS n FROM main_sft GROUP BY ALL",
}
