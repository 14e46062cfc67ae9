"""Conversations as ``messages ARRAY<STRUCT<role, content, train>>``: cleaning, normalising, packing. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import clean_text, strip, strip_wrapped

ROLES = ("system", "user", "assistant", "tool")
#: Markers of roles and of parts of an answer.
ROLE_MARKERS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>", "tool": "<|tool_result|>"}
PLAN, CALL, CALL_END, RESULT, FINAL = "<|plan|>", "<|tool_call|>", "<|tool_end|>", "<|tool_result|>", "<|final|>"
MESSAGE = "array<struct<role:string,content:string,train:boolean>>"


def message(role: Column | str, content: Column, train: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"), (train if train is not None else F.lit(None).cast("boolean")).alias("train"))


def clean_messages(messages: Column, max_chars: int | None = None) -> Column:
    """Known roles in lower case, contents stripped and whole (or cut to so many characters), empty ones dropped."""
    short = lambda c: F.substring(c, 1, max_chars) if max_chars else c
    tidy = F.transform(messages, lambda m: message(F.lower(F.trim(m["role"])), short(strip(F.coalesce(m["content"], F.lit("")))), m["train"]))
    return F.filter(tidy, lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def signature(messages: Column) -> Column:
    """What makes two conversations one: roles and contents in order."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary"))


def marker_count(messages: Column, marker: str) -> Column:
    """Assistant messages that contain a marker."""
    return F.size(F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].contains(marker)))


def tool_call_spans(text: Column) -> Column:
    """JSON texts of the tool calls in an answer."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<\|tool_call\|>(.*?)<\|tool_end\|>"), 1), lambda s: strip(s))


def tool_call(span: Column) -> Column:
    """``name, arguments, ok`` of one call; arguments may be called args, and may be a JSON text themselves."""
    arguments = F.coalesce(F.get_json_object(span, "$.arguments"), F.get_json_object(span, "$.args"), F.lit("{}"))
    name = F.get_json_object(span, "$.name")
    ok = F.coalesce(name.rlike(r"^[A-Za-z_][\w.\-]*$"), F.lit(False)) & F.coalesce(arguments.rlike(r"^\s*\{"), F.lit(False))
    return F.struct(name.alias("name"), arguments.alias("arguments"), ok.alias("ok"))


def format_tool_call(name: Column, arguments: Column) -> Column:
    return F.concat(F.lit(CALL + '{"name":'), F.to_json(F.struct(name.alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(name.alias("n")))) - 6), F.lit(',"arguments":'), arguments, F.lit("}" + CALL_END))


def with_tool_system(messages: Column, tools: Column) -> Column:
    """A system message with the tools in front, unless there is one or there are no tools."""
    need = F.coalesce(tools != "", F.lit(False)) & ~F.coalesce(messages[0]["role"] == "system", F.lit(False))
    return F.when(need, F.concat(F.array(message("system", F.concat(F.lit("Tools: "), tools))), messages)).otherwise(messages)


def add_tool_prompt(messages: Column, prompt: Column) -> Column:
    """The tools' prompt as a system message in front, or added to the one that is there."""
    first = messages[0]
    added = message("system", F.concat(F.coalesce(first["content"], F.lit("")), F.lit("\n\n"), prompt), first["train"])
    with_it = F.concat(F.array(added), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))))
    own = (F.size(messages) > 0) & F.coalesce(first["role"] == "system", F.lit(False))
    return F.when(own, with_it).otherwise(F.concat(F.array(message("system", prompt)), messages))


def agentic_messages(messages: Column, max_chars: int = 16_000) -> Column:
    """Traces with roles of their own: reasoning becomes a plan, tool calls and outputs get markers, answers are final.
    Wrappers in angle brackets give way to the markers. Empty contents and other roles are dropped."""

    def one(m: Column) -> Column:
        role = F.lower(strip(F.coalesce(m["role"], F.lit(""))))
        content = F.substring(clean_text(m["content"], compatibility=False), 1, max_chars)
        call = F.replace(F.replace(content, F.lit("<tool_call>"), F.lit(CALL)), F.lit("</tool_call>"), F.lit(CALL_END))
        call = F.when(call.contains(CALL), call).otherwise(F.concat(F.lit(CALL), call, F.lit(CALL_END)))
        output = strip(F.replace(F.replace(content, F.lit("<tool_response>"), F.lit("")), F.lit("</tool_response>"), F.lit("")))
        marked = (
            F.when(role == "reasoning", F.concat(F.lit(PLAN + "\n"), strip_wrapped(content, "<think>", "</think>"), F.lit("\n<|plan_end|>"))).when(role == "tool_call", call)
            .when(role == "tool_output", F.concat(F.lit(RESULT), output, F.lit(CALL_END))).when(role == "answer", F.concat(F.lit(FINAL + "\n"), strip_wrapped(content, "<answer>", "</answer>"))).otherwise(content)
        )
        to = F.when(role.isin("reasoning", "tool_call", "answer"), "assistant").when(role == "tool_output", "tool").otherwise(role)
        return message(to, F.when(content == "", content).otherwise(marked))

    return F.filter(F.transform(messages, one), lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))


#: Traces as JSON text.
TRACE = "array<struct<role:string,content:string>>"


def agentic_json(text: Column, max_chars: int = 16_000) -> Column:
    """``agentic_messages`` of a trace given as JSON text; an empty array if it is no list."""
    parsed = F.from_json(text, TRACE)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\["), agentic_messages(F.coalesce(parsed, F.array().cast(TRACE)), max_chars)).otherwise(F.array().cast(MESSAGE))


def compact_messages(messages: Column, max_chars: int = 12_000) -> Column:
    """Conversation cut to a context: two leading system or user messages, then what fits, then the last final answer."""
    lead = F.slice(F.filter(messages, lambda m: m["role"].isin("system", "user")), 1, 2)
    is_final = lambda m: (m["role"] == "assistant") & m["content"].contains(FINAL)
    numbered = F.transform(messages, lambda m, i: F.struct(m.alias("m"), i.alias("i"), m["role"].isin("system", "user").alias("s")))
    order = F.filter(numbered, lambda x: x["s"])
    third = F.when(F.size(order) > 2, order[2]["i"]).otherwise(F.lit(1 << 30))
    body = F.filter(numbered, lambda x: ~is_final(x["m"]) & (~x["s"] | (x["i"] >= third)))
    short = lambda m, n: message(m["role"], F.substring(m["content"], F.lit(1), n), m["train"])
    prefix = F.transform(lead, lambda m: short(m, F.lit(2000)))
    finals = F.filter(messages, is_final)
    final = F.when(F.size(finals) > 0, F.array(short(F.element_at(finals, -1), F.lit(2200)))).otherwise(F.array().cast(MESSAGE))
    used = F.aggregate(prefix, F.lit(0), lambda a, m: a + F.length(m["content"]))
    reserve = F.when(F.size(final) > 0, F.length(final[0]["content"])).otherwise(F.lit(0)) + 256
    start = F.struct(F.array().cast(MESSAGE).alias("kept"), used.alias("used"), F.lit(False).alias("stop"))

    def step(a: Column, x: Column) -> Column:
        room = F.lit(max_chars) - a["used"] - reserve
        stop = a["stop"] | (room <= 256)
        n = F.least(F.length(x["m"]["content"]), F.lit(2400), room)
        kept = F.when(stop, a["kept"]).otherwise(F.concat(a["kept"], F.array(short(x["m"], n))))
        return F.struct(kept.alias("kept"), F.when(stop, a["used"]).otherwise(a["used"] + n).alias("used"), stop.alias("stop"))

    middle = F.aggregate(body, start, step, lambda a: a["kept"])
    return F.concat(prefix, middle, final)


def swe_messages(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``keys, pos, role, content`` of raw traces to marked messages, one row each with ``pos, sub``.

    The last assistant message is final; one before a tool answer is a plan and a call; other ones are plans.
    """
    w = Window.partitionBy(*keys)
    rows = steps.withColumn("next_role", F.lead("role").over(w.orderBy("pos"))).withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(w))
    c = F.coalesce(F.col("content"), F.lit(""))
    cut = lambda n: F.substring(c, 1, n)
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    call = F.concat(F.lit(CALL), F.to_json(F.struct(F.lit("openhands_action").alias("name"), F.struct(cut(1800).alias("value")).alias("arguments"))), F.lit(CALL_END))
    marked = (
        F.when(F.col("role").isin("system", "user"), F.array(F.struct(F.col("role").alias("role"), cut(2400).alias("content"))))
        .when(F.col("role") == "tool", one("tool", F.concat(F.lit(RESULT), cut(3000))))
        .when(F.col("role") != "assistant", F.lit(None))
        .when(c == "", F.lit(None))
        .when(F.col("pos") == F.col("last"), one("assistant", F.concat(F.lit(FINAL), cut(2200))))
        .when(F.col("next_role") == "tool", F.concat(one("assistant", F.concat(F.lit(PLAN), cut(1800))), one("assistant", call)))
        .otherwise(one("assistant", F.concat(F.lit(PLAN), cut(2200))))
    )
    return rows.select(*keys, "pos", F.posexplode(marked).alias("sub", "m")).select(*keys, "pos", "sub", "m.role", "m.content")


def mask_of(messages: Column, lengths: Column) -> Column:
    """Loss mask of a packed conversation from the token counts of its contents: begin, role markers and unsupervised
    parts are 0; an assistant's content and end are 1 unless it is not to be trained; the end of text follows the last message."""
    known = F.filter(F.arrays_zip(messages.alias("m"), lengths.alias("n")), lambda x: x["m"]["role"].isin(*ROLES))
    trained = lambda m: ((m["role"] == "assistant") & F.coalesce(m["train"], F.lit(True))).cast("int")
    parts = F.transform(known, lambda x: F.concat(F.array(F.lit(0)), F.array_repeat(trained(x["m"]), x["n"].cast("int")), F.when(x["m"]["role"] == "assistant", F.array(trained(x["m"]))).otherwise(F.array().cast("array<int>"))))
    last = F.when(F.size(messages) > 0, trained(F.element_at(messages, -1))).otherwise(F.lit(0))
    return F.concat(F.array(F.lit(0)), F.flatten(parts), F.array(last))


def pairs_as_messages(system: Column, user: Column, assistant: Column, train: Column) -> Column:
    """One-turn conversation of a pair, without empty messages."""
    raw = F.array(message("system", F.coalesce(system, F.lit(""))), message("user", F.coalesce(user, F.lit(""))), message("assistant", F.coalesce(assistant, F.lit("")), train))
    return clean_messages(raw)


OPENAI = "array<struct<role:string,content:string,name:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"


def json_text(value: Column) -> Column:
    """A text as a JSON string."""
    pair = F.to_json(F.struct(value.alias("v")))
    return pair.substr(F.lit(6), F.length(pair) - 6)


def openai_messages(messages: Column) -> Column:
    """Messages with ``tool_calls``: calls become marked lines after the content, tool answers are wrapped with the tool's
    name, unless they have their marker. Fields are in order of their names; arguments are kept as they are written.

    Arguments that are no JSON are kept under ``raw``. Calls without a name, or with arguments that are JSON but no
    object, are left out.
    """

    def one(m: Column) -> Column:
        role = F.lower(strip(F.coalesce(m["role"], F.lit(""))))
        content = clean_text(m["content"], compatibility=False)
        calls = F.filter(F.coalesce(m["tool_calls"], F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")), lambda c: F.coalesce(c["function"]["name"], F.lit("")) != "")

        def line(c: Column) -> Column:
            a = F.coalesce(c["function"]["arguments"], F.lit("{}"))
            parsed = F.try_parse_json(a).isNotNull()
            value = F.when(parsed & a.rlike(r"^\s*\{"), strip(a)).when(~parsed, F.concat(F.lit('{"raw":'), json_text(a), F.lit("}")))
            return F.concat(F.lit(CALL + '{"arguments":'), value, F.lit(',"name":'), json_text(c["function"]["name"]), F.lit("}" + CALL_END))

        lines = F.array_join(F.array_compact(F.transform(calls, line)), "\n")
        told = F.when((content == "") | content.startswith(RESULT), content).otherwise(
            F.concat(F.lit(RESULT + '{"name":'), json_text(F.coalesce(F.nullif(m["name"], F.lit("")), F.lit("tool"))), F.lit(',"result":'), json_text(content), F.lit("}" + CALL_END))
        )
        called = (role == "assistant") & (F.size(F.coalesce(m["tool_calls"], F.array().cast("array<struct<function:struct<name:string,arguments:string>>>"))) > 0)
        return message(role, F.when(called, strip(F.concat(content, F.lit("\n"), lines))).when(role == "tool", told).otherwise(content))

    return F.filter(F.transform(messages, one), lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))


def history_tokens(messages: Column, tokens: Column) -> Column:
    """Word tokens of a conversation for answering: role markers and contents in order, an open assistant at the end."""
    parts = F.zip_with(messages, tokens, lambda m, t: F.concat(F.array(F.try_element_at(F.create_map(*(F.lit(x) for p in ROLE_MARKERS.items() for x in p)), m["role"])), t, F.when(m["role"] == "assistant", F.array(F.lit("<|end|>"))).otherwise(F.array().cast("array<string>"))))
    return F.concat(F.array(F.lit("<bos>")), F.flatten(parts), F.array(F.lit(ROLE_MARKERS["assistant"])))
