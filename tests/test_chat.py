from pyspark.sql import functions as F

from loomline.functions import chat as c


def chat(spark, *turns):
    return spark.createDataFrame([([(r, x, t) for r, x, t in turns],)], f"m {c.MESSAGE}")


def compact_model(messages, limit):
    lead = [m for m in messages if m[0] in ("system", "user")][:2]
    rest, final, n = [], None, 0
    for m in messages:
        if m[0] in ("system", "user"):
            n += 1
            if n <= 2:
                continue
        if m[0] == "assistant" and c.FINAL in m[1]:
            final = m[1][:2200]
            continue
        rest.append(m)
    out = [(m[0], m[1][:2000]) for m in lead]
    used, reserve = sum(len(x) for _, x in out), len(final or "") + 256
    for m in rest:
        room = limit - used - reserve
        if room <= 256:
            break
        out.append((m[0], m[1][: min(2400, room)]))
        used += len(out[-1][1])
    return out + ([("assistant", final)] if final else [])


def test_compaction(spark):
    turns = [("system", "s" * 50, None), ("user", "u" * 300, None), ("assistant", "a" * 900, None), ("tool", "t" * 700, None), ("user", "v" * 20, None), ("assistant", c.FINAL + "son", None)]
    for limit in (600, 1500, 4000):
        got = chat(spark, *turns).select(c.compact_messages(F.col("m"), limit).alias("o")).first().o
        assert [(m.role, m.content) for m in got] == compact_model(turns, limit)


def test_cleaning_and_signature(spark):
    df = chat(spark, ("User ", "  soru ", None), ("assistant", "", None), ("ASSISTANT", "yanıt", True), ("judge", "x", None))
    m = df.select(c.clean_messages(F.col("m")).alias("m"))
    assert [(x.role, x.content) for x in m.first().m] == [("user", "soru"), ("assistant", "yanıt")]
    assert m.select(c.has_role(F.col("m"), "assistant")).first()[0] is True
    assert m.select(c.signature(F.col("m"))).first()[0] == m.select(c.signature(F.col("m"))).first()[0]


def test_mask_follows_roles_and_training(spark):
    for train, bit in ((None, 1), (True, 1), (False, 0)):
        df = chat(spark, ("user", "x", None), ("assistant", "y", train))
        got = df.select(c.mask_of(F.col("m"), F.array(F.lit(2), F.lit(3))).alias("o")).first().o
        assert got == [0] + [0, 0, 0] + [0] + [bit] * 3 + [bit] + [bit]


def test_position_dependent_roles(spark):
    rows = [(1, i, r, x) for i, (r, x) in enumerate([("user", "q"), ("assistant", "think"), ("tool", "out"), ("assistant", "more"), ("assistant", "end")])]
    got = c.swe_messages(spark.createDataFrame(rows, "k int, pos int, role string, content string"), ["k"]).orderBy("pos", "sub").collect()
    assert [r.content.split("|>")[0] for r in got] == ["q", "<|plan", "<|tool_call", "<|tool_result", "<|plan", "<|final"]


def test_tool_calls(spark):
    text = '<|tool_call|>{"name":"add","args":{"a":1}}<|tool_end|> x <|tool_call|>{"name":"9x"}<|tool_end|>'
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(c.tool_call_spans(F.col("t"))).alias("s")).select(c.tool_call(F.col("s")).alias("c")).select("c.*")
    assert [(r.name, r.arguments, r.ok) for r in df.collect()] == [("add", '{"a":1}', True), ("9x", "{}", False)]
    assert spark.range(1).select(c.format_tool_call(F.lit('a"b'), F.lit("{}"))).first()[0] == '<|tool_call|>{"name":"a\\"b","arguments":{}}<|tool_end|>'


def test_openai_messages(spark):
    rows = [([("assistant", "ok", None, [(("f", '{"a":1}'),), (("g", "oops"),), (("", "{}"),), (("h", "[1]"),)]), ("tool", "done", "add", None), ("tool", "<|tool_result|>x", None, None), ("assistant", None, None, None), ("judge", "x", None, None)],)]
    got = spark.createDataFrame(rows, f"m {c.OPENAI}").select(c.openai_messages(F.col("m")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [
        ("assistant", 'ok\n<|tool_call|>{"arguments":{"a":1},"name":"f"}<|tool_end|>\n<|tool_call|>{"arguments":{"raw":"oops"},"name":"g"}<|tool_end|>'), ("tool", '<|tool_result|>{"name":"add","result":"done"}<|tool_end|>'), ("tool", "<|tool_result|>x"),
    ]


def test_agentic_messages(spark):
    turns = [("Reasoning", "<think> a </think>"), ("tool_call", "<tool_call>{}</tool_call>"), ("tool_call", "{}"), ("tool_output", "<tool_response>r</tool_response>"), ("answer", "<answer>son</answer>"), ("user", ""), ("odd", "x"), ("system", "s")]
    want = [("assistant", "<|plan|>\na\n<|plan_end|>"), ("assistant", "<|tool_call|>{}<|tool_end|>"), ("assistant", "<|tool_call|>{}<|tool_end|>"), ("tool", "<|tool_result|>r<|tool_end|>"), ("assistant", "<|final|>\nson"), ("system", "s")]
    df = spark.createDataFrame([(turns,)], f"m {c.TRACE}")
    assert [(m.role, m.content) for m in df.select(c.agentic_messages(F.col("m")).alias("o")).first().o] == want
    assert [(m.role, m.content) for m in df.select(c.agentic_json(F.to_json("m")).alias("o")).first().o] == want
    assert spark.range(1).select(c.agentic_json(F.lit("nonsense")).alias("o")).first().o == []
