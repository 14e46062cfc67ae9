import pytest
from pyspark.sql import functions as F

from loomline.functions import chat as c
from loomline.functions import knowledge as k
from loomline.functions.registry import Registry
from loomline.operators import deductive as d
from loomline.operators import gates, trajectories


def test_first_grammar_that_takes_a_text(spark):
    cases = {
        "Sen kimsin?": ("IDENTITY", None, None), "Mert hakkında ne biliyorsun?": ("DESCRIBE_ENTITY", None, ["Mert"]), "tell me about the old mill.": ("DESCRIBE_ENTITY", None, ["the_old_mill"]), "Tell me about yourself": ("IDENTITY", None, None),
        "Mert bir insan mıdır?": ("QUERY", "IsA", ["Mert", "Human"]), "Is Ann taller than Bob?": ("QUERY", "TallerThan", ["Ann", "Bob"]), "kedi sıcakkanlı mı?": ("QUERY", "WarmBlooded", ["Cat"]), "Every mammal is warm-blooded.": ("RULE", "WarmBlooded", ["Mammal"]), "Her kedi sıcakkanlıdır.": ("RULE", "WarmBlooded", ["Cat"]),
        "Mert bir   insandır.": ("FACT", "IsA", ["Mert", "Human"]), "Tekir is a CAT": ("FACT", "IsA", ["Tekir", "Cat"]), "Ali Veli'den daha uzundur.": ("FACT", "TallerThan", ["Ali", "Veli"]), "3 is in box": ("FACT", "LocatedIn", ["N_3", "box"]), '{"facts": []}': ("PROGRAM", None, None), "<|semantic_ir|>{}<|semantic_end|>": ("PROGRAM", None, None),
        "?! is in box": ("ERROR", None, None), "{broken": ("ERROR", None, None), "": ("ERROR", None, None), None: ("ERROR", None, None), "Rain falls.": ("ERROR", None, None), "a " * 20_000: ("ERROR", None, None),
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", k.compiled(F.col("x")).alias("p")).collect()
    assert {r.i: (r.p.kind, r.p.predicate, r.p.args) for r in rows} == dict(enumerate(cases.values()))


def test_operations_in_text(spark):
    one = lambda x: spark.createDataFrame([(x,)], "x string").select(k.compiled(F.col("x")).alias("p")).first().p
    assert one("(2 + 3)^2 işlemini hesapla").expression == "(2 + 3)**2" and one("Calculate: 4 / 2.").expression == "4 / 2."
    assert one("3 mü büyük 2.5 mi?").numbers == [3.0, 2.5] and one("Which is greater: 4 or -5?").kind == "COMPARE_VALUES"
    p = one("Sort these numbers in descending order: 3, -1, 2.5")
    assert p.kind == "SORT_VALUES" and p.numbers == [3.0, -1.0, 2.5] and p.descending and one("sort numbers: 3").kind == "ERROR" and one("bunları sırala: 2 1").descending is False
    p = one("Python code, inspect it:\n```py\nx = 1\n\n```")
    assert (p.kind, p.language, p.source) == ("ANALYZE_CODE", "python", "x = 1\n")


def test_programs_are_answered_over_the_facts_and_rules_among_them(spark):
    said = ["Tekir bir kedidir.", "Her kedi sıcakkanlıdır.", "Tekir sıcakkanlı mı?", "Is Tekir a dog?", "Tekir hakkında bilgi ver", "which is greater: 1 or 2", "sort: 2, 1", "calculate 1+1", "nonsense", "Tekir bir kedidir."]
    got = {(r.kind, r.predicate): r for r in d.executed(spark.createDataFrame([(x,) for x in said], "x string").select(k.compiled(F.col("x")).alias("program"))).collect()}
    assert len(got) == 9 and got["QUERY", "WarmBlooded"].answer == "true" and got["QUERY", "IsA"].answer == "false" and got["DESCRIBE_ENTITY", None].answer == "IsA(Tekir,Cat)"
    assert got["COMPARE_VALUES", None].answer == "less" and got["SORT_VALUES", None]["values"] == [1.0, 2.0] and got["ERROR", None].error == "outside the grammar" and got["ARITHMETIC", None].ok is False


def test_registry(spark):
    calls = Registry()
    calls.register("up", F.upper, "capitals")
    with pytest.raises(ValueError):
        calls.register("up", F.lower)
    with pytest.raises(KeyError):
        calls.execute("down", F.lit("x"))
    assert calls.specs() == [{"name": "up", "description": "capitals"}]
    rows = spark.createDataFrame([("up", "a"), ("rm", "a"), (None, "a"), ("up", None)], "n string, v string").select(calls.dispatch(F.col("n"), F.col("v")).alias("r")).collect()
    assert [(r.r.ok, r.r.value, r.r.error) for r in rows] == [(True, "A", None), (False, None, "not registered: rm"), (False, None, "not registered: "), (True, None, None)]


def test_prompts_preferences_and_allocations(spark):
    m = lambda *turns: spark.createDataFrame([([(r, x, None) for r, x in turns],)], f"m {c.MESSAGE}")
    first = lambda df: [(x.role, x.content) for x in df.select(c.add_tool_prompt(F.col("m"), F.lit("T")).alias("m")).first().m]
    assert first(m(("user", "u"))) == [("system", "T"), ("user", "u")] and first(m(("system", "s"), ("user", "u"))) == [("system", "s\n\nT"), ("user", "u")] and first(m()) == [("system", "T")]
    rows = spark.createDataFrame([("a", 10), ("b", 90)], "k string, n long")
    assert {(r.k, r.place) for r in trajectories.in_preference(rows, "k", ["x", "b", "a"]).collect()} == {("b", 1), ("a", 2)}
    got = {r.k: (r.n, r.target, r.short, r.fallback_target) for r in trajectories.allocation(rows, "k", "n", {"a": 0.5, "b": 0.5, "z": 0.1}, slack=5, least=1).collect()}
    assert got == {"a": (10, 50, 40, 45), "b": (90, 50, 0, None), "z": (0, 10, 10, 10)}
    x = spark.createDataFrame([(1.0, float("nan"), None)], "a double, b double, c double")
    assert x.select(gates.messages([("a", ">=", 1.0), ("b", "<", 9.0), ("c", ">", 0.0)])).first()[0] == ["b is not < 9.0", "c is not > 0.0"]
