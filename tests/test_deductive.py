import pytest

from loomline.operators import deductive as d
from loomline.operators import typed
from loomline.plans import deductive as plans

TALL = d.Rule((d.Atom("TallerThan", ("?x", "?y")), d.Atom("TallerThan", ("?y", "?z"))), d.Atom("TallerThan", ("?x", "?z")))


def facts(spark, *rows):
    return spark.createDataFrame([(p, list(a)) for p, *a in rows], d.FACT)


def closure_of(c):
    return {(r.predicate, *r.args) for r in c.facts.collect()}


def test_transitive_and_chain(spark):
    c = d.infer(facts(spark, *(("TallerThan", f"n{i}", f"n{i + 1}") for i in range(6))), [TALL])
    assert closure_of(c) == {("TallerThan", f"n{i}", f"n{j}") for i in range(7) for j in range(i + 1, 7)}
    assert (c.rounds, c.converged, c.derived) == (4, True, 15)


def test_cycles_end_and_limits_show(spark):
    c = d.infer(facts(spark, ("TallerThan", "a", "b"), ("TallerThan", "b", "a")), [TALL])
    assert c.converged and len(closure_of(c)) == 4
    assert d.infer(facts(spark, *(("TallerThan", f"n{i}", f"n{i + 1}") for i in range(6))), [TALL], max_rounds=1).converged is False


def test_rules_with_constants_repeats_and_unbound_heads(spark):
    f = facts(spark, ("Likes", "a", "a"), ("Likes", "a", "b"), ("IsA", "Ali", "Mammal"), ("IsA", "Ali", "Poet"))
    rules = [
        d.Rule((d.Atom("Likes", ("?x", "?x")),), d.Atom("Vain", ("?x",))), d.Rule((d.Atom("IsA", ("?x", "Mammal")),), d.Atom("WarmBlooded", ("?x",))),
        d.Rule((d.Atom("IsA", ("?x", "Poet")),), d.Atom("Odd", ("?y",))), d.Rule((), d.Atom("Axiom", ("one",))),
    ]
    c = d.infer(f, rules)
    assert {x for x in closure_of(c) if x[0] not in ("Likes", "IsA")} == {("Vain", "a"), ("WarmBlooded", "Ali"), ("Axiom", "one")}
    assert d.infer(f, []).rounds == 1


def test_session_answers_and_proofs(spark):
    s = d.Session(spark).add(facts(spark, ("IsA", "Ali", "Mammal")), [d.Rule((d.Atom("IsA", ("?x", "Mammal")),), d.Atom("WarmBlooded", ("?x",)), "warm")])
    got = s.ask(facts(spark, ("WarmBlooded", "Ali"), ("IsA", "Ali", "Computer"), ("IsA", "?x", "Mammal"))).collect()
    assert {(r.predicate, *r.args): r.answer for r in got} == {("WarmBlooded", "Ali"): True, ("IsA", "Ali", "Computer"): False, ("IsA", "?x", "Mammal"): False}
    tree = d.proof(d.derivations(s.closure.facts, s.rules), d.Atom("WarmBlooded", ("Ali",)))
    assert tree["rule"] == "warm" and tree["premises"][0]["kind"] == "fact"
    with pytest.raises(ValueError):
        d.Atom("no name", ("x",))


def test_aliases_resolve_arguments(spark):
    a = spark.createDataFrame([("  ALI  Bey", "Ali", 1), ("ali bey", "Ali2", 2)], "alias string, canonical string, ord int")
    got = d.resolve(facts(spark, ("IsA", "Ali  bey", "Poet"), ("IsA", "?x", "Poet")), d.last_alias(a)).collect()
    assert {tuple(r.args) for r in got} == {("Ali2", "Poet"), ("?x", "Poet")}


def test_typed_operations():
    assert typed.evaluate("27*14") == 378 and typed.evaluate("-7 // 2") == -4 and typed.evaluate("2^3") == 8
    for bad in ("2**13", "__import__('os')", "1/0", "+".join("1" * 100)):
        with pytest.raises((ValueError, ZeroDivisionError)):
            typed.evaluate(bad)
    x = typed.analyze("import os\ndef kare(x):\n    print(abs(x))\n", "python")
    assert x["imports"] == ["os"] and [s["name"] for s in x["symbols"]] == ["kare"] and {(c["scope"], c["target"]) for c in x["calls"]} == {("kare", "print"), ("kare", "abs")}
    assert typed.analyze("def f(x)\n  pass", "python")["diagnostics"][0].startswith("SyntaxError")
    j = typed.analyze("import java.util.List;\npublic class A {\n  int f(int x) {\n    return g(x);\n  }\n", "java")
    assert j["imports"] == ["java.util.List"] and ("f", "g") in {(c["scope"], c["target"]) for c in j["calls"]} and j["diagnostics"] == ["UnbalancedBraces delta=1"]


def test_statements_questions_and_plans(spark):
    from pyspark.sql import functions as F

    from loomline.functions import knowledge as k

    said = {
        "Mert bir bilgisayardır.": ("IsA", ["Mert", "Computer"]), "Ada bir kedidir.": ("IsA", ["Ada", "Cat"]), "Ali Ayşe'den daha uzundur": ("TallerThan", ["Ali", "Ayşe"]), "Ali is taller than Bob.": ("TallerThan", ["Ali", "Bob"]),
        "Kitap çanta içindedir.": ("LocatedIn", ["Kitap", "çanta"]), "The key is in the box": ("LocatedIn", ["The_key", "the_box"]), "Rain falls.": None, "": None,
    }
    df = spark.createDataFrame([(x,) for x in said], "s string").select("s", k.statement_atom(F.col("s")).alias("a"))
    assert {r.s: r.a and (r.a.predicate, r.a.args) for r in df.collect()} == said
    asked = {"Mert bir bilgisayar mıdır?": ("IsA", ["Mert", "Computer"]), "Ali sıcakkanlı mıdır?": ("WarmBlooded", ["Ali"]), "Is Ali taller than Bob?": ("TallerThan", ["Ali", "Bob"]), "Nedir?": None}
    df = spark.createDataFrame([(x,) for x in asked], "s string").select("s", k.question_atom(F.col("s")).alias("a"))
    assert {r.s: r.a and (r.a.predicate, r.a.args) for r in df.collect()} == asked
    ddl = "g string, e array<struct<id:string,role:string,name:string,value:string,enabled:boolean,visible:boolean>>"
    screen = [("b1", "button", "Save", None, True, True), ("t1", "textbox", "Name", None, None, None), ("d1", "icon", "Notes", None, True, True), ("h", "button", "save", None, True, False)]
    goals = {"save the file": [("CLICK", "b1", None)], 'type "hello"': [("CLICK", "t1", None), ("TYPE", "t1", "hello")], "open notes": [("DOUBLE_CLICK", "d1", None)], "scroll up": [("SCROLL", None, "UP")], "think": [("OBSERVE", None, None)], None: [("OBSERVE", None, None)]}
    got = spark.createDataFrame([(g, screen) for g in goals], ddl).select("g", k.ui_plan(F.col("g"), F.col("e")).alias("p")).collect()
    assert {r.g: [tuple(s) for s in r.p] for r in got} == goals
    found = spark.createDataFrame([("x", screen)], ddl).select(k.find_elements(F.col("e"), F.array(F.lit("button")), F.array(F.lit("SAVE")))).first()[0]
    assert found == ["b1"]


def test_stated_facts_in_sentences_of_any_length(spark, tmp_path):
    long = "the old mill of the village " * 40
    text = f"{long}is in the valley. Is {long}taller than the tower? {long}stays. \n \n{'.' * 50_000}x\nA is a B. Ah!"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.states, r.asks): r.n for r in plans.stated(spark, str(tmp_path)).collect()}
    assert got == {("LocatedIn", None): 1, (None, "TallerThan"): 1, ("IsA", None): 1, (None, None): 3}
