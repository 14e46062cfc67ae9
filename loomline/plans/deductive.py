"""Knowledge queries: facts from tables, closures, ground queries, and typed operations on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomline.functions import knowledge
from loomline.functions.text import strip
from loomline.operators import deductive as r
from loomline.operators import typed
from loomline.plans.corpus import WS
from loomline.session import table

LOCATED = r.Rule((r.Atom("LocatedIn", ("?x", "?y")), r.Atom("LocatedIn", ("?y", "?z"))), r.Atom("LocatedIn", ("?x", "?z")), "transitive")
SERVES = r.Rule((r.Atom("LocatedIn", ("?x", "?n")), r.Atom("Kind", ("?x", "supplier")), r.Atom("LocatedIn", ("?n", "EUROPE"))), r.Atom("ServesEurope", ("?x",)), "serves")


def facts(spark, d):
    n, g, c, s = (table(spark, d, x) for x in ("nation", "region", "customer", "supplier"))
    at = lambda a, b: F.array(a, b).alias("args")
    p = F.lit("LocatedIn").alias("predicate")
    parts = [
        n.join(g, n.n_regionkey == g.r_regionkey).select(p, at("n_name", "r_name")), c.join(n, c.c_nationkey == n.n_nationkey).select(p, at("c_name", "n_name")), s.join(n, s.s_nationkey == n.n_nationkey).select(p, at("s_name", "n_name")),
        s.select(F.lit("Kind").alias("predicate"), at(F.col("s_name"), F.lit("supplier"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def flat(rows):
    return rows.withColumn("args", F.array_join("args", "|"))


def facts_from_tables(spark, d):
    return flat(facts(spark, d))


def closure(spark, d):
    return flat(r.infer(facts(spark, d), [LOCATED, SERVES]).facts.select("predicate", "args"))


def queries_(spark, d):
    c = r.infer(facts(spark, d), [LOCATED])
    asked = table(spark, d, "customer").select(F.lit("LocatedIn").alias("predicate"), F.array(F.col("c_name"), F.lit("EUROPE")).alias("args"))
    return flat(r.answers(asked, c.facts).withColumn("rounds", F.lit(c.rounds).cast("long")))


def derivations(spark, d):
    """How each fact first follows: by which rule, from how many premises."""
    rules = [LOCATED, SERVES]
    out = r.derivations(r.infer(facts(spark, d), rules).facts, rules)
    return flat(out.select("predicate", "args", "rule", F.size("premises").cast("long").alias("premises")))


def described(spark, d):
    s = table(spark, d, "supplier")
    labels = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("entity"), F.concat(F.lit("No. "), "s_suppkey").alias("label")).distinct()
    out = r.describe(facts(spark, d), s.select(F.col("s_name").alias("entity")), labels)
    return out.select("entity", "label", F.array_join(F.transform("facts", lambda x: F.concat(x["predicate"], F.lit("("), F.array_join(x["args"], ","), F.lit(")"))), ";").alias("facts"))


def statistics(spark, d):
    aliases = table(spark, d, "nation").select("n_name")
    return r.memory_statistics(facts(spark, d), [LOCATED, SERVES], aliases).select("facts", "predicates", F.col("rules").cast("long").alias("rules"), F.col("aliases").cast("long").alias("aliases"))


def resolved(spark, d):
    """Facts with nations replaced by their aliases, of which the last one given counts."""
    n = table(spark, d, "nation")
    aliases = r.last_alias(n.select(F.lower("n_name").alias("alias"), F.concat(F.lit("N_"), "n_nationkey").alias("canonical"), F.col("n_nationkey").alias("ord")))
    return flat(r.resolve(facts(spark, d), aliases))


def triples(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("s"), F.col("o_orderpriority").alias("r"), F.col("n_name").alias("e"))
    entities = rows.select(F.explode(F.array("s", "e")).alias("x")).distinct()
    one = rows.agg(F.count(F.lit(1)).alias("n_triples"), F.count_distinct("r").alias("predicates"))
    return one.withColumn("entities", F.lit(entities.count()).cast("long"))


def lexicon(spark, d):
    """Words with their edges: trimmed synonyms and antonyms that are not empty; words without an edge are left out."""
    tidy = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    name = F.split("p_type", " ")
    rows = table(spark, d, "part").groupBy(F.concat(F.lit(" "), "p_brand").alias("word")).agg(F.collect_set(F.concat(name[0], F.lit(" "))).alias("synonyms"), F.collect_set(F.coalesce(F.try_element_at(name, F.lit(5)), F.lit(" "))).alias("antonyms"))
    out = rows.select(F.trim("word").alias("word"), F.size(tidy(F.col("synonyms"))).cast("long").alias("synonyms"), F.size(tidy(F.col("antonyms"))).cast("long").alias("antonyms"))
    return out.where("word <> '' and synonyms + antonyms > 0")


def arithmetic(spark, d):
    rows = table(spark, d, "orders")
    text = F.concat(F.col("o_custkey"), F.lit(" * 3 - ("), F.col("o_orderkey") % 7, F.lit(" + 2) ^ 2"))
    return rows.select("o_orderkey", typed.arithmetic(text).alias("x")).select("o_orderkey", F.col("x.ok").alias("ok"), F.col("x.value").alias("value"))


def compare_sort(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    s = typed.sort_values(F.col("q"), descending=True)
    c = typed.compare_values(s[0], F.element_at(s, -1))
    return rows.select("l_orderkey", F.array_join(F.transform(s, lambda v: v.cast("int").cast("string")), ",").alias("sorted"), c["relation"].alias("relation"), F.round(c["difference"], 4).alias("difference"))


def verified(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array(F.struct(F.length("text").cast("long").alias("actual"), F.col("n_chars").alias("expected"))).alias("checks"))
    return rows.select("doc_id", typed.verify(F.col("checks"))["ok"].alias("ok"))


def code(spark, d):
    """Symbols, calls and diagnostics of the code documents by language."""
    lang = F.lower(F.trim("lang"))
    body = F.regexp_replace(F.regexp_replace("text", r"(?s)^.*?<code>\n", ""), r"\n</code>\s*$", "")
    name = F.when(lang.isin("python", "py"), "python").when(lang.isin("c++", "cpp"), "cpp").when(lang.isin("golang", "go"), "go").otherwise(lang)
    rows = table(spark, d, "coder_raw").where("text is not null").select(name.alias("lang"), typed.analyze_code(body, F.coalesce(name, F.lit(""))).alias("x"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("x.symbols")).alias("symbols"), F.sum(F.size("x.calls")).alias("calls"), F.sum((F.size("x.diagnostics") > 0).cast("long")).alias("with_diagnostics"))


TALLER = r.Rule((r.Atom("TallerThan", ("?x", "?y")), r.Atom("TallerThan", ("?y", "?z"))), r.Atom("TallerThan", ("?x", "?z")), "taller")
WARM = r.Rule((r.Atom("IsA", ("?x", "Mammal")),), r.Atom("WarmBlooded", ("?x",)), "warm")
REACH = r.Rule((r.Atom("ConnectsTo", ("?x", "?y")), r.Atom("LocatedIn", ("?y", "?z"))), r.Atom("Near", ("?x", "?z")), "near")


def written(spark, d):
    """Facts written in the documents, with how many documents hold each."""
    rows = knowledge.written_facts(table(spark, d, "documents"), ["doc_id"], "text")
    return flat(rows.groupBy("predicate", "args").agg(F.count_distinct("doc_id").alias("documents")))


def written_closure(spark, d):
    rows = knowledge.written_facts(table(spark, d, "documents"), ["doc_id"], "text").select("predicate", "args")
    return flat(r.infer(rows, [TALLER, WARM, REACH]).facts.select("predicate", "args"))


def sentences(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", r"(?<=[.?!])[ \t\n]+|\n")).alias("s")).where(strip(F.col("s")) != "")


def stated(spark, d):
    """Facts and questions in the sentences of the corpus, by predicate."""
    rows = sentences(spark, d).select(knowledge.statement_atom(F.col("s"))["predicate"].alias("states"), knowledge.question_atom(F.col("s"))["predicate"].alias("asks"))
    return rows.groupBy("states", "asks").agg(F.count(F.lit(1)).alias("n"))


def compiled(spark, d):
    """What the sentences of the corpus mean, with how often each meaning is given."""
    rows = sentences(spark, d).select(knowledge.compiled(F.col("s")).alias("p"))
    numbers = F.array_join(F.transform("p.numbers", lambda v: F.round(v, 4).cast("string")), ",")
    return rows.groupBy("p.kind", "p.predicate", F.array_join("p.args", "|").alias("args"), "p.expression", numbers.alias("numbers"), "p.descending").agg(F.count(F.lit(1)).alias("n"))


def executed(spark, d):
    """Facts and rules in the sentences of the corpus recorded, its questions answered over them."""
    out = r.executed(sentences(spark, d).select(knowledge.compiled(F.col("s")).alias("program")).where("program.kind <> 'ERROR'"))
    return out.where("kind in ('FACT', 'RULE', 'QUERY', 'DESCRIBE_ENTITY')").select("kind", "predicate", F.array_join("args", "|").alias("args"), "ok", "answer")


QUERIES = {
    "written_facts": written, "written_closure": written_closure, "stated_facts": stated, "compiled_sentences": compiled, "executed_sentences": executed,
    "facts_from_tables": facts_from_tables, "deductive_closure": closure, "ground_queries": queries_, "rule_derivations": derivations, "describe_entity": described, "memory_stats": statistics, "alias_resolution": resolved,
    "triple_counts": triples, "lexicon_edges": lexicon, "arithmetic_ops": arithmetic, "compare_sort_ops": compare_sort, "verify_ops": verified, "code_analysis": code,
}

_FACTS = """f AS (SELECT DISTINCT 'LocatedIn' AS p, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'LocatedIn', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT 'LocatedIn', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'Kind', s_name, 'supplier' FROM supplier)"""
_CLOSED = "l AS (SELECT a, b FROM f WHERE p = 'LocatedIn' UNION SELECT x.a, y.b FROM l x JOIN f y ON x.b = y.a AND y.p = 'LocatedIn')"
_SERVES = "s AS (SELECT DISTINCT x.a FROM l x JOIN f k ON k.p = 'Kind' AND k.a = x.a JOIN l e ON e.a = x.b AND e.b = 'EUROPE')"

_WRITTEN = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z]*\([A-Za-z_][A-Za-z0-9_]*(?:, [A-Za-z_][A-Za-z0-9_]*)*\))', 1)) AS s FROM documents),
    f AS (SELECT doc_id, split_part(s, '(', 1) AS p, replace(regexp_extract(s, '\((.*)\)', 1), ', ', '|') AS a FROM w)"""



def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _symbol_sql(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ +| +$', '', 'g'), '^[ .?!]+|[ .?!]+$', '', 'g')"
    ident = rf"regexp_replace(regexp_replace({t}, '[^0-9A-Za-zÇĞİÖŞÜçğıöşü_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in knowledge.CONCEPTS.items())
    return f"coalesce(CASE lower(replace({t}, 'İ', 'i̇')) {known} END, CASE WHEN regexp_matches({ident}, '^[0-9]') THEN 'N_' || {ident} ELSE nullif({ident}, '') END)"


def _forms_sql(name: str, text: str, forms) -> str:
    """Columns of the first form that matches: its number, predicate and groups."""
    quoted = [_sql_text("(?i)" + p) for _, p in forms]
    number = "CASE " + " ".join(f"WHEN regexp_matches({text}, {q}) THEN {i}" for i, q in enumerate(quoted)) + " END"
    group = lambda g: "CASE " + " ".join(f"WHEN regexp_matches({text}, {q}) THEN " + (f"regexp_extract({text}, {q}, {g})" if g == 1 or p.count("(") - p.count("(?:") > 1 else "'-'") for q, (_, p) in zip(quoted, forms)) + " END"
    predicate = "CASE " + " ".join(f"WHEN regexp_matches({text}, {q}) THEN '{n}'" for q, (n, _) in zip(quoted, forms)) + " END"
    return f"{number} AS {name}_n, {predicate} AS {name}_p, {group(1)} AS {name}_1, {group(2)} AS {name}_2"


_TWO = {"f": "true", "r": "true", "q": "q_n > 1", "e": "false"}
_PARTS = (("e", "un", knowledge.DESCRIBE_FORMS), ("q", "un", knowledge.QUERY_FORMS), ("r", "one", knowledge.RULE_FORMS), ("f", "one", knowledge.FACT_FORMS))
_IDENTITY = _sql_text("(?i)^(?:" + "|".join(knowledge.IDENTITY) + ")$")
COMPILED = rf"""s AS (SELECT unnest(string_split(regexp_replace(text, '([.?!])[ \t\n]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM documents), n AS (SELECT regexp_replace(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS one FROM s),
    u AS (SELECT one, regexp_replace(one, '[?.!]+$', '') AS un FROM n WHERE one <> ''), m AS (SELECT *, {', '.join(_forms_sql(*p) for p in _PARTS)} FROM u),
    y AS (SELECT *, {', '.join(f"{_symbol_sql(f'{k}_{g}')} AS {k}_s{g}" for k, _, _ in _PARTS for g in (1, 2))} FROM m),
    ok AS (SELECT *, {', '.join(f"{k}_n IS NOT NULL AND {k}_s1 IS NOT NULL AND (NOT ({_TWO[k]}) OR {k}_s2 IS NOT NULL) AS {k}_ok" for k, _, _ in _PARTS)} FROM y)"""
_FIRST = lambda forms, g: "coalesce(" + ", ".join(f"nullif(regexp_extract(one, {_sql_text('(?i)' + p)}, {g}), '')" for p in forms) + ")"
_ANY = lambda forms: "(" + " OR ".join(f"regexp_matches(one, {_sql_text('(?i)' + p)})" for p in forms) + ")"
MEANT = f"""g AS (SELECT *, starts_with(one, '{{') AND json_valid(one) AS j, regexp_matches(lower(un), {_IDENTITY}) AS i, trim({_FIRST(knowledge.ARITHMETIC_FORMS, 1)}) AS sum, {_ANY(knowledge.COMPARE_FORMS)} AS cmp, {_FIRST(knowledge.COMPARE_FORMS, 1)} AS c1, {_FIRST(knowledge.COMPARE_FORMS, 2)} AS c2, regexp_extract_all({_FIRST(knowledge.SORT_FORMS, 2)}, '-?[0-9]+(?:[.][0-9]+)?') AS v, {_FIRST(knowledge.SORT_FORMS, 1)} AS dir FROM ok),
    h AS (SELECT *, CASE WHEN j THEN 'PROGRAM' WHEN i THEN 'IDENTITY' WHEN e_ok THEN 'DESCRIBE_ENTITY' WHEN q_ok THEN 'QUERY' WHEN r_ok THEN 'RULE' WHEN f_ok THEN 'FACT' WHEN sum <> '' THEN 'ARITHMETIC' WHEN cmp THEN 'COMPARE_VALUES' WHEN len(v) >= 2 THEN 'SORT_VALUES' ELSE 'ERROR' END AS kind FROM g),
    meant AS (SELECT kind, CASE kind WHEN 'QUERY' THEN q_p WHEN 'RULE' THEN r_s2 WHEN 'FACT' THEN f_p END AS predicate, CASE kind WHEN 'DESCRIBE_ENTITY' THEN e_s1 WHEN 'QUERY' THEN q_s1 || CASE WHEN q_n > 1 THEN '|' || q_s2 ELSE '' END WHEN 'RULE' THEN r_s1 WHEN 'FACT' THEN f_s1 || '|' || f_s2 END AS args,
    CASE kind WHEN 'ARITHMETIC' THEN replace(sum, '^', '**') END AS expression, CASE kind WHEN 'COMPARE_VALUES' THEN CAST(c1::DOUBLE AS VARCHAR) || ',' || CAST(c2::DOUBLE AS VARCHAR) WHEN 'SORT_VALUES' THEN array_to_string(list_transform(v, lambda x: CAST(x::DOUBLE AS VARCHAR)), ',') END AS numbers, CASE kind WHEN 'SORT_VALUES' THEN coalesce(lower(dir) IN ('büyükten küçüğe', 'descending'), false) END AS descending FROM h)"""

SQL = {
    "stated_facts": f"WITH {COMPILED} SELECT CASE WHEN f_ok THEN f_p END AS states, CASE WHEN q_ok THEN q_p END AS asks, count(*) AS n FROM ok GROUP BY ALL",
    "compiled_sentences": f"WITH {COMPILED}, {MEANT} SELECT kind, predicate, args, expression, numbers, descending, count(*) AS n FROM meant GROUP BY ALL",
    "executed_sentences": f"""WITH {COMPILED}, {MEANT}, p AS (SELECT DISTINCT kind, predicate, args FROM meant), k AS (SELECT predicate, args FROM p WHERE kind = 'FACT' UNION SELECT u.predicate, split_part(m.args, '|', 1) FROM p u JOIN p m ON u.kind = 'RULE' AND m.kind = 'FACT' AND m.predicate = 'IsA' AND split_part(m.args, '|', 2) = u.args),
        about AS (SELECT split_part(args, '|', 1) AS e, string_agg(predicate || '(' || replace(args, '|', ',') || ')', ';' ORDER BY predicate, args) AS facts FROM p WHERE kind = 'FACT' GROUP BY 1)
        SELECT kind, predicate, args, true AS ok, CASE kind WHEN 'QUERY' THEN CAST(EXISTS (SELECT 1 FROM k WHERE k.predicate = p.predicate AND k.args = p.args) AS VARCHAR) WHEN 'DESCRIBE_ENTITY' THEN coalesce((SELECT facts FROM about WHERE e = p.args), '') ELSE 'recorded' END AS answer
        FROM p WHERE kind IN ('FACT', 'RULE', 'QUERY', 'DESCRIBE_ENTITY')""",
    "written_facts": f"WITH {_WRITTEN} SELECT p AS predicate, a AS args, count(DISTINCT doc_id) AS documents FROM f GROUP BY ALL",
    "written_closure": f"""WITH RECURSIVE {_WRITTEN}, g AS (SELECT DISTINCT p, a, split_part(a, '|', 1) AS x, split_part(a, '|', 2) AS y, len(string_split(a, '|')) AS n FROM f),
        t AS (SELECT x, y FROM g WHERE p = 'TallerThan' AND n = 2 UNION SELECT t.x, g.y FROM t JOIN g ON g.p = 'TallerThan' AND g.n = 2 AND t.y = g.x)
        SELECT p AS predicate, a AS args FROM g UNION SELECT 'TallerThan', x || '|' || y FROM t UNION SELECT 'WarmBlooded', x FROM g WHERE p = 'IsA' AND n = 2 AND y = 'Mammal'
        UNION SELECT 'Near', c.x || '|' || l.y FROM g c JOIN g l ON c.p = 'ConnectsTo' AND c.n = 2 AND l.p = 'LocatedIn' AND l.n = 2 AND c.y = l.x""",
    "facts_from_tables": f"WITH {_FACTS} SELECT p AS predicate, a || '|' || b AS args FROM f",
    "deductive_closure": f"WITH RECURSIVE {_FACTS}, {_CLOSED}, {_SERVES} SELECT 'LocatedIn' AS predicate, a || '|' || b AS args FROM l UNION ALL SELECT 'Kind', a || '|' || b FROM f WHERE p = 'Kind' UNION ALL SELECT 'ServesEurope', a FROM s",
    "ground_queries": f"WITH RECURSIVE {_FACTS}, {_CLOSED} SELECT 'LocatedIn' AS predicate, c_name || '|EUROPE' AS args, c_name IN (SELECT a FROM l WHERE b = 'EUROPE') AS answer, CAST(2 AS BIGINT) AS rounds FROM customer",
    "rule_derivations": f"WITH RECURSIVE {_FACTS}, {_CLOSED}, {_SERVES} SELECT 'LocatedIn' AS predicate, l.a || '|' || l.b AS args, 'transitive' AS rule, CAST(2 AS BIGINT) AS premises FROM l LEFT JOIN f ON f.p = 'LocatedIn' AND f.a = l.a AND f.b = l.b WHERE f.a IS NULL UNION ALL SELECT 'ServesEurope', a, 'serves', 3 FROM s",
    "describe_entity": f"WITH {_FACTS} SELECT s_name AS entity, CASE WHEN s_suppkey % 2 = 0 THEN 'No. ' || s_suppkey ELSE replace(s_name, '_', ' ') END AS label, string_agg(p || '(' || a || ',' || b || ')', ';' ORDER BY p, b) AS facts FROM (SELECT DISTINCT s_name, s_suppkey FROM supplier) JOIN f ON a = s_name GROUP BY s_name, s_suppkey",
    "memory_stats": f"WITH {_FACTS} SELECT count(*) AS facts, CAST(3 AS BIGINT) AS predicates, CAST(2 AS BIGINT) AS rules, (SELECT count(*) FROM nation) AS aliases FROM f",
    "alias_resolution": f"WITH {_FACTS}, m AS (SELECT lower(n_name) AS k, 'N_' || n_nationkey AS v FROM nation) SELECT DISTINCT p AS predicate, coalesce(x.v, a) || '|' || coalesce(y.v, b) AS args FROM f LEFT JOIN m x ON x.k = lower(a) LEFT JOIN m y ON y.k = lower(b)",
    "triple_counts": """WITH t AS (SELECT c_name AS s, o_orderpriority AS r, n_name AS e FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        SELECT count(*) AS n_triples, count(DISTINCT r) AS predicates, (SELECT count(*) FROM (SELECT s FROM t UNION SELECT e FROM t)) AS entities FROM t""",
    "lexicon_edges": "SELECT trim(p_brand) AS word, count(DISTINCT split_part(p_type, ' ', 1)) AS synonyms, count(DISTINCT nullif(trim(split_part(p_type, ' ', 5)), '')) AS antonyms FROM part GROUP BY 1",
    "arithmetic_ops": "SELECT o_orderkey, true AS ok, CAST(o_custkey * 3 - (o_orderkey % 7 + 2) * (o_orderkey % 7 + 2) AS DOUBLE) AS value FROM orders",
    "compare_sort_ops": "SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY l_quantity DESC) AS sorted, CASE WHEN max(l_quantity) > min(l_quantity) THEN 'greater' ELSE 'equal' END AS relation, round(max(l_quantity) - min(l_quantity), 4) AS difference FROM lineitem GROUP BY 1",
    "verify_ops": "SELECT doc_id, length(text) IS NOT DISTINCT FROM n_chars AS ok FROM documents",
}
