"""Facts and Horn rules as tables: rule bodies are joins, and inference runs to a fixpoint.

Facts are rows of ``predicate STRING, args ARRAY<STRING>``. Rules are a short list on the driver, as a query's
text is. Each round joins only what the last round added with all facts; new facts are cut from their lineage
by checkpoint, and the loop ends when a round adds none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import casefold, nfkc, strip
from loomline.session import cut

FACT = "predicate string, args array<string>"
MAX_ROUNDS = 32
#: Rounds after which the facts of all rounds are written together.
COMPACT_ROUNDS = 8
_VARIABLE = re.compile(r"\?[A-Za-z_][A-Za-z0-9_]*")


def is_variable(term: str) -> bool:
    return bool(_VARIABLE.fullmatch(term))


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple[str, ...]

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.predicate) or not self.args:
            raise ValueError(f"no atom: {self.predicate}{self.args}")


@dataclass(frozen=True)
class Rule:
    premises: tuple[Atom, ...]
    conclusion: Atom
    name: str = "rule"

    @property
    def safe(self) -> bool:
        bound = {a for p in self.premises for a in p.args if is_variable(a)}
        return all(not is_variable(a) or a in bound for a in self.conclusion.args)


@dataclass
class Closure:
    facts: DataFrame  # predicate, args, round (0 for given facts)
    rounds: int
    converged: bool
    derived: int = field(default=0)


def bindings(facts: DataFrame, atom: Atom) -> DataFrame:
    """Rows of variable values that match an atom: constants filter, a repeated variable equates its places."""
    rows = facts.where((F.col("predicate") == atom.predicate) & (F.size("args") == len(atom.args)))
    seen: dict[str, int] = {}
    for i, a in enumerate(atom.args):
        here = F.col("args")[i]
        if not is_variable(a):
            rows = rows.where(here == a)
        elif a in seen:
            rows = rows.where(here == F.col("args")[seen[a]])
        else:
            seen[a] = i
    return rows.select(*(F.col("args")[i].alias(v) for v, i in seen.items())) if seen else rows.select(F.lit(1).alias("__hit")).limit(1)


def _ordered(premises: Sequence[Atom]) -> list[int]:
    """Order of the premises in which each shares variables with those before it, where that can be."""
    left, out, bound = list(range(len(premises))), [], set()
    while left:
        k = next((i for i in left if not bound or bound & {a for a in premises[i].args if is_variable(a)}), left[0])
        left.remove(k)
        out.append(k)
        bound |= {a for a in premises[k].args if is_variable(a)}
    return out


def body(sources: Sequence[DataFrame], premises: Sequence[Atom]) -> DataFrame:
    """Bindings of a rule body; premise i is matched in source i.

    Premises are joined on the variables they share, in an order that keeps them connected. Only a rule whose
    premises fall apart into unconnected parts means a product, and then its result is one."""
    out = None
    for i in _ordered(premises):
        rows = bindings(sources[i], premises[i]).distinct()
        if out is None:
            out = rows
            continue
        shared = [c for c in rows.columns if c in out.columns and c != "__hit"]
        out = out.join(rows, shared) if shared else out.drop("__hit").crossJoin(rows.drop("__hit") if len(rows.columns) > 1 else rows)
    return out


def conclusions(matched: DataFrame, conclusion: Atom) -> DataFrame:
    args = [F.col(a) if is_variable(a) else F.lit(a) for a in conclusion.args]
    return matched.select(F.lit(conclusion.predicate).alias("predicate"), F.array(*args).cast("array<string>").alias("args"))


def infer(facts: DataFrame, rules: Sequence[Rule], max_rounds: int = MAX_ROUNDS) -> Closure:
    """All facts that follow, with the round that each first appears in.

    Semi-naive: in a round at least one premise takes a fact of the round before. ``rounds`` counts the last,
    empty round too, unless the limit ends the loop; ``converged`` tells which. Rules with a conclusion that a
    body does not bind are skipped. Repeated facts count once; null predicates or arguments match nothing.
    """
    usable = [r for r in rules if r.safe]
    known = cut(facts.select("predicate", "args").distinct().withColumn("round", F.lit(0)))
    delta, rounds, derived = known, 0, 0
    for number in range(1, max_rounds + 1):
        rounds = number
        found = []
        for r in usable:
            if not r.premises:
                if number == 1:
                    found.append(conclusions(facts.sparkSession.range(1).select(F.lit(1).alias("__hit")), r.conclusion))
                continue
            for k in range(len(r.premises)):
                found.append(conclusions(body([delta if j == k else known for j in range(len(r.premises))], r.premises), r.conclusion))
        if not found:
            return Closure(known, rounds, True)
        new = reduce(DataFrame.union, found).distinct().join(known, ["predicate", "args"], "left_anti")
        delta = cut(new.select("predicate", "args", F.lit(number).alias("round")))
        n = delta.count()
        if n == 0:
            return Closure(known, rounds, True, derived)
        derived += n
        known = known.unionByName(delta)
        if number % COMPACT_ROUNDS == 0:  # only what a round adds is written, and all of it once in a while
            known = cut(known)
    return Closure(known, rounds, False, derived)


def derivations(closure: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One derivation of each derived fact: the first rule, and of that the least premises, whose premises are all
    of earlier rounds. Columns ``predicate, args, rule, premises``."""
    parts = []
    for k, r in enumerate(rules):
        if not r.safe or not r.premises:
            continue
        rows = body([closure] * len(r.premises), r.premises)
        atoms = F.array(*(F.struct(F.lit(p.predicate).alias("predicate"), F.array(*(F.col(a) if is_variable(a) else F.lit(a) for a in p.args)).cast("array<string>").alias("args")) for p in r.premises))
        args = F.array(*(F.col(a) if is_variable(a) else F.lit(a) for a in r.conclusion.args)).cast("array<string>")
        parts.append(rows.select(F.lit(r.conclusion.predicate).alias("predicate"), args.alias("args"), F.lit(k).alias("k"), F.lit(r.name).alias("rule"), atoms.alias("premises")))
    every = reduce(DataFrame.unionByName, parts).join(closure.where("round > 0"), ["predicate", "args"])
    used = every.withColumn("p", F.explode("premises")).select("predicate", "args", "round", "k", "rule", "premises", F.col("p.predicate").alias("pp"), F.col("p.args").alias("pa"))
    given = closure.select(F.col("predicate").alias("pp"), F.col("args").alias("pa"), F.col("round").alias("pr"))
    latest = used.join(given, ["pp", "pa"]).groupBy("predicate", "args", "round", "k", "rule", "premises").agg(F.max("pr").alias("pr"), F.count(F.lit(1)).alias("n"))
    sound = latest.where(F.col("pr") < F.col("round"))
    best = sound.groupBy("predicate", "args").agg(F.min(F.struct("k", "premises", "rule")).alias("x"))
    return best.select("predicate", "args", "x.rule", "x.premises")


def answers(queries: DataFrame, closure: DataFrame) -> DataFrame:
    """``predicate, args`` queries with ``answer``: whether the fact holds. A variable in a query is taken literally."""
    facts = closure.select("predicate", "args").distinct().withColumn("__yes", F.lit(True))
    return queries.join(facts, ["predicate", "args"], "left").withColumn("answer", F.coalesce("__yes", F.lit(False))).drop("__yes")


def alias_key(name: Column) -> Column:
    return casefold(F.regexp_replace(strip(nfkc(name)), r"\s+", " "))


def last_alias(aliases: DataFrame) -> DataFrame:
    """``alias_key, canonical`` of ``alias, canonical, ord``: of colliding aliases the last counts."""
    return aliases.groupBy(alias_key(F.col("alias")).alias("alias_key")).agg(F.max_by("canonical", "ord").alias("canonical"))


def resolve(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts with every argument that has an alias replaced. Arguments without one, and variables, stay."""
    rows = facts.withColumn("__id", F.monotonically_increasing_id())
    parts = rows.select("__id", "predicate", F.posexplode("args").alias("pos", "arg")).withColumn("alias_key", F.when(~F.col("arg").rlike(r"^\?[A-Za-z_]\w*$"), alias_key(F.col("arg"))))
    named = parts.join(aliases, "alias_key", "left").withColumn("arg", F.coalesce("canonical", "arg"))
    out = named.groupBy("__id", "predicate").agg(F.array_sort(F.collect_list(F.struct("pos", "arg"))).alias("a"))
    return out.select("predicate", F.transform("a", lambda x: x["arg"]).alias("args")).distinct()


def triples_as_facts(triples: DataFrame) -> DataFrame:
    """Facts of complete triples ``s, r, e``; a row with a missing field gives none."""
    ok = triples.where("s <> '' and r <> '' and e <> ''")
    ident = F.regexp_replace(F.regexp_replace("r", r"[^A-Za-z0-9_]+", "_"), r"^(\d)", "N_$1")
    return ok.select(ident.alias("predicate"), F.array("s", "e").alias("args")).distinct()


def memory_statistics(facts: DataFrame, rules: Sequence[Rule], aliases: DataFrame | None = None) -> DataFrame:
    """Facts, rules, predicates (of facts and rule heads) and aliases, one row."""
    heads = facts.sparkSession.createDataFrame([(r.conclusion.predicate,) for r in rules] or [(None,)], "predicate string").dropna()
    predicates = facts.select("predicate").union(heads).distinct().count()
    counted = facts.distinct().agg(F.count(F.lit(1)).alias("facts")).withColumn("predicates", F.lit(predicates).cast("long"))
    return counted.withColumn("rules", F.lit(len(set(rules)))).withColumn("aliases", F.lit(aliases.count() if aliases is not None else 0))


def describe(facts: DataFrame, entities: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Given facts about each entity (its first argument), sorted; entities without facts have an empty list."""
    about = facts.withColumn("entity", F.col("args")[0]).groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("predicate", "args"))).alias("facts"))
    out = entities.select("entity").distinct().join(about, "entity", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<predicate:string,args:array<string>>>")))
    return out.join(labels, "entity", "left").withColumn("label", F.coalesce("label", F.replace("entity", F.lit("_"), F.lit(" ")))) if labels is not None else out


def proof(derived: DataFrame, atom: Atom, depth: int = 64) -> dict:
    """Proof tree of one fact, followed from the derivations level by level. Only the ancestors of this fact reach the driver."""
    wanted, seen, rows = [(atom.predicate, tuple(atom.args))], set(), {}
    for _ in range(depth):
        wanted = [w for w in wanted if w not in seen]
        if not wanted:
            break
        seen.update(wanted)
        keys = derived.sparkSession.createDataFrame([(p, list(a)) for p, a in wanted], FACT)
        level = derived.join(keys, ["predicate", "args"]).collect()
        wanted = []
        for r in level:
            premises = [(p["predicate"], tuple(p["args"])) for p in r.premises]
            rows[(r.predicate, tuple(r.args))] = (r.rule, premises)
            wanted += premises

    def tree(key, above=()):
        if key in above:
            return {"fact": key, "kind": "cycle"}
        if key not in rows:
            return {"fact": key, "kind": "fact"}
        rule, premises = rows[key]
        return {"fact": key, "kind": "rule", "rule": rule, "premises": [tree(p, (*above, key)) for p in premises]}

    return tree((atom.predicate, tuple(atom.args)))


def executed(programs: DataFrame) -> DataFrame:
    """Answers to compiled programs (``program`` as ``functions.knowledge.compiled`` has it) over the facts and rules among them.

    One row per distinct program: ``kind, predicate, args, numbers, ok, answer, values, error``. Questions are answered
    over the facts and what the rules add to them; a comparison has its relation, a sorting its ``values``, a
    description the given facts about its entity; facts and rules are recorded. A program that is none, or of a kind
    that is not run here, is a row with its error and no exception.
    """
    p = cut(programs.select("program.*").distinct())
    facts = p.where("kind = 'FACT'").select("predicate", "args")
    rules = p.where("kind = 'RULE'").select(F.col("predicate").alias("head"), F.col("args")[0].alias("class"))
    members = facts.where("predicate = 'IsA'").select(F.col("args")[0].alias("x"), F.col("args")[1].alias("class"))
    derived = members.join(rules, "class").select(F.col("head").alias("predicate"), F.array("x").alias("args"))
    known = facts.unionByName(derived).distinct().withColumn("__yes", F.lit(True))
    about = facts.groupBy(F.col("args")[0].alias("__entity")).agg(F.array_sort(F.collect_set(F.concat(F.col("predicate"), F.lit("("), F.array_join("args", ","), F.lit(")")))).alias("__facts"))
    rows = p.join(known, ["predicate", "args"], "left").withColumn("__entity", F.when(F.col("kind") == "DESCRIBE_ENTITY", F.col("args")[0])).join(about, "__entity", "left")
    kind, a, b = F.col("kind"), F.try_element_at("numbers", F.lit(1)), F.try_element_at("numbers", F.lit(2))
    relation = F.when(a > b, "greater").when(a < b, "less").otherwise("equal")
    answer = F.when(kind == "QUERY", F.coalesce("__yes", F.lit(False)).cast("string")).when(kind == "COMPARE_VALUES", relation).when(kind == "DESCRIBE_ENTITY", F.coalesce(F.array_join("__facts", ";"), F.lit(""))).when(kind.isin("FACT", "RULE"), "recorded")
    values = F.when(kind == "SORT_VALUES", F.sort_array("numbers", asc=True)).otherwise(F.lit(None))
    values = F.when((kind == "SORT_VALUES") & F.col("descending"), F.sort_array("numbers", asc=False)).otherwise(values)
    error = F.when(kind == "ERROR", "outside the grammar").when(~kind.isin("FACT", "RULE", "QUERY", "COMPARE_VALUES", "SORT_VALUES", "DESCRIBE_ENTITY", "IDENTITY"), "not run here")
    return rows.select("kind", "predicate", "args", "numbers", error.isNull().alias("ok"), answer.alias("answer"), values.alias("values"), error.alias("error"))


class Session:
    """Facts and rules that programs add to and ask. Queries see all rules; derived facts are never stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rules = spark, []
        self.facts = spark.createDataFrame([], FACT)
        self._closure: Closure | None = None

    def add(self, facts: DataFrame | None = None, rules: Sequence[Rule] = ()) -> Session:
        if facts is not None:
            self.facts = cut(self.facts.unionByName(facts.select("predicate", "args")).distinct())
        self.rules += [r for r in rules if r not in self.rules]
        self._closure = None
        return self

    @property
    def closure(self) -> Closure:
        if self._closure is None:  # inferred once for all queries until something is added
            self._closure = infer(self.facts, self.rules)
        return self._closure

    def ask(self, queries: DataFrame) -> DataFrame:
        c = self.closure
        return answers(queries, c.facts).withColumns({"rounds": F.lit(c.rounds), "derived_facts": F.lit(c.derived)})
