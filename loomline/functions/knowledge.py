"""Facts, questions and rules stated in text, as ``struct<predicate, args>`` columns, and plans over interface elements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import WS, blank_as_null, let, strip, symbol

#: Names that have identifiers of their own.
CONCEPTS = {
    "kedi": "Cat", "cat": "Cat", "köpek": "Dog", "kopek": "Dog", "dog": "Dog", "kuş": "Bird", "kus": "Bird", "bird": "Bird", "memeli": "Mammal", "mammal": "Mammal", "araç": "Vehicle", "arac": "Vehicle", "vehicle": "Vehicle",
    "bilgisayar": "Computer", "computer": "Computer", "program": "Program", "dosya": "File", "file": "File", "insan": "Human", "human": "Human", "person": "Human", "hayvan": "Animal", "animal": "Animal",
    "sıcakkanlı": "WarmBlooded", "sicakkanli": "WarmBlooded", "warm-blooded": "WarmBlooded",
}

#: Forms of sentences, in the order in which they are tried; groups are the arguments. All are matched
#: without regard to case on text with single blanks.
COPULA = "(?:dır|dir|dur|dür|tır|tir|tur|tür)?"
FACT_FORMS = (
    ("IsA", rf"^(.+?) bir ([^.?!]+?){COPULA}[.]?$"), ("IsA", r"^(.+?) is an? ([^.?!]+)[.]?$"), ("TallerThan", r"^(.+?) (.+?)['’]den daha uzun(?:dur)?[.]?$"),
    ("TallerThan", r"^(.+?) is taller than (.+?)[.]?$"), ("LocatedIn", r"^(.+?) (.+?) içinde(?:dir)?[.]?$"), ("LocatedIn", r"^(.+?) is in (.+?)[.]?$"),
)
RULE_FORMS = (("", rf"^her ([^.?!]+?) (sıcakkanlı|sicakkanli){COPULA}[.]?$"), ("", r"^every ([^.?!]+?) is (warm-blooded)[.]?$"))
#: These are matched without signs at the end.
QUERY_FORMS = (
    ("WarmBlooded", r"^(.+?) sıcakkanlı m[ıiuü](?:dır|dir)?$"), ("WarmBlooded", r"^is (.+?) warm-blooded$"), ("IsA", r"^(.+?) bir (.+?) m[ıiuü](?:dır|dir|dur|dür)?$"), ("IsA", r"^is (.+?) an? (.+?)$"),
    ("TallerThan", r"^(.+?) (.+?)['’]den daha uzun mu$"), ("TallerThan", r"^is (.+?) taller than (.+?)$"),
)
DESCRIBE_FORMS = tuple(("DESCRIBE_ENTITY", p) for p in (r"^(.+?) hakkında ne biliyorsun$", r"^(.+?) hakkında bildiklerini anlat$", r"^(.+?) hakkında bilgi ver$", r"^what do you know about (.+?)$", r"^tell me about (.+?)$"))
IDENTITY = (
    "sen kimsin", "kimsin", "sen nesin", "kendini tanıt", "kendini tanit", "kendinden (?:biraz )?bahset", "adın ne", "adin ne", "nasıl bir yapay zek[aâ]sın", "nasil bir yapay zekasin", "ne tür bir asistansın", "ne tur bir asistansin", "seni nasıl tanımlarsın", "seni nasil tanimlarsin",
    "who are you", "what are you", "introduce yourself", "tell me about yourself", "what is your name", "what kind of ai are you", "what kind of assistant are you", "how would you describe yourself",
    "nasıl çalışıyorsun", "nasil calisiyorsun", "cevaplarını nasıl oluşturuyorsun", "cevaplarini nasil olusturuyorsun", "cevaplarını nasıl üretiyorsun", "cevaplarini nasil uretiyorsun", "how do you work", "how do you form your answers", "how do you generate your answers",
)
_SUM = r"([0-9+\-*/%(). ^]+)"
ARITHMETIC_FORMS = (rf"^{_SUM} işlemini hesapla[.]?$", rf"^hesapla[: ]+{_SUM}[.]?$", rf"^calculate[: ]+{_SUM}[.]?$")
_VALUE = r"(-?[0-9]+(?:\.[0-9]+)?)"
COMPARE_FORMS = (rf"^{_VALUE}\s*(?:mi|mı|mu|mü) büyük\s+{_VALUE}\s*(?:mi|mı|mu|mü)[?]?$", rf"^hangisi büyük[: ]+{_VALUE}\s*(?:,|ve|ile)\s*{_VALUE}[?]?$", rf"^which is greater[: ]+{_VALUE}\s*(?:,|or|and)\s*{_VALUE}[?]?$")
_VALUES = r"(-?[0-9.,\s-]+)[.]?$"
SORT_FORMS = (
    rf"^(?:şunları|bunları|sayıları)\s+(büyükten küçüğe|küçükten büyüğe)\s+sırala[: ]+{_VALUES}", rf"^sort(?: these)?(?: numbers)?\s+(?:in\s+)?(descending|ascending)\s+order[: ]+{_VALUES}",
    rf"^(?:şunları|bunları|sayıları)\s+sırala()[: ]+{_VALUES}", rf"^sort(?: these)?(?: numbers)?()[: ]+{_VALUES}",
)
CODE_FENCE, ASKS_CODE = r"(?is)```(python|py|java|javascript|js|typescript|ts|go|rust|rs|c|cpp|c\+\+)?[ \t]*\n(.*?)```", "(?:python|kod|code).*(?:analiz|incele|ne yapıyor|ne yapiyor|analyze|inspect|what does)"

PROGRAM = "struct<kind:string,predicate:string,args:array<string>,expression:string,numbers:array<double>,descending:boolean,language:string,source:string>"


def any_case(form: str) -> str:
    return "(?iu)" + form


def concept_symbol(name: Column) -> Column:
    """Identifier of a name, with the names of CONCEPTS under theirs; null if nothing is left."""
    return symbol(name, F.create_map(*(F.lit(x) for pair in CONCEPTS.items() for x in pair)))


def _program(kind: Column | str, **fields: Column) -> Column:
    types = {"predicate": "string", "args": "array<string>", "expression": "string", "numbers": "array<double>", "descending": "boolean", "language": "string", "source": "string"}
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), *(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def _plain(form: str) -> str:
    """The longest stretch of a form that stands in every text it matches, in lower case with one letter i."""
    parts = re.split(r"\(.*?\)\??|\[.*?\]\??|[\^$]|\w\?", form)
    return max((x for x in parts if not re.search(r"[?*+|\\]", x)), key=len).replace("ı", "i")


def _form(text: Column, forms, make) -> Column:
    """What ``make`` has of the first form that matches; null if none does, or if an argument has no identifier.
    Texts without the plain part of a form are not matched with it."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("struct<name:string,groups:array<string>>")
        for name, pattern in reversed(forms):
            n = 2 if pattern.count("(") - pattern.count("(?:") > 1 else 1
            groups = F.array(*(F.regexp_extract(text, any_case(pattern), g + 1) for g in range(n)))
            out = F.when(low.contains(_plain(pattern)) & text.rlike(any_case(pattern)), F.struct(F.lit(name).alias("name"), groups.alias("groups"))).otherwise(out)
        return out

    def named(hit: Column) -> Column:
        args = F.transform(hit["groups"], concept_symbol)
        return let(F.struct(hit["name"].alias("name"), args.alias("args")), lambda v: F.when(~F.exists(v["args"], lambda a: a.isNull()), make(v["name"], v["args"])))

    return let(let(F.lower(F.translate(text, "İIı", "iii")), first), lambda hit: F.when(hit.isNotNull(), named(hit)))


def _on_one_line(text: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{WS}+", " ")


def _unended(text: Column) -> Column:
    return F.regexp_replace(text, "[?.!]+$", "")


def fact_program(text: Column) -> Column:
    return _form(text, FACT_FORMS, lambda name, args: _program("FACT", predicate=name, args=args))


def rule_program(text: Column) -> Column:
    """A rule ``IsA(?x, class)`` implies ``predicate(?x)``: the class is the argument."""
    return _form(text, RULE_FORMS, lambda _, args: _program("RULE", predicate=args[1], args=F.slice(args, 1, 1)))


def query_program(text: Column) -> Column:
    return _form(_unended(text), QUERY_FORMS, lambda name, args: _program("QUERY", predicate=name, args=args))


def describe_program(text: Column) -> Column:
    return _form(_unended(text), DESCRIBE_FORMS, lambda name, args: _program("DESCRIBE_ENTITY", args=args))


def identity_program(text: Column) -> Column:
    return F.when(F.lower(_unended(text)).rlike(any_case(f"^(?:{'|'.join(IDENTITY)})$")), _program("IDENTITY"))


def operation_program(text: Column, raw: Column) -> Column:
    """Arithmetic, comparison, sorting of two numbers and more, or code to analyse; the first that fits."""
    got = lambda p, g: F.regexp_extract(text, any_case(p), g)
    out = F.when(raw.rlike(CODE_FENCE) & text.rlike(any_case(ASKS_CODE)), _program("ANALYZE_CODE", language=_language(raw), source=F.concat(F.regexp_replace(F.regexp_extract(raw, CODE_FENCE, 2), rf"{WS}+$", ""), F.lit("\n"))))
    for p in reversed(SORT_FORMS):
        values = F.transform(F.regexp_extract_all(got(p, 2), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda v: v.cast("double"))
        out = F.when(text.rlike(any_case(p)) & (F.size(values) >= 2), _program("SORT_VALUES", numbers=values, descending=F.lower(got(p, 1)).isin("büyükten küçüğe", "descending"))).otherwise(out)
    for p in reversed(COMPARE_FORMS):
        out = F.when(text.rlike(any_case(p)), _program("COMPARE_VALUES", numbers=F.array(got(p, 1).cast("double"), got(p, 2).cast("double")))).otherwise(out)
    for p in reversed(ARITHMETIC_FORMS):
        sum_ = F.trim(got(p, 1))
        out = F.when(sum_ != "", _program("ARITHMETIC", expression=F.replace(sum_, F.lit("^"), F.lit("**")))).otherwise(out)
    return out


def _language(raw: Column) -> Column:
    name = F.lower(F.regexp_extract(raw, CODE_FENCE, 1))
    return F.when(name.isin("", "py"), "python").otherwise(name)


def json_program(text: Column) -> Column:
    """A program given as a JSON object, with or without its markers, as ``source``."""
    body = strip(F.regexp_replace(F.regexp_replace(text, r"^<\|semantic_ir\|>", ""), r"<\|semantic_end\|>$", ""))
    return F.when((text.startswith("{") | text.startswith("<|semantic_ir|>")) & body.startswith("{") & F.try_parse_json(body).isNotNull(), _program("PROGRAM", source=body))


def compiled(text: Column) -> Column:
    """What a text means, by the first grammar that takes it: a JSON program, a question for identity, a request to
    describe, a question, a rule, a fact, an operation. Texts outside all of them have the kind ERROR."""

    def of(raw: Column, one: Column) -> Column:
        return F.coalesce(json_program(raw), identity_program(one), describe_program(one), query_program(one), rule_program(one), fact_program(one), operation_program(one, raw), _program("ERROR"))

    return let(strip(F.coalesce(text, F.lit(""))), lambda raw: let(_on_one_line(raw), lambda one: of(raw, one)))


def _atom(program: Column) -> Column:
    return F.when(program.isNotNull(), F.struct(program["predicate"].alias("predicate"), program["args"].alias("args")))


def statement_atom(text: Column) -> Column:
    """The fact a sentence states, in Turkish or English; null if it has no known form."""
    return let(_on_one_line(text), lambda one: let(fact_program(one), _atom))


def question_atom(text: Column) -> Column:
    """The fact a question asks for; null if it has no known form."""
    return let(_on_one_line(text), lambda one: let(query_program(one), _atom))


def written_facts(df: DataFrame, keys: list[str], text: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Facts written as ``Predicate(arg, arg)`` anywhere in a text, one row each."""
    spans = F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z][A-Za-z]*\([A-Za-z_][A-Za-z0-9_]*(?:, [A-Za-z_][A-Za-z0-9_]*)*\))"), 1)
    rows = df.select(*keys, F.explode(spans).alias("s"))
    rows = rows.select(*keys, F.substring_index("s", "(", 1).alias("predicate"), F.split(F.regexp_extract("s", r"\((.*)\)", 1), ", ").alias("args"))
    return rows.where(~F.col("predicate").isin(*skip)) if skip else rows


def ui_plan(goal: Column, elements: Column) -> Column:
    """Steps for a goal over ``elements ARRAY<STRUCT<id, role, name, value, enabled, visible>>``: the first rule that fits of
    save, type, open, scroll and observe. Steps are ``action, target, payload``."""
    g = F.lower(F.coalesce(goal, F.lit("")))
    usable = F.filter(elements, lambda e: F.coalesce(e["enabled"], F.lit(True)) & F.coalesce(e["visible"], F.lit(True)))
    first = lambda test: F.get(F.filter(usable, test), F.lit(0))["id"]
    named = lambda w: first(lambda e: F.lower(F.coalesce(e["name"], F.lit(""))).contains(w))
    step = lambda action, target=None, payload=None: F.struct(F.lit(action).alias("action"), (target if target is not None else F.lit(None).cast("string")).alias("target"), (payload if payload is not None else F.lit(None).cast("string")).alias("payload"))
    save = F.coalesce(named("save"), named("kaydet"))
    box = first(lambda e: F.lower(e["role"]).isin("textbox", "input", "editor"))
    quoted = blank_as_null(F.regexp_extract(goal, r"[\"“'«]([^\"”'»]+)[\"”'»]", 1))
    wanted = strip(F.regexp_replace(g, r"\b(?:open|aç|launch|başlat)\b", ""))
    opened = F.when(wanted != "", first(lambda e: F.lower(F.coalesce(e["name"], F.lit(""))).contains(wanted)))
    return (
        F.when(g.rlike(r"\b(?:save|kaydet)"), F.when(save.isNotNull(), F.array(step("CLICK", save))).otherwise(F.array(step("KEY", payload=F.lit("CTRL+S")))))
        .when(quoted.isNotNull() | g.rlike(r"\b(?:type|write|yaz)\b"), F.when(box.isNotNull(), F.array(step("CLICK", box), step("TYPE", box, F.coalesce(quoted, F.lit(""))))).otherwise(F.array(step("TYPE", payload=F.coalesce(quoted, F.lit(""))))))
        .when(g.rlike(r"\b(?:open|aç|launch|başlat)\b") & opened.isNotNull(), F.array(step("DOUBLE_CLICK", opened)))
        .when(g.rlike(r"\b(?:scroll|kaydır)"), F.array(step("SCROLL", payload=F.when(g.rlike(r"up|yukarı"), "UP").otherwise("DOWN"))))
        .otherwise(F.array(step("OBSERVE")))
    )


def find_elements(elements: Column, roles: Column, needles: Column) -> Column:
    """Ids of visible, enabled elements of one of the roles (any, if empty) whose name or value holds every needle."""
    text = lambda e: F.lower(F.concat_ws(" ", e["name"], e["value"]))
    return F.transform(
        F.filter(elements, lambda e: F.coalesce(e["enabled"], F.lit(True)) & F.coalesce(e["visible"], F.lit(True)) & ((F.size(roles) == 0) | F.array_contains(roles, F.lower(e["role"]))) & F.forall(needles, lambda n: text(e).contains(F.lower(n)))),
        lambda e: e["id"],
    )
