"""Defects of question-answer pairs, by ordered rules; every rule that applies gives a defect type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.language import AGAINST_LABEL, Profiles, detect_languages, without_code

#: Markers that end an answer.
END_MARKERS = r"<\|(?:end|eos|endoftext|end_of_text|im_end|eot_id|assistant_end)\|>|</s>|<eos>|\[(?:END|EOS|DONE)\]"
#: Answers, by their letters and digits, that only hold a place.
PLACEHOLDERS = ("null", "none", "na", "nan", "nil", "undefined", "tbd", "todo", "empty", "noanswer", "boş", "bos", "yoktur", "cevapyok", "leer", "keineantwort", "vide", "vacio", "vacío", "sinrespuesta", "placeholder", "answer", "xxx")

#: Ways of declining, in the first person, by language.
REFUSALS = {
    "en": r"\bi(?:['’]m| am) (?:very |so |really )?sorry,? (?:but )?(?:i|this|that)|\bi (?:can(?:no|['’])t|am (?:not able|unable)|won['’]t be able|will not be able|must (?:decline|refuse)|have to (?:decline|refuse|pass)|do(?:n['’]t| not) have (?:the ability|access)|have no access|decline|refuse)\b|unfortunately,? i\b|my apologies|\bi apologi[sz]e|not (?:be )?appropriate for me|as an ai\b|i['’]m (?:unable|not able)|beyond what i can",
    "tr": r"üzgünüm|maalesef|ne yazık ki|kusura bakma|yardımcı olam[aı]|(?:yapa|vere|paylaşa|yan[ıi]tlaya|cevaplaya|getire|ede|söyleye|anlata|aç[ıi]klaya|konuşa|yaza)m(?:[ıi]yorum|[ae]m|[ıi]yoruz|[ae]y[ıi]z|ayaca[ğg][ıi]m|eyece[ğg][ıi]m)(?!\p{L})|mümkün değil|uygun olmaz|yapay zek[âa]|geri çevirmek|reddetmek zorunda",
    "de": r"tut mir (?:sehr )?leid|leider|(?:kann|darf|muss|möchte) ich .{0,60}(?:nicht|keine|ablehnen)|\bich (?:kann|darf|muss|möchte) .{0,60}(?:nicht|keine|ablehnen)|als (?:ki|sprachmodell)\b|entschuldigung",
    "fr": r"désolée?|malheureusement|je (?:ne (?:peux|puis|suis)|n['’]ai) pas|je (?:dois|préfère) (?:refuser|décliner)|impossible de (?:répondre|traiter|vous|t['’])|en tant qu['’](?:ia|intelligence|un modèle|modèle)|je (?:refuse|décline)|je ne suis pas en mesure",
    "es": r"lo siento|lamentablemente|por desgracia|no (?:puedo|me es posible|estoy en condiciones|tengo (?:acceso|permitido|la capacidad))|debo (?:rechazar|declinar)|tengo que (?:rechazar|declinar)|como (?:modelo|una? ia|inteligencia)|me temo que no|disculpa",
}
#: Sentences that may stand beside declining ones without answering: offers, thanks, sympathy and reasons, by language.
ASIDES = {
    "en": r"(?:another|different|other) (?:topics?|questions?|subjects?|requests?|things?)|(?:something|anything) else|(?:happy|glad) to (?:help|assist)|feel free|let me know|^\W*thank(?:s| you)|\bi (?:understand|appreciate|hope you|know (?:that )?this|realize|realise)|please (?:ask|consult|contact|reach out|understand)|my (?:guidelines|rules|polic|instructions|programming)|(?:guidelines|rules|polic\w+) (?:do not|don['’]t|prohibit|forbid)",
    "tr": r"başka (?:bir )?(?:konu|soru|şey|istek)|soru sorabilirsin|sorabilirsin|yardımcı olmaktan|yardımcı olabilirim|çekinme|teşekkür|anl[ıi]yorum|anlayış|lütfen .{0,60}(?:danış|başvur)|(?:yönerge|kural|politika|ilke)(?:ler)?(?:im|imiz)",
    "de": r"(?:andere[nrms]?|weitere[nrms]?) (?:thema|themen|fragen?|anliegen)|etwas ander|helfe ich|gerne? (?:helfen|behilflich|weiter)|^\W*(?:vielen )?dank|ich verstehe|verständnis|bitte wende|meine richtlinien|meinen richtlinien|meine[nr]? (?:regeln|vorgaben)",
    "fr": r"(?:autre|d['’]autres) (?:sujets?|questions?|demandes?|choses?)|n['’]hésite|^\W*merci|je comprends|je (?:serai|serais|suis) (?:ravi|heureu)|je peux (?:vous |t['’])?aider|veuillez (?:consulter|contacter)|mes (?:consignes|règles|directives)",
    "es": r"(?:otro|otros|otra|otras) (?:temas?|preguntas?|cosas?|solicitud(?:es)?|asuntos?)|no dudes|no dude en|^\W*(?:muchas )?gracias|entiendo|comprendo|con gusto|encantad|puedo ayudar|mis (?:normas|reglas|directrices|pautas)",
}
#: Where a sentence of joined text ends; not after an initial or a short form.
_SENTENCE_END = r"(?<=[.!?…])(?<!\b(?:\p{L}|dr|mr|mrs|ms|prof|vb|örn|bkz|bzw|etc|ej|ex)\.)\s+|\n"

#: Requests for another language, and names of languages.
ASKS_LANGUAGE = r"(?iu)translat|çevir|tercüme|übersetz|traduis|tradui[rst]|traduc|tradúc|\b(?:in|into|to) (?:english|turkish|german|french|spanish)\b|auf (?:englisch|türkisch|deutsch|französisch|spanisch)|en (?:anglais|turc|allemand|français|espagnol|inglés|turco|alemán|francés|español)\b|(?:ingilizce|türkçe|almanca|fransızca|ispanyolca)"

_TRIM = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"
_QUOTED = r"\x22[^\x22]*(?:\x22|$)|“[^”]*(?:”|$)|«[^»]*(?:»|$)|„[^“”]*(?:[“”]|$)"
_ITEM = r"^\s*(?:[-*•▪+–]|\d+[.)])(?:\s|$)"


def letters(text: Column) -> Column:
    """Letters and digits in lower case, dotted and dotless i as one letter."""
    return F.regexp_replace(F.replace(F.lower(F.translate(text, "İIı", "iii")), F.lit("i̇"), F.lit("i")), r"[^\p{L}\p{N}\p{M}]+", "")


def _at_words(forms: dict[str, str]) -> str:
    """One pattern of all forms; each begins where a word does, so other places need no try."""
    return r"(?<!\p{L})(?:" + "|".join(forms.values()) + ")"


def _repeats(answer: Column, question: Column) -> Column:
    """The answer is the question once or several times and nothing else."""
    n = F.length(question)
    times = F.when(n > 0, F.floor(F.length(answer) / n))
    return F.coalesce((n > 0) & (times > 0) & (answer == F.repeat(question, times.cast("int"))), F.lit(False))


def _unbalanced(text: Column) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (count(r"\(") != count(r"\)")) | (count(r"\[") != count(r"\]")) | (count(r"\{") != count(r"\}"))


def pair_defects(pairs: DataFrame, profiles: Profiles) -> DataFrame:
    """``sft_id, user, assistant`` to ``sft_id, defects ARRAY<STRING>``, in the order of the rules.

    empty: null, blank, or only punctuation, an end marker or a placeholder word; then no other rule applies.
    copy: the letters and digits are the question's, once or repeated, after an introduction of any length or not.
    truncated: an open tool call, JSON value, code fence or bracket; a list marker without an entry; or prose
    that ends without a sign that ends sentences. Answers of up to three words and entries need none; never with copy.
    refusal: of the unquoted sentences at least one declines in the first person, and no other answers; sentences
    go on over line breaks, but not over blank lines and into entries of lists.
    other_language: code apart, the answer has one language, the question another, and asks for none.

    A null user has no language and nothing to copy. Rows are judged one by one; other columns are ignored;
    repeated rows give repeated results. Texts are judged whole, whatever their length.
    """
    rows = pairs.select("sft_id", "user", "assistant")
    rows = rows.withColumn("body", F.regexp_replace(F.regexp_replace(F.coalesce("assistant", F.lit("")), END_MARKERS, ""), _TRIM, ""))
    rows = rows.withColumns({"a": letters(F.col("body")), "q": letters(F.coalesce("user", F.lit("")))})
    rows = rows.withColumn("empty", (F.col("a") == "") | F.col("a").isin(*PLACEHOLDERS))
    told = letters(F.regexp_replace("body", r"^[^:\n]+[:\n]\s*", ""))
    rows = rows.withColumn("copy", ~F.col("empty") & (_repeats(F.col("a"), F.col("q")) | _repeats(told, F.col("q"))))

    body = F.col("body")
    rows = rows.withColumns({"last": F.substring_index(body, "\n", -1), "plain": without_code(body)})
    fences = F.size(F.split(body, "```")) - 1
    call = F.regexp_extract(body, r"(?s)^<\|tool_call\|>(.*?)(?:<\|tool_end\|>|\z)", 1)
    is_call, is_json = body.startswith("<|tool_call|>"), body.rlike(r'^(?:\{\s*["}]|\[\s*[\{\[])')
    last_call = F.element_at(F.split(body, r"<\|tool_call\|>"), -1)
    broken_call = ~last_call.contains("<|tool_end|>") & F.try_parse_json(call).isNull() | last_call.contains("<|tool_end|>") & F.try_parse_json(F.split(last_call, r"<\|tool_end\|>")[0]).isNull()
    broken_call = broken_call | ~last_call.contains("<|tool_end|>")
    is_code, last = F.col("plain") != body, F.col("last")
    words = F.size(F.split(body, r"\s+"))
    ended = last.rlike(r"[.!?…。؟][\s\x22'”’»“)\]}*_~]*$")
    item = last.rlike(_ITEM)
    bare_item = last.rlike(r"^\s*(?:[-*•▪+]|\d+[.)])\s*$")
    prose_cut = ~ended & ~item & (words > 3)
    truncated = (
        F.when(is_call, broken_call)
        .when(is_json, F.try_parse_json(body).isNull())
        .when(fences > 0, (fences % 2 == 1) | ~body.endswith("```") & ~ended & ~item)
        .when(is_code, _unbalanced(body) | last.rlike(r"[-+*/=<>,(\[{:&|]\s*$") & ~last.rlike(r"^\s*//"))
        .otherwise(bare_item | prose_cut)
    )
    spoken = F.regexp_replace(body, _QUOTED, " ")
    joined = F.regexp_replace(F.regexp_replace(spoken, r"\n[^\S\n]*\n\s*|\n(?=\s*(?:[-*•▪+–]|\d+[.)])\s)", "\u2028"), r"[^\S\u2028]+", " ")
    low = F.translate(F.lower(F.replace(joined, F.lit("I"), F.lit("i"))), "\u2028", "\n")
    sentences, declines = F.filter(F.split(low, _SENTENCE_END), lambda s: s.rlike(r"[\p{L}\p{N}]")), _at_words(REFUSALS)
    refusal = F.forall(sentences, lambda s: s.rlike(_at_words(REFUSALS | {f"{k} aside": v for k, v in ASIDES.items()}))) & F.exists(sentences, lambda s: s.rlike(declines))
    rows = rows.withColumns({"truncated": ~F.col("empty") & ~F.col("copy") & truncated, "refusal": ~F.col("empty") & refusal})

    keep = ["sft_id", "empty", "copy", "truncated", "refusal", "speech", "asks"]
    rows = rows.withColumns({"speech": F.when(~F.col("empty"), F.col("plain")), "asks": F.coalesce(F.col("user").rlike(ASKS_LANGUAGE), F.lit(False))})
    asked = detect_languages(rows, keep, "user", profiles).withColumnRenamed("languages", "asked").drop("segments", "scores")
    both = detect_languages(asked, ["sft_id", "empty", "copy", "truncated", "refusal", "asks", "asked"], "speech", profiles)
    known = F.array(*map(F.lit, profiles.languages))
    question, answer = F.col("asked")[0]["lang"], F.col("languages")[0]["lang"]
    favour = F.array_max("scores") - F.col("scores")[(F.array_position(known, question) - 1).cast("int")]
    other = ~F.col("asks") & (F.size("asked") == 1) & (F.size("languages") == 1) & (question != answer) & (favour >= AGAINST_LABEL)
    both = both.withColumn("other_language", ~F.col("empty") & F.coalesce(other, F.lit(False)))
    kinds = ("empty", "copy", "truncated", "refusal", "other_language")
    return both.select("sft_id", F.array_compact(F.array(*(F.when(F.col(k), k) for k in kinds))).alias("defects"))
