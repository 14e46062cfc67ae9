"""Corpus queries: cleaning, deduplication, budgets, quality and overlap over documents, code and raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as t
from loomline.operators import corpus as c
from loomline.operators import gates
from loomline.session import table
from loomline.sources import readers

WS = r"[\t-\r\x1c-\x1f\x{85}\pZ]"
#: SQL of a document's text on one line, without the compatibility step.
LINE = rf"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '[\r\f\x0b]+', '', 'g'), '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
LINES = f"lines AS (SELECT doc_id, coalesce(source, '(none)') AS source, lang, {LINE} AS line FROM documents)"
FIRSTS = "firsts AS (SELECT *, strlen(line) + 1 AS n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY md5(line) ORDER BY source, doc_id) AS r FROM lines WHERE length(line) >= 160) WHERE r = 1)"
#: Budgets are shares of the input, so that they grow with it.
SHARE = 0.5


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), "lang", t.one_line(F.col("text"), compatibility=False).alias("line"))


def clean_lengths(spark, d):
    return lines(spark, d).select("doc_id", F.length("line").cast("long").alias("chars"), F.octet_length("line").cast("long").alias("n_bytes"), (F.length("line") >= 160).alias("long_enough"))


def dedup_first_wins(spark, d):
    rows = lines(spark, d).where(F.length("line") >= 160).withColumn("digest", t.content_digest(F.col("line")))
    return c.first_wins(rows, "digest", ["source", "doc_id"]).select("source", "doc_id")


def fill(spark, d):
    filled = c.fill_budget(lines(spark, d), ["source"], "doc_id", "line", SHARE)
    return filled.select("source", "doc_id", "n_bytes", F.col("prev_bytes").cast("long").alias("prev_bytes"), "written_bytes")


def fill_texts(spark, d):
    """Digest of every text that the fill writes, the cut ones included."""
    rows = lines(spark, d)
    out = c.payloads(c.fill_budget(rows, ["source"], "doc_id", "line", SHARE), rows, ["source"], "doc_id", "line")
    return out.select("source", "doc_id", F.md5(F.col("payload").cast("binary")).alias("digest"))


def fill_stats(spark, d):
    return c.fill_statistics(lines(spark, d), ["source"], "doc_id", "line", SHARE).select("source", "n_bytes", "documents", "duplicates_skipped", "ok")


def fill_stop(spark, d):
    out = c.fill_budget(lines(spark, d), ["source"], "doc_id", "line", SHARE, min_chars=200, dedup_prefix=0, separator_bytes=0, cut_mode="stop")
    return out.select("source", "doc_id", F.col("written_bytes").cast("long").alias("written_bytes"))


def fill_raw_cut(spark, d):
    """The fill of an earlier version: 180 characters, copies told by their first 4 096, cut at a byte."""
    out = c.fill_budget(lines(spark, d), ["source"], "doc_id", "line", SHARE, min_chars=180, dedup_prefix=4096, slack=0, cut_mode="bytes")
    return out.select("source", "doc_id", "written_bytes")


#: Fixed value: what parts documents in the oldest form of the corpus.
DOCUMENT_SEPARATOR = "\n\n<|document|>\n\n"


def fill_separated(spark, d):
    """The oldest fill: stripped texts of 200 characters, copies kept, a separator counted with each, cut at a byte."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), t.strip(F.col("text")).alias("line"))
    out = c.fill_budget(rows, ["source"], "doc_id", "line", SHARE, min_chars=200, dedup_prefix=0, separator_bytes=len(DOCUMENT_SEPARATOR), slack=0, cut_mode="bytes")
    return out.select("source", "doc_id", "written_bytes")


def mix(spark, d):
    rows = lines(spark, d)
    langs = [(k, rows.where(F.lower("lang").startswith(k)).select("doc_id", "line"), SHARE) for k in ("tr", "en")]
    return c.fill_mix(langs, "doc_id", "line").select(F.col("source_name").alias("lang"), "doc_id", "written_bytes")


def utf8(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length(t.utf8_prefix(F.col("text"), 100)).cast("long").alias("kept_bytes"))


def quality(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(t.letter_ratio(x), 6).alias("letter_ratio"), F.round(t.punctuation_ratio(x), 6).alias("punctuation_ratio"), t.is_turkish(x).alias("turkish"))


def quality_gate(spark, d):
    x = F.col("text")
    rows = table(spark, d, "documents").where("text is not null").groupBy(F.coalesce("source", F.lit("(none)")).alias("rule")).agg(F.round(F.avg(t.letter_ratio(x)), 6).alias("actual"))
    return rows.withColumn("ok", F.col("actual") >= 0.60)


def natural(spark, d):
    return table(spark, d, "main_raw").select("ord", t.natural_text(F.col("text")).alias("natural_text"))


def overlap(spark, d):
    """Rows and items that share nine words in a row. The few hashes of the items are joined to those of the rows; if
    Spark finds them small they are sent to every task, so that only hits are shuffled."""
    hashed = lambda name, key: table(spark, d, name).select(key, F.explode(F.transform(t.shingles(t.normalized_words(F.col("text")), 9), lambda s: F.xxhash64(s))).alias("h"))
    return hashed("main_raw", "ord").join(hashed("eval_items", "item_id"), "h").groupBy("ord", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def copies(spark, d):
    """Similarity of answers to their questions."""
    pairs = table(spark, d, "main_sft").select("sft_id", t.normalized_words(F.col("user")).alias("u"), t.normalized_words(F.col("assistant")).alias("a"))
    return pairs.select("sft_id", F.round(t.copy_similarity("u", "a"), 6).alias("similarity"), t.has_verbatim_overlap(F.col("u"), F.col("a")).alias("overlap"))


def _coder_rows(spark, d):
    rows = table(spark, d, "coder_raw").where("text is not null")
    code = t.strip(F.col("text"))
    doc = F.when(code.startswith("<source>"), code).otherwise(t.coder_document(F.lower(F.trim(F.coalesce("source", F.lit("unknown")))), F.lit(None).cast("string"), code))
    return rows.where(F.length(code) >= 80).select("ord", F.octet_length(doc).cast("long").alias("n_bytes"), t.content_digest(code, None).alias("digest"))


def code_documents(spark, d):
    return _coder_rows(spark, d).select("ord", "n_bytes")


def code_fill(spark, d):
    """Code documents, each code once, to 60 % of their bytes."""
    rows = c.first_wins(_coder_rows(spark, d), "digest", ["ord"]).select("ord", "n_bytes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    return c.fill_skip_tail(rows, "ord", "n_bytes", int(total * 0.6)).select("ord", "n_bytes")


def raw_sources(spark, d):
    rows = table(spark, d, "main_raw")
    body = readers.raw_text(rows)
    return rows.select("ord", "source", body.alias("body")).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("body") != "", 1)).alias("with_text"), F.sum(F.octet_length("body")).alias("n_bytes"))


def prefix_copy(spark, d):
    rows = lines(spark, d).where(F.length("line") > 0)
    return c.copy_prefix(rows, "doc_id", "line", SHARE).select("doc_id", "written_bytes")


def row_caps(spark, d):
    rows = table(spark, d, "documents").where(F.length("text") >= 160).select(F.coalesce("source", F.lit("(none)")).alias("source"), "doc_id")
    counted = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) * SHARE).alias("cap"))  # half of each source
    return c.row_caps(rows.join(counted, "source"), ["source"], ["doc_id"], F.col("cap")).select("source", "doc_id")


def quotas(spark, d):
    rows = table(spark, d, "documents").where("domain is not null").select(F.lower(F.trim("lang")).alias("lang"), "doc_id").where("lang <> ''")
    return c.quota_and_cap(rows, "lang", ["doc_id"], int(rows.count() * SHARE))


def knowledge(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return readers.knowledge_lines(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def ordinals(spark, d):
    rows = table(spark, d, "main_raw").where("crawled_at is not null").select(F.col("ord").alias("id"), "crawled_at")
    return readers.with_ordinal(rows, ["crawled_at", "id"], "place").select("id", "place")


def json_fields(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", t.compact_json(("title", F.col("title")), ("lang", F.col("lang")), ("n_chars", F.col("n_chars"))).alias("json"))


def labels(spark, d):
    name = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", t.symbol(name).alias("symbol"), t.display_label(t.symbol(name), F.lit(None).cast("string")).alias("label"))


def wiki_fill(spark, d):
    """Titled documents as title and text to one byte budget, no deduplication."""
    rows = table(spark, d, "documents").where("title is not null").select("doc_id", t.one_line(F.col("title"), False).alias("title"), t.one_line(F.col("text"), False).alias("body"))
    rows = rows.where(F.length("body") >= 200).select("doc_id", F.concat("title", F.lit("\n"), "body").alias("line")).withColumn("source", F.lit("wiki"))
    return c.fill_budget(rows, ["source"], "doc_id", "line", SHARE, min_chars=0, dedup_prefix=0, slack=0).select("doc_id", "written_bytes")


def repetition(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(t.repeated_token_ratio(F.col("text")), 6).alias("repeated"), t.lexical_diversity(F.col("text")).alias("distinct_words"))


def sample_gate(spark, d):
    """Answers against the thresholds of the sample validator."""
    x = F.col("assistant")
    rows = table(spark, d, "main_sft").where("assistant is not null").select("sft_id", t.letter_ratio(x).alias("letters"), t.punctuation_ratio(x).alias("marks"), t.repeated_token_ratio(x).alias("repeated"))
    ok = (F.col("letters") >= 0.60) & (F.col("marks") <= 0.24) & (F.col("repeated") <= 0.42)
    return rows.groupBy(ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def input_gates(spark, d):
    """Totals of the tables against minimums."""
    one = lambda name, key, value: table(spark, d, name).agg(value.cast("double").alias("actual")).select(F.lit(key).alias("rule"), "actual")
    totals = one("main_raw", "main_bytes", F.sum(F.octet_length("text"))).unionByName(one("coder_raw", "coder_bytes", F.sum(F.octet_length("text")))).unionByName(one("main_sft", "sft_rows", F.count("assistant")))
    totals = totals.unionByName(one("cu07_manifest", "episodes", F.count_distinct("episode_id"))).unionByName(one("cu07_manifest", "domains", F.count_distinct("domain")))
    return gates.minimum_gates(totals, {"main_bytes": 1_000_000, "coder_bytes": 250_000, "sft_rows": 1_000, "episodes": 100, "domains": 30, "agents": 1})


def ablatives(spark, d):
    """Ablatives of numbers and of names of parts and nations."""
    words = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("word")).union(table(spark, d, "part").select(F.element_at(F.split("p_name", " "), 1))).union(table(spark, d, "nation").select(F.initcap("n_name")))
    return words.distinct().where("word <> ''").select("word", t.turkish_ablative(F.col("word")).alias("ablative"))


def prompts(spark, d):
    """Instruction prompts with their context; pairs without an instruction or an answer have none."""
    rows = table(spark, d, "main_sft").select("sft_id", t.alpaca_prompt(F.col("user"), F.col("system_prompt"), F.col("assistant")).alias("prompt"))
    return rows.select("sft_id", F.length("prompt").cast("long").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


def hashes(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", t.image_digest(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), t.provenance(F.col("text")).alias("provenance"), t.asks_verbatim(F.col("text")).alias("verbatim"))


def compatible(spark, d):
    """Digest of every document's cleaned text, compatibility forms composed."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(t.clean_text(F.col("text")).cast("binary")).alias("digest"))


def older_cleaning(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(t.clean_text(F.col("text"), "v0.6", compatibility=False).cast("binary")).alias("digest"))


def copy_rule(spark, d):
    """Answers that share nine words in a row with their question, short ones exempt."""
    rows = table(spark, d, "main_sft").where("assistant is not null and user is not null")
    return rows.select("sft_id", ((F.length(t.normalized_words(F.col("assistant"))) >= 18) & t.has_verbatim_overlap(F.col("user"), F.col("assistant"))).alias("overlaps"))


QUERIES = {
    "corpus_fill_texts": fill_texts, "corpus_fill_raw_cut": fill_raw_cut, "corpus_fill_separated": fill_separated, "turkish_ablatives": ablatives, "alpaca_prompts": prompts, "content_hashes": hashes, "clean_compatible": compatible, "clean_older": older_cleaning, "copy_rule": copy_rule,
    "wiki_fill": wiki_fill, "repeated_token_ratio": repetition, "sample_gate": sample_gate, "input_gates": input_gates,
    "corpus_fill_budget": fill, "corpus_fill_statistics": fill_stats, "corpus_fill_stop_before": fill_stop, "corpus_language_mix": mix, "corpus_clean_lengths": clean_lengths,
    "corpus_dedup_first_wins": dedup_first_wins, "corpus_utf8_prefix": utf8, "corpus_quality_flags": quality, "corpus_quality_gate": quality_gate, "corpus_natural_text": natural,
    "copy_overlap_9gram": overlap, "copy_similarity_pairs": copies, "code_documents": code_documents, "code_fill_skip_tail": code_fill, "raw_source_statistics": raw_sources,
    "corpus_copy_prefix": prefix_copy, "corpus_row_caps": row_caps, "corpus_quota_and_cap": quotas, "knowledge_line_kinds": knowledge, "source_ordinals": ordinals,
    "compact_json": json_fields, "symbols_and_labels": labels,
}

ST = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
CL = lambda x: ST(f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(0), ' '), '[\\r\\f\\x0b]+', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")
_CL6 = lambda x: ST(f"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[\\t\\r\\f\\x0b]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")
_CODE = rf"""s AS (SELECT ord, source, {ST('text')} AS code FROM coder_raw WHERE text IS NOT NULL), code_rows AS (SELECT ord, code, CAST(strlen(CASE WHEN starts_with(code, '<source>') THEN code ELSE '<source>' || lower(trim(coalesce(source, 'unknown'))) || '</source>' || chr(10)
    || '<instruction>Explain, complete, test, or improve the following code.</instruction>' || chr(10) || '<code>' || chr(10) || code || chr(10) || '</code>' END) AS BIGINT) AS n_bytes FROM s WHERE length(code) >= 80)"""


def _cut(hex_: str, n: str) -> str:
    """SQL of the bytes that a prefix of at most n bytes of whole characters has."""
    inner = lambda k: f"substr({hex_}, 2 * ({n} - {k}) + 1, 2) NOT BETWEEN '80' AND 'BF'"
    return f"CASE WHEN strlen({hex_}) <= 2 * ({n}) THEN strlen({hex_}) // 2 WHEN {inner(0)} THEN {n} WHEN {inner(1)} THEN {n} - 1 WHEN {inner(2)} THEN {n} - 2 ELSE {n} - 3 END"


def _filled(source: str, key: str = "source", order: str = "doc_id", slack: int = 4, share: str = "") -> str:
    """Rows with n_bytes to rows with the bytes before them and the room left in a budget of a share of the even part of all bytes."""
    budget = f"(SELECT CAST(floor({SHARE} * sum(n_bytes) / count(DISTINCT {key})) AS BIGINT) FROM {share or source})"
    prev = f"CAST(coalesce(sum(n_bytes) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    return f"SELECT *, budget - prev AS room FROM (SELECT *, {prev} AS prev, {budget} AS budget FROM {source}) WHERE prev < budget - {slack}"


_WRITTEN = f"CAST(CASE WHEN n_bytes <= room THEN n_bytes ELSE 1 + {_cut('hex(encode(line))', '(room - 1)')} END AS BIGINT)"
_NW = r"trim(regexp_replace(regexp_replace(lower(replace(coalesce({x}, ''), 'İ', 'i̇')), '[^0-9A-Za-zÇĞİÖŞÜçğıöşü]+', ' ', 'g'), ' +', ' ', 'g'))"
_SH = "list_distinct(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i + 8], ' ')))"
_INK = rf"len(regexp_extract_all(text, '[^\t-\r\x1c-\x1f\x{{85}}\pZ]'))"
_LET = r"len(regexp_extract_all(text, '[\pL\pN]'))"

_WL = lambda x: LINE.replace("text", x)
_TK = r"[\pL\pN_]+|[^\pL\pN_\t-\r\x1c-\x1f\x{85}\pZ]"
_REP = lambda src, x, key: f"tk AS (SELECT {key}, unnest(regexp_extract_all(lower(replace({x}, 'İ', 'i̇')), '{_TK}')) AS w FROM {src}), fr AS (SELECT {key}, w, count(*) AS n FROM tk GROUP BY ALL), rp AS (SELECT {key}, CASE WHEN sum(n) < 4 THEN 0.0 ELSE max(n) / sum(n) END AS repeated FROM fr GROUP BY {key})"

SQL = {
    "wiki_fill": f"""WITH b AS (SELECT 'wiki' AS source, doc_id, line, strlen(line) + 1 AS n_bytes FROM (SELECT doc_id, {_WL('title')} || chr(10) || {_WL('text')} AS line FROM documents WHERE title IS NOT NULL AND length({_WL('text')}) >= 200)), f AS ({_filled('b', slack=0)}) SELECT doc_id, {_WRITTEN} AS written_bytes FROM f""",
    "corpus_fill_budget": f"WITH {LINES}, {FIRSTS}, f AS ({_filled('firsts')}) SELECT source, doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, prev AS prev_bytes, {_WRITTEN} AS written_bytes FROM f",
    "corpus_fill_texts": f"WITH {LINES}, {FIRSTS}, f AS ({_filled('firsts')}), w AS (SELECT *, {_WRITTEN} AS written FROM f) SELECT source, doc_id, md5(unhex(left(hex(encode(line)), CAST(2 * (least(written, n_bytes) - 1) AS BIGINT)))) AS digest FROM w",
    "corpus_fill_statistics": f"""WITH {LINES}, {FIRSTS}, f AS ({_filled('firsts')}), w AS (SELECT source, sum({_WRITTEN}) AS n_bytes, count(*) AS documents, max(doc_id) AS last, max(budget) AS budget FROM f GROUP BY source)
        SELECT w.source, CAST(w.n_bytes AS BIGINT) AS n_bytes, documents, (SELECT count(*) FROM lines l WHERE l.source = w.source AND length(line) >= 160 AND doc_id <= last) - documents AS duplicates_skipped, w.n_bytes >= floor(budget * 0.95) AS ok FROM w""",
    "corpus_fill_stop_before": f"""WITH {LINES}, p AS (SELECT source, doc_id, strlen(line) AS n_bytes FROM lines WHERE length(line) >= 200), q AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM p)
        SELECT source, doc_id, CAST(n_bytes AS BIGINT) AS written_bytes FROM q WHERE prev + n_bytes <= (SELECT floor({SHARE} * sum(n_bytes) / count(DISTINCT source)) FROM p) OR prev = 0""",
    "corpus_fill_raw_cut": f"""WITH {LINES}, a AS (SELECT *, strlen(line) + 1 AS n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY md5(left(line, 4096)) ORDER BY source, doc_id) AS r FROM lines WHERE length(line) >= 180) WHERE r = 1), f AS ({_filled('a', slack=0)})
        SELECT source, doc_id, CAST(least(n_bytes, room) AS BIGINT) AS written_bytes FROM f""",
    "corpus_fill_separated": f"""WITH a AS (SELECT *, strlen(line) + {len(DOCUMENT_SEPARATOR)} AS n_bytes FROM (SELECT doc_id, coalesce(source, '(none)') AS source, {ST('text')} AS line FROM documents) WHERE length(line) >= 200), f AS ({_filled('a', slack=0)})
        SELECT source, doc_id, CAST(least(n_bytes, room) AS BIGINT) AS written_bytes FROM f""",
    "corpus_language_mix": f"""WITH {LINES}, x AS (SELECT left(lower(lang), 2) AS lang, doc_id, line, md5(line) AS m, strlen(line) + 1 AS n_bytes FROM lines WHERE length(line) >= 160 AND left(lower(lang), 2) IN ('tr', 'en')), x1 AS (SELECT * FROM x WHERE lang = 'tr'), x2 AS (SELECT * FROM x WHERE lang = 'en'),
        a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id) AS r FROM x1) WHERE r = 1), f1 AS ({_filled('a1', 'lang', share='x1')}),
        seen AS (SELECT DISTINCT m FROM x1 WHERE doc_id <= (SELECT max(doc_id) FROM f1)),
        a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id) AS r FROM x2 WHERE m NOT IN (SELECT m FROM seen)) WHERE r = 1), f2 AS ({_filled('a2', 'lang', share='x2')})
        SELECT lang, doc_id, {_WRITTEN} AS written_bytes FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2)""",
    "corpus_copy_prefix": f"WITH {LINES}, a AS (SELECT 1 AS one, doc_id, line, strlen(line) + 1 AS n_bytes FROM lines WHERE line <> ''), f AS ({_filled('a', 'one', slack=0)}) SELECT doc_id, {_WRITTEN} AS written_bytes FROM f",
    "corpus_row_caps": f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT coalesce(source, '(none)') AS source, doc_id FROM documents WHERE length(text) >= 160)) WHERE r <= ceil(n * {SHARE})",
    "corpus_quota_and_cap": f"""WITH a AS (SELECT lower(trim(lang)) AS lang, doc_id FROM documents WHERE domain IS NOT NULL AND lower(trim(lang)) <> ''), n AS (SELECT floor(count(*) * {SHARE}) AS cap, count(DISTINCT lang) AS n FROM a),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM a) WHERE r <= (SELECT ceil(cap / n) FROM n)) SELECT lang, doc_id FROM (SELECT *, row_number() OVER (ORDER BY lang, doc_id) AS q FROM b) WHERE q <= (SELECT cap FROM n)""",
    "corpus_quality_flags": f"SELECT doc_id, round(CASE WHEN {_INK} = 0 THEN 0.0 ELSE {_LET} / {_INK} END, 6) AS letter_ratio, round(CASE WHEN {_INK} = 0 THEN 1.0 ELSE 1 - {_LET} / {_INK} END, 6) AS punctuation_ratio, regexp_matches(lower(replace(text, 'İ', 'i̇')), '[çğıöşü]') OR " + " OR ".join(f"contains(lower(replace(text, 'İ', 'i̇')), {w!r})" for w in t.TURKISH_PARTS) + " AS turkish FROM documents WHERE text IS NOT NULL",
    "corpus_natural_text": rf"""WITH a AS (SELECT ord, {ST("coalesce(text, '')")} AS x FROM main_raw), b AS (SELECT ord, x, list_transform(regexp_extract_all(x, '[A-Za-zÇĞİÖŞÜçğıöşü]{{2,}}'), lambda w: lower(replace(w, 'İ', 'i̇'))) AS w FROM a)
        SELECT ord, length(x) >= 20 AND len(regexp_extract_all(x, '\pL')) / greatest(length(x), 1) > 0.45 AND NOT regexp_matches(x, '[\x00-\x08\x0b-\x1f\x{{fffd}}]') AND len(w) >= 4 AND (len(w) < 12 OR len(list_distinct(w)) / len(w) >= 0.3) AS natural_text FROM b""",
    "turkish_ablatives": """WITH w AS (SELECT DISTINCT word FROM (SELECT CAST(p_partkey AS VARCHAR) AS word FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT upper(left(n_name, 1)) || lower(substr(n_name, 2)) FROM nation) WHERE word <> '')
        SELECT word, word || chr(39) || CASE WHEN right(word, 1) IN ('0', '6', '9') THEN 'dan' WHEN right(word, 1) IN ('1', '2', '7', '8') THEN 'den' WHEN right(word, 1) IN ('3', '4', '5') THEN 'ten' WHEN regexp_extract(lower(word), '([aeıioöuü])[^aeıioöuü]*$', 1) IN ('a', 'ı', 'o', 'u') THEN 'dan' ELSE 'den' END AS ablative FROM w""",
    "alpaca_prompts": f"""WITH a AS (SELECT sft_id, {CL('"user"')} AS i, {CL('system_prompt')} AS c, {CL('assistant')} AS o FROM main_sft), b AS (SELECT sft_id, CASE WHEN i <> '' AND o <> '' THEN CASE WHEN c = '' THEN i ELSE i || chr(10) || chr(10) || 'Bağlam:' || chr(10) || c END END AS p FROM a) SELECT sft_id, length(p) AS chars, md5(p) AS digest FROM b""",
    "content_hashes": "SELECT doc_id, left(sha1(coalesce(text, '')), 16) AS digest, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS provenance, " + " OR ".join(f"contains(lower(coalesce(text, '')), {w!r})" for w in t.VERBATIM) + " AS verbatim FROM documents",
    "clean_older": f"SELECT doc_id, md5({_CL6('text')}) AS digest FROM documents WHERE text IS NOT NULL",
    "copy_rule": f"""WITH a AS (SELECT sft_id, {_NW.format(x='"user"')} AS q, {_NW.format(x='assistant')} AS o FROM main_sft WHERE assistant IS NOT NULL AND "user" IS NOT NULL), b AS (SELECT sft_id, o, list_filter(string_split(q, ' '), lambda z: z <> '') AS q, list_filter(string_split(o, ' '), lambda z: z <> '') AS w FROM a),
        c AS (SELECT sft_id, o, {_SH} AS mine, q AS w FROM b) SELECT sft_id, length(o) >= 18 AND list_has_any(mine, {_SH}) AS overlaps FROM c""",
    "compact_json": "SELECT doc_id, CAST(json_object('lang', lang, 'n_chars', n_chars, 'title', title) AS VARCHAR) AS json FROM documents",
    "code_fill_skip_tail": f"""WITH RECURSIVE {_CODE}, u AS (SELECT ord, n_bytes, row_number() OVER (ORDER BY ord) AS k FROM (SELECT ord, n_bytes, row_number() OVER (PARTITION BY md5(code) ORDER BY ord) AS r FROM code_rows) WHERE r = 1), g AS (SELECT CAST(floor(sum(n_bytes) * 0.6) AS BIGINT) AS goal FROM u),
        walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS total, false AS taken UNION ALL
        SELECT u.k, u.ord, u.n_bytes, CASE WHEN t.total < goal AND (t.total < goal * 0.98 OR t.total + u.n_bytes <= goal) THEN t.total + u.n_bytes ELSE t.total END, t.total < goal AND (t.total < goal * 0.98 OR t.total + u.n_bytes <= goal) FROM walk t JOIN u ON u.k = t.k + 1 CROSS JOIN g)
        SELECT ord, n_bytes FROM walk WHERE taken""",
    "knowledge_line_kinds": """WITH v AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS v FROM documents), j AS (SELECT v, starts_with(v, '{') AS o, CASE WHEN starts_with(v, '{') AND json_valid(v) THEN v END AS j FROM v WHERE v <> ''),
        f AS (SELECT o, j, coalesce(nullif(trim(j->>'s_label'), ''), nullif(trim(j->>'subject'), ''), nullif(trim(j->>'s_id'), '')) AS s, coalesce(nullif(trim(j->>'r_label'), ''), nullif(trim(j->>'predicate'), ''), nullif(trim(j->>'r_id'), '')) AS r, coalesce(nullif(trim(j->>'e_label'), ''), nullif(trim(j->>'object'), ''), nullif(trim(j->>'e_id'), '')) AS e FROM j)
        SELECT CASE WHEN NOT o THEN 'text' WHEN j IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL AND e IS NOT NULL THEN 'triple' ELSE 'rejected' END AS kind, count(*) AS n FROM f GROUP BY 1""",
    "repeated_token_ratio": rf"""WITH {_REP('documents', 'text', 'doc_id')} SELECT d.doc_id, round(coalesce(repeated, 0.0), 6) AS repeated, CAST(len(list_distinct(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[\pL\pN_]{{2,}}'))) AS INT) AS distinct_words FROM documents d LEFT JOIN rp USING (doc_id) WHERE text IS NOT NULL""",
    "sample_gate": f"""WITH {_REP('main_sft', 'assistant', 'sft_id')}, x AS (SELECT sft_id, CASE WHEN {_INK.replace('text', 'assistant')} = 0 THEN 0.0 ELSE {_LET.replace('text', 'assistant')} / {_INK.replace('text', 'assistant')} END AS l, {_INK.replace('text', 'assistant')} AS ink FROM main_sft WHERE assistant IS NOT NULL)
        SELECT l >= 0.6 AND CASE WHEN ink = 0 THEN 1.0 ELSE 1 - l END <= 0.24 AND coalesce(repeated, 0) <= 0.42 AS ok, count(*) AS n FROM x LEFT JOIN rp USING (sft_id) GROUP BY 1""",
    "input_gates": """WITH a AS (SELECT 'main_bytes' AS rule, sum(strlen(text)) AS actual FROM main_raw UNION ALL SELECT 'coder_bytes', sum(strlen(text)) FROM coder_raw UNION ALL SELECT 'sft_rows', count(assistant) FROM main_sft UNION ALL SELECT 'episodes', count(DISTINCT episode_id) FROM cu07_manifest UNION ALL SELECT 'domains', count(DISTINCT domain) FROM cu07_manifest UNION ALL SELECT 'agents', 0)
        SELECT rule, CAST(actual AS DOUBLE) AS actual, CAST(minimum AS DOUBLE) AS minimum, actual >= minimum AS ok FROM a JOIN (VALUES ('main_bytes', 1000000), ('coder_bytes', 250000), ('sft_rows', 1000), ('episodes', 100), ('domains', 30), ('agents', 1)) AS v(rule, minimum) USING (rule)""",
    "corpus_clean_lengths": f"WITH {LINES} SELECT doc_id, length(line) AS chars, CAST(strlen(line) AS BIGINT) AS n_bytes, length(line) >= 160 AS long_enough FROM lines",
    "corpus_dedup_first_wins": f"WITH {LINES}, {FIRSTS} SELECT source, doc_id FROM firsts",
    "corpus_utf8_prefix": f"SELECT doc_id, CAST({_cut('hex(encode(text))', '100')} AS BIGINT) AS kept_bytes FROM documents WHERE text IS NOT NULL",
    "corpus_quality_gate": f"SELECT rule, actual, actual >= 0.6 AS ok FROM (SELECT coalesce(source, '(none)') AS rule, round(avg(CASE WHEN {_INK} = 0 THEN 0.0 ELSE {_LET} / {_INK} END), 6) AS actual FROM documents WHERE text IS NOT NULL GROUP BY 1)",
    "copy_overlap_9gram": f"""WITH a AS (SELECT ord, string_split({_NW.format(x='text')}, ' ') AS w FROM main_raw), b AS (SELECT item_id, string_split({_NW.format(x='text')}, ' ') AS w FROM eval_items),
        x AS (SELECT ord, unnest({_SH}) AS s FROM a), y AS (SELECT item_id, unnest({_SH}) AS s FROM b) SELECT ord, item_id, count(*) AS shared FROM x JOIN y USING (s) GROUP BY ord, item_id""",
    "code_documents": rf"""WITH s AS (SELECT ord, source, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS code FROM coder_raw WHERE text IS NOT NULL) SELECT ord, CAST(strlen(CASE WHEN starts_with(code, '<source>') THEN code ELSE
        '<source>' || lower(trim(coalesce(source, 'unknown'))) || '</source>' || chr(10) || '<instruction>Explain, complete, test, or improve the following code.</instruction>' || chr(10) || '<code>' || chr(10) || code || chr(10) || '</code>' END) AS BIGINT) AS n_bytes FROM s WHERE length(code) >= 80""",
    "raw_source_statistics": "SELECT source, count(*) AS n_rows, count(*) FILTER (body <> '') AS with_text, CAST(sum(strlen(body)) AS BIGINT) AS n_bytes FROM (SELECT source, coalesce(nullif(text, ''), nullif(content, ''), '') AS body FROM main_raw) GROUP BY source",
    "source_ordinals": "SELECT ord AS id, row_number() OVER (ORDER BY crawled_at, ord) - 1 AS place FROM main_raw WHERE crawled_at IS NOT NULL",
    "symbols_and_labels": r"SELECT p_partkey, s AS symbol, replace(s, '_', ' ') AS label FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand || ' ' || p_type, '^[ .?!]+|[ .?!]+$', '', 'g'), '[^\pL\pN_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)",
}
