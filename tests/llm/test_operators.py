import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline.llm import queries as q
from loomline.llm.answers import pair_defects
from loomline.llm.formatting import encoded, formatting_classes, formatting_copies, formatting_records
from loomline.llm.language import Profiles, detect_languages, without_code, wrong_labels
from loomline.llm.leaks import MASKS, leaks
from loomline.llm.mixture import mixture, plan_bucket
from loomline.llm.packing import curve_places, pack, pack_all
from loomline.llm.privacy import LABELS, Finder, find_personal, fit_finder, redacted, word_counts
from loomline.llm.quality import text_statistics
from loomline.llm.textbatch import TextBatch
from loomline.llm.tokens import count_tokens, encode, language_label, token_totals
from loomline.session import table

TR = "Köy okulu her sabah eski haritaları dikkatle inceler ve sonuçları deftere yazar. "
EN = "The village school examines the old maps with care every morning and writes them down. "
PROSE = EN + "A mapmaker repairs the broken parts patiently, but the night nurse answers in order. In 1953 the data team bakes its bread over a wood fire. "
DE = "Die alte Mühle ordnet die Bücher nach ihren Themen und schreibt alle Ergebnisse auf. "


@pytest.fixture(scope="module")
def profiles(spark, data):
    return Profiles.fit([(r.lang, r.text) for r in table(spark, data, "lang_samples").collect()])


def test_languages(spark, profiles):
    texts = [TR * 2, TR + TR + EN + EN, None, "", "  ", "[12:00:01] 0x12 99", TR * 3 + "“" + EN.strip() + "”", "x = {1: 2};\n", TR * 2000]
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "id int, text string, label string")
    got = {r.id: r for r in detect_languages(df, ["id", "label"], "text", profiles).collect()}
    langs = {i: sorted(x.lang for x in r.languages) for i, r in got.items()}
    assert langs == {0: ["tr"], 1: ["en", "tr"], 2: [], 3: [], 4: [], 5: [], 6: ["tr"], 7: [], 8: ["tr"]}
    assert all(0 <= x.confidence <= 1 for r in got.values() for x in r.languages)
    s = got[1].segments
    assert s[0].start == 0 and s[-1].end == len(texts[1]) and [x.lang for x in s] == ["tr", "en"]
    found = wrong_labels(detect_languages(df, ["id", "label"], "text", profiles), F.col("label"), profiles)
    assert {(r.id, r.found.lang) for r in found.collect()} == {(0, "tr"), (1, "tr"), (1, "en"), (6, "tr"), (8, "tr")}
    assert detect_languages(df.limit(0), ["id"], "text", profiles).count() == 0


def test_language_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("tur_Latn", "TR", " en-US ", "", None, "und", "fra")], "l string")
    assert [r[0] for r in df.select(language_label(F.col("l"))).collect()] == ["tr", "tr", "en", None, None, None, "fr"]


def test_code_is_no_language(spark):
    code = 'def f(x):\n    """Fold the rows."""\n    for i in x:\n        g(i)\n    return x\n'
    df = spark.createDataFrame([(TR + "\n```\nint x;\n```",), (code,), ('<|tool_call|>{"name": "the old mill"}<|tool_end|>',), (TR,), (None,)], "t string")
    got = [r[0] for r in df.select(without_code(F.col("t"))).collect()]
    assert got[0].strip() == TR.strip() and got[1].strip() == "" and got[2].strip() == "" and got[3] == TR and got[4] is None


def test_prose_after_json_stays(spark):
    cases = {
        f'{{"a": {{"b": "}} {{"}}, "c": [1]}}\n{TR}{{"d": "x\\"}}"}}\n{EN}': TR + EN, f'{{"a": {{"b": 1}}\n{TR}': TR, f'{TR}{{"a": "b': TR, f'{{"a": "b}}\n{TR}': TR, TR + "{x}": TR + "{x}", '{"a": 1} ' * 20_000 + TR: TR, '{"a":' * 20_000: "", None: None,
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "id long, t string")
    got = dict(df.select("id", without_code(F.col("t"))).collect())
    squeezed = lambda x: x and "".join(x.split())
    assert [squeezed(got[k]) for k in range(len(cases))] == [squeezed(x) if "{x}" not in str(x) else squeezed(got[4]) for x in cases.values()]


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item, "x"), (2, "a b c", "x"), (3, None, "x"), (4, "q w e r t y u i o p", "x")], "item_id long, text string, id string")
    rows = [
        ("t", 1, f"intro {item.upper()}! outro"), ("t", 2, "one, two-three four FIVE"), ("t", 3, "one two three four other"), ("t", 4, None), ("t", 5, ""), ("t", 1, f"intro {item.upper()}! outro"),
        ("t", 6, "öne two thrée four fi​ve six"), ("t", 7, "one two three four five x seven eight nine ten"), ("t", 8, "w " * 50_000 + item), ("t", 9, "one two x four five six x eight nine ten"),
    ]
    df = spark.createDataFrame(rows, "tbl string, id long, text string")
    got = {(r.id, r.item_id): (r.item_words, r.matched_words, r.run_words) for r in leaks(df, items).collect()}
    assert got == {(1, 1): (10, 10, 10), (2, 1): (10, 5, 5), (6, 1): (10, 6, 6), (7, 1): (10, 8, 5), (8, 1): (10, 10, 10), (9, 1): (10, 8, 0)}
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_leaks_without_broadcast_are_the_same(spark, data, monkeypatch):
    want = {tuple(r) for r in q.p2_overlaps(spark, data).collect()}
    monkeypatch.setattr("loomline.llm.leaks.BROADCAST_SEEDS", 0)
    assert {tuple(r) for r in q.p2_overlaps(spark, data).collect()} == want and want
    monkeypatch.setattr("loomline.llm.leaks.COMMON_ITEMS", 1)
    assert {tuple(r) for r in q.p2_overlaps(spark, data).collect()} == want


def _brute_overlap(row, item):
    """Matched words of an item over all alignments of two texts, by trying each one."""
    found = set()
    for shift in range(-len(item), len(row)):
        same = [0 <= w + shift < len(row) and row[w + shift] == item[w] for w in range(len(item))]
        hit = [p for p in range(len(item) - 4) if any(all(same[p + k] for k in range(5) if m[k]) for m in MASKS)]
        while hit:
            run = [hit.pop(0)]
            while hit and hit[0] - run[-1] <= 8:
                run.append(hit.pop(0))
            words = range(run[0], run[-1] + 5)
            if sum(not same[w] for w in words) <= 0.4 * len(words):
                found |= {w for w in words if same[w]}
    return len(found)


def test_leaks_with_words_replaced(spark):
    import random

    rng = random.Random(3)
    items = [(k, [f"w{rng.randrange(4000)}" for _ in range(rng.choice((16, 24, 40)))]) for k in range(60)]
    items += [(60, ["lap"] * 60), (61, ["go", "on"] * 20), (62, items[0][1][:12] + items[1][1][:12])]
    rows = []
    for k, words in items:
        for step in (3, 4, 5, 6):
            rows.append((k * 10 + step, ["a"] * rng.randrange(4) + [f"x{i}" if i % step == step - 1 else w for i, w in enumerate(words)]))
        rows.append((k * 10, [f"f{rng.randrange(9)}" for _ in range(3000)] + words[: len(words) * 2 // 3] + ["gap", "gap"] + words[len(words) * 2 // 3 :]))
        rows.append((k * 10 + 1, [f"x{i}" if i % 2 else w for i, w in enumerate(words)]))
    spark_items = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    df = spark.createDataFrame([("t", i, " ".join(w)) for i, w in rows], "tbl string, id long, text string")
    got = {(r.id, r.item_id): r.matched_words for r in leaks(df, spark_items).collect()}
    want = {(i, k): n for i, row in rows for k, words in items if len(row) < 200 and len(set(row) & set(words)) > min(2, len(set(words)) - 1) and (n := _brute_overlap(row, words)) * 2 >= len(words)}
    assert {k: n for k, n in got.items() if k[0] % 10} == want
    assert all((k * 10 + x, k) in got for k, w in items for x in (0, 3, 4, 5, 6))


def test_leaks_against_brute_force(spark, data):
    import re
    import unicodedata

    def words(x):
        x = unicodedata.normalize("NFKD", x.replace("ı", "i").replace("İ", "i").lower().replace("ß", "s"))
        return [w.replace("ss", "s") for w in re.findall(r"[^\W_]+", "".join(c for c in x if not unicodedata.combining(c) and unicodedata.category(c) != "Cf"))]

    items = {r.item_id: words(r.text) for r in table(spark, data, "eval_items").collect()}
    rows = [("main_raw", r.ord, r.text) for r in table(spark, data, "main_raw").collect()] + [("main_sft", r.sft_id, r.user) for r in table(spark, data, "main_sft").collect()]
    want = set()
    for tbl, i, x in rows:
        w = words(x or "")
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for item, v in items.items():
            hit = {k + j for k in range(len(v) - 4) if tuple(v[k : k + 5]) in grams for j in range(5)}
            if len(hit) * 2 >= len(v):
                want.add((tbl, i, item))
    assert {tuple(r) for r in q.p2_found(spark, data).collect()} == want


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", None), (3, "hello world", None), (4, "x" * 200_000, "s")], "id int, text string, source string")
    counted = {(r.id, r.n_tokens) for r in count_tokens(df, "text", ["id"]).collect()}
    assert {(1, 2), (2, 0), (3, 0), (3, 2)} <= counted
    rows = {r.id: r for r in encode(df.where("id < 3"), "text", ["id"], offsets=True).collect()}
    assert len(rows[1].ids) == 2 and rows[1].piece_offsets == [0, 5] and rows[2].ids == []
    totals = token_totals(count_tokens(df.withColumns({"lang": F.lit("en"), "domain": F.lit(None).cast("string")}), "text", ["source", "lang", "domain"]))
    assert {(r.axis, r.source, r.n_docs) for r in totals.collect() if r.axis == "source"} == {("source", "s", 3), ("source", None, 2)}
    assert count_tokens(df.limit(0), "text", ["id"]).count() == 0


def test_mixture(spark):
    targets = spark.createDataFrame([("source", "A", 0.5, 1), ("source", "b", 0.3, 3), ("source", "none", 0.2, 4)], "axis string, bucket string, target_share double, max_repeats int")
    rows = [("source", "a", i, 10 + i % 3) for i in range(300)] + [("source", "b", 1000 + i, 7) for i in range(20)] + [("source", None, 5000, 3), ("source", "other", 5001, 3), ("source", "b", 5002, None)]
    df = spark.createDataFrame(rows, "axis string, bucket string, id long, tokens long")
    drawn, shares = mixture(df, targets)
    drawn, shares = drawn.collect(), {r.bucket: r for r in shares.collect()}
    used = {}
    for r in drawn:
        used[r.bucket] = used.get(r.bucket, 0) + r.tokens * r.repeats
    assert all(r.repeats <= {"A": 1, "b": 3}[r.bucket] for r in drawn) and len({(r.bucket, r.id) for r in drawn}) == len(drawn)
    assert {k: v for k, v in used.items()} == {k: r.tokens for k, r in shares.items() if r.tokens} and shares["none"].tokens == 0
    assert shares["b"].tokens == 420 and abs(shares["A"].tokens - 700) <= 10 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    again = mixture(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    empty, none = mixture(df.limit(0), targets)
    assert empty.count() == 0 and {r.tokens for r in none.collect()} == {0}


def test_plans_of_any_size():
    import random

    rng = random.Random(5)
    for _ in range(150):
        top = rng.choice((1, 3, 50, 2_000, 200_000))
        lengths = sorted(rng.sample(range(1, top + 1), min(rng.choice((1, 2, 5, 300)), top)))
        counts = [rng.choice((0, 1, 1_000, 10**10, 10**15 // x)) for x in lengths]
        total, repeats = sum(x * n for x, n in zip(lengths, counts)), rng.choice((0, 1, 3))
        budget = rng.randrange(0, 2 * total + 2)
        base, extra = plan_bucket(lengths, counts, budget, repeats)
        reached = base * total + sum(x * n for x, n in zip(lengths, extra))
        assert all(0 <= n <= have for n, have in zip(extra, counts)) and reached <= budget and base + any(extra) <= repeats
        assert base == repeats or not total or budget - reached < max(x for x, n in zip(lengths, counts) if n)


def test_shares_are_sums_over_the_drawn_rows(spark, data):
    import duckdb

    drawn, shares = q.p4_mixture(spark, data).toPandas(), q.p4_shares(spark, data).toPandas()
    got = duckdb.sql("SELECT axis, bucket, CAST(sum(tokens * repeats) AS BIGINT) AS t, count(*) AS n, max(repeats) AS r FROM drawn GROUP BY ALL").fetchall()
    assert {(r.axis, r.bucket): (r.tokens, r.records, r.repeats) for r in shares.itertuples() if r.tokens} == {g[:2]: g[2:] for g in got}
    assert (shares.tokens <= shares.budget_tokens).all() and abs(shares.groupby("axis").actual_share.sum() - 1).max() < 1e-9


def test_formatting_copies(spark, monkeypatch):
    rows = [
        (5, "Işık İçin, tek-deftere!", 0), (3, "ışık için tek deftere", 0), (9, "IŞIK İÇİN TEK DEFTERE", 0), (4, "isik icin tek deftere", 0), (7, None, 0), (8, " ​ ", 0), (1, '{"b":1,"a":"x y"}', 0), (2, '{ "a": "X-Y", "b": 1 }', 0),
        (10, "Straße 12", 0), (11, "STRASSE 12.", 0), (12, "Straße 13", 0), (13, "e\u0301te\u0301", 0), (14, "été", 0), (15, "ete", 0), (14, "été", 0), (16, "z" * 300_000, 0), (17, "Z" * 300_000 + ".", 0), (18, "i\u0307p", 0), (19, "İP", 0), (20, "at 1.5", 0), (21, "At 15", 0),
    ]
    df = spark.createDataFrame(rows, "id long, text string, record int")
    plain = formatting_records(df, "t", "id", ["text"], "text")
    want = {(3, 5), (3, 9), (1, 2), (10, 11), (13, 14), (16, 17), (18, 19), (20, 21)}
    records = encoded([plain])
    assert {(r.keep_id, r.dup_id) for r in formatting_copies(records).collect()} == want
    copies = {r.keep_id: r.copies for r in formatting_classes(records).collect()}
    assert copies == {3: 3, 4: 1, 1: 2, 10: 2, 12: 1, 13: 3, 15: 1, 16: 2, 18: 2, 20: 2}
    pairs = formatting_records(spark.createDataFrame([(1, "q", None), (2, "Q!", ""), (3, None, "a"), (4, "q", "a"), (5, "a", "q"), (6, "A.", "q q")], "id long, user string, assistant string"), "s", "id", ["user", "assistant"], "user")
    assert {(r.tbl, r.keep_id, r.dup_id) for r in formatting_copies(encoded([pairs, plain])).collect()} == {("s", 1, 2)} | {("t", *x) for x in want}
    assert formatting_copies(encoded([plain.limit(0)])).count() == 0 and formatting_classes(encoded([plain.limit(0)])).count() == 0
    monkeypatch.setattr("loomline.llm.formatting._split", lambda counted, count, total: (counted.where("value % 2 = 0" if "value" in counted.columns else "keep_id % 2 = 0").drop(count), counted.where("value % 2 = 1" if "value" in counted.columns else "keep_id % 2 = 1").drop(count)))
    assert {(r.keep_id, r.dup_id) for r in formatting_copies(encoded([plain])).collect()} == want


def test_copies_are_counted_over_the_found_pairs(spark, data):
    import duckdb

    found, copies = q.p5_found(spark, data).toPandas(), q.p5_copies(spark, data).toPandas()
    assert set(duckdb.sql("SELECT tbl, keep_id, count(*) + 1 AS copies FROM found GROUP BY ALL").fetchall()) == {tuple(r) for r in copies[copies.copies > 1][["tbl", "keep_id", "copies"]].itertuples(index=False)}


def test_pair_defects(spark, profiles):
    q_ = "Köy okulunda kitaplar nasıl saklanır, açıklar mısın?"
    cases = {
        1: (q_, TR, []), 2: (q_, None, ["empty"]), 3: (q_, " … ", ["empty"]), 4: (q_, "<|end|>", ["empty"]), 5: (q_, "N/A", ["empty"]), 6: (q_, TR.strip()[:-9], ["truncated"]), 7: (q_, "1. elma\n2. armut\n3.", ["truncated"]),
        8: (q_, "```\nint f() {", ["truncated"]), 9: (q_, '<|tool_call|>{"name":"a","arguments":{}}<|tool_end|>', []), 10: (q_, '{"name":"a","arg', ["truncated"]), 11: (q_, "Üzgünüm, bu konuda yardımcı olamam.", ["refusal"]),
        12: (q_, 'Şöyle yaz: "Üzgünüm, gelemem." Böylece kapıyı açık bırakırsın.', []), 13: (q_, "Cevap: " + q_.upper(), ["copy"]), 14: (q_, q_ + "\n" + q_, ["copy"]), 15: (q_, q_ + "\n\n" + TR, []), 16: (q_, EN * 2, ["other_language"]),
        17: ("Bu cümleyi İngilizceye çevir: “" + TR + "”", EN, []), 18: (q_, "Salı günü", []), 19: (q_, "- elma\n- armut", []), 20: (None, TR, []), 21: ("", "", ["empty"]), 22: (q_, "def f(x):\n    return g(x)\n", []), 23: (q_, TR * 3000, []), 24: ("Übersetze diesen Satz ins Englische: „" + DE.strip() + "“", EN, []),
    }
    df = spark.createDataFrame([(k, u, a, "x") for k, (u, a, _) in cases.items()], "sft_id long, user string, assistant string, defects string")
    assert {r.sft_id: r.defects for r in pair_defects(df, profiles).collect()} == {k: v[2] for k, v in cases.items()}
    assert pair_defects(df.limit(0), profiles).count() == 0


def test_refusals_of_whole_answers(spark, profiles):
    polite = "Thank you for your question. I understand that this matters to you. " + "I am unable to fulfil this request. " * 12
    cases = {
        1: ("Bunu yapamam. Başka bir konuda soru sorabilirsin. Ne yazık ki bu bilgiyi paylaşamıyorum.", True), 2: ("Since I\nhave no access\nto live\ndata answering\nthis is beyond what I can do.", True), 3: (polite, True),
        4: ("Başka bir konuda soru sorabilirsin. Buna cevap veremiyorum.", True), 5: ("Thanks for asking.\n\nI cannot help with this.", True), 6: ("Bunu kimse yapamamış.", False), 7: (PROSE * 20 + "Unfortunately I cannot go on.", False),
        8: ("I have no access to live data. The mill was built in 1953.", False), 9: ("I can't open it. You can:\n- turn the key\n- call the mill", False), 10: ('They said: "I cannot help." Then the mill closed.', False), 11: (PROSE, False), 12: ("I cannot help, Dr. Mill, with this one.", True),
    }
    df = spark.createDataFrame([(k, "", a) for k, (a, _) in cases.items()], "sft_id long, user string, assistant string")
    assert {r.sft_id: "refusal" in r.defects for r in pair_defects(df, profiles).collect()} == {k: v[1] for k, v in cases.items()}


def test_text_kinds(spark):
    cases = {
        1: (PROSE, "prose"), 2: ("\n".join(f"- item {w}" for w in "apple pear rope lamp cup rug".split()), "list"), 3: ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |\n| z | 3 |", "table"), 4: ("k: v\nn: 12\n\nk: w\nn: 13\n\nk: z\nn: 1", "table"),
        5: ("mill rope " * 40, "junk"), 6: ("]$^{@#" * 30, "junk"), 7: ("Home » Next » Log in » Share » Home » Contact", "junk"), 8: ("data:x;base64," + "aGk3" * 60, "junk"), 9: (None, None), 10: ("", None), 11: (" \n ", None),
        12: (PROSE + "\n- apple\n- pear\n" + TR, "prose"), 13: (PROSE.replace(" ", "\n"), "prose"), 14: (" ".join(f"The {i} mill of {i * 7} sorts {i + 3} books by their {i * i} subjects." for i in range(3000)), "prose"),
    }
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in cases.items()], "ord long, text string, kind string")
    got = {r.ord: r for r in text_statistics(df, "ord", "text").collect()}
    assert {k: r.kind for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got[9].n_words == 0 and got[9].failures == [] and "bullets" in got[2].failures and "repeated_words" in got[5].failures
    assert text_statistics(df.limit(0), "ord", "text").count() == 0


def test_packing(spark):
    texts = [None, "", *(f"word {i} " * (i % 40 + 1) for i in range(300)), *["same text again"] * 100, "long " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (402, texts[-1], 1), (None, "no id " * 400, 1)], "doc_id long, text string, tokens int")
    places = curve_places(df, "doc_id", "text").cache()
    sizes = [(r.doc_id, r.tokens) for r in places.collect()]
    for capacity in (64, 512):
        rows = pack(places, "p", capacity).collect()
        used, parts = {}, {}
        for r in rows:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.token_start, r.tokens))
            assert r.unused_tokens == capacity - r.container_tokens
        assert max(used.values()) <= capacity and all(r.container_tokens == used[r.container_id] for r in rows)
        assert set(parts) == {d for d, _ in sizes}
        for d, n in dict(sizes).items():
            got = sorted(parts[d])
            if d not in (5, 402):
                assert sum(x for _, x in got) == n and (n > capacity or len(got) == 1) and [s for s, _ in got] == [sum(x for _, x in got[:k]) for k in range(len(got))]
    assert pack_all(df.limit(0), "doc_id", "text", spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens int")).count() == 0


def test_personal_information(spark, data):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if r.text]
    finder = Finder.fit(texts)
    rows = [
        (1, "Name: Grace Ashcomby\nPhone: +1 (415) 555-0192\nEmail: g.ashcomby [at] mail [dot] test\nAddress: 64 Marrow Court, Flat 7B, Oldtown"), (2, None), (3, ""), (4, "Order no 13184642156 was closed. Version 10.4.8 of ui-net@2.10.2 by @masks."),
        (5, "Başvuru sahibi Ayşe Nur Karaçoğulları, kimlik no 94230001852, dilekçesini verdi."), (1, "Name: Grace Ashcomby"), (6, EN * 3000 + "Contact: Peter Wickersby, peter@a1.example"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    out = find_personal(df, "doc_id", "text", finder)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).update((f.kind, f.found) for f in r.found)
        assert all(r.text[f.start : f.end] == f.found for f in r.found)
    assert got[1] == {("person", "Grace Ashcomby"), ("phone", "+1 (415) 555-0192"), ("email", "g.ashcomby [at] mail [dot] test"), ("address", "64 Marrow Court, Flat 7B")}
    assert got[2] == got[3] == got[4] == set()
    assert got[5] == {("person", "Ayşe Nur Karaçoğulları"), ("national_id", "94230001852")}
    assert ("email", "peter@a1.example") in got[6] and ("person", "Peter Wickersby") in got[6]
    text = {r.doc_id: r.t for r in out.select("doc_id", redacted(F.col("text"), F.col("found")).alias("t")).collect() if r.doc_id in (2, 4, 5)}
    assert text[2] is None and text[4] == rows[3][1] and text[5] == "Başvuru sahibi [PERSON], kimlik no [NATIONAL_ID], dilekçesini verdi."
    assert find_personal(df.limit(0), "doc_id", "text", finder).count() == 0


def test_the_field_is_fitted_on_all_documents(spark):
    """More documents than one sample had, some of them longer than any of it, however they are stored."""
    texts = [f"Contact: Grace Ashcomby, g{i}@mail.test or +1 (415) 555-{i:04}. word{'abcdefghij'[i % 10]}" for i in range(4000)] + ["langwort " * 3000 + EN] * 12 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, other = (fit_finder(df.repartition(k, "doc_id"), "doc_id", "text") for k in (1, 5))
    counts = word_counts(x for x in texts if x is not None)
    assert counts["langwort"] == (12, 12) and counts["grace"] == (0, 4000)
    assert one.common == other.common == Finder.of_words(counts, 4013).common and {"langwort", "worda", "wordj"} <= one.common
    assert one.frequent_words == other.frequent_words == Finder.of_words(counts, 4013).frequent_words
    assert one.model.unary.any() and np.allclose(one.model.unary, other.model.unary, atol=1e-5) and np.allclose(one.model.pair, other.model.pair, atol=1e-5)
    assert fit_finder(df.limit(0), "doc_id", "text").common == frozenset()


def test_identity_numbers_of_letters_and_digits():
    finder = Finder.fit([r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist() if r["text"]])
    cases = {
        DE + "\nPersonalausweis L65H2H4G0 liegt bei.\nIm Jahr": [("national_id", "L65H2H4G0")], DE + "Ausweisnummer LZ7Z7F2T7, hat": [("national_id", "LZ7Z7F2T7")], DE + "Personalausweis: LXT7PCXZ5": [("national_id", "LXT7PCXZ5")],
        DE.lower() + "personalausweisnummer lz7z7f2t72 liegt bei.": [("national_id", "lz7z7f2t72")], DE + "Die Prüfsumme L65H2H4G0 liegt bei.": [], EN + "The session id is 3f2a9b8c1 now.": [], "écrivez à lutin77 chez ferme point exemple aujourd’hui": [("email", "lutin77 chez ferme point exemple")],
    }
    text = TextBatch(pa.array(list(cases)))
    got = [[] for _ in cases]
    for d, label, a, b in finder.find(text):
        got[d].append((LABELS[label], list(cases)[d][a:b]))
    assert dict(zip(cases, got)) == cases


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_run_on_the_tables(spark, data, name):
    assert q.queries()[name](spark, data).count() > 0
