import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.operators import corpus as c
from loomline.plans import corpus as plans
from loomline.sources import readers


def table(spark, texts, source="s"):
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(texts)], "source string, ord long, text string")


def sequential_fill(texts, target, least, seen):
    out, total = [], 0
    for i, x in enumerate(texts):
        if len(x) < least or x in seen:
            continue
        seen.add(x)
        body = x.encode()[: max(0, target - total - 1)].decode("utf-8", "ignore") if len(x.encode()) + 1 > target - total else x
        out.append((i, len(body.encode()) + 1))
        total += len(body.encode()) + 1
        if total >= target - 4:
            break
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["a" * 5, "é" * 7, "b" * 20, "🙂" * 6, "cc", "d" * 11]), max_size=30), st.integers(20, 200))
def test_fill_budget_is_the_sequential_loop(spark, texts, target):
    got = c.fill_budget(table(spark, texts), ["source"], "ord", "text", target, min_chars=3).select("ord", "written_bytes").orderBy("ord").collect()
    assert [tuple(r) for r in got] == sequential_fill(texts, target, 3, set())


def test_fill_mix_sees_only_what_was_scanned(spark):
    one = ["aaaaa", "bbbbb", "ccccc", "ddddd"]
    two = ["ccccc", "aaaaa", "eeeee"]
    got = c.fill_mix([("x", table(spark, one).drop("source"), 12), ("y", table(spark, two).drop("source"), 100)], "ord", "text", min_chars=1)
    assert sorted((r.source_name, r.ord) for r in got.collect()) == [("x", 0), ("x", 1), ("y", 0), ("y", 2)]


def test_stop_before_overflow(spark):
    rows = table(spark, ["a" * 10, "b" * 10, "c" * 10])
    got = c.fill_budget(rows, ["source"], "ord", "text", 25, min_chars=1, dedup_prefix=0, separator_bytes=0, cut_mode="stop")
    assert sorted(r.ord for r in got.collect()) == [0, 1]


def test_payloads_and_cuts_at_bytes(spark):
    rows = table(spark, ["éé", "ab", None, "çç"])
    out = c.fill_budget(rows, ["source"], "ord", "text", 10, min_chars=1, dedup_prefix=0, slack=0)
    assert [(r.ord, r.payload) for r in c.payloads(out, rows, ["source"], "ord", "text").orderBy("ord").collect()] == [(0, "éé"), (1, "ab"), (3, "")]
    raw = c.fill_budget(rows, ["source"], "ord", "text", 10, min_chars=1, dedup_prefix=0, slack=0, cut_mode="bytes")
    assert [r.written_bytes for r in raw.orderBy("ord").collect()] == [5, 3, 2]
    assert c.fill_budget(rows.limit(0), ["source"], "ord", "text", 0.5).count() == 0


def test_prefix_sum_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else "cold", i, i % 5) for i in range(500)], "k string, o int, v long")
    got = {(r.k, r.o): r.p for r in c.prefix_sum(rows, ["k"], ["o"], F.col("v"), "p").collect()}
    total = {}
    for i in range(500):
        k = "hot" if i % 3 else "cold"
        assert got[(k, i)] == total.get(k, 0)
        total[k] = total.get(k, 0) + i % 5


def test_skip_tail_is_first_fit(spark):
    random.seed(4)
    for target in (100, 333, 1000):
        sizes = [random.randint(1, 60) for _ in range(80)]
        total, want = 0, []
        for i, n in enumerate(sizes):
            if total < 0.98 * target or total + n <= target:
                want.append(i)
                total += n
            if total >= target:
                break
        rows = spark.createDataFrame(list(enumerate(sizes)), "ord long, n long")
        assert sorted(r.ord for r in c.fill_skip_tail(rows, "ord", "n", target).collect()) == want


def test_first_wins_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "o int, d string")
    assert sorted(r.o for r in c.first_wins(rows, "d", ["o"]).collect()) == [1, 3, 4, 5]
    assert c.first_wins(rows.limit(0), "d", ["o"]).count() == 0


def test_caps_quota_shards(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, o int")
    assert c.row_caps(rows, ["k"], ["o"], F.lit(2)).count() == 3
    assert c.quota_and_cap(rows, "k", ["o"], 4).count() == 3
    assert [r.shard for r in c.shards(rows, ["o"], 4, "x").orderBy("o").collect()] == ["x_000"] * 4 + ["x_001"] * 2


def test_readers(spark, tmp_path):
    lines = ['{"subject":"Ali","predicate":"knows","object":"Ayşe"}', "düz metin", "", '{"broken', '{"s_label":"a","r_label":"b","e_label":"c"}']
    got = readers.knowledge_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.kind for r in got.collect()) == ["rejected", "text", "triple", "triple"]
    rows = readers.renamed(spark.createDataFrame([("Sor", "", "Ver")], " talimat  string, input string, answer string".replace("  ", " ")), readers.ALPACA)
    assert rows.first().asDict() == {"instruction": "Sor", "input": "", "output": "Ver"}
    ids = spark.createDataFrame([(1, [0, 65535]), (2, [])], "doc int, ids array<int>")
    readers.export_tokens(ids, "ids", f"{tmp_path}/t")
    assert sorted((r.doc, list(r.ids)) for r in readers.import_tokens(spark, f"{tmp_path}/t").collect()) == [(1, [0, 65535]), (2, [])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("x\ny\n")
    (tmp_path / "d/b.txt").write_text("z\n")
    assert readers.text_folder(spark, f"{tmp_path}/d", 1).count() == 2
    facts = spark.createDataFrame([("P", ["b"]), ("P", ["a"])], "predicate string, args array<string>")
    readers.write_facts(facts, f"{tmp_path}/f")
    assert readers.read_facts(spark, f"{tmp_path}/f").count() == 2
    assert readers.probe(lambda: spark.read.parquet(f"{tmp_path}/none"), "x")["ok"] is False
    assert readers.shortest(spark.createDataFrame([("a", None), ("b", 2.0)], "n string, t double"), "t").first().n == "b"
    assert readers.stage("s", lambda: 1 / 0, required=False)["ok"] is False


def test_code_fill_takes_each_code_once(spark, tmp_path):
    codes = [f"def f{i}():\n" + f"    return {i}\n" * 20 for i in range(10)]
    texts = [x for y in codes for x in (y, f"  {y}\n")] + [codes[0]] * 30 + ["a" * 9000 + "b", "a" * 9000 + "c", None, "short"]
    spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts)], "ord long, source string, text string").write.parquet(str(tmp_path / "coder_raw.parquet"))
    size = {r.ord: r.n_bytes for r in plans.code_documents(spark, str(tmp_path)).collect()}
    firsts = [*range(0, 20, 2), 50, 51]
    target, total, want = int(sum(size[k] for k in firsts) * 0.6), 0, []
    for k in firsts:
        if total < target and (total < target * 0.98 or total + size[k] <= target):
            want.append(k)
            total += size[k]
    assert len(size) == 52 and sorted(r.ord for r in plans.code_fill(spark, str(tmp_path)).collect()) == want
