import duckdb
import oracle
from pyspark.sql import functions as F

from loomline.functions import geometry as g
from loomline.operators import gates, generators, streams, trajectories
from loomline.plans import recordings
from loomline.streaming import runs, stateful


def test_parsing_rules(spark):
    cases = {
        "pyautogui.click(50, 100)": ("CLICK", [0.5, 1.0], None, ""), "pyautogui.click(x=1, y=2, clicks=2)": ("DOUBLE_CLICK", [0.01, 0.02], None, ""), "pyautogui.click(1, 2, button='right')": ("RIGHT_CLICK", [0.01, 0.02], None, ""),
        "pyautogui.moveTo(0, 0); pyautogui.dragTo(100, 50)": ("DRAG", [0.0, 0.0], [1.0, 0.5], ""), "pyautogui.dragTo(1, 1)": None, "pyautogui.moveTo(z, 0); pyautogui.dragTo(q, 50); pyautogui.press('a', 'b')": ("KEY", None, None, "a"),
        "pyautogui.hotkey('ctrl', 'c')": ("KEY", None, None, "ctrl+c"), "pyautogui.scroll(-3.7)": ("SCROLL", None, None, "0,-3"), "pyautogui.hscroll(2)": ("SCROLL", None, None, "2,0"), "pyautogui.scroll(clicks=4)": ("SCROLL", None, None, "0,4"), "pyautogui.write('')": None, "not python (": None, None: None, "print(1)": None,
        "pyautogui.write('it\\'s (1)\\n')": ("TYPE", None, None, "it's (1)\n"), "pyautogui.typewrite(message=\"a, b\")": ("TYPE", None, None, "a, b"), "pyautogui.keyDown('shift')": ("KEY_DOWN", None, None, "shift"), "pyautogui.moveTo(200, 0)": ("MOVE", [1.0, 0.0], None, ""), "import x\npyautogui.doubleClick(5, 5)": ("DOUBLE_CLICK", [0.05, 0.05], None, ""),
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    got = {r.k: r.a and (r.a.operation, r.a.coord, r.a.coord2, r.a.payload) for r in df.select("k", g.parsed_action(F.col("x"), F.lit(101.0), F.lit(101.0)).alias("a")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_runtime_actions_and_plans(spark):
    val = lambda c: spark.range(1).select(c).first()[0]
    none, at = F.lit(None).cast("array<double>"), lambda *v: F.array(*map(F.lit, v))
    run = lambda op, payload=None, c=none, d=none: val(g.runtime_action(F.lit(op), c, d, F.lit(payload)))
    assert run("KEY", "ctrl + c,").keys == ["ctrl", "c"] and run("TYPE", "  ").seconds == 0.15 and run("SCROLL", "3,-4").scroll_y == -4 and run("SCROLL", "-4").scroll_x == 0
    assert run("WAIT", "9 s").seconds == 5.0 and run("WAIT", "").seconds == 0.25 and run("ODD").type == "DONE" and run("DRAG", None, at(0.1, 0.2), at(0.3, 0.4)).x2 == 0.3 and run("CLICK", None, at(0.1)).y is None
    assert val(g.plan_operation(F.lit("Left_Click_Drag"))) == "DRAG" and val(g.plan_operation(F.lit("hover"))) is None and val(g.plan_operation(F.lit(None).cast("string"))) is None
    plan = lambda op, **k: val(g.plan_action(F.lit(op), k.get("c", none), k.get("s", none), F.lit(k.get("text", "")), F.lit(k.get("keys", "")), F.lit(k.get("x", 0)), F.lit(k.get("y", 0)), F.lit(k.get("to")), F.lit(k.get("sec")), F.lit(k.get("status"))))
    assert plan("CLICK", c=at(999.0, 0.0)).coord == [1.0, 0.0] and plan("CLICK", c=at(0.5, 0.25)).coord == [0.5, 0.25] and plan("CLICK") is None and plan("DRAG", c=at(0.1, 0.1)) is None
    assert plan("SCROLL", to="North").payload == "0,3" and plan("SCROLL", to="left", y=2).payload == "-3,2" and plan("WAIT").payload == "1" and plan("DONE").payload == "success" and plan("TYPE") is None


def test_geometry(spark):
    one = spark.range(1)
    box = lambda *v: F.array(*map(F.lit, v))
    val = lambda c: one.select(c).first()[0]
    assert val(g.norm_bbox(box(200.0, 50.0, 100.0, 150.0), F.lit(200.0), F.lit(100.0))) == [0.5, 0.5, 1.0, 1.0]
    assert val(g.norm_bbox(box(0.1, 0.2, 0.3, 0.4), F.lit(200.0), F.lit(100.0))) == [0.1, 0.2, 0.3, 0.4]
    assert val(g.norm_bbox(box(1.0, 2.0), F.lit(2.0), F.lit(1.0))) is None
    assert val(g.action_point(F.lit("pyautogui.click( 50, 25)"), F.lit(100.0), F.lit(100.0))) == [0.5, 0.25] and val(g.action_point(F.lit("tap 50, 25"), F.lit(100.0), F.lit(100.0))) is None
    assert val(g.pixel(F.lit(0.5), F.lit(2))) == 0 and val(g.pixel(F.lit(0.5), F.lit(4))) == 2
    assert val(g.patch_index(box(1.0, 1.0), 16)) == 255
    assert [val(g.classify_action(F.lit(x))) for x in ("double Click (1)", "dragTo(1)", "hotkey('a')", "click", "")] == ["CLICK", "DRAG", "KEY", "OTHER", "OTHER"]
    assert val(g.classify_action(F.lit("dragTo(1)"), drag=False)) == "MOVE"
    assert val(g.summarize_action(F.lit("TYPE"), box(0.5, 0.5), F.lit(None).cast("array<double>"), F.lit(" a\nb "))) == "TYPE:a b" and val(g.summarize_action(F.lit("DRAG"), box(0.5, 0.5), F.lit(None).cast("array<double>"), F.lit(""))) == "DRAG"
    assert val(g.summarize_action(F.lit("CLICK"), box(0.8765, 0.5), F.lit(None).cast("array<double>"), F.lit(""))) == "CLICK@%.3f,%.3f" % (0.8765, 0.5)
    assert val(g.summarize_action(F.lit("TYPE"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"), F.lit("x" * 70))) == "TYPE:" + "x" * 61 + "..."
    assert val(g.fit_side(F.lit(2560), F.lit(1000)))["height"] == 500


def test_trajectory_steps(spark):
    rows = [("t", "do", "d", 1.0, ["pyautogui.click(1, 1)", "nonsense(", "pyautogui.write('a')"], [(10, 10), (10, 10)], ["success"]), ("u", "do", "d", 0.0, ["pyautogui.click(1, 1)"], [(1, 1)], [])]
    df = spark.createDataFrame(rows, "task_id string, instruction string, domain string, score double, actions array<string>, screenshots array<struct<width:int,height:int>>, exe_statuses array<string>")
    assert [(r.task_id, r.pos, r.operation) for r in trajectories.prepare_steps(df).collect()] == [("t", 0, "CLICK")]
    boxes = spark.createDataFrame([(1, 100, 100, [[0.0, 0.0, 10.0, 10.0], [1.0, 2.0, 3.0]], ["ok"])], "id int, width int, height int, bbox array<array<double>>, text array<string>")
    assert [(r.name, r.box is None) for r in trajectories.explode_boxes(boxes, ["id"]).orderBy("pos").collect()] == [("ok", False), ("UI element", True)]
    flags = spark.createDataFrame([(None, None, None, None), (True, None, None, None), (None, None, None, False), (None, None, False, None)], "is_delete boolean, is_mock boolean, task_completed boolean, is_use boolean")
    assert trajectories.usable_steps(flags).count() == 1


def test_a_long_trajectory_has_each_status_once(spark):
    n = 30_000  # 14 GB with all statuses beside each step
    steps = F.sequence(F.lit(1), F.lit(n))
    df = spark.range(1).select(
        F.lit("t").alias("task_id"), F.lit("do").alias("instruction"), F.lit("d").alias("domain"), F.lit(1.0).alias("score"), F.transform(steps, lambda i: F.lit("pyautogui.click(1, 1)")).alias("actions"),
        F.transform(steps, lambda i: F.struct(F.lit(10).alias("width"), F.lit(10).alias("height"))).alias("screenshots"), F.slice(F.transform(steps, lambda i: F.when(i % 3 == 0, "failed").otherwise("Success")), 1, n - 6).alias("exe_statuses"),
    )
    got = trajectories.prepare_steps(df).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pos") % 3 == 2, 1)).alias("late")).first()
    assert (got.n, got.late) == (n * 2 // 3 + 2, 2)  # the last six have no status, two of which are third ones


def test_recordings_of_any_length_are_rows(spark, tmp_path):
    """Steps of episodes without a name all fall into one recording."""
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 9, F.lit("e")).otherwise("").alias("episode_id"), (F.col("id") * 7 % 15 + 1).cast("int").alias("step"), F.lit("task").alias("task"), F.lit("d").alias("domain"), F.lit("i").alias("image"),
        F.when(F.col("id") % 4 == 0, "nonsense(").when(F.col("id") % 4 == 1, "pyautogui.write('a')").otherwise("pyautogui.click(1, 1)").alias("action_source"),
    )
    rows.withColumn("row_id", F.col("row_id") + 1).write.parquet(str(tmp_path / "cu07_manifest.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW cu07_manifest AS SELECT * FROM '{tmp_path}/cu07_manifest.parquet/*.parquet'")
    for name in ("recorded_steps", "recording_counters"):
        ours = recordings.QUERIES[name](spark, str(tmp_path))
        assert oracle.rows(ours.toPandas()) == oracle.rows(db.execute(recordings.SQL[name]).df()), name


def test_gates(spark):
    got = gates.minimum_gates(spark.createDataFrame([("a", 5.0)], "rule string, actual double"), {"a": 3, "b": 1}).orderBy("rule").collect()
    assert [(r.rule, r.ok) for r in got] == [("a", True), ("b", False)]
    m = spark.createDataFrame([(8.0, float("nan"), None)], "loss double, acc double, hit double")
    assert sorted((r.rule, r.ok) for r in gates.metric_gates(m, {"loss": ("<", 8.5), "acc": (">=", 0.5), "hit": (">=", 0.1)}).collect()) == [("acc", False), ("hit", False), ("loss", True)]


def test_streams(spark):
    one = spark.range(1)
    assert one.select(streams.window_starts(F.lit(13), 3)).first()[0] == [0, 4, 8]
    assert one.select(streams.holdout_size(F.lit(1000), 4, 0.02)).first()[0] == 128
    assert one.select(streams.holdout_size(F.lit(383), 4, 0.02)).first()[0] is None
    a = b = 0
    for t in (5, 0, 65535, 7):
        a, b = (a * streams.M1 + t + 1) % streams.P1, (b * streams.M2 + t + 1) % streams.P2
    assert one.select(streams.fingerprint(F.array(*map(F.lit, (5, 0, 65535, 7))))).first()[0] == a * streams.P2 + b
    got = one.select(streams.shifted(F.array(*map(F.lit, range(8))), F.array(*map(F.lit, [0, 1, 0, 1, 1, 0, 0, 0])), F.lit(1), 3).alias("w")).first().w
    assert got.x == [1, 2, 3] and got.y == [-100, 3, 4]
    rows = spark.range(50).withColumn("k", F.col("id") % 3)
    assert sorted(r.draw for r in streams.epoch_order(rows, "id", 1, 0).collect()) == list(range(50))
    assert streams.balanced_draws(rows, "k", "id", 30, 5).count() == 30
    m = spark.range(2).select(generators.tool_loop(F.col("id")).alias("m")).collect()
    assert "14" in m[0].m[3].content and m[0].m[0].content.startswith("3 ile 11")


def test_streaming_equals_batch(spark, data):
    from loomline.plans import manifest

    batch = {r.row_id: (r.stall, r.guard) for r in manifest.stall(spark, data).collect()}
    assert {r.row_id: (r.stall, r.guard) for r in runs.stall(spark, data).collect()} == batch
    assert runs.dedup(spark, data).first().kept == manifest.table(spark, data, "main_raw").select(F.md5(F.col("text").cast("binary"))).distinct().count()


def test_folds_over_many_batches_equal_the_batch_operators(spark, data, tmp_path):
    from loomline.plans import manifest
    from loomline.session import table

    rows = manifest.stall_input(table(spark, data, "cu07_manifest"))[0].withColumn("episode_id", F.when(F.col("row_id") % 3 > 0, F.lit("long")).otherwise(F.col("episode_id"))).withColumn("step", F.col("row_id").cast("int"))
    rows = rows.withColumn("action", F.when(F.col("row_id") % 40 < 9, F.lit("same")).otherwise(F.col("action"))).withColumn("delta", F.lit(0.001))
    for part in range(4):  # four files, in order of the steps
        rows.where(F.floor((F.col("row_id") - 7_000_000) / 150) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batch = {r.row_id: r.history for r in trajectories.histories(rows, "episode_id", ["step", "row_id"]).collect()}
    found, state = stateful.fold_batches(read(), stateful.history_fold, f"{tmp_path}/h")
    assert {r.row_id: r.history for r in found.collect()} == batch and max(r["count"] for r in state.groupBy("__key").count().collect()) == 8
    want = {r.row_id: (r.stall, r.guard) for r in trajectories.stall_guard(rows, "episode_id", ["step", "row_id"], F.col("action"), F.col("delta")).collect()}
    assert {r.row_id: (r.stall, r.guard) for r in stateful.fold_batches(read(), stateful.guard_fold, f"{tmp_path}/g")[0].collect()} == want
    total = stateful.fold_batches(read(), stateful.count_fold(["operation"]), f"{tmp_path}/c")[1]
    assert {tuple(r) for r in total.collect()} == {tuple(r) for r in rows.groupBy("operation").count().collect()}


def test_fact_ingest_adds_only_new_facts(spark, tmp_path):
    src = f"{tmp_path}/in"
    ddl = "predicate string, args array<string>"
    for part in ([("P", ["a"]), ("P", ["a"])], [("P", ["a"]), ("P", ["b"])]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
        stateful.ingest_facts(spark.readStream.schema(ddl).parquet(src), f"{tmp_path}/store", f"{tmp_path}/state").awaitTermination()
    assert sorted(tuple(r.args) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [("a",), ("b",)]


def test_long_episodes_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(trajectories, "STRETCH", 16)
    rows = [(i, "e" if i % 4 else None, i, ["CLICK", "CLICK", "TYPE"][i % 50 // 20], None, None, str(i // 7), 0.001 if i % 11 else 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, episode_id string, step int, operation string, coord array<double>, coord2 array<double>, payload string, delta double")
    got = {r.row_id: r.history for r in trajectories.histories(df, "episode_id", ["step"]).collect()}
    last = {}
    for r in rows:
        key = r[1] or ""
        assert got[r[0]] == last.get(key, [])[-8:]
        last.setdefault(key, []).append(f"{r[3]}:{r[6]}")
    guard = {r.row_id: (r.stall, r.guard) for r in trajectories.stall_guard(df, "episode_id", ["step"], F.concat("operation", "payload"), F.col("delta")).collect()}
    state, want = {}, {}
    for r in rows:
        key, act = r[1] or "", r[3] + r[6]
        a, n, ended = state.get(key, (None, 0, False))
        if ended:
            continue
        n = n + 1 if a == act and r[7] < 0.008 else 0
        want[r[0]] = (n, "stalled_abort" if n >= 5 else "stalled_repeat" if n >= 3 else None)
        state[key] = (act, n, n >= 5)
    assert guard == want and any(g for _, g in want.values())
