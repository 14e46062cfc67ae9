"""Trajectory queries over the action manifest and geometry over the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import geometry as g
from loomline.operators import gates, trajectories
from loomline.operators.corpus import shards as shard_rows
from loomline.session import table
from loomline.streaming import runs

OP = "coalesce(nullif(upper(trim(operation)), ''), 'OTHER')"
MINIMUMS = {"CLICK": 1000, "KEY": 500, "TYPE": 1000, "SCROLL": 400, "DRAG": 100, "RIGHT_CLICK": 100, "DOUBLE_CLICK": 100, "DONE": 50, "ZOOM": 1}
#: Sources in order of preference, and parts of the rows by operation.
PREFERRED = ("uigrain/tasks", "no/such", "deskgrid/os-traces")
ALLOCATION = {"CLICK": 0.58, "TYPE": 0.16, "KEY": 0.10, "SCROLL": 0.08, "DRAG": 0.08}
CAPS = {"CLICK": 100, "TYPE": 80, "KEY": 60}


def steps(spark, d):
    return table(spark, d, "cu07_manifest")


def statistics(spark, d):
    return trajectories.manifest_statistics(steps(spark, d))


def histories(spark, d):
    rows = trajectories.histories(steps(spark, d), "episode_id", ["step", "row_id"])
    return rows.select("row_id", F.size("history").cast("long").alias("n"), F.array_join("history", "|").alias("history"))


def caps(spark, d):
    rows = trajectories.valid_labels(steps(spark, d)).where("error is null").select("op", "row_id")
    return trajectories.operation_caps(rows, ["row_id"], CAPS, 40)


def labels(spark, d):
    rows = trajectories.valid_labels(steps(spark, d))
    c = lambda k: F.count(F.when(F.col(k), 1)).alias(k)
    return rows.groupBy("op", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"), c("coord_valid"), c("coord2_valid"), c("payload_valid"))


def holdout(spark, d):
    key = trajectories.holdout_key(*map(F.col, ("episode_id", "task", "archive", "image")))
    return steps(spark, d).groupBy(trajectories.group_holdout(key).alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("groups"))


def minimum_gate(spark, d):
    counts = steps(spark, d).groupBy(g.operation_name(F.col("operation")).alias("rule")).agg(F.count(F.lit(1)).alias("actual"))
    return gates.minimum_gates(counts, MINIMUMS)


def stall(spark, d):
    return trajectories.stall_guard(*stall_input(steps(spark, d))).select("row_id", F.col("stall").cast("long").alias("stall"), "guard")


def stall_input(rows):
    rows = rows.where("episode_id is not null").withColumn("action", F.concat_ws(":", g.operation_name(F.col("operation")), F.coalesce("payload", F.lit(""))))
    x = F.coalesce(F.try_element_at("coord", F.lit(1)), F.lit(0.0))
    rows = rows.withColumn("delta", F.abs(x - F.lit(0.5)) / 50)
    return rows, "episode_id", ["step", "row_id"], F.col("action"), F.col("delta")


def deliveries(spark, d):
    rows = trajectories.latest_delivery(steps(spark, d), ["episode_id", "step", "image"], "arrived_at", "row_id")
    return rows.groupBy(g.operation_name(F.col("operation")).alias("op")).agg(F.count(F.lit(1)).alias("n"))


def parsed(spark, d):
    """Every row's action as the recorded code has it; points in millionths of the screen."""
    rows = steps(spark, d).where("action_source is not null").select("row_id", g.parsed_action(F.col("action_source"), F.lit(1920.0), F.lit(1080.0)).alias("a"))
    micro = lambda c, i: F.round(F.try_element_at(F.col(f"a.{c}"), F.lit(i)) * 1e6).cast("long")
    return rows.select("row_id", "a.operation", micro("coord", 1).alias("x"), micro("coord", 2).alias("y"), micro("coord2", 1).alias("x2"), micro("coord2", 2).alias("y2"), "a.payload")


def classified(spark, d):
    x = F.col("action_source")
    return steps(spark, d).where("action_source is not null").groupBy(g.classify_action(x).alias("op"), g.classify_action(x, drag=False).alias("older")).agg(F.count(F.lit(1)).alias("n"))


def action_points(spark, d):
    """Point of the first click or move in the recorded code."""
    rows = steps(spark, d).where("action_source is not null").select("row_id", g.action_point(F.col("action_source"), F.lit(1920.0), F.lit(1080.0)).alias("p"))
    return rows.where("p is not null").select("row_id", F.round(F.col("p")[0] * 1e6).cast("long").alias("x"), F.round(F.col("p")[1] * 1e6).cast("long").alias("y"))


def runtime(spark, d):
    """What every row runs as."""
    a = g.runtime_action(g.operation_name(F.col("operation")), F.col("coord"), F.col("coord2"), F.col("payload"))
    rows = steps(spark, d).select("row_id", a.alias("a"))
    return rows.select("row_id", "a.type", F.col("a.x").isNotNull().alias("pointed"), F.col("a.x2").isNotNull().alias("dragged"), "a.text", F.array_join("a.keys", "|").alias("keys"), "a.scroll_x", "a.scroll_y", F.round("a.seconds", 6).alias("seconds"))


def plans(spark, d):
    """Rows written as plans (points in thousandths, scrolls by direction) and read again."""
    op = g.operation_name(F.col("operation"))
    name = F.element_at(F.map_from_arrays(F.array(*map(F.lit, g.PLAN_OPERATIONS.values())), F.array(*map(F.lit, g.PLAN_OPERATIONS))), op)
    thousandths = lambda c: F.transform(c, lambda v: v * 999)
    drag = op == "DRAG"
    way = F.when(F.col("payload").contains("-"), "down").otherwise("up")
    a = g.plan_action(g.plan_operation(name), thousandths(F.when(drag, F.col("coord2")).otherwise(F.col("coord"))), thousandths(F.col("coord")), F.coalesce("payload", F.lit("")), F.coalesce("payload", F.lit("")), F.lit(0), F.lit(0), way, F.col("payload"), F.lit(""))
    rows = steps(spark, d).select("row_id", g.plan_operation(name).alias("planned"), a.alias("a"))
    micro = lambda c, i: F.round(F.try_element_at(F.col(f"a.{c}"), F.lit(i)) * 1e6).cast("long")
    return rows.select("row_id", "planned", "a.operation", micro("coord", 1).alias("x"), micro("coord2", 1).alias("x2"), "a.payload")


def domain_ids(spark, d):
    """Numbers of the domains in order of their names, from 1."""
    return trajectories.name_ids(steps(spark, d), "domain").select("domain", F.col("id").cast("long").alias("id"))


def missing_archives(spark, d):
    """Archives that rows name and the first delivery of no image proves: those whose every row lacks an image."""
    rows = steps(spark, d).where("coalesce(archive, '') <> ''")
    there = rows.where("coalesce(image, '') <> ''").select("archive").distinct()
    return rows.select("archive").distinct().join(there, "archive", "left_anti")


def preferred_sources(spark, d):
    """Sources of the table that are among the preferred ones, in the order of preference."""
    have = steps(spark, d).select(F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")).distinct()
    return trajectories.in_preference(have, "source", PREFERRED).select("source", F.col("place").cast("long").alias("place"))


def allocations(spark, d):
    """Rows of each operation against its part of the whole, and whether a fallback has to fill it up."""
    rows = steps(spark, d).groupBy(g.operation_name(F.col("operation")).alias("op")).agg(F.count(F.lit(1)).alias("n"))
    return trajectories.allocation(rows, "op", "n", ALLOCATION).select("op", "n", "target", "short", "fallback_target")


def metrics(spark, d):
    """Metrics of a baseline that predicts the rounded coordinate and CLICK."""
    rows = steps(spark, d).where((F.size("coord") == 2) & F.col("coord")[0].isNotNull() & F.col("coord")[1].isNotNull()).select(
        g.operation_name(F.col("operation")).alias("op"), F.lit("CLICK").alias("predicted_op"), "coord", F.transform("coord", lambda v: F.round(v, 1)).alias("predicted"))
    out = trajectories.pointer_metrics(rows)
    return out.select(F.coalesce("op", F.lit("all")).alias("op"), "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "pointer_hit", "mean_distance")))


def shard_sizes(spark, d):
    rows = shard_rows(steps(spark, d).select("row_id"), ["row_id"], 1000, "shard")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def lanes(spark, d):
    from loomline.operators.streams import lane

    return steps(spark, d).groupBy(lane(F.col("row_id")).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


def boxes(spark, d):
    micro = lambda v: F.floor(v * 1e6)
    rows = table(spark, d, "lineitem")
    box = g.norm_bbox(F.array(F.col("l_quantity") * 30, F.col("l_discount") * 9000, F.col("l_extendedprice") / 60, F.col("l_tax") * 13000), F.lit(1920.0), F.lit(1080.0))
    centre = g.bbox_centre(box)
    return rows.select("l_orderkey", "l_linenumber", *(micro(box[i]).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), micro(centre[0]).alias("cx"), micro(centre[1]).alias("cy"), g.patch_index(centre, 16).alias("patch"))


def pixels(spark, d):
    rows = steps(spark, d).where((F.size("coord") == 2) & F.col("coord")[0].isNotNull() & F.col("coord")[1].isNotNull())
    return rows.select("row_id", g.pixel(F.col("coord")[0], F.lit(1920)).alias("x"), g.pixel(F.col("coord")[1], F.lit(1080)).alias("y"))


QUERIES = {
    "action_points": action_points, "runtime_actions": runtime, "plan_actions": plans, "domain_ids": domain_ids, "missing_archives": missing_archives, "preferred_sources": preferred_sources, "operation_allocation": allocations,
    "manifest_stats": statistics, "action_history8": histories, "action_caps_per_op": caps, "action_label_validity": labels, "episode_holdout": holdout, "op_minimum_gate": minimum_gate, "stall_guard_batch": stall,
    "first_delivery": deliveries, "action_parse": parsed, "action_classify": classified, "pointer_metrics": metrics, "shard_sizes": shard_sizes, "lane_interleave": lanes, "bbox_normalise": boxes, "pixel_coordinates": pixels,
    "stream_running_dedup": runs.dedup, "stream_episode_history": runs.histories, "stream_stall_guard": runs.stall, "stream_operation_counts": runs.counts, "stream_running_totals": runs.running_totals, "stream_continuations": runs.continuations, "stream_progress": runs.progress,
}

_HAS = lambda c: f"coalesce(len({c}) >= 2 AND {c}[1] IS NOT NULL AND {c}[2] IS NOT NULL, false)"
_IN = lambda c: f"coalesce(len({c}) >= 2 AND {c}[1] BETWEEN 0 AND 1 AND {c}[2] BETWEEN 0 AND 1, false)"
_POINTERS = "('CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK', 'DRAG', 'MOVE')"
_TEXTS = "('TYPE', 'KEY', 'SCROLL', 'WAIT', 'KEY_DOWN', 'KEY_UP')"
_LABELS = f"""l AS (SELECT *, {OP} AS op, {OP} IN {_POINTERS} AND {_HAS('coord')} AS coord_valid, {OP} = 'DRAG' AND {_HAS('coord2')} AS coord2_valid, {OP} IN {_TEXTS} AND coalesce(payload, '') <> '' AS payload_valid,
    CASE WHEN {OP} NOT IN {_POINTERS} AND {OP} NOT IN {_TEXTS} AND {OP} <> 'DONE' THEN 'unknown operation' WHEN {OP} IN {_POINTERS} AND NOT {_IN('coord')} THEN 'no point within the screen' WHEN {OP} = 'DRAG' AND NOT {_IN('coord2')} THEN 'no second point'
    WHEN {OP} IN ('TYPE', 'KEY') AND coalesce(payload, '') = '' THEN 'no payload' END AS error FROM cu07_manifest)"""
_PT = "trim(replace(coalesce(payload, ''), chr(10), ' '), ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
_P = f"CASE WHEN length({_PT}) > 64 THEN left({_PT}, 61) || '...' ELSE {_PT} END"
_AT = lambda c: f"printf('%.3f,%.3f', {c}[1], {c}[2])"
_SUMMARY = f"CASE WHEN {OP} IN ('MOVE', 'CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK') AND {_HAS('coord')} THEN {OP} || '@' || {_AT('coord')} WHEN {OP} = 'DRAG' AND {_HAS('coord')} AND {_HAS('coord2')} THEN 'DRAG@' || {_AT('coord')} || '->' || {_AT('coord2')} WHEN {_P} <> '' THEN {OP} || ':' || {_P} ELSE {OP} END"
_CALLS = r"list_zip(regexp_extract_all(action_source, 'pyautogui\.(\w+)\(([^()]*)\)', 1), regexp_extract_all(action_source, 'pyautogui\.(\w+)\(([^()]*)\)', 2))"
_NUM = lambda a, i: rf"TRY_CAST(nullif(regexp_extract({a}, '^\s*{'[^,=]*,' * i}\s*(-?[0-9]+(?:\.[0-9]*)?)\s*(?:,|$)', 1), '') AS DOUBLE)"
_M = lambda v, d: f"CAST(round(least(1.0, greatest(0.0, {v} / {d - 1}.0)) * 1000000) AS BIGINT)"
_HITS = lambda *calls: "(" + " OR ".join(f"contains(c, '{x}(')" for x in calls) + ")"
_CLASS = lambda drag: f"CASE WHEN {_HITS('click')} THEN 'CLICK' WHEN {_HITS('write', 'typewrite')} THEN 'TYPE' WHEN {_HITS('hotkey', 'press', 'keydown', 'keyup')} THEN 'KEY' WHEN {_HITS('scroll')} THEN 'SCROLL' WHEN {_HITS('dragto', 'dragrel')} THEN '{drag}' WHEN {_HITS('moveto', 'move')} THEN 'MOVE' ELSE 'OTHER' END"
_UNIT = lambda c, i: f"CAST(round(least(1.0, greatest(0.0, CASE WHEN abs({c}[1]) > 1.5 OR abs({c}[2]) > 1.5 THEN {c}[{i}] / 999.0 ELSE {c}[{i}] END)) * 1000000) AS BIGINT)"
_STALL = f"""a AS (SELECT row_id, episode_id, step, {OP} || ':' || coalesce(payload, '') AS action, abs(coalesce(coord[1], 0) - 0.5) / 50 AS delta FROM cu07_manifest WHERE episode_id IS NOT NULL),
    b AS (SELECT *, CASE WHEN action = lag(action) OVER w AND delta < 0.008 THEN 1 ELSE 0 END AS same FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY step, row_id)),
    c AS (SELECT *, sum(1 - same) OVER (PARTITION BY episode_id ORDER BY step, row_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
    e AS (SELECT *, row_number() OVER (PARTITION BY episode_id, island ORDER BY step, row_id) - 1 AS stall FROM c),
    f AS (SELECT *, coalesce(sum(CASE WHEN stall >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
    SELECT row_id, stall, CASE WHEN stall >= 5 THEN 'stalled_abort' WHEN stall >= 3 THEN 'stalled_repeat' END AS guard FROM f WHERE ended = 0"""
_BOX = "least(1.0, greatest(0.0, CASE WHEN greatest(abs(a), abs(b), abs(c), abs(e)) > 1.5 THEN {v} / {d} ELSE {v} END))"
_X1, _Y1, _X2, _Y2 = (_BOX.format(v=v, d=d) for v, d in (("a", 1920.0), ("b", 1080.0), ("c", 1920.0), ("e", 1080.0)))

SQL = {
    "stream_running_totals": f"SELECT {OP} AS op, coalesce(nullif(trim(source), ''), '(none)') AS source, count(*) AS n FROM cu07_manifest GROUP BY ALL",
    "stream_progress": "SELECT count(*) AS n, count(text) AS with_text FROM main_raw",
    "episode_holdout": "WITH k AS (SELECT coalesce(nullif(episode_id, ''), nullif(task, ''), coalesce(archive, '') || '|' || coalesce(image, '')) AS k FROM cu07_manifest) SELECT ('0x' || substr(md5(k), 1, 4))::INT % 10 = 0 AS held_out, count(*) AS n, count(DISTINCT k) AS groups FROM k GROUP BY 1",
    "action_parse": rf"""WITH c AS (SELECT row_id, {_CALLS} AS l FROM cu07_manifest WHERE action_source IS NOT NULL), e AS (SELECT row_id, l[-1][1] AS n, l[-1][2] AS a, CASE WHEN len(l) > 1 AND l[1][1] = 'moveTo' AND l[2][1] = 'dragTo' THEN l[1][2] END AS p, l[2][2] AS q FROM c),
        f AS (SELECT *, regexp_extract(a, '^\s*''([^'']*)''', 1) AS t, list_transform(regexp_extract_all(a, '''([^'']*)''', 1), lambda k: k) AS keys FROM e),
        o AS (SELECT *, CASE WHEN p IS NOT NULL THEN 'DRAG' WHEN n IN ('click', 'doubleClick', 'rightClick', 'moveTo') AND {_NUM('a', 0)} IS NOT NULL AND {_NUM('a', 1)} IS NOT NULL THEN CASE WHEN n = 'moveTo' THEN 'MOVE' WHEN n = 'doubleClick' OR regexp_matches(a, 'clicks\s*=\s*[2-9]') THEN 'DOUBLE_CLICK' WHEN n = 'rightClick' OR regexp_matches(a, 'button\s*=\s*.right') THEN 'RIGHT_CLICK' ELSE 'CLICK' END
            WHEN n IN ('write', 'typewrite') AND t <> '' THEN 'TYPE' WHEN n IN ('hotkey', 'press') AND len(keys) > 0 THEN 'KEY' WHEN n = 'keyDown' THEN 'KEY_DOWN' WHEN n = 'keyUp' THEN 'KEY_UP' WHEN n IN ('scroll', 'hscroll') AND {_NUM('a', 0)} IS NOT NULL THEN 'SCROLL' END AS operation FROM f)
        SELECT row_id, operation, CASE WHEN operation = 'DRAG' THEN {_M(_NUM('p', 0), 1920)} WHEN operation IN ('CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK', 'MOVE') THEN {_M(_NUM('a', 0), 1920)} END AS x, CASE WHEN operation = 'DRAG' THEN {_M(_NUM('p', 1), 1080)} WHEN operation IN ('CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK', 'MOVE') THEN {_M(_NUM('a', 1), 1080)} END AS y,
        CASE WHEN operation = 'DRAG' THEN {_M(_NUM('q', 0), 1920)} END AS x2, CASE WHEN operation = 'DRAG' THEN {_M(_NUM('q', 1), 1080)} END AS y2, CASE WHEN operation IS NULL THEN NULL WHEN operation IN ('TYPE', 'KEY_DOWN', 'KEY_UP') THEN t WHEN operation = 'KEY' THEN CASE WHEN n = 'press' THEN keys[1] ELSE array_to_string(keys, '+') END
        WHEN operation = 'SCROLL' THEN CASE WHEN n = 'hscroll' THEN CAST(CAST(trunc({_NUM('a', 0)}) AS BIGINT) AS VARCHAR) || ',0' ELSE '0,' || CAST(CAST(trunc({_NUM('a', 0)}) AS BIGINT) AS VARCHAR) END ELSE '' END AS payload FROM o""",
    "action_classify": f"WITH a AS (SELECT replace(lower(action_source), ' ', '') AS c FROM cu07_manifest WHERE action_source IS NOT NULL) SELECT {_CLASS('DRAG')} AS op, {_CLASS('MOVE')} AS older, count(*) AS n FROM a GROUP BY ALL",
    "action_points": r"""WITH a AS (SELECT row_id, TRY_CAST(nullif(regexp_extract(action_source, '(?:click|doubleClick|moveTo)\s*\(\s*([0-9.]+)\s*,\s*([0-9.]+)', 1), '') AS DOUBLE) AS x, TRY_CAST(nullif(regexp_extract(action_source, '(?:click|doubleClick|moveTo)\s*\(\s*([0-9.]+)\s*,\s*([0-9.]+)', 2), '') AS DOUBLE) AS y FROM cu07_manifest)
        SELECT row_id, CAST(round(least(1.0, CASE WHEN x > 1 OR y > 1 THEN x / 1920.0 ELSE x END) * 1000000) AS BIGINT) AS x, CAST(round(least(1.0, CASE WHEN x > 1 OR y > 1 THEN y / 1080.0 ELSE y END) * 1000000) AS BIGINT) AS y FROM a WHERE x IS NOT NULL AND y IS NOT NULL""",
    "runtime_actions": rf"""WITH a AS (SELECT row_id, {OP} AS op, coord, coord2, coalesce(payload, '') AS p, trim(coalesce(payload, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t, list_filter(list_transform(regexp_split_to_array(coalesce(payload, ''), '[+,]'), lambda k: trim(k, ' ' || chr(9) || chr(10) || chr(13))), lambda k: k <> '') AS keys, regexp_extract_all(coalesce(payload, ''), '-?\d+') AS w FROM cu07_manifest),
        b AS (SELECT *, op = 'TYPE' AND t = '' OR op IN ('KEY', 'KEY_DOWN', 'KEY_UP') AND len(keys) = 0 AS idle FROM a)
        SELECT row_id, CASE WHEN idle THEN 'WAIT' WHEN op IN {_POINTERS} OR op IN {_TEXTS} THEN op ELSE 'DONE' END AS type, op IN {_POINTERS} AND coord[1] IS NOT NULL AS pointed, op = 'DRAG' AND coord2[1] IS NOT NULL AS dragged, CASE WHEN op = 'TYPE' AND NOT idle THEN t END AS text, CASE WHEN op IN ('KEY', 'KEY_DOWN', 'KEY_UP') AND NOT idle THEN array_to_string(keys, '|') END AS keys,
        CASE WHEN op = 'SCROLL' THEN CASE WHEN len(w) >= 2 THEN w[1]::INT ELSE 0 END END AS scroll_x, CASE WHEN op = 'SCROLL' THEN CASE WHEN len(w) >= 2 THEN w[2]::INT WHEN len(w) = 1 THEN w[1]::INT ELSE 0 END END AS scroll_y,
        CASE WHEN idle THEN 0.15 WHEN op = 'WAIT' THEN round(least(5.0, greatest(0.05, coalesce(TRY_CAST(nullif(regexp_extract(p, '\d+(?:\.\d+)?'), '') AS DOUBLE), 0.25))), 6) END AS seconds FROM b""",
    "plan_actions": f"""WITH a AS (SELECT row_id, CASE WHEN {OP} IN ('CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK', 'DRAG', 'SCROLL', 'TYPE', 'KEY', 'MOVE', 'WAIT', 'DONE') THEN {OP} END AS planned, coord AS c, coord2 AS e, payload FROM cu07_manifest),
        b AS (SELECT *, CASE WHEN planned IN ('CLICK', 'DOUBLE_CLICK', 'RIGHT_CLICK', 'MOVE') THEN {_HAS('c')} WHEN planned = 'DRAG' THEN {_HAS('c')} AND {_HAS('e')} WHEN planned IN ('TYPE', 'KEY') THEN coalesce(payload, '') <> '' ELSE planned IS NOT NULL END AS ok FROM a),
        v AS (SELECT *, list_transform(c, lambda x: x * 999) AS cc, list_transform(e, lambda x: x * 999) AS ee FROM b)
        SELECT row_id, planned, CASE WHEN ok THEN planned END AS operation, CASE WHEN ok AND planned IN {_POINTERS} THEN {_UNIT('cc', 1)} END AS x, CASE WHEN ok AND planned = 'DRAG' THEN {_UNIT('ee', 1)} END AS x2,
        CASE WHEN NOT ok THEN NULL WHEN planned IN ('TYPE', 'KEY') THEN payload WHEN planned = 'SCROLL' THEN CASE WHEN contains(payload, '-') THEN '0,-3' ELSE '0,3' END WHEN planned = 'WAIT' THEN coalesce(payload, '1') WHEN planned = 'DONE' THEN 'success' ELSE '' END AS payload FROM v""",
    "domain_ids": "SELECT domain, row_number() OVER (ORDER BY domain) AS id FROM (SELECT DISTINCT domain FROM cu07_manifest WHERE domain IS NOT NULL)",
    "missing_archives": "SELECT archive FROM cu07_manifest WHERE coalesce(archive, '') <> '' GROUP BY archive HAVING count(nullif(image, '')) = 0",
    "preferred_sources": "SELECT source, place FROM (VALUES ('uigrain/tasks', 0::BIGINT), ('no/such', 1), ('deskgrid/os-traces', 2)) AS v(source, place) WHERE source IN (SELECT lower(trim(source)) FROM cu07_manifest)",
    "operation_allocation": f"""WITH w AS (SELECT count(*) AS w FROM cu07_manifest), a AS (SELECT op, coalesce((SELECT count(*) FROM cu07_manifest WHERE {OP} = op), 0) AS n, CAST(floor(w * part) AS BIGINT) AS target FROM (VALUES ('CLICK', 0.58::DOUBLE), ('TYPE', 0.16), ('KEY', 0.10), ('SCROLL', 0.08), ('DRAG', 0.08)) AS v(op, part), w)
        SELECT op, n, target, greatest(0, target - n) AS short, CASE WHEN target > n THEN least(target, greatest(1200, target - n + 800)) END AS fallback_target FROM a""",
    "manifest_stats": f"""WITH r AS (SELECT {OP} AS o, nullif(trim(source), '') AS s, nullif(archive, '') AS a, nullif(domain, '') AS m FROM cu07_manifest) SELECT 'operation' AS axis, o AS value, count(*) AS n FROM r GROUP BY o UNION ALL SELECT 'source', s, count(*) FROM r WHERE s IS NOT NULL GROUP BY s
        UNION ALL SELECT 'archive', a, count(*) FROM r WHERE a IS NOT NULL GROUP BY a UNION ALL SELECT 'all', NULL, count(*) FROM r UNION ALL SELECT 'domains', NULL, count(DISTINCT m) FROM r""",
    "action_history8": f"SELECT row_id, len(h) AS n, array_to_string(h, '|') AS history FROM (SELECT row_id, coalesce(list({_SUMMARY}) OVER (PARTITION BY coalesce(episode_id, '') ORDER BY step, row_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM cu07_manifest)",
    "action_caps_per_op": f"WITH {_LABELS} SELECT op, row_id FROM (SELECT op, row_id, row_number() OVER (PARTITION BY op ORDER BY row_id) AS r FROM l WHERE error IS NULL) WHERE r <= CASE op WHEN 'CLICK' THEN 100 WHEN 'TYPE' THEN 80 WHEN 'KEY' THEN 60 ELSE 40 END",
    "action_label_validity": f"WITH {_LABELS} SELECT op, coalesce(error, 'none') AS error, count(*) AS n, count(*) FILTER (coord_valid) AS coord_valid, count(*) FILTER (coord2_valid) AS coord2_valid, count(*) FILTER (payload_valid) AS payload_valid FROM l GROUP BY ALL",
    "op_minimum_gate": f"SELECT rule, CAST(coalesce(n, 0) AS DOUBLE) AS actual, CAST(minimum AS DOUBLE) AS minimum, coalesce(n, 0) >= minimum AS ok FROM (VALUES {', '.join(f'({k!r}, {v})' for k, v in MINIMUMS.items())}) AS v(rule, minimum) LEFT JOIN (SELECT {OP} AS rule, count(*) AS n FROM cu07_manifest GROUP BY 1) USING (rule)",
    "stall_guard_batch": f"WITH {_STALL}",
    "stream_stall_guard": f"WITH {_STALL}",
    "first_delivery": f"SELECT {OP} AS op, count(*) AS n FROM (SELECT operation, CASE WHEN episode_id IS NULL OR step IS NULL OR image IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY episode_id, step, image ORDER BY arrived_at, row_id) END AS r FROM cu07_manifest) WHERE r = 1 GROUP BY 1",
    "pointer_metrics": f"""WITH p AS (SELECT {OP} AS op, coord[1] AS x, coord[2] AS y FROM cu07_manifest WHERE len(coord) = 2 AND coord[1] IS NOT NULL AND coord[2] IS NOT NULL), q AS (SELECT op, (op = 'CLICK')::INT AS r, sqrt((x - round(x, 1)) ** 2 + (y - round(y, 1)) ** 2) AS v FROM p)
        SELECT coalesce(op, 'all') AS op, count(*) AS n, round(avg(r), 6) AS accuracy, round(avg((v <= 0.1)::INT), 6) AS pointer_hit, round(avg(v), 6) AS mean_distance FROM q GROUP BY GROUPING SETS ((op), ())""",
    "shard_sizes": "SELECT printf('shard_%03d', (r - 1) // 1000) AS shard, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r FROM cu07_manifest) GROUP BY 1",
    "lane_interleave": "SELECT CASE WHEN row_id % 5 < 3 THEN 'main' WHEN row_id % 5 = 3 THEN 'coder' ELSE 'agent' END AS lane, count(*) AS n FROM cu07_manifest GROUP BY 1",
    "bbox_normalise": f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 AS a, l_discount * 9000 AS b, l_extendedprice / 60 AS c, l_tax * 13000 AS e FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, {_X1} AS p, {_Y1} AS q, {_X2} AS r, {_Y2} AS s FROM v)
        SELECT l_orderkey, l_linenumber, CAST(floor((least(p, r)) * 1e6) AS BIGINT) AS x1, CAST(floor((least(q, s)) * 1e6) AS BIGINT) AS y1, CAST(floor((greatest(p, r)) * 1e6) AS BIGINT) AS x2, CAST(floor((greatest(q, s)) * 1e6) AS BIGINT) AS y2, CAST(floor(((p + r) / 2) * 1e6) AS BIGINT) AS cx, CAST(floor(((q + s) / 2) * 1e6) AS BIGINT) AS cy,
        CAST(floor(least(0.999999, (q + s) / 2) * 16) * 16 + floor(least(0.999999, (p + r) / 2) * 16) AS INT) AS patch FROM n""",
    "pixel_coordinates": "SELECT row_id, CAST(round_even(least(1.0, greatest(0.0, coord[1])) * 1919, 0) AS INT) AS x, CAST(round_even(least(1.0, greatest(0.0, coord[2])) * 1079, 0) AS INT) AS y FROM cu07_manifest WHERE len(coord) = 2 AND coord[1] IS NOT NULL AND coord[2] IS NOT NULL",
    "stream_running_dedup": "SELECT count(DISTINCT md5(text)) + max((text IS NULL)::INT) AS kept FROM main_raw",
    "stream_operation_counts": f"SELECT date_trunc('day', recorded_at::TIMESTAMP) AS start, {OP} AS op, count(*) AS n FROM cu07_manifest WHERE recorded_at IS NOT NULL GROUP BY ALL",
}
SQL["stream_episode_history"] = SQL["action_history8"]
