"""Action trajectories: step explosion, histories, caps, hold-outs, statistics, metrics and the stall guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.geometry import POINTER, WITH_PAYLOAD, action_error, action_point, bbox_centre, classify_action, norm_bbox, norm_point, operation_name, parsed_action, summarize_action
from loomline.functions.text import strip
from loomline.operators.corpus import prefix_sum, quota_and_cap, row_caps
from loomline.session import cut


def zip_steps(df: DataFrame, keys: Sequence[str], *arrays: str) -> DataFrame:
    """One row per step, as many as the shortest array has, with ``pos`` from 0."""
    n = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    n = F.greatest(n, F.lit(0))
    zipped = F.arrays_zip(*(F.slice(F.col(a), F.lit(1), n).alias(a) for a in arrays))
    return df.select(*keys, F.posexplode(zipped).alias("pos", "s")).select(*keys, "pos", *(F.col(f"s.{a}").alias(a) for a in arrays))


def parsed_steps(steps: DataFrame) -> DataFrame:
    """Steps (``actions, screenshots, status``) with the action ``a`` that their code has; those that failed or cannot be
    parsed are left out. Each step is a row of its own, so a recording may have any number of them."""
    steps = steps.where(F.lower(F.coalesce("status", F.lit(""))).isin("", "success", "none"))
    a = parsed_action(F.col("actions"), F.col("screenshots.width").cast("double"), F.col("screenshots.height").cast("double"))
    return steps.withColumn("a", a).where("a.operation is not null")


def prepare_steps(trajectories: DataFrame) -> DataFrame:
    """Parsed steps of successful desktop trajectories (``task_id, instruction, domain, score, actions, screenshots,
    exe_statuses``): steps that failed or cannot be parsed are left out. A step has its own status only: with those of
    the whole trajectory beside each step, memory would grow with the square of its length."""
    good = trajectories.where(F.coalesce("score", F.lit(0.0)) > 0)
    good = good.withColumn("status", F.transform("actions", lambda _, i: F.get("exe_statuses", i)))
    steps = zip_steps(good, ["task_id", "instruction", "domain"], "actions", "screenshots", "status")
    return parsed_steps(steps).select("task_id", "instruction", "domain", "pos", "a.*", F.substring("actions", 1, 2000).alias("action_source"))


def explode_boxes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per box of ``bbox ARRAY<ARRAY<DOUBLE>>, text ARRAY<STRING>, width, height`` with its name and centre."""
    out = rows.select(*keys, "width", "height", "text", F.posexplode("bbox").alias("pos", "box"))
    out = out.withColumn("name", F.when(F.col("pos") < F.size("text"), F.col("text")[F.col("pos")]).otherwise(F.lit("UI element")))
    return out.withColumn("box", norm_bbox(F.col("box"), F.col("width"), F.col("height"))).withColumn("coord", bbox_centre(F.col("box"))).drop("text")


def usable_steps(steps: DataFrame) -> DataFrame:
    """Steps that are not deleted, mock, incomplete or marked unused; missing flags mean usable."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return steps.where(no("is_delete") & no("is_mock") & F.coalesce("task_completed", F.lit(True)) & ~F.col("is_use").eqNullSafe(False))


def valid_labels(rows: DataFrame) -> DataFrame:
    """Which labels of an action count: the point for pointer operations, the second only for drags, the payload for the rest."""
    has = lambda c: F.coalesce((F.size(c) >= 2) & F.col(c)[0].isNotNull() & F.col(c)[1].isNotNull(), F.lit(False))
    op = operation_name(F.col("operation"))
    return rows.withColumns(
        {
            "op": op, "coord_valid": op.isin(*POINTER) & has("coord"), "coord2_valid": (op == "DRAG") & has("coord2"),
            "payload_valid": op.isin(*WITH_PAYLOAD) & (F.coalesce("payload", F.lit("")) != ""), "error": action_error(op, F.col("coord"), F.col("coord2"), F.col("payload")),
        }
    )


#: Rows of one episode that a window sees at a time.
STRETCH = 4096


def _cut_up(placed: DataFrame, overlap: int) -> DataFrame:
    own = F.floor(F.col("__n") / STRETCH)
    late = F.col("__n") % STRETCH >= STRETCH - overlap
    return placed.withColumn("__stretch", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.col("__stretch") == own)


def stretches(rows: DataFrame, episode: str, order: Sequence[str], overlap: int) -> DataFrame:
    """Rows with their place ``__n`` in the episode and a ``__stretch`` of it. Each stretch also gets the last
    ``overlap`` rows of the one before (``__own`` false), so a window over stretches sees what it needs and no
    task sees a long episode whole. ``__key`` is the episode, '' for a missing one."""
    rows = rows.withColumn("__key", F.coalesce(F.col(episode), F.lit("")))
    return _cut_up(prefix_sum(rows, ["__key"], order, F.lit(1).cast("long"), "__n"), overlap)


def histories_of(placed: DataFrame, summary: str, size: int = 8) -> DataFrame:
    """Adds ``history`` to rows with ``__key`` and ``__n``: the summaries of up to ``size`` rows before, oldest first."""
    w = Window.partitionBy("__key", "__stretch").orderBy("__n").rowsBetween(-size, -1)
    return _cut_up(placed, size).withColumn("history", F.collect_list(summary).over(w)).where("__own").drop("__stretch", "__own")


def histories(rows: DataFrame, episode: str, order: Sequence[str], size: int = 8) -> DataFrame:
    """Adds ``history``: summaries of up to ``size`` earlier actions of the episode, oldest first.

    Rows without an episode form one. Long episodes are cut into stretches that overlap by ``size`` rows.
    """
    summary = summarize_action(operation_name(F.col("operation")), F.col("coord"), F.col("coord2"), F.col("payload"))
    rows = rows.withColumn("summary", summary).withColumn("__key", F.coalesce(F.col(episode), F.lit("")))
    return histories_of(prefix_sum(rows, ["__key"], order, F.lit(1).cast("long"), "__n"), "summary", size).drop("__key", "__n")


def operation_caps(rows: DataFrame, order: Sequence[str], caps: dict[str, int], default: int | None = None) -> DataFrame:
    """The first rows of each operation up to its cap, in order."""
    table = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair)) if caps else F.create_map().cast("map<string,int>")
    return row_caps(rows, ["op"], order, F.coalesce(F.try_element_at(table, F.col("op")), F.lit(default)))


def holdout_key(episode: Column, task: Column, archive: Column, image: Column) -> Column:
    """What is held out together: an episode, else a task, else one image of an archive."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(episode), some(task), F.concat(F.coalesce(archive, F.lit("")), F.lit("|"), F.coalesce(image, F.lit(""))))


def group_holdout(key: Column, parts: int = 10) -> Column:
    """True for one of so many parts of the groups, by the digest of their key: a group is never split."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int") % parts == 0


def manifest_statistics(rows: DataFrame) -> DataFrame:
    """Counts by operation, source and archive, all rows and distinct domains, as ``axis, value, n``, from one grouping."""
    rows = rows.select(operation_name(F.col("operation")).alias("operation"), F.nullif(F.trim("source"), F.lit("")).alias("source"), F.nullif("archive", F.lit("")).alias("archive"), F.nullif("domain", F.lit("")).alias("domain"))
    c = [F.col(x) for x in ("operation", "source", "archive", "domain")]
    g = rows.groupingSets([(c[0],), (c[1],), (c[2],), (c[3],), ()], *c).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    axis = F.when(F.col("g") == 7, "operation").when(F.col("g") == 11, "source").when(F.col("g") == 13, "archive").when(F.col("g") == 14, "domain").otherwise("all")
    g = g.select(axis.alias("axis"), F.coalesce(*c).alias("value"), "n")
    named = g.where("axis = 'all' or axis = 'operation' or value is not null")
    domains = named.where("axis = 'domain'").agg(F.lit("domains").alias("axis"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n"))
    return named.where("axis <> 'domain'").unionByName(domains)


def pointer_metrics(rows: DataFrame, side: int = 16) -> DataFrame:
    """Accuracy by class and in all, share of pointer hits and mean distance of ``op, predicted_op, coord, predicted``."""
    d = F.sqrt(F.pow(F.col("coord")[0] - F.col("predicted")[0], 2) + F.pow(F.col("coord")[1] - F.col("predicted")[1], 2))
    scored = rows.withColumn("right", (F.col("op") == F.col("predicted_op")).cast("int")).withColumn("d", d)
    hit = (F.col("d") <= max(0.10, 1.5 / side)).cast("int")
    return scored.groupingSets([(F.col("op"),), ()], F.col("op")).agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy"), F.avg(hit).alias("pointer_hit"), F.avg("d").alias("mean_distance"))


def stall_guard(rows: DataFrame, episode: str, order: Sequence[str], action: Column, delta: Column, small: float = 0.008) -> DataFrame:
    """How often in a row an action was repeated without effect, and what follows: a wait from 3, an end from 5.

    Rows after an episode's first end are left out. A run of repeats begins at the last row that is none; its
    place comes from sums over ranges, so that a long episode spreads over tasks.
    """
    cut_ = stretches(rows.withColumn("__a", action), episode, order, 1)
    before = F.lag("__a").over(Window.partitionBy("__key", "__stretch").orderBy("__n"))
    same = F.coalesce((F.col("__a") == before) & (delta < small), F.lit(False))
    marked = cut_.withColumn("__new", (~same).cast("long")).where("__own").drop("__stretch", "__own")
    runs = cut(prefix_sum(marked, ["__key"], ["__n"], F.col("__new"), "__sum").withColumn("__run", F.col("__sum") + F.col("__new")))
    begins = runs.groupBy("__key", "__run").agg(F.min("__n").alias("__begin"))
    counted = cut(runs.join(begins, ["__key", "__run"]).withColumn("stall", F.col("__n") - F.col("__begin")))
    ends = counted.where("stall >= 5").groupBy("__key").agg(F.min("__n").alias("__end"))
    kept = counted.join(ends, "__key", "left").where("__end is null or __n <= __end")
    guard = F.when(F.col("stall") >= 5, "stalled_abort").when(F.col("stall") >= 3, "stalled_repeat")
    return kept.withColumn("guard", guard).drop("__a", "__key", "__n", "__new", "__sum", "__run", "__begin", "__end")


def latest_delivery(rows: DataFrame, keys: Sequence[str], arrived: str, id_: str) -> DataFrame:
    """One row per delivered action, the first to arrive. Rows with a missing key stay."""
    complete = F.lit(True)
    for k in keys:
        complete &= F.col(k).isNotNull()
    firsts = rows.where(complete).groupBy(*keys).agg(F.min(F.struct(arrived, id_)).alias("k")).select(F.col(f"k.{id_}").alias(id_))
    return rows.where(complete).join(firsts, id_, "left_semi").unionByName(rows.where(~complete))


def name_ids(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with their number in order, from 1. Values are few (domains, labels); nulls have none."""
    return rows.select(column).dropna().distinct().withColumn("id", F.dense_rank().over(Window.orderBy(column)))


def in_preference(rows: DataFrame, column: str, preferred: Sequence[str]) -> DataFrame:
    """The rows of preferred values with their place in the order of preference, from 0."""
    wanted = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(preferred)], f"`{column}` string, place int")
    return rows.join(wanted, column)


def allocation(counts: DataFrame, column: str, n: str, parts: dict[str, float], slack: int = 800, least: int = 1200) -> DataFrame:
    """Parts of the sum of all counts, rounded down, against the counts. A value that is short by some has a fallback
    target: what is short and ``slack`` more, at least ``least``, but no more than its target."""
    whole = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("__whole"))
    wanted = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in parts.items()], f"`{column}` string, __part double")
    out = wanted.join(counts, column, "left").join(whole)  # one row
    out = out.withColumn("target", F.floor(F.col("__whole") * F.col("__part"))).withColumn(n, F.coalesce(F.col(n), F.lit(0)).cast("long"))
    short = F.greatest(F.lit(0).cast("long"), F.col("target") - F.col(n))
    fallback = F.when(short > 0, F.least(F.col("target"), F.greatest(F.lit(least).cast("long"), short + slack)))
    return out.withColumns({"short": short, "fallback_target": fallback}).drop("__part", "__whole")


def trajectory_counters(trajectories: DataFrame, steps: DataFrame, length: Column | None = None) -> DataFrame:
    """Trajectories scanned and successful, their steps, and the steps kept and skipped: one row. ``length`` is the number
    of a trajectory's steps, without it that of its actions with a screenshot."""
    good = F.coalesce("score", F.lit(0.0)) > 0
    n = F.greatest(F.least(F.size("actions"), F.size("screenshots")), F.lit(0)) if length is None else length
    seen = trajectories.agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(good, 1)).alias("successful"), F.coalesce(F.sum(F.when(good, n)), F.lit(0)).alias("steps"))
    kept = steps.agg(F.count(F.lit(1)).alias("kept"))
    return seen.join(kept).withColumn("skipped", F.col("steps") - F.col("kept"))  # one row each


def capped_actions(trajectories: DataFrame, key: str, cap: int = 8) -> DataFrame:
    """Steps of ``key, actions, images`` in pairs, as many as the shorter has, with operation and point of the action's
    text; the first ``cap`` of each trajectory."""
    rows = zip_steps(trajectories, [key], "actions", "images").where(F.col("pos") < cap)
    return rows.select(key, "pos", "images", classify_action(F.col("actions")).alias("op"), action_point(F.col("actions"), F.lit(1920.0), F.lit(1080.0)).alias("coord"), F.substring("actions", 1, 1000).alias("action"))


def grounded_boxes(rows: DataFrame, config: str, order: Sequence[str], target: int) -> DataFrame:
    """Named boxes with their centres; an even share of each configuration and no more than the target in all."""
    return quota_and_cap(explode_boxes(rows, [config, *order]).where("box is not null"), config, [*order, "pos"], target)


def pointed_prompts(rows: DataFrame, key: str, prompt: str, point: str) -> DataFrame:
    """Prompts after their last image mark with their point in parts of the screen; rows without either are left out."""
    tail = strip(F.element_at(F.split(F.col(prompt), "<image>"), -1))
    out = rows.select(key, tail.alias("prompt"), norm_point(F.col(point), F.col("width"), F.col("height")).alias("coord"))
    return out.where("coord is not null and prompt <> ''")


#: Parts of a recording's length at which its frames are taken.
FRAMES = (0.25, 0.6, 0.85)


def captioned_frames(recordings: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Frames of ``key, label, caption, length`` recordings with their label's name and a caption of at most 500
    characters; recordings of unknown labels and of no length have none."""
    named = recordings.join(labels, label).where("length > 0")
    return named.select(key, "name", F.substring("caption", 1, 500).alias("caption"), F.explode(F.array(*map(F.lit, FRAMES))).alias("part"), "length").withColumn("frame", F.floor(F.col("length") * F.col("part"))).drop("length")


def planned_steps(steps: DataFrame, caps: dict[str, int], order: Sequence[str]) -> DataFrame:
    """Usable steps with the action their code has, or their plan's where the code tells another operation; the first
    of each operation up to its cap. ``parsed`` and ``planned`` are actions, ``op`` is the plan's operation."""
    same = F.col("parsed.operation") == F.col("op")
    rows = usable_steps(steps).withColumn("a", F.when(F.coalesce(same, F.lit(False)), F.col("parsed")).otherwise(F.col("planned"))).where("a is not null")
    return operation_caps(rows, order, caps)
