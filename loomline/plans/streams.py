"""Token stream queries over documents and raw text, with white-space words as tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import streams as s
from loomline.plans.corpus import WS
from loomline.session import table

TOKENS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')"


def tokens(spark, d, name="documents", key="doc_id"):
    return table(spark, d, name).select(F.col(key).alias("doc"), s.words(F.col("text")).alias("w"))


def windows(spark, d):
    n = F.size("w")
    return tokens(spark, d).select("doc", n.cast("long").alias("tokens"), F.size(s.window_starts(n, 64)).cast("long").alias("windows"), s.holdout_size(n, 4, 0.02).cast("long").alias("held_out"))


def top_continuations(spark, d):
    pairs = s.ngrams(tokens(spark, d), ["doc"], "w", 3).select(F.array_join("context", " ").alias("context"), "next")
    bank = s.continuation_bank(pairs)
    return bank.select("context", "next", "n", F.col("rank").cast("long").alias("rank"), F.round("weight", 6).alias("weight"))


def looked_up(spark, d):
    join = lambda rows: rows.select("doc", F.array_join("context", " ").alias("context"), "next")
    bank = s.continuation_bank(join(s.ngrams(tokens(spark, d, "main_raw", "ord"), ["doc"], "w", 2)), 1)
    asked = join(s.ngrams(tokens(spark, d, "eval_items", "item_id"), ["doc"], "w", 2))
    found = s.look_up(asked.withColumnRenamed("next", "actual"), bank.select("context", "next"))
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("contexts"), F.count("next").alias("known"), F.count(F.when(F.col("next") == F.col("actual"), 1)).alias("right"))


def fingerprints(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", s.fingerprint(F.col("t")).alias("fp"))


def draws(spark, d):
    """Balanced draws: how many draws each class got, and whether every drawn row is of its class."""
    rows = table(spark, d, "cu07_manifest").select("row_id", F.coalesce(F.nullif(F.upper(F.trim("operation")), F.lit("")), F.lit("OTHER")).alias("op"))
    n = rows.count()
    return s.balanced_draws(rows, "op", "row_id", n, 11).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def permutation(spark, d):
    out = s.epoch_order(table(spark, d, "main_sft").select("sft_id"), "sft_id", 3, 1)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("draw").alias("places"), F.max("draw").cast("long").alias("last"))


def distances(spark, d):
    """Mean of each label's vectors and the mean distance to it."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    mean = e.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d2 = e.join(mean, ["label", "i"]).groupBy("label", "vec_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("m"), 2))).alias("x"))
    return d2.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("mean_distance"))


def slots(spark, d):
    rows = fingerprints(spark, d).select("l_orderkey", "l_linenumber", s.bank_slots(F.col("fp"), 1_048_576).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s.a", "s.b")


def evaluation_split(spark, d):
    return table(spark, d, "main_sft").select("sft_id", s.is_evaluation(F.col("sft_id"), 7).alias("held_out"))


def blocks(spark, d):
    """Training part and blocks of each document's tokens."""
    b = s.block_split(F.size("w"), 32)
    return tokens(spark, d).select("doc", b["train"].alias("train"), b["blocks"].cast("long").alias("blocks"))


QUERIES = {"token_blocks": blocks, "bank_slots": slots, "evaluation_split": evaluation_split, "token_windows": windows, "ngram_topk_exact": top_continuations, "ngram_lookup": looked_up, "rolling_fingerprint": fingerprints, "balanced_sampler": draws, "epoch_permutation": permutation, "label_distances": distances}

_NG = lambda src, key, n: f"t AS (SELECT {key} AS doc, {TOKENS} AS w FROM {src}), g AS (SELECT doc, w, unnest(range(1, len(w) - {n} + 1)) AS i FROM t), p AS (SELECT doc, array_to_string(w[i:i + {n} - 1], ' ') AS context, w[i + {n}] AS next FROM g)"


def _fold(m: int, p: int) -> str:
    out = "0"
    for t in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        out = f"(({out} * {m} + {t} + 1) % {p})"
    return out


_DRAW = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"

SQL = {
    "stream_continuations": f"WITH {_NG('eval_items', 'item_id', 2)}, c AS (SELECT context, next, count(*) AS n FROM p GROUP BY ALL) SELECT context, next, n FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS r FROM c) WHERE r = 1",
    "token_blocks": f"WITH t AS (SELECT doc_id AS doc, CAST(floor(floor(len({TOKENS}) * 0.99) / 32) * 32 AS BIGINT) AS train FROM documents) SELECT doc, train, greatest(0, CAST(floor((train - 1) / 32) AS BIGINT)) AS blocks FROM t",
    "evaluation_split": f"SELECT sft_id, {_DRAW("'7:' || sft_id")} % 100 < 2 AS held_out FROM main_sft",
    "balanced_sampler": f"""WITH o AS (SELECT coalesce(nullif(upper(trim(operation)), ''), 'OTHER') AS op FROM cu07_manifest), k AS (SELECT op, row_number() OVER (ORDER BY op) - 1 AS k FROM (SELECT DISTINCT op FROM o)),
        w AS (SELECT {_DRAW("'11:class:' || i")} % (SELECT count(*) FROM k) AS k FROM (SELECT unnest(range((SELECT count(*) FROM o))) AS i)) SELECT op, count(*) AS n FROM w JOIN k USING (k) GROUP BY op""",
    "token_windows": f"""WITH t AS (SELECT doc_id AS doc, len({TOKENS}) AS n FROM documents) SELECT doc, n AS tokens, CAST(CASE WHEN n - 66 >= 0 THEN (n - 66) // 65 + 1 ELSE 0 END AS BIGINT) AS windows,
        CAST(CASE WHEN n >= 384 THEN least(greatest(128, floor(n * 0.02)), floor(n / 5)) END AS BIGINT) AS held_out FROM t""",
    "ngram_topk_exact": f"""WITH {_NG('documents', 'doc_id', 3)}, c AS (SELECT context, next, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rank FROM c)
        SELECT context, next, n, rank, round(n / sum(n) OVER (PARTITION BY context), 6) AS weight FROM r WHERE rank <= 4""",
    "ngram_lookup": f"""WITH {_NG('main_raw', 'ord', 2)}, c AS (SELECT context, next, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT context, next FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS k FROM c) WHERE k = 1),
        {_NG('eval_items', 'item_id', 2).replace('t AS', 't2 AS').replace('FROM t)', 'FROM t2)').replace('g AS', 'g2 AS').replace('FROM g)', 'FROM g2)').replace('p AS', 'q AS')}
        SELECT doc, count(*) AS contexts, count(r.next) AS known, count(*) FILTER (r.next = q.next) AS right FROM q LEFT JOIN r USING (context) GROUP BY doc""",
    "rolling_fingerprint": f"SELECT l_orderkey, l_linenumber, CAST({_fold(s.M1, s.P1)} * {s.P2} + {_fold(s.M2, s.P2)} AS BIGINT) AS fp FROM lineitem",
    "bank_slots": f"SELECT l_orderkey, l_linenumber, CAST(fp % 1048576 AS BIGINT) AS a, CAST(xor(fp, fp // 1048576) % 1048576 AS BIGINT) AS b FROM (SELECT l_orderkey, l_linenumber, CAST({_fold(s.M1, s.P1)} * {s.P2} + {_fold(s.M2, s.P2)} AS BIGINT) AS fp FROM lineitem)",
    "epoch_permutation": "SELECT count(*) AS n, count(*) AS places, count(*) - 1 AS last FROM main_sft",
    "label_distances": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), x AS (SELECT label, vec_id, sqrt(sum((v - m) ** 2)) AS x FROM e JOIN m USING (label, i) GROUP BY ALL) SELECT label, count(*) AS n, round(avg(x), 5) AS mean_distance FROM x GROUP BY label",
}
