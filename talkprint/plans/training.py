"""Registered queries W01-W07, W11 and the curve tables."""

from pyspark.sql import functions as F

from talkprint.operators import curves
from talkprint.plans.bindings import table, with_r6
from talkprint.plans.registry import query


def runs(spark, d):
    """Events as curve points: one run per user, the event id as iteration."""
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("iteration"), F.col("event_type").alias("best_id"),
        (F.col("value") / 100.0).alias("score"), F.col("value").cast("string").alias("raw"),
    )


RUNS = "runs AS (SELECT user_id, event_id AS iteration, event_type AS best_id, value / 100.0 AS score, value FROM events)"


@query(
    "w01_attempt_index",
    f"WITH {RUNS} SELECT user_id, iteration, dense_rank() OVER (PARTITION BY user_id ORDER BY iteration) AS attempt FROM runs",
)
def w01(spark, d):
    return curves.attempt_index(runs(spark, d), ["user_id"])


@query(
    "w01_attempt_index_global",
    "SELECT iteration, dense_rank() OVER (ORDER BY iteration) AS attempt FROM (SELECT DISTINCT o_orderkey AS iteration FROM orders)",
)
def w01b(spark, d):
    its = table(spark, d, "orders").select(F.col("o_orderkey").alias("iteration"))
    return curves.attempt_index(its)


@query(
    "w02_validation_band",
    "SELECT iteration, round(avg(v), 6) + 0.0 AS mean, min(v) AS lo, max(v) AS hi FROM (SELECT event_id // 20 AS iteration, value AS v FROM events "
    "WHERE event_id % 11 > 2) GROUP BY iteration",
)
def w02(spark, d):
    k = F.col("event_id") % 11
    raw = F.when(k == 0, "NaN").when(k == 1, "broken").when(k == 2, "Infinity").otherwise(F.col("value").cast("string"))
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 20).alias("iteration"), raw.alias("v"))
    return with_r6(curves.validation_band(rows, "v"), ["mean"])


@query(
    "w03_validation_by_n",
    "SELECT coalesce(n, 10)::INT AS n_personas, event_id // 50 AS iteration, count(*) AS n_points, round(avg(value), 6) + 0.0 AS mean "
    "FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 10 END AS n FROM events) GROUP BY 1, 2",
)
def w03(spark, d):
    k = F.col("event_id") % 4
    rows = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 50).alias("iteration"), F.when(k == 0, 5).when(k == 1, 8).when(k == 2, 10).alias("n_personas"), "value"
    )
    return with_r6(curves.validation_by_n(rows, "value"), ["mean"])


@query(
    "w04_best_worst",
    """WITH pool AS (SELECT event_id // 3 AS batch, event_id AS pos, CASE WHEN event_id // 3 % 5 = 0 THEN NULL ELSE value END AS score FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, pos DESC) AS hi, row_number() OVER (PARTITION BY batch ORDER BY score, pos) AS lo FROM pool WHERE score IS NOT NULL)
    SELECT batch, pos, score, hi::INT AS slot FROM s WHERE hi <= 2 UNION ALL SELECT batch, pos, score, (lo + 2)::INT FROM s WHERE lo <= 2
    UNION ALL SELECT batch, pos, score, (row_number() OVER (PARTITION BY batch ORDER BY pos))::INT FROM pool WHERE batch NOT IN (SELECT batch FROM s)""",
)
def w04(spark, d):
    batch = F.floor(F.col("event_id") / 3)
    pool = table(spark, d, "events").select(batch.alias("batch"), F.col("event_id").alias("pos"), F.when(batch % 5 != 0, F.col("value")).alias("score"))
    return curves.best_worst(pool, "batch", "score", "pos")


@query(
    "w04_best_worst_users",
    """WITH s AS (SELECT user_id AS batch, event_id AS pos, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS hi,
      row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo FROM events)
    SELECT batch, pos, score, hi::INT AS slot FROM s WHERE hi <= 2 UNION ALL SELECT batch, pos, score, (lo + 2)::INT FROM s WHERE lo <= 2""",
)
def w04b(spark, d):
    pool = table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.col("value").alias("score"))
    return curves.best_worst(pool, "batch", "score", "pos")


@query(
    "w05_stagnation",
    f"""WITH {RUNS}, c AS (SELECT *, lag(best_id) OVER w IS DISTINCT FROM best_id AS changed FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY iteration)),
    i AS (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY iteration) AS island FROM c),
    s AS (SELECT user_id, iteration, best_id, min(iteration) OVER (PARTITION BY user_id, island) AS since FROM i)
    SELECT *, iteration - since >= 200 AS stop FROM s""",
)
def w05(spark, d):
    rows = runs(spark, d).select("user_id", "iteration", "best_id")
    return curves.stagnation(rows, 200, keys=["user_id"])


@query(
    "w06_validation_triggers",
    f"WITH {RUNS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iteration) AS rn FROM runs) SELECT user_id, iteration, score FROM f WHERE rn = 1 OR score > 0.7",
)
def w06(spark, d):
    return curves.validation_triggers(runs(spark, d).select("user_id", "iteration", "score"), keys=["user_id"])


@query("w06_validation_triggers_global", f"WITH {RUNS} SELECT user_id, iteration, score FROM runs WHERE score > 0.7 OR iteration = (SELECT min(iteration) FROM runs)")
def w06b(spark, d):
    return curves.validation_triggers(runs(spark, d).select("user_id", "iteration", "score"))


@query("w07_resume_offset", f'WITH {RUNS} SELECT user_id, max(iteration) AS "offset" FROM runs GROUP BY user_id')
def w07(spark, d):
    return curves.resume_offset(runs(spark, d), ["user_id"])


@query("w07_resume_offset_empty", 'SELECT coalesce(max(event_id), 0) AS "offset" FROM (SELECT CASE WHEN value < -1e300 THEN event_id END AS event_id FROM events)')
def w07b(spark, d):
    nothing_logged = F.when(F.col("value") < -1e300, F.col("event_id"))
    return curves.resume_offset(table(spark, d, "events").select(nothing_logged.alias("iteration")))


