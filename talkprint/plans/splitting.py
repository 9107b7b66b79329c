"""Registered queries J01-J17 and W08-W10."""

from pyspark.sql import functions as F

from talkprint.operators import batches, curves, splits
from talkprint.plans.bindings import CONV, conv_turns, r6, table
from talkprint.plans.registry import query


def tasks(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("item_id").alias("pos"), "text")


def sql_rank(src: str, id_: str, seed: int, where: str = "") -> str:
    return (
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {id_}), {id_}) AS r, count(*) OVER () AS n FROM {src} {where})"
    )


@query(
    "j01_split",
    f"WITH {sql_rank('customer', 'c_custkey', 42)} SELECT c_custkey, CASE WHEN r <= floor(n * 0.2) THEN 'test' "
    "WHEN r <= floor(n * 0.2) + floor((n - floor(n * 0.2)) * 0.15) THEN 'val' ELSE 'train' END AS split FROM ranked",
)
def j01(spark, d):
    return splits.split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.2, 0.15)


@query(
    "j02_train_val_split",
    f"WITH {sql_rank('benchmark', 'item_id', 7)} SELECT item_id, CASE WHEN r <= least(greatest(1, floor(n * 0.01)), n - 1) THEN 'val' ELSE 'train' END AS split FROM ranked",
)
def j02(spark, d):
    return splits.train_val_split(table(spark, d, "benchmark").select("item_id"), "item_id", 0.01, 7)


def sql_greedy(src: str, key: str, frac: float, tie: str) -> str:
    return f"""WITH RECURSIVE sizes AS (SELECT {key} AS k, count(*) AS size FROM {src} GROUP BY 1),
    o AS (SELECT k, size, row_number() OVER (ORDER BY size DESC, {tie}) AS i, sum(size) OVER ()::DOUBLE AS total FROM sizes),
    f AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS k, 0::BIGINT AS size, ''::VARCHAR AS side, 0.0::DOUBLE AS tr, 0.0::DOUBLE AS te
      UNION ALL SELECT o.i, o.k, o.size, CASE WHEN {frac} * total - tr >= (1.0 - {frac}) * total - te THEN 'train' ELSE 'test' END,
        CASE WHEN {frac} * total - tr >= (1.0 - {frac}) * total - te THEN tr + o.size ELSE tr END,
        CASE WHEN {frac} * total - tr >= (1.0 - {frac}) * total - te THEN te ELSE te + o.size END FROM f JOIN o ON o.i = f.i + 1)
    SELECT k, size, side FROM f WHERE i > 0"""


@query("j03_group_sides", sql_greedy("events", "user_id::VARCHAR", 0.75, "k"))
def j03(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("k"))
    return splits.group_sides(users, "k", 0.75)


@query("j03_group_sides_orders", sql_greedy("orders", "o_custkey::VARCHAR", 0.6, "k"))
def j03b(spark, d):
    return splits.group_sides(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")), "k", 0.6)


@query("j04_group_sides_seeded", sql_greedy("events", "user_id::VARCHAR", 0.75, "md5('5:' || k), k"))
def j04(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("k"))
    return splits.group_sides(users, "k", 0.75, tie_seed=5)


@query(
    "j04_group_disjoint_rows",
    sql_greedy("events", "user_id::VARCHAR", 0.75, "md5('5:' || k), k").replace(
        "SELECT k, size, side FROM f WHERE i > 0",
        "SELECT user_id, event_id, side FROM events JOIN f ON f.k = user_id::VARCHAR AND i > 0",
    ),
)
def j04b(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("user_id").cast("string").alias("k"))
    return splits.group_disjoint_split(rows, "k", 0.75, tie_seed=5).drop("k")


@query(
    "j05_job_expansion",
    "SELECT item_id::VARCHAR AS task_id, event_id AS pos, event_type AS text FROM benchmark JOIN events ON event_id % 50 = item_id",
)
def j05(spark, d):
    personas = table(spark, d, "events").select((F.col("event_id") % 50).cast("string").alias("task_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"))
    return batches.expand_jobs(tasks(spark, d), personas)


@query("j05_default_jobs", "SELECT item_id::VARCHAR AS task_id, i::INT AS pos, '' AS text FROM benchmark, range(0, 4) t(i)")
def j05b(spark, d):
    return batches.expand_jobs(tasks(spark, d), n=4)


SPLIT_TABLE = "splits AS (SELECT item_id::VARCHAR AS task_id, CASE WHEN item_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM benchmark WHERE item_id % 4 <> 0)"


def split_table(spark, d):
    i = F.col("pos")
    return tasks(spark, d).where(i % 4 != 0).select("task_id", F.when(i % 3 == 0, "test").otherwise("train").alias("split"))


@query(
    "j06_official_split",
    f"WITH {SPLIT_TABLE} SELECT o_orderkey, (o_custkey % 50)::VARCHAR AS task_id, split AS official FROM orders LEFT JOIN splits ON task_id = (o_custkey % 50)::VARCHAR",
)
def j06(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("task_id"))
    return splits.official_split(rows, split_table(spark, d))


@query(
    "j07_human_side",
    f"""WITH {SPLIT_TABLE}, dlg AS (SELECT conv_id AS dialog_id, CASE WHEN conv_id % 2 = 0 THEN 'retail' ELSE 'airline' END AS domain,
      (conv_id % 45)::VARCHAR AS task_id, count(*) AS n_turns FROM conversations GROUP BY ALL)
    SELECT dialog_id, domain, task_id, n_turns, CASE WHEN (domain = 'retail' AND EXISTS (SELECT 1 FROM splits s WHERE s.task_id = dlg.task_id AND split = 'test'))
      OR (task_id::INT % 7 = 0 AND domain = 'airline') THEN 'test' ELSE 'train' END AS side FROM dlg WHERE n_turns >= 2""",
)
def j07(spark, d):
    dialogs = conv_turns(spark, d).groupBy("dialog_id").agg(F.count("*").alias("n_turns")).select(
        "dialog_id", F.when(F.col("dialog_id") % 2 == 0, "retail").otherwise("airline").alias("domain"),
        (F.col("dialog_id") % 45).cast("string").alias("task_id"), "n_turns",
    )
    sp = split_table(spark, d).withColumn("domain", F.lit("retail"))
    val = dialogs.where((F.col("task_id").cast("int") % 7 == 0) & (F.col("domain") == "airline")).select(
        F.concat_ws(":", "domain", "task_id").alias("task_key")
    )
    return splits.human_side(dialogs, sp, val, ["retail", "airline"]).select("dialog_id", "domain", "task_id", "n_turns", "side")


@query(
    "j08_in_list_order",
    "SELECT c_custkey::VARCHAR AS task_id, c_nationkey AS pos, text FROM customer JOIN benchmark ON item_id = c_custkey",
)
def j08(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id"), F.col("c_nationkey").alias("pos"))
    return splits.in_list_order(tasks(spark, d).select("task_id", "text"), ids)


@query("j08_in_task_order", "SELECT item_id::VARCHAR AS task_id, text FROM benchmark WHERE item_id IN (SELECT o_custkey FROM orders)")
def j08b(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("task_id"))
    return splits.in_task_order(tasks(spark, d).select("task_id", "text"), ids)


@query("j09_sample_k", f"WITH {sql_rank('customer', 'c_custkey', 3)} SELECT c_custkey, c_name FROM ranked WHERE r <= 100")
def j09(spark, d):
    return splits.sample_k(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 3)


@query("j09_sample_in_split", f"WITH {sql_rank('customer', 'c_custkey', 3, 'WHERE c_nationkey < 5')} SELECT c_custkey FROM ranked WHERE r <= 50")
def j09b(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return splits.sample_k(rows, "c_custkey", 50, 3, pool=F.col("c_nationkey") < 5).select("c_custkey")


@query(
    "j10_holdout",
    f"WITH {sql_rank('customer', 'c_custkey', 0)} SELECT c_custkey, CASE WHEN r <= 40 THEN 'val' ELSE 'train' END AS part, r > 40 AND r <= 140 AS baseline FROM ranked",
)
def j10(spark, d):
    return splits.holdout(table(spark, d, "customer").select("c_custkey"), "c_custkey", 40, 100)


@query(
    "j11_sliding_batches",
    """WITH n AS (SELECT count(*) AS n, least(7, count(*)) AS bs FROM benchmark), s AS (SELECT n, bs, (n + bs - 1) // bs AS steps FROM n),
    it AS (SELECT event_id + 1 AS iteration, (event_id // steps) + 1 AS epoch, (event_id % steps) + 1 AS batch_in_epoch, steps AS steps_per_epoch, n, bs FROM events, s),
    k AS (SELECT *, i::INT AS k, (batch_in_epoch - 1) * bs + i AS p FROM it, range(0, 7) t(i) WHERE i < bs)
    SELECT iteration, epoch, batch_in_epoch, steps_per_epoch, k, item_id::VARCHAR AS task_id FROM k JOIN benchmark ON item_id = CASE WHEN p < n THEN p ELSE p - n END""",
)
def j11(spark, d):
    its = table(spark, d, "events").select((F.col("event_id") + 1).alias("iteration"))
    return batches.sliding_batches(tasks(spark, d), its, 7).withColumn("k", F.col("k").cast("int"))


@query(
    "j12_modulo_batches",
    """SELECT event_id AS batch, i::INT AS k, item_id::VARCHAR AS task_id FROM events, range(0, 6) t(i), (SELECT count(*) AS n FROM benchmark)
    JOIN benchmark ON true WHERE item_id = (event_id * 5 + i) % n AND item_id % 10 <> 9""",
)
def j12(spark, d):
    starts = table(spark, d, "events").select(F.col("event_id").alias("batch"), (F.col("event_id") * 5).alias("start"))
    ids = tasks(spark, d).select("task_id", "pos")
    return batches.modulo_batches(ids, tasks(spark, d).where("pos % 10 <> 9"), starts, 6)


@query("j13_random_batch", f"WITH {sql_rank('orders', 'o_orderkey', 11)} SELECT o_orderkey, r AS draw FROM ranked WHERE r <= 64")
def j13(spark, d):
    return splits.sample_k(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64, 11, sort=False)


@query(
    "j14_curriculum",
    """SELECT event_id, CASE WHEN pool > 100 THEN [5, 8, 10][least((it - 1) // 20, 2) + 1] WHEN ep >= 4 THEN 10 WHEN ep >= 2 THEN 8 WHEN ep >= 1 THEN 5 ELSE 10 END::INT AS n_personas
    FROM (SELECT event_id, event_id % 7 AS ep, event_id % 90 + 1 AS it, user_id AS pool FROM events)""",
)
def j14(spark, d):
    e = F.col("event_id")
    n = batches.persona_count(e % 7, e % 90 + 1, F.col("user_id"), [(1, 5), (2, 8), (4, 10)])
    return table(spark, d, "events").select("event_id", n.cast("int").alias("n_personas"))


@query(
    "j15_score_weights",
    "SELECT event_id, round(1.0 - w, 6) + 0.0 AS w_likeness, round(w, 6) + 0.0 AS w_coverage FROM (SELECT event_id, 0.5 * least(1.0, greatest(1, event_id % 13) / 10) AS w FROM events)",
)
def j15(spark, d):
    h, c = batches.score_weights(F.col("event_id") % 13, 0.5, 10)
    return table(spark, d, "events").select("event_id", r6(h, "w_likeness"), r6(c, "w_coverage"))


@query(
    "j16_nearest_attempt",
    """WITH t AS (SELECT DISTINCT user_id, event_id AS iteration FROM events WHERE event_type <> 'error'),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iteration) AS attempt FROM t),
    v AS (SELECT DISTINCT user_id, event_id AS iteration FROM events WHERE event_type = 'error')
    SELECT v.user_id, v.iteration, arg_min(attempt, abs(a.iteration - v.iteration) * 1000000000000 + a.iteration) AS attempt FROM v JOIN a USING (user_id) GROUP BY ALL""",
)
def j16(spark, d):
    ev = table(spark, d, "events").select("user_id", F.col("event_id").alias("iteration"), "event_type")
    return curves.nearest_attempt(ev.where("event_type = 'error'"), ev.where("event_type <> 'error'"), ["user_id"])


@query(
    "j17_pad_personas",
    """WITH p AS (SELECT user_id AS task_id, event_id AS pos, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), v AS (SELECT task_id, text, pos, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS i,
      count(*) OVER (PARTITION BY task_id) AS m FROM p WHERE rn <= 12 AND trim(text) <> '')
    SELECT task_id, text, s::BIGINT AS slot FROM v, range(0, 12) t(s) WHERE s % m = i""",
)
def j17(spark, d):
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), text.alias("text"))
    return batches.pad_personas(rows, 12).withColumn("slot", F.col("slot").cast("long"))


@query(
    "w08_split_views",
    f"WITH {CONV}, d AS (SELECT DISTINCT dialog_id FROM turns) SELECT dialog_id, CASE WHEN dialog_id % 4 = 0 THEN 'test' ELSE 'train' END AS view FROM d UNION ALL SELECT dialog_id, 'all' FROM d",
)
def w08(spark, d):
    dialogs = conv_turns(spark, d).select("dialog_id").distinct()
    views = splits_views(dialogs)
    out = None
    for name, df in views.items():
        tagged = df.withColumn("view", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def splits_views(dialogs):
    """Train: three of four dialogues; the test candidates overlap and get cleared."""
    return curves.split_views(dialogs.where("dialog_id % 4 <> 0"), dialogs.where("dialog_id % 2 = 0"))


@query(
    "w09_entity_counts",
    "SELECT CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id, "
    "count(DISTINCT event_type) AS n_event_type FROM events GROUP BY 1",
)
def w09(spark, d):
    rows = table(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 4 == 0, "test").otherwise("train"))
    return curves.entity_counts(rows, "side", ["user_id", "event_type"])


@query(
    "w10_domain_union",
    "SELECT c_custkey AS task_id, 'retail' AS domain, 'retail:' || c_custkey AS task_key FROM customer UNION ALL SELECT s_suppkey, 'airline', 'airline:' || s_suppkey FROM supplier",
)
def w10(spark, d):
    names = curves.domain_list("retail_airline")
    sources = [table(spark, d, "customer").select(F.col("c_custkey").alias("task_id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("task_id"))]
    return curves.domain_union(dict(zip(names, sources)))


@query("m04_fold_assignment", "SELECT label, fold, count(*) AS n FROM (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5)::INT AS fold FROM embeddings) GROUP BY ALL")
def folds(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return splits.stratified_folds(rows, "label", "vec_id", 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


