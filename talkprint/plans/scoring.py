"""Registered queries S01-S10, M01-M08 and A14.

Humans are the user side of ``conversations``, simulators the assistant side.
Condition, task, outcome and the P(human) column of the value-checked queries
are arithmetic on ``conv_id``.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import evaluation, model, scorecard, stats
from talkprint.operators.fingerprint import fingerprint
from talkprint.operators.splits import stratified_folds
from talkprint.plans.bindings import (
    CONV, RATE_DIGITS, conv_turns, r6, sql_chamfer, sql_dims, sql_fp, sql_means, sql_r6, sql_scaler, sql_spread, sql_z, table, with_r6,
)
from talkprint.plans.registry import query
from talkprint.sources import tables
from talkprint.sources.shared import scratch, settle


def humans(spark, d):
    fps = settle(fingerprint(conv_turns(spark, d)), "humans")
    return fps.withColumn("split", F.when(F.col("dialog_id") % 3 == 0, "test").otherwise("train"))


def episodes(spark, d):
    i = F.col("dialog_id")
    names = F.array(*[F.lit(c) for c in scorecard.CONDITIONS])
    return settle(fingerprint(conv_turns(spark, d), "assistant"), "simulated").select(
        "dialog_id", names[(i % 4).cast("int")].alias("condition"), (i % 10).alias("task_id"),
        ((i * 37) % 101 >= 50).alias("success"), ((i * 37) % 101 / F.lit(100.0)).alias("reward"),
        F.col("n_messages").alias("n_turns"), ((i * 53) % 97 / F.lit(96.0)).alias("p_human"), *FEATURES,
    )


EP = (
    "ep AS (SELECT *, ['default', 'dp', 'initial', 'evolved'][dialog_id % 4 + 1] AS condition, dialog_id % 10 AS task_id, (dialog_id * 37) % 101 >= 50 AS success, "
    "((dialog_id * 37) % 101) / 100.0 AS reward, n_messages AS n_turns, ((dialog_id * 53) % 97) / 96.0 AS p_human FROM s_fp)"
)
BASE = f"{sql_fp(CONV)}, {sql_fp('', 'assistant', p='s_')}, {EP}"


def _hw(x: str) -> str:
    return f"CASE WHEN count({x}) < 2 THEN 0.0 ELSE 1.96 * stddev_samp({x}) / sqrt(count({x})) END"


METRIC_COLS = ["p_human", "p_human_ci", "success", "success_ci", "reward", "reward_ci", "turns", "chamfer", *stats.DIMS, "overall"]
METRICS = f"""{BASE}, {sql_scaler('fp', where='WHERE dialog_id % 3 <> 0')},
h AS (SELECT dialog_id, {sql_z()} AS vec FROM fp CROSS JOIN scaler), {sql_spread('h', 'dialog_id')},
p AS (SELECT condition || ':' || task_id AS grp, dialog_id, {sql_z()} AS vec FROM ep CROSS JOIN scaler),
{sql_chamfer('p', 'dialog_id', 'h', 'dialog_id', 'grp')},
cov AS (SELECT split_part(grp, ':', 1) AS condition, avg(chamfer) AS chamfer FROM cham GROUP BY 1),
{sql_means('fp', 'hm')}, {sql_means('ep', 'cm', 'condition')}, {sql_dims('cm', 'hm', 'condition')},
base AS (SELECT condition, count(*) AS n, avg(p_human) AS p_human, {_hw('p_human')} AS p_human_ci, avg(success::INT) AS success,
  {_hw('success::INT')} AS success_ci, avg(reward) AS reward, {_hw('reward')} AS reward_ci, avg(n_turns) AS turns FROM ep GROUP BY condition),
met AS (SELECT * FROM base JOIN cov USING (condition) JOIN dice USING (condition))"""


def cloud(spark, d):
    h = humans(spark, d)
    train, test = h.where("split = 'train'"), h.where("split = 'test'")
    return scorecard.Cloud(scorecard.reference_cloud(train, test, "train+test"), train)


def metrics(spark, d):
    return scorecard.condition_metrics(episodes(spark, d), cloud(spark, d))


@query("s01_baseline_summary", f"WITH {BASE} SELECT count(*) AS n_episodes, round(avg(success::INT), 6) + 0.0 AS success_rate FROM ep WHERE condition = 'default'")
def s01(spark, d):
    return with_r6(scorecard.baseline_summary(episodes(spark, d).where("condition = 'default'")), ["success_rate"])


@query("s02_policy_score")
def s02(spark, d):
    h = humans(spark, d)
    ep = episodes(spark, d)
    fitted = model.fit_discriminator(h, ep.where("condition = 'default'"))
    scored = model.score(fitted, ep.where("condition = 'evolved'").drop("p_human"))
    return scorecard.policy_score(scored, stats.population_stats(h))


S02_COLS = ["human_likeness", "combined_score", "success_rate", "dice_d1", "dice_d2", "dice_d3", "dice_d4"]


@query(
    "s02_policy_score_given_p",
    f"WITH {METRICS} SELECT n AS n_episodes, round(p_human, 6) + 0.0 AS human_likeness, round(p_human, 6) + 0.0 AS combined_score, round(success, 6) + 0.0 AS success_rate, "
    "round(D1, 6) + 0.0 AS dice_d1, round(D2, 6) + 0.0 AS dice_d2, round(D3, 6) + 0.0 AS dice_d3, round(D4, 6) + 0.0 AS dice_d4 FROM met WHERE condition = 'evolved'",
)
def s02b(spark, d):
    ep = episodes(spark, d).where("condition = 'evolved'")
    return with_r6(scorecard.policy_score(ep, stats.population_stats(humans(spark, d))), S02_COLS)


@query("s03_condition_metrics", f"WITH {METRICS} SELECT condition, n, {sql_r6(METRIC_COLS)} FROM met")
def s03(spark, d):
    return with_r6(metrics(spark, d), METRIC_COLS)


def _recorded(spark, d):
    """Episodes and their turns as recorded, nothing derived yet; ``n_turns`` 0 falls back to the messages."""
    turns = conv_turns(spark, d).withColumnRenamed("dialog_id", "episode_id")
    i, names = F.col("episode_id"), F.array(*[F.lit(c) for c in scorecard.CONDITIONS])
    eps = turns.select("episode_id").distinct().select(
        "episode_id", names[(i % 4).cast("int")].alias("condition"), (i % 10).alias("task_id"), ((i * 37) % 101 >= 50).alias("success"),
        ((i * 37) % 101 / F.lit(100.0)).alias("reward"), F.lit(0).alias("n_turns"), ((i * 53) % 97 / F.lit(96.0)).alias("p_human"),
    )
    return eps, turns


def _full_scorecard(spark, d):
    h = humans(spark, d).withColumn("p_human", (F.col("dialog_id") * 31) % 89 / F.lit(88.0))
    train, test = h.where("split = 'train'"), h.where("split = 'test'")
    return evaluation.scorecard(*_recorded(spark, d), train, test, role="assistant")


@query("s03_scorecard_call", f"WITH {METRICS} SELECT condition, n, {sql_r6(METRIC_COLS)} FROM met")
def s03c(spark, d):
    return with_r6(_full_scorecard(spark, d).metrics, METRIC_COLS)


@query(
    "m07_held_out_auc",
    """WITH d AS (SELECT DISTINCT conv_id AS i FROM conversations), s AS (SELECT ((i * 31) % 89) / 88.0 AS s, true AS y FROM d WHERE i % 3 = 0
    UNION ALL SELECT ((i * 53) % 97) / 96.0, false FROM d WHERE i % 4 = 0), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM s),
    c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(mid) FILTER (y) AS rs FROM r)
    SELECT round((rs - p * (p + 1) / 2.0) / (p * q::DOUBLE), 6) + 0.0 AS auc, p AS n_pos, q AS n_neg FROM c""",
)
def m07c(spark, d):
    return _auc_row(_full_scorecard(spark, d).held_out)


@query(
    "s03_condition_metrics_raw_subset",
    f"""WITH {BASE}, h AS (SELECT dialog_id, [words_per_turn, opening_length] AS vec FROM fp), {sql_spread('h', 'dialog_id')},
    p AS (SELECT condition || ':' || task_id AS grp, dialog_id, [words_per_turn, opening_length] AS vec FROM ep), {sql_chamfer('p', 'dialog_id', 'h', 'dialog_id', 'grp')}
    SELECT split_part(grp, ':', 1) AS condition, round(avg(chamfer), 6) + 0.0 AS chamfer FROM cham GROUP BY 1""",
)
def s03b(spark, d):
    h = humans(spark, d)
    c = scorecard.Cloud(h, h, ["words_per_turn", "opening_length"], standardize=False)
    return scorecard.condition_metrics(episodes(spark, d), c).select("condition", r6("chamfer"))


@query(
    "s04_reference_cloud",
    f"WITH {sql_fp(CONV, features=['words_per_turn'])} SELECT 'train' AS policy, count(*) AS n, round(avg(words_per_turn), 6) + 0.0 AS mean FROM fp WHERE dialog_id % 3 <> 0 "
    "UNION ALL SELECT 'test', count(*), round(avg(words_per_turn), 6) + 0.0 FROM fp WHERE dialog_id % 3 = 0 "
    "UNION ALL SELECT 'train+test', count(*), round(avg(words_per_turn), 6) + 0.0 FROM fp "
    "UNION ALL SELECT 'test missing', count(*), round(avg(words_per_turn), 6) + 0.0 FROM fp WHERE dialog_id % 3 <> 0",
)
def s04(spark, d):
    h = humans(spark, d)
    train, test = h.where("split = 'train'"), h.where("split = 'test'")
    picks = {
        "train": scorecard.reference_cloud(train, test, "train"), "test": scorecard.reference_cloud(train, test, "test"),
        "train+test": scorecard.reference_cloud(train, test), "test missing": scorecard.reference_cloud(train, None, "test"),
    }
    out = None
    for name, df in picks.items():
        row = df.agg(F.count("*").alias("n"), r6(F.avg("words_per_turn"), "mean")).withColumn("policy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "s05_human_ceiling",
    f"""WITH {sql_fp(CONV)}, {sql_scaler('fp', where='WHERE dialog_id % 3 <> 0')}, h AS (SELECT dialog_id, {sql_z()} AS vec FROM fp CROSS JOIN scaler WHERE dialog_id % 3 <> 0),
    p AS (SELECT 1 AS one, dialog_id, {sql_z()} AS vec FROM fp CROSS JOIN scaler WHERE dialog_id % 3 = 0), {sql_spread('h', 'dialog_id')},
    {sql_chamfer('p', 'dialog_id', 'h', 'dialog_id', 'one')}, {sql_means('fp', 'hm', where='WHERE dialog_id % 3 <> 0')},
    {sql_means('(SELECT 1 AS one, * FROM fp WHERE dialog_id % 3 = 0)', 'cm', 'one')}, {sql_dims('cm', 'hm', 'one')}
    SELECT (SELECT count(*) FROM p) AS n, {sql_r6(['chamfer', *stats.DIMS, 'overall'])} FROM cham JOIN dice USING (one)""",
)
def s05(spark, d):
    h = humans(spark, d)
    row = scorecard.human_ceiling(h.where("split = 'train'"), h.where("split = 'test'"))
    return with_r6(row, ["chamfer", *stats.DIMS, "overall"])


@query("s06_composite", f"WITH {METRICS} SELECT condition, round(0.5 * p_human + 0.5 * chamfer, 6) + 0.0 AS score FROM met")
def s06(spark, d):
    m = metrics(spark, d)
    return m.select("condition", r6(scorecard.composite(F.col("p_human"), F.col("chamfer")), "score"))


DELTA = ["p_human", "chamfer", "success", "reward"]


@query(
    "s06_deltas",
    f"WITH {METRICS} SELECT " + ", ".join(f"round(e.{c} - b.{c}, 6) + 0.0 AS d_{c}" for c in DELTA)
    + " FROM (SELECT * FROM met WHERE condition = 'evolved') e CROSS JOIN (SELECT * FROM met WHERE condition = 'default') b",
)
def s06b(spark, d):
    return with_r6(scorecard.deltas(metrics(spark, d)), [f"d_{c}" for c in DELTA])


def _fmt(x: str, digits: int = 3) -> str:
    return f"format('{{{{:.{digits}f}}}}', {x})".replace("{{", "{").replace("}}", "}")


@query(
    "s07_report",
    f"WITH {METRICS} SELECT CASE condition WHEN 'default' THEN 1 WHEN 'dp' THEN 2 WHEN 'initial' THEN 3 ELSE 4 END::INT AS place, "
    "CASE condition WHEN 'default' THEN 'Base-simulator' WHEN 'dp' THEN 'DP Personas' WHEN 'initial' THEN 'Initial generator' ELSE 'Evolved generator' END AS simulator, n, "
    f"{_fmt('p_human')} || '±' || {_fmt('p_human_ci')} AS p_human, {_fmt('chamfer')} AS chamfer, {_fmt('D1')} AS D1, {_fmt('D2')} AS D2, {_fmt('D3')} AS D3, {_fmt('D4')} AS D4, "
    f"{_fmt('overall')} AS d_avg, {_fmt('success * 100', 1)} || '%±' || {_fmt('success_ci * 100', 1)} AS success, {_fmt('reward')} || '±' || {_fmt('reward_ci')} AS reward, "
    f"{_fmt('turns', 1)} AS turns, {_fmt('0.5 * p_human + 0.5 * chamfer')} AS score, true AS partial FROM met",
)
def s07(spark, d):
    return scorecard.report(metrics(spark, d), [*scorecard.CONDITIONS, "never run"])


@query("s08_weighted_fitness", f"WITH {METRICS} SELECT condition, round(0.7 * p_human + 0.3 * chamfer, 6) + 0.0 AS combined FROM met")
def s08(spark, d):
    return scorecard.weighted_fitness(metrics(spark, d), 0.7, 0.3).select("condition", r6("combined"))


@query(
    "s09_pass_rates",
    """WITH o AS (SELECT user_id AS episode_id, CASE WHEN user_id % 17 = 0 THEN NULL ELSE event_id END AS case_id, CASE WHEN event_id % 7 = 0 AND user_id % 4 <> 0 THEN NULL ELSE event_type END AS expected,
      CASE WHEN event_id % 5 = 0 AND user_id % 4 <> 0 THEN NULL WHEN event_id % 3 = 0 AND user_id % 4 <> 0 THEN 'click' ELSE event_type END AS actual, user_id % 13 = 0 AS blocked FROM events),
    r AS (SELECT episode_id, CASE WHEN bool_or(blocked) OR count(case_id) = 0 THEN 0.0 ELSE count(*) FILTER (expected IS NOT NULL AND expected = actual) / count(case_id) END AS reward FROM o GROUP BY episode_id)
    SELECT episode_id, round(reward, 6) + 0.0 AS reward, reward >= 0.999 AS success FROM r""",
)
def s09(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    strict = u % 4 != 0
    outcomes = table(spark, d, "events").select(
        u.alias("episode_id"), F.when(u % 17 != 0, e).alias("case_id"), F.when(~((e % 7 == 0) & strict), F.col("event_type")).alias("expected"),
        F.when((e % 5 == 0) & strict, F.lit(None).cast("string")).when((e % 3 == 0) & strict, "click").otherwise(F.col("event_type")).alias("actual"),
        (u % 13 == 0).alias("blocked"),
    )
    return with_r6(scorecard.pass_rates(outcomes), ["reward"])


@query(
    "s10_surviving_episodes",
    "SELECT o_orderpriority AS condition, count(*) AS n_jobs, count(*) FILTER (o_custkey % 6 <> 0) AS n_episodes, count(*) FILTER (o_custkey % 6 = 0) AS n_failed, "
    "round(avg(CASE WHEN o_custkey % 6 <> 0 THEN o_totalprice END), 4) + 0.0 AS reward FROM orders GROUP BY 1",
)
def s10(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("condition"))
    done = o.where("o_custkey % 6 <> 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("reward"))
    return scorecard.surviving(jobs, done).withColumn("reward", F.round("reward", 4) + 0.0)


@query(
    "s11_turn_fallback",
    "SELECT user_id AS episode_id, CASE WHEN user_id % 3 = 0 THEN count(*) ELSE user_id END AS n_turns FROM events GROUP BY user_id",
)
def turn_fallback(spark, d):
    ev = table(spark, d, "events")
    eps = ev.select(F.col("user_id").alias("episode_id")).distinct().withColumn(
        "n_turns", F.when(F.col("episode_id") % 3 == 0, 0).otherwise(F.col("episode_id"))
    )
    return scorecard.episode_turns(eps, ev.select(F.col("user_id").alias("episode_id")))


@query("a14_scorecard_sink", f"WITH {METRICS} SELECT condition, n, {sql_r6(['p_human', 'reward'])} FROM met")
def a14(spark, d):
    path = scratch(spark, "scorecard")
    tables.save_scorecard(metrics(spark, d), path)
    return with_r6(spark.read.parquet(path).select("condition", "n", "p_human", "reward"), ["p_human", "reward"])


# ------------------------------------------------------------- discriminator


def _populations(spark, d):
    turns = conv_turns(spark, d)
    return settle(fingerprint(turns), "humans"), settle(fingerprint(turns, "assistant"), "simulated")


@query(
    "m01_training_set",
    f"WITH {BASE} SELECT 'h:' || dialog_id AS row_id, 1.0::DOUBLE AS label, {sql_r6(FEATURES, RATE_DIGITS)} FROM fp UNION ALL SELECT 's:' || dialog_id, 0.0, {sql_r6(FEATURES, RATE_DIGITS)} FROM s_fp",
)
def m01(spark, d):
    return with_r6(model.training_set(*_populations(spark, d)), FEATURES, RATE_DIGITS)


@query(
    "m02_class_weights",
    f"WITH {sql_fp(CONV, features=['words_per_turn'])}, l AS (SELECT 'h:' || dialog_id AS row_id, 1 AS label FROM fp UNION ALL SELECT 's:' || dialog_id, 0 FROM fp WHERE dialog_id % 3 = 0) "
    "SELECT row_id, label::DOUBLE AS label, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)), 6) + 0.0 AS weight FROM l",
)
def m02(spark, d):
    fps = fingerprint(conv_turns(spark, d), features=["words_per_turn"])
    data = model.training_set(fps, fps.where("dialog_id % 3 = 0"), ["words_per_turn"])
    return with_r6(model.class_weights(data).select("row_id", "label", "weight"), ["weight"])


@query("m03_fit_discriminator")
def m03(spark, d):
    """Forest at the default size; the result is the number of nodes per tree."""
    fitted = model.fit_discriminator(*_populations(spark, d)).stages[-1]
    return spark.createDataFrame([(i, t.numNodes, t.depth) for i, t in enumerate(fitted.trees)], "tree int, nodes int, depth int")


@query("m04_cross_validation")
def m04(spark, d):
    return model.cross_validation(*_populations(spark, d))


@query("m05_importances")
def m05(spark, d):
    return model.importances(spark, model.fit_discriminator(*_populations(spark, d)))


@query("m06_batch_scoring")
def m06(spark, d):
    h, s = _populations(spark, d)
    return model.score(model.fit_discriminator(h, s), h).select("dialog_id", "p_human")


ONE = ["words_per_turn"]
PARTED_SQL = """SELECT 'h' AS side, conv_id AS dialog_id, 1.0::DOUBLE AS p_human FROM conversations GROUP BY conv_id
UNION ALL SELECT 's', conv_id, 0.0 FROM conversations GROUP BY conv_id"""


def _parted(spark, d):
    """Two populations that one feature parts, with one split to find: P is 0 or 1 whatever rows a tree draws."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("dialog_id")).agg(F.min("turn").alias("n"))
    none = turns.select("dialog_id", (F.col("n") * 0.0).alias("words_per_turn"))
    return none.withColumn("words_per_turn", F.col("words_per_turn") + 1), none


def _parted_scores(spark, d, fitted):
    h, s = _parted(spark, d)
    both = h.withColumn("side", F.lit("h")).unionByName(s.withColumn("side", F.lit("s")))
    return model.score(fitted, both).select("side", "dialog_id", "p_human")


@query("m03_parted_populations", PARTED_SQL)
def m03b(spark, d):
    return _parted_scores(spark, d, model.fit_discriminator(*_parted(spark, d), features=ONE))


@query("m03_tree_sizes", "SELECT i::INT AS tree, 3 AS nodes, 1 AS depth FROM range(200) t(i), (SELECT count(*) AS n FROM conversations) WHERE n > 0")
def m03c(spark, d):
    fitted = model.fit_discriminator(*_parted(spark, d), features=ONE).stages[-1]
    return spark.createDataFrame([(i, t.numNodes, t.depth) for i, t in enumerate(fitted.trees)], "tree int, nodes int, depth int")


@query("m04_parted_folds", "SELECT i::INT AS fold, 1.0::DOUBLE AS auc FROM range(5) t(i), (SELECT count(*) AS n FROM conversations) WHERE n > 0")
def m04b(spark, d):
    return model.cross_validation(*_parted(spark, d), features=ONE)


@query("m05_parted_importance", "SELECT 1 AS rank, 'words_per_turn' AS feature, 1.0::DOUBLE AS importance FROM (SELECT count(*) AS n FROM conversations) WHERE n > 0")
def m05b(spark, d):
    return with_r6(model.importances(spark, model.fit_discriminator(*_parted(spark, d), features=ONE)), ["importance"])


@query("m08_parted_saved", PARTED_SQL)
def m08b(spark, d):
    path = scratch(spark, "discriminator")
    model.save_model(model.fit_discriminator(*_parted(spark, d), features=ONE), path)
    return _parted_scores(spark, d, model.load_model(path))


KINDS = ["click", "error", "purchase", "signup", "view"]
SHARES_SQL = f"""WITH e AS (SELECT event_id, kind, (event_type = kind)::INT::DOUBLE AS flag, user_id % 2 = 0 AS human FROM events, unnest({KINDS}) k(kind)),
t AS (SELECT count(*) FILTER (human)::DOUBLE AS n1, count(*) FILTER (NOT human)::DOUBLE AS n0 FROM e WHERE kind = 'view'),
s AS (SELECT kind, flag, count(*) FILTER (human) / any_value(n1) AS a, count(*) FILTER (NOT human) / any_value(n0) AS b FROM e, t GROUP BY kind, flag)"""


def _flagged(spark, d, kind):
    """Events as fingerprints of one feature, whether they are of a kind; the populations are users of even and odd number."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("dialog_id"), (F.col("event_type") == kind).cast("double").alias("flag"), (F.col("user_id") % 2 == 0).alias("human")
    )


def _flag_tree(spark, d, kind):
    """One tree that sees all rows.  Its two leaves hold the classes' weighted shares; as classes weigh the same, one leaf
    tends to either class, so that no leaves are merged."""
    rows = _flagged(spark, d, kind)
    return model.fit_discriminator(rows.where("human"), rows.where("not human"), num_trees=1, max_features="all", features=["flag"])


def _flag_shares(spark, d, kind, fitted):
    cells = _flagged(spark, d, kind).select("flag").distinct()
    return with_r6(model.score(fitted, cells).select(F.lit(kind).alias("kind"), "flag", "p_human"), ["p_human"])


@query("m03_leaf_shares", f"{SHARES_SQL} SELECT kind, flag, round(a / (a + b), 6) + 0.0 AS p_human FROM s")
def m03d(spark, d):
    return reduce(DataFrame.unionByName, [_flag_shares(spark, d, k, _flag_tree(spark, d, k)) for k in KINDS])


@query("m08_saved_leaf_shares", f"{SHARES_SQL} SELECT kind, flag, round(a / (a + b), 6) + 0.0 AS p_human FROM s WHERE kind = 'error'")
def m08c(spark, d):
    path = scratch(spark, "discriminator")
    model.save_model(_flag_tree(spark, d, "error"), path)
    return _flag_shares(spark, d, "error", model.load_model(path))


@query("m06_scored_events", f"{SHARES_SQL} SELECT event_id AS dialog_id, round(a / (a + b), 6) + 0.0 AS p_human FROM e JOIN s USING (kind, flag) WHERE kind = 'purchase'")
def m06b(spark, d):
    fitted = _flag_tree(spark, d, "purchase")
    return with_r6(model.score(fitted, _flagged(spark, d, "purchase")).select("dialog_id", "p_human"), ["p_human"])


@query(
    "m04_fold_aucs",
    """WITH f AS (SELECT value AS s, event_type = 'purchase' AS y,
      (row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY md5('42:' || event_id), event_id::VARCHAR) - 1) % 5 AS fold FROM events),
    r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS mid FROM f),
    c AS (SELECT fold, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(mid) FILTER (y) AS rs FROM r GROUP BY fold)
    SELECT fold::INT AS fold, round((rs - p * (p + 1) / 2.0) / (p * q::DOUBLE), 6) + 0.0 AS auc FROM c""",
)
def m04c(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("row_id"), F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("double").alias("label")
    )
    folded = settle(stratified_folds(rows, "label", "row_id", 5), "folds")
    return with_r6(model.fold_aucs(folded, "s", "label", "fold", 5), ["auc"])


AUC_SQL = """WITH s AS (SELECT {score} AS s, {label} AS y FROM {src}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM s),
c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(mid) FILTER (y) AS rs FROM r)
SELECT round((rs - p * (p + 1) / 2.0) / (p * q::DOUBLE), 6) + 0.0 AS auc, p AS n_pos, q AS n_neg FROM c"""


@query("m07_exact_auc", AUC_SQL.format(score="value", label="event_type = 'purchase'", src="events"))
def m07(spark, d):
    rows = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return _auc_row(model.exact_auc(rows, "value", "label"))


@query("m07_exact_auc_ties", AUC_SQL.format(score="l_quantity", label="l_returnflag = 'R'", src="lineitem"))
def m07b(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return _auc_row(model.exact_auc(rows, "l_quantity", "label"))


def _auc_row(df):
    return df.select(r6("auc"), "n_pos", "n_neg")


@query("m08_save_load")
def m08(spark, d):
    h, s = _populations(spark, d)
    path = scratch(spark, "discriminator")
    model.save_model(model.fit_discriminator(h, s), path)
    return model.score(model.load_model(path), s).select("dialog_id", "p_human")
