import numpy as np
import pytest
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import model, scorecard, stats
from talkprint.sources.shared import settle


@pytest.fixture(scope="module")
def populations(spark):
    rng = np.random.default_rng(0)

    def make(shift, n):
        rows = [[i, 4] + [float(x) for x in rng.random(19) + shift] for i in range(n)]
        return spark.createDataFrame(rows, "dialog_id int, n_messages int, " + ", ".join(f"{f} double" for f in FEATURES))

    return make(0.35, 24), make(0.0, 20)


def test_train_score_save_load(spark, populations, tmp_path):
    human, sim = populations
    fitted = model.fit_discriminator(human, sim, num_trees=10, max_depth=4, max_features=1)
    scores = model.score(fitted, human).select("p_human").collect()
    assert len(scores) == 24 and all(0.0 <= r.p_human <= 1.0 for r in scores) and np.mean([r.p_human for r in scores]) > 0.6
    path = str(tmp_path / "model")
    model.save_model(fitted, path)
    again = model.load_model(path)
    assert model.feature_order(again) == FEATURES
    both = model.score(again, model.score(fitted, sim), "again")
    assert both.where(F.abs(F.col("again") - F.col("p_human")) > 1e-9).count() == 0
    top = model.importances(spark, fitted).collect()
    assert len(top) == 12 and [r["rank"] for r in top] == list(range(1, 13))
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    with pytest.raises(RuntimeError):
        model.score(None, sim)


def test_cross_validation(populations):
    human, sim = populations
    folds = model.cross_validation(human, sim, num_trees=10, max_depth=4)
    assert folds.count() == 5 and model.cv_summary(folds).first().mean_auc > 0.7
    assert model.cross_validation(human.limit(2), sim.limit(1), num_trees=2).count() == 0


def test_class_weights(populations):
    human, sim = populations
    got = {(r.label, round(r.weight, 6)) for r in model.class_weights(model.training_set(human, sim)).collect()}
    assert got == {(1.0, round(44 / 48, 6)), (0.0, 1.1)}


@pytest.mark.parametrize("levels", [1, 3, 10_000])
def test_exact_auc_with_ties(spark, levels):
    rng = np.random.default_rng(levels)
    data = [(float(rng.integers(levels)) / levels, int(rng.random() < 0.4)) for _ in range(700)]
    pos, neg = ([s for s, y in data if y == k] for k in (1, 0))
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    row = model.exact_auc(spark.createDataFrame(data, "s double, y int"), "s", "y", buckets=16).first()
    assert row.auc == pytest.approx(want) and (row.n_pos, row.n_neg) == (len(pos), len(neg))


def test_exact_auc_one_class(spark):
    assert model.exact_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first().auc is None


def test_scorecard(populations):
    human, sim = populations
    ep = sim.select(
        "*", F.when(F.col("dialog_id") < 1, "default").otherwise("evolved").alias("condition"), (F.col("dialog_id") % 3).alias("task_id"),
        (F.col("dialog_id") % 2 == 0).alias("success"), (F.col("dialog_id") / 20.0).alias("reward"), F.lit(6).alias("n_turns"),
        (F.col("dialog_id") / 40.0).alias("p_human"),
    )
    cloud = scorecard.Cloud(human, human)
    metrics = settle(scorecard.condition_metrics(ep, cloud))
    rows = {r.condition: r for r in metrics.collect()}
    assert rows["default"].n == 1 and rows["default"].p_human_ci == 0.0 and rows["evolved"].n == 19
    assert rows["evolved"].turns == 6.0 and rows["evolved"].success == pytest.approx(9 / 19)
    points = {k: np.array([r.vec for r in cloud.place(ep.where(F.col("condition") == k)).select("vec").collect()]) for k in ("default",)}
    h = np.array([r.vec for r in cloud.points.collect()])
    d = cloud.spread.first().d_ref
    m = np.linalg.norm(h[:, None] - points["default"][None], axis=2)
    assert rows["default"].chamfer == pytest.approx(max(0, 1 - min(1, (m.min(1).mean() + m.min(0).mean()) / (2 * d))))
    assert scorecard.deltas(metrics).count() == 1 and scorecard.deltas(metrics.where("condition = 'default'")).count() == 0
    report = scorecard.report(metrics).collect()
    assert [r.simulator for r in report] == ["Base-simulator", "Evolved generator"] and all(r.partial for r in report)
    assert not scorecard.report(metrics, ["default", "evolved"]).first().partial


def test_ceiling_and_clouds(populations):
    human, _ = populations
    train, test = human.where("dialog_id < 16"), human.where("dialog_id >= 16")
    assert scorecard.human_ceiling(train, test).first().n == 8
    assert scorecard.human_ceiling(train, test.limit(0)).count() == 0
    sizes = [scorecard.reference_cloud(train, t, p).count() for t, p in [(test, "train"), (test, "test"), (test, "train+test"), (None, "test")]]
    assert sizes == [16, 8, 24, 16]


def test_empty_policy_scores_zero(populations):
    human, sim = populations
    none = sim.limit(0).withColumn("p_human", F.lit(0.5)).withColumn("success", F.lit(True))
    row = scorecard.policy_score(none, stats.population_stats(human)).first().asDict()
    assert row.pop("n_episodes") == 0 and set(row.values()) == {0.0}
    assert tuple(scorecard.baseline_summary(none).first()) == (0, 0.0)


def test_pass_rates(spark):
    rows = [
        ("all", 1, "x", "x", False), ("half", 1, "x", "x", False), ("half", 2, "x", None, None), ("null", 1, None, None, False),
        ("blocked", 1, "x", "x", True), ("none", None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "episode_id string, case_id int, expected string, actual string, blocked boolean")
    got = {r.episode_id: (r.reward, r.success) for r in scorecard.pass_rates(df).collect()}
    assert got == {"all": (1.0, True), "half": (0.5, False), "null": (0.0, False), "blocked": (0.0, False), "none": (0.0, False)}


def test_surviving_and_turn_fallback(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "job_id int, condition string")
    eps = spark.createDataFrame([(1, 0.5)], "job_id int, reward double")
    got = {r.condition: (r.n_jobs, r.n_episodes, r.n_failed, r.reward) for r in scorecard.surviving(jobs, eps).collect()}
    assert got == {"a": (2, 1, 1, 0.5), "b": (1, 0, 1, None)}
    ep = spark.createDataFrame([("x", 0), ("y", 9), ("z", None)], "episode_id string, n_turns int")
    turns = spark.createDataFrame([("x",), ("x",), ("y",)], "episode_id string")
    assert {r.episode_id: r.n_turns for r in scorecard.episode_turns(ep, turns).collect()} == {"x": 2, "y": 9, "z": 0}


def test_entity_counts_by_bitmaps(spark):
    from talkprint.operators import curves

    rows = [("a", 1, "x", 1 << 60), ("a", 1, "y", -5), ("a", None, "x", 7), ("b", -40000, None, 7), (None, 5, "x", None)]
    df = spark.createDataFrame(rows * 900, "side string, n long, s string, far long")
    got = curves.entity_counts(df, "side", ["n", "s", "far"])
    assert {tuple(r) for r in got.collect()} == {("a", 2700, 1, 2, 3), ("b", 900, 1, 0, 1), (None, 900, 1, 1, 0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan
