import json

import pytest
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import evaluation, model, scorecard


def fingerprints(spark, n, shift):
    rows = [tuple([f"d{i}", 4] + [float(shift + (i * (k + 3)) % 7) for k in range(19)]) for i in range(n)]
    return spark.createDataFrame(rows, "dialog_id string, n_messages long, " + ", ".join(f"{f} double" for f in FEATURES))


def test_train_discriminator(spark, tmp_path):
    human, base = fingerprints(spark, 12, 100), fingerprints(spark, 12, 0)
    base = base.unionByName(base.limit(1).select("dialog_id", "n_messages", *[F.lit(None).cast("double").alias(f) for f in FEATURES]))
    got = evaluation.train_discriminator(base, individual=human, path=str(tmp_path / "m"), num_trees=10, max_depth=3)
    assert [r.auc for r in got.folds.collect()] == [1.0] * 5 and got.importances.count() == 12
    assert min(r.p_human for r in model.score(model.load_model(str(tmp_path / "m")), human).collect()) > 0.9
    with pytest.raises(ValueError, match="no fingerprints"):
        evaluation.train_discriminator(base.limit(0), individual=human)
    with pytest.raises(ValueError, match="no human reference"):
        evaluation.train_discriminator(base)


def test_scorecard_from_recorded_episodes(spark):
    turns = [(e, i, r, f"please do thing {e} {i}") for e in range(8) for i, r in enumerate(["user", "assistant", "user"])]
    turns = spark.createDataFrame(turns, "episode_id int, turn long, role string, content string")
    eps = [(e, scorecard.CONDITIONS[e % 2 * 3], f"t{e % 3}", e % 2 == 0, 0.5, None if e else 7, 0.0) for e in range(8)]
    eps = spark.createDataFrame(eps, "episode_id int, condition string, task_id string, success boolean, reward double, n_turns int, p_human double")
    human = fingerprints(spark, 9, 2)
    sims = fingerprints(spark, 9, 50)
    fitted = model.fit_discriminator(human, sims, num_trees=5, max_depth=2)
    card = evaluation.scorecard(eps, turns, human, human.limit(4), fitted, compress=3, expected=["default", "evolved"])
    rows = {r.condition: r for r in card.metrics.collect()}
    assert set(rows) == {"default", "evolved"} and rows["default"].n == 4 and rows["default"].turns == 4.0
    assert [r.partial for r in card.table.collect()] == [False, False]
    assert card.ceiling.first().n == 4 and card.held_out.first().n_neg == 4 and 0 <= card.held_out.first().auc <= 1


@pytest.mark.parametrize("layout", ["object", "lines"])
def test_human_reference_over_domains(spark, tmp_path, layout):
    def conversation(text):
        roles = ["user", "assistant", "user"]
        return {"conversation": [{"role": r, "content": f"{text} {i}"} for i, r in enumerate(roles)]}

    keyed = {"retail_1_ann1": conversation("a b c"), "retail_2_ann1": conversation("only test"), "airline_7": conversation("x")}
    keyed["airline_8"] = conversation("held out now")
    text = json.dumps(keyed) if layout == "object" else "\n".join(json.dumps({k: v}) for k, v in keyed.items())
    (tmp_path / "h.json").write_text(text)
    official = spark.createDataFrame([("retail", "2", "test"), ("airline", "7", "train")], "domain string, task_id string, split string")
    val = spark.createDataFrame([("airline:8",)], "task_key string")
    got = evaluation.human_reference(spark, str(tmp_path / "h.json"), official, val, ["retail", "airline"], layout=layout)
    words = {(r.domain, r.n): r["mean"] for r in got.where("feature = 'words_per_turn'").collect()}
    assert words == {("retail", 1): 4.0, ("airline", 1): 2.0}
