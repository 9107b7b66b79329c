"""Composed calls: from recorded dialogues to a discriminator, a human reference and a scorecard."""

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import clean, model, splits, stats
from talkprint.operators.fingerprint import fingerprint
from talkprint.operators.scorecard import CONDITIONS, Cloud, condition_metrics, episode_turns, human_ceiling, reference_cloud, report
from talkprint.sources.dialogs import read_keyed_dialogs, to_turns
from talkprint.sources.shared import settle
from talkprint.sources.tables import human_fingerprints


@dataclass
class Discriminator:
    model: PipelineModel
    folds: DataFrame
    importances: DataFrame


def train_discriminator(
    baseline: DataFrame, individual: DataFrame | None = None, episode_turns: DataFrame | None = None,
    ref_stats: DataFrame | None = None, path: str | None = None, features: list[str] = FEATURES, **forest,
) -> Discriminator:
    """Choose the human source, cross-validate, fit, rank the features and save.

    ``baseline`` holds simulated fingerprints; rows without any feature are left
    out, and none at all is an error.
    """
    human = settle(human_fingerprints(individual, episode_turns, ref_stats), "humans")
    simulated = settle(baseline.where(F.coalesce(*[f for f in features if f in baseline.columns]).isNotNull()), "baseline")
    if simulated.isEmpty():
        raise ValueError("no fingerprints in the baseline")
    folds = model.cross_validation(human, simulated, features=features, **forest)
    fitted = model.fit_discriminator(human, simulated, features=features, **forest)
    if path is not None:
        model.save_model(fitted, path)
    return Discriminator(fitted, folds, model.importances(baseline.sparkSession, fitted))


def human_reference(
    spark: SparkSession, path, official: DataFrame, val_ids: DataFrame, domains: list[str], side: str = "train", layout: str = "object"
) -> DataFrame:
    """``ref_stats`` of the human dialogues of several domains on one side of the split.

    Keyed dialogue files of ``domains`` are read, leading setup turns stripped,
    instance keys turned into task ids and dialogues placed by ``official(domain,
    task_id, split)`` and ``val_ids(task_key)``.
    """
    rows = None
    for domain in domains:
        turns = to_turns(read_keyed_dialogs(spark, path, domain, layout).withColumnRenamed("instance_id", "dialog_id"))
        fps = fingerprint(clean.strip_leading_setup(turns)).select(
            "*", F.lit(domain).alias("domain"), clean.instance_task_id(F.col("dialog_id"), domain).alias("task_id"),
            F.col("n_messages").alias("n_turns"),
        )
        rows = fps if rows is None else rows.unionByName(fps)
    placed = settle(splits.human_side(rows, official, val_ids, domains).where(F.col("side") == side), "human-reference")
    parts = [stats.population_stats(placed.where(F.col("domain") == d), f"human {side}", d) for d in domains]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Scorecard:
    metrics: DataFrame
    table: DataFrame
    ceiling: DataFrame
    held_out: DataFrame


def held_out_auc(human_test: DataFrame, episodes: DataFrame, base: str = "default") -> DataFrame:
    """The discriminator on humans it has not seen, against the base simulator: one row ``(auc, n_pos, n_neg)``."""
    rows = human_test.select("p_human", F.lit(1).alias("label")).unionByName(
        episodes.where(F.col("condition") == base).select("p_human", F.lit(0).alias("label"))
    )
    return model.exact_auc(rows, "p_human", "label")


def scorecard(
    episodes: DataFrame, turns: DataFrame, human_train: DataFrame, human_test: DataFrame, fitted: PipelineModel | None = None,
    coverage_ref: str = "train+test", standardize: bool = True, features: list[str] = FEATURES, compress: int = 0,
    expected: list[str] = CONDITIONS, role: str = "user",
) -> Scorecard:
    """Everything a benchmark reports, from recorded episodes.

    ``episodes(episode_id, condition, task_id, success, reward, n_turns)`` and
    their ``turns(episode_id, turn, role, content)`` are fingerprinted and
    scored with ``fitted``; without a model the given ``p_human`` columns stay.
    """
    fps = fingerprint(turns.withColumnRenamed("episode_id", "dialog_id"), role).withColumnRenamed("dialog_id", "episode_id")
    joined = episode_turns(episodes, turns).join(fps, "episode_id")
    if fitted is not None:
        joined, human_test = model.score(fitted, joined.drop("p_human")), model.score(fitted, human_test.drop("p_human"))
    joined, human_test = settle(joined, "episodes"), settle(human_test, "held-out")
    train = settle(human_train, "humans")
    shared = [c for c in human_test.columns if c in train.columns]
    reference = reference_cloud(train.select(shared), human_test.select(shared), coverage_ref)
    cloud = Cloud(reference, train, features, standardize, compress)
    metrics = settle(condition_metrics(joined, cloud), "metrics")
    return Scorecard(
        metrics, report(metrics, expected), human_ceiling(train, human_test, features, standardize), held_out_auc(human_test, joined)
    )
