"""Benchmark scorecards over recorded episodes.

``episodes`` has one row per episode: ``condition, task_id, success, reward,
n_turns, p_human`` and the feature columns.  The human cloud is a fingerprint
table.  Everything per condition is one map-side combined aggregate; only the
coverage goes through the distance cells.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprint.functions import text as T
from talkprint.functions.banks import FEATURES
from talkprint.operators import stats
from talkprint.operators.distance import compress_cloud, mean_task_chamfer, overall_chamfer, reference_spread
from talkprint.sources.shared import settle

# --- fixed values: report order and labels -----------------------------------
CONDITIONS = ["default", "dp", "initial", "evolved"]
LABELS = {
    "default": "Base-simulator", "dp": "DP Personas", "initial": "Initial generator", "evolved": "Evolved generator",
}


def episode_turns(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``n_turns`` of 0 or null falls back to the number of messages."""
    sizes = turns.groupBy("episode_id").agg(F.count("*").alias("_len"))
    n = F.coalesce(F.nullif("n_turns", F.lit(0)), "_len", F.lit(0))
    return episodes.join(sizes, "episode_id", "left").withColumn("n_turns", n).drop("_len")


def baseline_summary(episodes: DataFrame) -> DataFrame:
    """One row ``(n_episodes, success_rate)``, rate 0 without episodes."""
    return episodes.agg(
        F.count("*").alias("n_episodes"),
        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def reference_cloud(train: DataFrame, test: DataFrame | None, policy: str = "train+test") -> DataFrame:
    """The humans a method is scored against; a missing test set falls back to train."""
    if policy == "train" or test is None:
        return train
    return test if policy == "test" else train.unionByName(test)


class Cloud:
    """A human reference: scaled vectors, their spread, the scaler and the means.

    ``scale_from`` is always the train humans; ``standardize=False`` keeps the
    raw feature space.  ``compress`` turns the scaled cloud into k centroids.
    """

    def __init__(self, humans, scale_from, features=FEATURES, standardize=True, compress=0):
        self.features, self.dim = list(features), len(features)
        self.scaler = (
            stats.fit_scaler(stats.assemble(scale_from, self.features), self.dim) if standardize else None
        )
        self.points = settle(self.place(humans).select("vec"), "points")
        if compress:
            self.points = compress_cloud(self.points, compress)
        self.spread = reference_spread(self.points)
        self.ref_stats = stats.population_stats(
            humans.withColumn("n_messages", F.lit(1)), features=self.features
        )

    def place(self, fps: DataFrame) -> DataFrame:
        """Fingerprints as vectors in the cloud's space."""
        rows = stats.assemble(fps, self.features)
        return rows if self.scaler is None else stats.apply_scaler(rows, self.scaler, self.dim)


def condition_metrics(episodes: DataFrame, cloud: Cloud) -> DataFrame:
    """One row per condition."""
    ok = F.col("success").cast("double")
    base = episodes.groupBy("condition").agg(
        F.count("*").alias("n"),
        F.avg("p_human").alias("p_human"),
        stats.half_width(F.col("p_human")).alias("p_human_ci"),
        F.avg(ok).alias("success"),
        stats.half_width(ok).alias("success_ci"),
        F.avg("reward").alias("reward"),
        stats.half_width(F.col("reward")).alias("reward_ci"),
        F.avg("n_turns").alias("turns"),
    )
    placed = cloud.place(episodes).select("condition", "task_id", "vec")
    coverage = mean_task_chamfer(placed, cloud.points, cloud.spread, "task_id", ["condition"])
    dice = stats.dice_alignment(episodes, cloud.ref_stats, ["condition"])
    return base.join(coverage, "condition").join(dice, "condition")


def human_ceiling(train: DataFrame, test: DataFrame, features=FEATURES, standardize=True) -> DataFrame:
    """Held-out humans as one group against the train cloud; no row without a test set."""
    cloud = Cloud(train, train, features, standardize)
    covered = overall_chamfer(cloud.place(test).select("vec"), cloud.points, cloud.spread)
    cols = [F.count("*").alias("n")]
    if "p_human" in test.columns:
        cols.append(F.avg("p_human").alias("p_human"))
    row = test.agg(*cols).where(F.col("n") > 0)
    dice = stats.overall_dice(test, cloud.ref_stats)
    return row.withColumn("chamfer", covered.scalar()).withColumn(
        "_d", dice.select(F.struct(*dice.columns)).scalar()
    ).select("*", "_d.*").drop("_d")


def composite(likeness: Column, coverage: Column) -> Column:
    """Equal-weight score."""
    return 0.5 * likeness + 0.5 * coverage


def deltas(metrics: DataFrame, base: str = "default", against: str = "evolved") -> DataFrame:
    """Differences of two conditions; no row unless both exist."""
    cols = ["p_human", "chamfer", "success", "reward"]
    both = metrics.where(F.col("condition").isin(base, against)).agg(
        F.count("*").alias("_n"),
        *[
            (F.max(F.when(F.col("condition") == against, F.col(c))) - F.max(F.when(F.col("condition") == base, F.col(c)))).alias(f"d_{c}")
            for c in cols
        ],
    )
    return both.where(F.col("_n") == 2).drop("_n")


def report(metrics: DataFrame, expected: list[str] = CONDITIONS) -> DataFrame:
    """The rows in report order with labels, rounded text cells and ``partial``.

    Conditions outside the known ones have no place in the report.
    """
    known = metrics.where(F.col("condition").isin(CONDITIONS))
    have = known.select(F.count_distinct(F.when(F.col("condition").isin(expected), F.col("condition")))).scalar()
    place = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    for i, c in enumerate(CONDITIONS):
        place = F.when(F.col("condition") == c, i + 1).otherwise(place)
        label = F.when(F.col("condition") == c, LABELS[c]).otherwise(label)

    def fixed(c, d=3, scale=1):
        return T.fixed(F.col(c) * scale, d)

    def pm(c, ci, d=3, scale=1, unit=""):
        return F.concat(fixed(c, d, scale), F.lit(unit + "±"), fixed(ci, d, scale))

    return known.select(
        place.alias("place"), label.alias("simulator"), "n",
        pm("p_human", "p_human_ci").alias("p_human"), fixed("chamfer").alias("chamfer"),
        *[fixed(d).alias(d) for d in stats.DIMS], fixed("overall").alias("d_avg"),
        pm("success", "success_ci", 1, 100, "%").alias("success"),
        pm("reward", "reward_ci").alias("reward"), fixed("turns", 1).alias("turns"),
        T.fixed(composite(F.col("p_human"), F.col("chamfer")), 3).alias("score"),
        (have < len(expected)).alias("partial"),
    ).orderBy("place")


def weighted_fitness(metrics: DataFrame, w_likeness: float, w_coverage: float) -> DataFrame:
    """Combined score per group; missing parts count as zero."""
    hl, cov = F.coalesce("p_human", F.lit(0.0)), F.coalesce("chamfer", F.lit(0.0))
    return metrics.withColumn("combined", w_likeness * hl + w_coverage * cov)


def pass_rates(outcomes: DataFrame, threshold: float = 0.999) -> DataFrame:
    """``(episode_id, reward, success)`` from recorded test outcomes.

    ``outcomes(episode_id, case_id, expected, actual, blocked)``; a case passes
    when the expected value is non-null and equal; blocked code or no cases
    (``case_id`` null) earn 0.
    """
    passed = F.col("expected").isNotNull() & F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    rate = F.when(
        F.max(F.coalesce("blocked", F.lit(False))) | (F.count("case_id") == 0), F.lit(0.0)
    ).otherwise(F.count(F.when(passed, 1)) / F.count("case_id"))
    return outcomes.groupBy("episode_id").agg(rate.alias("reward")).withColumn("success", F.col("reward") >= threshold)


def surviving(jobs: DataFrame, episodes: DataFrame, by: str = "condition") -> DataFrame:
    """Per group the jobs, the finished episodes and the failures; metrics use survivors only."""
    done = episodes.select("job_id", F.lit(1).alias("_ok"), "reward")
    return jobs.join(done, "job_id", "left").groupBy(by).agg(
        F.count("*").alias("n_jobs"),
        F.count("_ok").alias("n_episodes"),
        F.count(F.when(F.col("_ok").isNull(), 1)).alias("n_failed"),
        F.avg("reward").alias("reward"),
    )


def policy_score(episodes: DataFrame, ref_stats: DataFrame) -> DataFrame:
    """One row for a policy's scored episodes; zeros when there are none."""
    zero = F.lit(0.0)
    row = episodes.agg(
        F.count("*").alias("n_episodes"),
        F.coalesce(F.avg("p_human"), zero).alias("human_likeness"),
        F.coalesce(F.avg(F.col("success").cast("double")), zero).alias("success_rate"),
    )
    dice = stats.overall_dice(episodes, ref_stats)
    return (
        row.withColumn("combined_score", F.col("human_likeness"))
        .withColumn("_d", dice.select(F.struct(*stats.DIMS)).scalar())
        .select("*", *[F.col(f"_d.{d}").alias(f"dice_{d.lower()}") for d in stats.DIMS])
        .drop("_d")
    )


