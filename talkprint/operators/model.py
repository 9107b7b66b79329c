"""The human-versus-simulator discriminator on Spark ML."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators.ordering import range_bucket, sample_bounds
from talkprint.operators.splits import stratified_folds
from talkprint.sources.shared import settle

# --- fixed values: forest defaults -------------------------------------------
NUM_TREES = 200
MAX_DEPTH = 12
SEED = 42


def training_set(human: DataFrame, simulated: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Both populations stacked, label 1 = human, 0 = simulator.

    ``row_id`` is the dialogue id under a prefix per class, so the same id may
    occur in both.
    """

    def side(df, label, prefix):
        return df.select(
            F.concat(F.lit(prefix), F.col("dialog_id").cast("string")).alias("row_id"),
            *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features],
            F.lit(label).alias("label"),
        )

    return side(human, 1.0, "h:").unionByName(side(simulated, 0.0, "s:"))


def class_weights(labelled: DataFrame) -> DataFrame:
    """Adds ``weight`` = n / (2 * n_class).

    The input is written once, as the sizes and the rows are two reads of it, and so
    are the many passes of a fit; the sizes of the two classes become constants.
    """
    labelled = settle(labelled, "labelled")
    sizes = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n, weight = sum(sizes.values()), F.lit(None).cast("double")
    for label, size in sizes.items():
        weight = F.when(F.col("label") == label, n / (2.0 * size)).otherwise(weight)
    return labelled.withColumn("weight", weight)


def _forest(num_trees, max_depth, max_features, features):
    """A single tree sees every row; the trees of a forest draw theirs."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=SEED,
        numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy=str(max_features),
        bootstrap=num_trees > 1,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest])


def fit_discriminator(
    human: DataFrame,
    simulated: DataFrame,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    max_features: int | str = "sqrt",
    features: list[str] = FEATURES,
) -> PipelineModel:
    """Balanced random forest.  Trees ignore scale, so no scaler stage is needed."""
    data = class_weights(training_set(human, simulated, features))
    return _forest(num_trees, max_depth, max_features, features).fit(data)


def score(model: PipelineModel | None, fps: DataFrame, out: str = "p_human") -> DataFrame:
    """P(human) for every fingerprint."""
    if model is None:
        raise RuntimeError("the discriminator is not trained")
    added = ["features", "rawPrediction", "probability", "prediction"]
    scored = model.transform(fps).withColumn(out, vector_to_array("probability")[1])
    return scored.drop(*added)


def importances(spark: SparkSession, model: PipelineModel, top: int = 12) -> DataFrame:
    """The ``top`` features by importance, descending, with ``rank``."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(feature_order(model), values), key=lambda t: -t[1])[:top]
    return spark.createDataFrame(
        [(i + 1, name, float(v)) for i, (name, v) in enumerate(ranked)], "rank int, feature string, importance double"
    )


def cross_validation(
    human: DataFrame, simulated: DataFrame, num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH,
    max_features: int | str = "sqrt", features: list[str] = FEATURES, parallelism: int = 5,
) -> DataFrame:
    """One row per fold ``(fold, auc)``; empty below four rows.

    k = min(5, max(2, n // 2)); folds are even inside each class, and the class
    weights are those of each training part.  Up to ``parallelism`` folds are
    fitted side by side: a fit is many short jobs that leave executors idle.
    """
    data = settle(training_set(human, simulated, features), "training-set")
    n = data.count()
    k = min(5, max(2, n // 2)) if n >= 4 else 0
    folded = settle(stratified_folds(data, "label", "row_id", max(k, 1)), "folds")
    spark = data.sparkSession

    def held_out(fold: int) -> tuple[int, float]:
        model = _forest(num_trees, max_depth, max_features, features).fit(class_weights(folded.where(F.col("fold") != fold)))
        held = score(model, folded.where(F.col("fold") == fold))
        return fold, exact_auc(held, "p_human", "label").first().auc

    found = []
    if k:
        with ThreadPoolExecutor(max(1, min(k, parallelism))) as pool:
            found = list(pool.map(inheritable_thread_target(held_out), range(k)))
    return spark.createDataFrame(found, "fold int, auc double")


def fold_aucs(scored: DataFrame, score_col: str, label: str, fold: str, k: int) -> DataFrame:
    """``(fold, auc)`` of given scores, fold by fold."""
    parts = [
        exact_auc(scored.where(F.col(fold) == i), score_col, label).select(F.lit(i).alias("fold"), "auc") for i in range(k)
    ]
    return reduce(DataFrame.unionByName, parts)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the fold AUCs."""
    return folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def exact_auc(rows: DataFrame, score_col: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row ``(auc, n_pos, n_neg)``, the Mann-Whitney statistic, ties count half.

    Rows collapse to distinct scores first.  Ranges of those scores, as many as
    there are shuffle partitions, then let the running count of negatives be
    taken range by range, so the whole table never meets in one window.
    """
    pos = F.col(label) == 1
    by_score = settle(
        rows.groupBy(F.col(score_col).alias("s")).agg(F.count(F.when(pos, 1)).alias("p"), F.count(F.when(~pos, 1)).alias("q")), "scores"
    )
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = by_score.withColumn("b", range_bucket(F.col("s"), sample_bounds(by_score, "s", buckets)))
    below = F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    ahead = Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("b").agg(F.sum("q").alias("q")).select("b", F.sum("q").over(ahead).alias("_before"))
    wins = placed.withColumn("_in", below).join(F.broadcast(carried), "b").select(
        "p", "q",
        (F.col("p") * (F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0)) + F.col("q") / 2.0)).alias("w"),
    )
    total = wins.agg(F.sum("w").alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return total.select(
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        "n_pos", "n_neg",
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Assembler (with its feature order) and forest, in Spark ML's own format."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_order(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()
