"""Population statistics and dimension-wise alignment of fingerprints."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprint.functions.banks import DIMENSIONS, FEATURES

DIMS = list(DIMENSIONS)


def dimension_table(spark: SparkSession) -> DataFrame:
    """The feature-to-dimension map, one row per feature in vector order."""
    rows = [(f, d) for d, names in DIMENSIONS.items() for f in names]
    return spark.createDataFrame(
        [(f, d, i) for i, (f, d) in enumerate(rows)], "feature string, dim string, pos int"
    )


def long_form(wide: DataFrame, ids: list[str], features: list[str], value: str = "value") -> DataFrame:
    return wide.unpivot(ids, features, "feature", value)


def population_stats(
    fps: DataFrame, source: str = "custom", domain: str = "custom", features: list[str] = FEATURES
) -> DataFrame:
    """``ref_stats(source, domain, feature, mean, std, n)``.

    Population standard deviation over dialogues with a non-empty trace; one
    map-side combined aggregate.  Raises when there is nothing to describe.
    """
    row = fps.where(F.col("n_messages") > 0).agg(
        F.count("*").alias("n"),
        *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features],
    )
    # In a filter, so that a caller's choice of columns cannot prune the check away.
    none = F.raise_error(F.lit("no fingerprints computed"))
    checked = row.where(F.when(F.col("n") > 0, F.lit(True)).otherwise(none))
    return long_form(checked, ["n"], features).select(
        F.lit(source).alias("source"), F.lit(domain).alias("domain"), "feature", "value.mean", "value.std", "n"
    )


def neutral_prior(spark: SparkSession, features: list[str] = FEATURES) -> DataFrame:
    """Zero means over zero dialogues, for when no reference exists."""
    return spark.createDataFrame(
        [("none", "none", f, 0.0, 0.0, 0) for f in features],
        "source string, domain string, feature string, mean double, std double, n long",
    )


def mean_fingerprint(fps: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Per-feature mean of every group."""
    return fps.groupBy(*by).agg(*[F.avg(f).alias(f) for f in features])


def dice(m: Column, h: Column) -> Column:
    """2*min/(sum) of the magnitudes, 1.0 when both vanish."""
    m, h = F.abs(m), F.abs(h)
    return F.when(m + h < 1e-12, F.lit(1.0)).otherwise(2.0 * F.least(m, h) / (m + h))


def dice_per_feature(means: DataFrame, ref_stats: DataFrame, by: list[str], features=FEATURES) -> DataFrame:
    """One row per group and feature; a feature missing on either side reads as 0.

    ``ref_stats`` must hold one reference: a feature that occurs twice fails.
    """
    spark = means.sparkSession
    names = [f for f in features if f in means.columns]
    long = long_form(means, by, names, "m")
    several = F.raise_error(F.lit("ref_stats holds several references: keep one source and domain"))
    ref = (
        ref_stats.groupBy("feature").agg(F.count("*").alias("_n"), F.max("mean").alias("h"))
        .where(F.when(F.col("_n") > 1, several).otherwise(F.lit(True))).drop("_n")
    )
    dims = dimension_table(spark).select("feature", "dim")
    return (
        long.join(F.broadcast(dims), "feature")
        .join(ref, "feature", "left")
        .select(*by, "feature", "dim", dice(F.coalesce("m", F.lit(0.0)), F.coalesce("h", F.lit(0.0))).alias("dice"))
    )


def dice_alignment(fps: DataFrame, ref_stats: DataFrame, by: list[str]) -> DataFrame:
    """Aggregate first, then Dice per feature, mean per dimension, mean of the four."""
    per_dim = (
        dice_per_feature(mean_fingerprint(fps, by), ref_stats, by)
        .groupBy(*by)
        .agg(*[F.avg(F.when(F.col("dim") == d, F.col("dice"))).alias(d) for d in DIMS])
    )
    return per_dim.withColumn("overall", sum(F.col(d) for d in DIMS) / len(DIMS))


def overall_dice(fps: DataFrame, ref_stats: DataFrame) -> DataFrame:
    """P04 for a single pool: one row, all zeros when the pool is empty."""
    one = fps.withColumn("_g", F.lit(1))
    scored = dice_alignment(one, ref_stats, ["_g"])
    return scored.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in [*DIMS, "overall"]])


def assemble(fps: DataFrame, features: list[str] = FEATURES, out: str = "vec") -> DataFrame:
    """Features as one dense array in the given order, absent = 0.0."""
    cols = [F.coalesce(F.col(f), F.lit(0.0)) if f in fps.columns else F.lit(0.0) for f in features]
    return fps.withColumn(out, F.array(*[c.cast("double") for c in cols]))


def fit_scaler(points: DataFrame, dim: int, vec: str = "vec", floor: float = 1e-9) -> DataFrame:
    """One row of arrays ``mu`` and ``sd``; a spread below ``floor`` becomes 1."""
    x = [F.col(vec)[i] for i in range(dim)]
    row = points.agg(
        F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*[F.stddev_pop(c) for c in x]).alias("sd")
    )
    return row.withColumn("sd", F.transform("sd", lambda s: F.when(s < floor, F.lit(1.0)).otherwise(s)))


def apply_scaler(points: DataFrame, scaler: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """z-score ``vec``.

    The fitted scaler is a model of ``2 * dim`` numbers, so it is read once and
    becomes constants of the projection, as a fitted ML stage does.
    """
    fit = scaler.first()
    z = [(F.col(vec)[i] - F.lit(fit["mu"][i])) / F.lit(fit["sd"][i]) for i in range(dim)]
    return points.withColumn(vec, F.array(*z))


def half_width(x: Column) -> Column:
    """95 % half-width, 1.96 * sample std / sqrt(n); 0 below two values."""
    return F.when(F.count(x) >= 2, 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))).otherwise(F.lit(0.0))
