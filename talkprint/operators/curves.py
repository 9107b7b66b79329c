"""Training and validation curves, samples for reflection, run control tables.

``keys`` names the columns that identify a run; it may be empty.  Runs may be of
any length: per-run orderings use the two-level forms of
:mod:`talkprint.operators.ordering`.
"""

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprint.operators.ordering import running_max, running_sum

# --- fixed values ------------------------------------------------------------
DEFAULT_PERSONAS = 10
VAL_THRESHOLD = 0.7


def attempt_index(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Distinct iterations of a run become 1..k."""
    its = curve.select(*keys, "iteration").distinct()
    return running_sum(its, keys, "iteration", F.lit(1), "attempt")


def nearest_attempt(val: DataFrame, train: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Validation iteration to the attempt number of the nearest train iteration,
    ties to the smaller one.  Without train iterations of its run it maps to itself."""
    idx = attempt_index(train, keys).withColumn("_t", F.lit(True))
    both = (
        val.select(*keys, "iteration").distinct().join(idx, [*keys, "iteration"], "full")
        .join(val.select(*keys, "iteration").distinct().withColumn("_wanted", F.lit(True)), [*keys, "iteration"], "left")
    )
    it = F.col("iteration")
    here = F.when(F.col("_t"), F.struct("iteration", "attempt"))
    lower = running_max(both, keys, "iteration", here, "lo")
    mirrored = lower.withColumn("_neg", -it)
    upper = running_max(mirrored, keys, "_neg", F.when(F.col("_t"), F.struct(F.col("_neg").alias("n"), "attempt")), "hi")
    below, above = it - F.col("lo.iteration"), -F.col("hi.n") - it
    pick = F.when(F.col("hi").isNull() | (below <= above), F.col("lo.attempt")).otherwise(F.col("hi.attempt"))
    return upper.where("_wanted").select(*keys, "iteration", F.coalesce(pick, it).alias("attempt"))


def train_score(final: str = "final_combined_score", train: str = "train_combined") -> Column:
    """The score of a training row: the final one, else that of the training set, else 0."""
    return F.coalesce(F.col(final), F.col(train), F.lit(0.0))


def finite(col: str) -> Column:
    v = F.expr(f"try_cast(`{col}` as double)")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def validation_band(rows: DataFrame, field: str, keys: list[str] = ()) -> DataFrame:
    """Mean, min and max per iteration over all groups; non-finite and unparsable drop."""
    return (
        rows.select(*keys, F.coalesce("iteration", F.lit(0)).alias("iteration"), finite(field).alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*keys, "iteration")
        .agg(F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )


def validation_by_n(rows: DataFrame, field: str) -> DataFrame:
    """The validation curve by persona count, absent = 10."""
    n = F.coalesce("n_personas", F.lit(DEFAULT_PERSONAS)).alias("n_personas")
    return rows.groupBy(n, "iteration").agg(F.count("*").alias("n_points"), F.avg(field).alias("mean"))


def best_worst(pool: DataFrame, batch: str, score: str, pos: str) -> DataFrame:
    """Up to four rows per batch with ``slot``: best, second best, worst, second worst.

    Fewer than four rows repeat.  Batches without any score give their first
    four rows.  All ranks are pruned to four rows per batch and task.
    """

    def ranked(df, *order, limit):
        rank = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
        return df.withColumn("_rn", rank).where(F.col("_rn") <= limit)

    scored = pool.where(F.col(score).isNotNull())
    top = ranked(scored, F.desc(score), F.desc(pos), limit=2).withColumn("slot", F.col("_rn"))
    low = ranked(scored, F.asc(score), F.asc(pos), limit=2).withColumn("slot", F.col("_rn") + 2)
    unscored = pool.groupBy(batch).agg(F.count(score).alias("_s")).where(F.col("_s") == 0).select(batch)
    plain = ranked(pool.join(unscored, batch, "left_semi"), F.asc(pos), limit=4).withColumn("slot", F.col("_rn"))
    return top.unionByName(low).unionByName(plain).drop("_rn")


def stagnation(curve: DataFrame, limit: int, best: str = "best_id", keys: list[str] = ()) -> DataFrame:
    """Per iteration the start of the current run of equal ``best`` ids and whether
    it has lasted ``limit`` iterations; a limit of 0 or less switches it off."""
    prev = running_max(curve, keys, "iteration", F.struct("iteration", best), "_p", inclusive=False)
    new = F.col("_p").isNull() | ~F.col(f"_p.{best}").eqNullSafe(F.col(best))
    runs = running_max(prev.withColumn("_new", new), keys, "iteration", F.when(F.col("_new"), F.col("iteration")), "since")
    stop = (F.col("iteration") - F.col("since") >= limit) & F.lit(limit > 0)
    return runs.withColumn("stop", stop).drop("_p", "_new")


def validation_triggers(curve: DataFrame, threshold: float = VAL_THRESHOLD, keys: list[str] = ()) -> DataFrame:
    """Iterations that get a full validation: the first of a run and every score above the bar."""
    if not keys:
        first = curve.select(F.min("iteration")).scalar()
        return curve.where((F.col("iteration") == first) | (F.col("score") > threshold))
    first = curve.groupBy(*keys).agg(F.min("iteration").alias("_first"))
    return (
        curve.join(first, [*keys])
        .where((F.col("iteration") == F.col("_first")) | (F.col("score") > threshold))
        .drop("_first")
    )


def resume_offset(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The last logged iteration, 0 for an empty curve."""
    return curve.groupBy(*keys).agg(F.coalesce(F.max("iteration"), F.lit(0)).alias("offset"))


BITS_PER_ROW = 64


def entity_counts(rows: DataFrame, side: str, entities: list[str]) -> DataFrame:
    """Rows and distinct entities per side.

    Whole numbers that lie close together are counted in bitmaps, which merge before
    the shuffle: a bit for every number between the least and the greatest, if that
    is no more than ``BITS_PER_ROW`` for every row.  Other entities are counted one by
    one.  Either way no row is multiplied by the number of entities.
    """
    whole = [e for e, t in rows.dtypes if e in entities and t in ("tinyint", "smallint", "int", "bigint")]
    wide = [F.max(e).cast("double") - F.min(e).cast("double") <= F.count("*") * BITS_PER_ROW for e in whole]
    dense = {e for e, narrow in zip(whole, rows.agg(F.count("*"), *wide).first()[1:]) if narrow}
    parts = [rows.groupBy(side).agg(F.count("*").alias("n")).select(side, F.lit("n_rows").alias("what"), "n")]
    for e in entities:
        if e in dense:
            bits = rows.where(F.col(e).isNotNull()).groupBy(side, F.bitmap_bucket_number(e).alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(e)).alias("bits")
            )
            counted = bits.groupBy(side).agg(F.sum(F.bitmap_count("bits")).alias("n"))
        else:
            counted = rows.groupBy(side).agg(F.count_distinct(e).alias("n"))
        parts.append(counted.select(side, F.lit(f"n_{e}").alias("what"), "n"))
    named = [F.coalesce(F.max(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in ["n_rows", *(f"n_{e}" for e in entities)]]
    return functools.reduce(DataFrame.unionByName, parts).groupBy(side).agg(*named)


# --- fixed values: multi-domain selectors ------------------------------------
DEFAULT_DOMAIN = "retail"
DOMAIN_ALIASES = {
    "retail_airline": ["retail", "airline"],
    "airline_retail": ["airline", "retail"],
    "combined_retail_airline": ["retail", "airline"],
}


def domain_list(selector: str | None) -> list[str]:
    """Domains of a selector: names joined by commas or plus signs, each of which may be
    an alias for several; a domain is listed once.  Nothing selects the default domain."""
    names = re.findall(r"[^,+\s](?:[^,+]*[^,+\s])?", selector or "")
    domains = (d for name in names for d in DOMAIN_ALIASES.get(name, [name]))
    return list(dict.fromkeys(domains)) or [DEFAULT_DOMAIN]


def domain_union(tables: dict[str, DataFrame], id_col: str = "task_id") -> DataFrame:
    """Rows of all domains tagged with ``domain``; ids read ``domain:id`` when there are several."""
    many = len(tables) > 1
    out = None
    for name, df in tables.items():
        key = F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string")) if many else F.col(id_col).cast("string")
        tagged = df.withColumn("domain", F.lit(name)).withColumn("task_key", key)
        out = tagged if out is None else out.unionByName(tagged)
    return out


def split_views(train: DataFrame, test: DataFrame, id_col: str = "dialog_id") -> dict[str, DataFrame]:
    """Train, test and their union; test excludes anything already in train."""
    clean_test = test.join(train.select(id_col), id_col, "left_anti")
    return {"train": train, "test": clean_test, "all": train.unionByName(clean_test)}
