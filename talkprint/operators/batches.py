"""Task batches, the persona-count curriculum and job expansion."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprint.functions import text as T

# --- fixed values: curriculum defaults ---------------------------------------
LARGE_POOL = 100
ITERATIONS_PER_STAGE = 20


def sliding_batches(tasks: DataFrame, iterations: DataFrame, size: int) -> DataFrame:
    """``(iteration, epoch, batch_in_epoch, steps_per_epoch, k, task_id)``.

    ``tasks(task_id, pos)`` with contiguous 0-based ``pos``; ``iterations`` is
    1-based.  A short last batch wraps to the head of the list.  Every task
    position is index arithmetic, so this is one equi-join.
    """
    n = tasks.select(F.count("*")).scalar()
    bs = F.greatest(F.lit(1), F.least(F.lit(size), F.col("_n")))
    steps = F.floor((F.col("_n") + F.col("_bs") - 1) / F.col("_bs"))
    it0 = F.col("iteration") - 1
    start = (F.col("batch_in_epoch") - 1) * F.col("_bs")
    plan = (
        iterations.select("iteration")
        .withColumn("_n", n)
        .where(F.col("_n") > 0)
        .withColumn("_bs", bs)
        .withColumn("steps_per_epoch", steps)
        .withColumn("batch_in_epoch", (it0 % F.col("steps_per_epoch")) + 1)
        .withColumn("epoch", F.floor(it0 / F.col("steps_per_epoch")) + 1)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1)))
        .withColumn("_p", start + F.col("k"))
        .withColumn("pos", F.when(F.col("_p") < F.col("_n"), F.col("_p")).otherwise(F.col("_p") - F.col("_n")))
    )
    return plan.join(tasks.select("task_id", "pos"), "pos").select(
        "iteration", "epoch", "batch_in_epoch", "steps_per_epoch", "k", "task_id"
    )


def modulo_batches(id_list: DataFrame, tasks: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """The k-th task of a batch is ``ids[(start + k) mod n]``; unknown ids drop.

    ``id_list(task_id, pos)``, ``starts(batch, start)``.
    """
    n = id_list.select(F.count("*")).scalar()
    slots = (
        starts.withColumn("_n", n)
        .where(F.col("_n") > 0)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .withColumn("pos", F.pmod(F.pmod("start", F.col("_n")) + F.col("k"), F.col("_n")))
    )
    return slots.join(id_list, "pos").join(tasks.select("task_id"), "task_id", "left_semi").select(
        "batch", "k", "task_id"
    )


def persona_count(
    epoch: Column,
    iteration: Column,
    pool_size: Column,
    schedule: list[tuple[int, int]],
    base: int = 10,
    enabled: bool = True,
) -> Column:
    """Personas per task at a point of the run.

    Small pools look up the largest epoch threshold reached; pools above 100
    tasks step through the schedule every 20 iterations and hold the last value.
    The schedule is a handful of configured pairs, hence an expression.
    """
    base = max(1, base)
    stages = sorted(schedule, key=lambda t: t[0])
    if not enabled or not stages:
        return F.lit(base)
    by_epoch = F.lit(base)
    for threshold, n in stages:
        by_epoch = F.when(epoch >= threshold, F.lit(max(1, n))).otherwise(by_epoch)
    stage = F.least(
        F.floor((F.greatest(F.lit(1), iteration) - 1) / ITERATIONS_PER_STAGE), F.lit(len(stages) - 1)
    )
    by_iteration = F.get(F.array(*[F.lit(max(1, n)) for _, n in stages]), stage.cast("int"))
    return F.when(pool_size > LARGE_POOL, by_iteration).otherwise(by_epoch)


def score_weights(n_current: Column, lam: float, n_final: int) -> tuple[Column, Column]:
    """(weight of human-likeness, weight of coverage), ramping with the persona count."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(1), n_current) / max(1, n_final))
    coverage = F.lit(float(lam)) * ratio
    return 1.0 - coverage, coverage


def expand_jobs(tasks: DataFrame, personas: DataFrame | None = None, n: int = 10) -> DataFrame:
    """``(task_id, pos, text)``: every persona of every task, or for the default
    condition ``n`` empty personas per task."""
    if personas is None:
        return tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"), F.lit("").alias("text"))
    return tasks.select("task_id").join(personas.select("task_id", "pos", "text"), "task_id")


def pad_personas(personas: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` personas per task: those with a non-blank text among the first
    ``n`` rows, trimmed, in order, repeated cyclically.  Tasks without any fail.
    A missing ``persona_id`` reads ``direct_persona_<slot>``, if the column is given.

    ``personas(task_id, pos, text, ...)``; at most ``n`` rows per task pass the
    pruned rank filter.
    """
    first = F.row_number().over(Window.partitionBy("task_id").orderBy("pos"))
    near = personas.withColumn("_rn", first).where(F.col("_rn") <= n)
    near = near.withColumn("text", T.trim_ws(F.coalesce("text", F.lit(""))))
    valid = F.col("text") != ""
    w = Window.partitionBy("task_id")
    kept = (
        near.withColumn("_valid", F.sum(valid.cast("int")).over(w))
        .where(F.when(F.col("_valid") == 0, F.raise_error(F.lit("a task has no valid persona"))).otherwise(valid))
        .withColumn("_i", F.row_number().over(w.orderBy("pos")) - 1)
    )
    copies = F.explode(F.sequence(F.col("_i"), F.lit(n - 1), F.col("_valid").cast("int")))
    out = kept.withColumn("slot", copies).drop("_rn", "_valid", "_i", "pos")
    if "persona_id" in out.columns:
        named = F.concat(F.lit("direct_persona_"), F.col("slot").cast("string"))
        out = out.withColumn("persona_id", F.coalesce("persona_id", named))
    return out
