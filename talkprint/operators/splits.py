"""Leakage-free splits, samples and group packing.

Shuffles are the order of ``md5(seed:id)``, repeatable on any cluster and in
any engine; the cut points follow the integer arithmetic of the originals.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprint.operators.ordering import hash_order, hash_rank, value_rank
from talkprint.sources.shared import settle


def split(tasks: DataFrame, id_col: str, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: test first, then val from the rest, the remainder is train."""
    ranked = hash_rank(tasks, id_col, seed, out="_r", total="_n")
    n_test = F.floor(F.col("_n") * test)
    n_val = F.floor((F.col("_n") - n_test) * val)
    r = F.col("_r")
    return ranked.withColumn(
        "split", F.when(r <= n_test, "test").when(r <= n_test + n_val, "val").otherwise("train")
    ).drop("_r", "_n")


def train_val_split(ids: DataFrame, id_col: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` in train/val with at least one id on each side.

    With a single id the val part is empty.  ``val`` must lie inside (0, 1).
    """
    if not 0.0 < val < 1.0:
        raise ValueError(f"val must be inside (0, 1), got {val!r}")
    if ids.isEmpty():
        raise ValueError("no ids to split")
    ranked = hash_rank(ids, id_col, seed, out="_r", total="_n")
    n_val = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * val)), F.col("_n") - 1)
    return ranked.withColumn("split", F.when(F.col("_r") <= n_val, "val").otherwise("train")).drop("_r", "_n")


def _pack_sizes(train_frac: float):
    """Greedy packing over the histogram of group sizes, largest first.

    Inside a run of equal sizes the choice is train (or test) until the balance
    tips and alternates from there, so one row per distinct size describes the
    side of every group: the first ``lead`` groups go to ``side``, then the
    other side and ``side`` take turns.
    """

    def fold(batches):
        hist = pd.concat(list(batches), ignore_index=True).sort_values("size", ascending=False)
        total = int((hist["size"] * hist["n"]).sum())
        quota_train, quota_test = train_frac * total, (1.0 - train_frac) * total
        filled = [0, 0]
        rows = []

        def train_next(f_train, f_test):
            return quota_train - f_train >= quota_test - f_test

        for size, n in zip(hist["size"].tolist(), hist["n"].tolist()):
            first = train_next(*filled)
            i = 0 if first else 1
            gap = (quota_train - filled[0]) - (quota_test - filled[1])
            lead = max(1, min(n, int(abs(gap) // size)))

            def after(k, i=i):
                return (filled[0] + k * size, filled[1]) if i == 0 else (filled[0], filled[1] + k * size)

            while lead < n and train_next(*after(lead)) == first:
                lead += 1
            while lead > 1 and train_next(*after(lead - 1)) != first:
                lead -= 1
            rest = n - lead
            filled[i] += size * (lead + rest // 2)
            filled[1 - i] += size * (rest - rest // 2)
            rows.append((size, first, lead))
        yield pd.DataFrame(rows, columns=["size", "first_train", "lead"])

    return fold


def group_sides(df: DataFrame, key: str, train_frac: float = 0.75, tie_seed: int | None = None) -> DataFrame:
    """``(key, size, side)``; groups by size, largest first, each to the side
    furthest below its quota, ties to train.

    Equal sizes are ordered by key (J03) or by a seeded shuffle (J04).  Only the
    histogram of sizes is folded in order, at most sqrt(2 * rows) rows; every
    group then finds its side from its rank among groups of its size.
    """
    sizes = settle(df.groupBy(F.col(key)).agg(F.count("*").alias("size")), "sizes")
    hist = sizes.groupBy("size").agg(F.count("*").alias("n"))
    rules = hist.coalesce(1).mapInPandas(
        _pack_sizes(train_frac), "size long, first_train boolean, lead long"
    )
    if tie_seed is None:
        ranked = value_rank(sizes, key, ["size"], out="_r")
    else:
        ranked = hash_rank(sizes, key, tie_seed, ["size"], out="_r")
    past = F.col("_r") - F.col("lead")
    on_first = (past <= 0) | (past % 2 == 0)
    return ranked.join(rules, "size").select(
        key, "size", F.when(on_first == F.col("first_train"), "train").otherwise("test").alias("side")
    )


def group_disjoint_split(df: DataFrame, key: str, train_frac: float = 0.75, tie_seed: int | None = None) -> DataFrame:
    """Rows with the ``side`` of their group."""
    return df.join(group_sides(df, key, train_frac, tie_seed).select(key, "side"), key)


def official_split(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """``official`` in train/test/null from ``splits(task_id, split)``; train wins a double entry."""
    one = splits.groupBy("task_id").agg(
        F.when(F.max(F.col("split") == "train"), "train").when(F.max(F.col("split") == "test"), "test").alias("official")
    )
    return tasks.join(one, "task_id", "left")


def human_side(dialogs: DataFrame, splits: DataFrame, val_ids: DataFrame, domains: list[str]) -> DataFrame:
    """Dialogues with at least two turns and their ``side``.

    ``dialogs(dialog_id, domain, task_id, n_turns)``, ``splits(domain, task_id,
    split)``, ``val_ids(task_key)``.  Train is: not in the official test split
    and not held out for validation; a task missing from the splits counts as
    train.  With several domains keys read ``domain:task_id``.
    """
    many = len(domains) > 1
    key = F.concat_ws(":", "domain", "task_id") if many else F.col("task_id")
    test = splits.where(F.col("split") == "test").select("domain", "task_id").distinct()
    in_train = splits.where(F.col("split") == "train").select("domain", "task_id").distinct()
    only_test = test.join(in_train, ["domain", "task_id"], "left_anti").withColumn("_test", F.lit(True))
    held = val_ids.select(F.col("task_key").alias("_key")).distinct().withColumn("_val", F.lit(True))
    joined = (
        dialogs.where((F.col("n_turns") >= 2) & F.col("domain").isin(domains))
        .withColumn("_key", key)
        .join(only_test, ["domain", "task_id"], "left")
        .join(held, "_key", "left")
    )
    out = F.col("_test").isNotNull() | F.col("_val").isNotNull()
    return joined.withColumn("side", F.when(out, "test").otherwise("train")).drop("_key", "_test", "_val")


def in_list_order(tasks: DataFrame, id_list: DataFrame) -> DataFrame:
    """Tasks named in ``id_list(task_id, pos)``, ``pos`` kept for ordering; unknown ids drop."""
    return id_list.join(tasks, "task_id")


def in_task_order(tasks: DataFrame, id_list: DataFrame) -> DataFrame:
    """J08 for validation: tasks in their own order, restricted to the list."""
    return tasks.join(id_list.select("task_id"), "task_id", "left_semi")


def sample_k(df: DataFrame, id_col: str, k: int, seed: int = 0, sort: bool = True, pool: Column | None = None) -> DataFrame:
    """A seeded sample of ``k`` rows, all rows for ``k = 0`` or ``k >= n``.

    ``pool`` restricts the draw to one split.  ``sort=False`` keeps the shuffle
    position in ``draw`` instead of sorting by id.
    """
    rows = df if pool is None else df.where(pool)
    if k:
        # Every task keeps its k smallest hashes: no rank of the whole table is needed.
        rows = rows.orderBy(hash_order(seed, id_col), id_col).limit(k)
    return rows.sort(id_col) if sort else hash_rank(rows, id_col, seed, out="draw")


def holdout(tasks: DataFrame, id_col: str, val_size: int, baseline_size: int, seed: int = 0) -> DataFrame:
    """``part`` of every task: the first ``val_size`` of the shuffle are val, the
    next ``baseline_size`` train with ``baseline`` set, the rest train."""
    ranked = hash_rank(tasks, id_col, seed, out="_r")
    r = F.col("_r")
    return ranked.select(
        *tasks.columns,
        F.when(r <= val_size, "val").otherwise("train").alias("part"),
        ((r > val_size) & (r <= val_size + baseline_size)).alias("baseline"),
    )


def stratified_folds(rows: DataFrame, label: str, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Fold number per row, even inside each class."""
    ranked = hash_rank(rows, id_col, seed, [label], out="_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


