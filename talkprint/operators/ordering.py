"""Global and per-key orderings that never sort one key in one task.

A window over a whole table, or over a key that may own a third of it, runs in
a single task.  Everything here works in two levels instead: rows fall into
buckets that follow the order, windows run inside a bucket, and a small table
of bucket summaries carries the totals across.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprint.sources.shared import settle


def hash_order(seed, id_col: str = "id") -> Column:
    """Order key of every seeded shuffle: ``md5(seed || ':' || id)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_head(h: str) -> Column:
    """The leading 32 bits of a hash order key as a number, in the same order."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; keeps one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def bucketed_rank(
    df: DataFrame, bucket: str, order: list, keys: list[str] = (), out: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based row number by ``(bucket, order)`` inside ``keys``.

    ``bucket`` must ascend with the order.  The offsets table has one row per
    key and bucket.
    """
    keys = list(keys)
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    offsets = offsets.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = _null_safe(df.withColumn("_in", F.row_number().over(inside)), offsets, [*keys, bucket], "inner")
    return ranked.withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before")


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed,
    keys: list[str] = (),
    out: str = "rank",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """1-based position in the seeded shuffle order, optionally per ``keys``.

    md5 is uniform, so equal ranges of its leading 32 bits make even buckets; by
    default there are as many as shuffle partitions.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_h", hash_order(seed, id_col))
    keyed = keyed.withColumn("_b", F.shiftright(hash_head("_h") * buckets, 32))
    return bucketed_rank(keyed, "_b", ["_h", id_col], keys, out, total).drop("_h", "_b")


def sample_bounds(df: DataFrame, col: str, buckets: int) -> list:
    """At most ``buckets - 1`` split points for ``col``: the values with the
    smallest hashes, an even and repeatable sample.  Only these reach the driver."""
    picked = (
        df.select(col).where(F.col(col).isNotNull()).orderBy(F.xxhash64(col), col).limit(max(buckets - 1, 1)).collect()
    )
    return sorted({r[0] for r in picked})


def range_bucket(col: Column, bounds: list) -> Column:
    """Index of the range ``col`` falls in, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def value_rank(
    df: DataFrame, order: str, keys: list[str] = (), out: str = "rank", buckets: int | None = None
) -> DataFrame:
    """1-based row number by ascending ``order`` (unique inside ``keys``)."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sample_bounds(df, order, buckets)
    return bucketed_rank(
        df.withColumn("_b", range_bucket(F.col(order), bounds)), "_b", [order], keys, out
    ).drop("_b")


def _hot_keys(data: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Keys that own more than one part in ``buckets`` of all rows, so fewer than ``buckets`` keys."""
    share = data.count() / buckets
    return data.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select(*keys, F.lit(True).alias("_hot"))


def _blocked(df: DataFrame, keys, order: str, value: Column, out: str, inclusive, fn, merge, buckets: int | None = None):
    """Windows inside blocks of ``order`` plus a carry over a small table of block summaries.

    Blocks are ranges between sampled values, so they are even whatever the
    spacing of ``order``.  Only keys too large for one task are cut; there are
    fewer of them than buckets, and each has at most ``buckets`` summaries.
    """
    keys, spark = list(keys), df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = settle(df.withColumn("_v", value), "ordered")
    if keys:
        hot = settle(_hot_keys(data, keys, buckets), "hot-keys")
        data = _null_safe(data, F.broadcast(hot), keys, "left")
        place = range_bucket(F.col(order), sample_bounds(data.where("_hot"), order, buckets))
        data = data.withColumn("_b", F.when(F.col("_hot"), place).otherwise(-1)).drop("_hot")
    else:
        data = data.withColumn("_b", range_bucket(F.col(order), sample_bounds(data, order, buckets)))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    near = data.withColumn("_near", fn("_v").over(inside))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = data.where("_b >= 0").groupBy(*keys, "_b").agg(fn("_v").alias("_bv"))
    carried = blocks.select(*keys, "_b", fn("_bv").over(ahead).alias("_carry"))
    joined = _null_safe(near, carried, [*keys, "_b"], "left")
    return joined.withColumn(out, merge(F.col("_near"), F.col("_carry"))).drop("_v", "_b", "_near", "_carry")


def running_max(
    df: DataFrame, keys, order: str, value: Column, out: str, inclusive: bool = True, buckets: int | None = None
) -> DataFrame:
    """Running maximum of ``value`` by ascending ``order`` (any type, unique per key) inside ``keys``.

    With a struct ``(order, payload)`` and ``inclusive=False`` this is the
    previous row.
    """
    return _blocked(df, keys, order, value, out, inclusive, F.max, F.greatest, buckets)


def running_sum(
    df: DataFrame, keys, order: str, value: Column, out: str, inclusive: bool = True, buckets: int | None = None
) -> DataFrame:
    """Running sum of a non-null ``value`` by ascending ``order`` (any type, unique per key) inside ``keys``."""
    zero = F.lit(0)
    return _blocked(
        df, keys, order, value, out, inclusive, F.sum,
        lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), buckets,
    )
