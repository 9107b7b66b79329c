"""Mean pairwise distance, two-sided coverage, cloud compression and projection.

Pairs of points are never rows.  Clouds are first reduced to distinct vectors with
weights, so any number of copies costs one point; that table is written to the
shared folder because it is read several times.

The exact spread lets hash blocks of bounded size meet in a grid of cells; it is
quadratic in the number of *distinct* points by definition, and
:func:`estimate_spread` is the way for a caller to whom a bound of the error will do.

Coverage looks for nearest neighbours and need not try all pairs.  A bounded number
of pivots parts space into cells, of which every cloud knows the distances of its
nearest and farthest member to the pivot.  By the triangle inequality these bound
the distance of a point to the whole cell.  Neighbouring cells share blocks of
bounded size; a point travels only to the blocks with a cell that may hold its
nearest neighbour, once to each, and inside a block the same bounds are used once
more (:func:`nearest`).  Where bounds rule nothing out, a point so meets as many
blocks as the cloud fills, not every cell.  Nothing but pivots is collected or sent
to all tasks.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprint.sources.shared import settle

BLOCK_ROWS = 2048
BLOCKS = 16  # a cloud is cut into so many blocks before they grow
WIDE = 8  # and blocks grow to so many times their rows: more blocks mean more copies of every row
AT_ONCE = 1 << 20  # distances held at a time
IN_CACHE = 1 << 17  # and those that one pass hands to the next while they are in a core's cache


def _n_blocks(n: int, block_rows: int) -> int:
    """Number of blocks of ``block_rows`` rows, or up to ``WIDE`` times as many if there would be over ``BLOCKS``."""
    return max(1, -(-n // min(max(block_rows, -(-n // BLOCKS)), WIDE * block_rows)))


def _blocks(points: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, int]:
    """Distinct vectors with weight ``w`` in hash blocks ``blk`` and the number of blocks (:func:`_n_blocks`).

    Every block meets many others, so the distinct table is written once.
    """
    distinct = settle(points.groupBy(*keys, "vec").agg(F.count("*").alias("w")), "cloud")
    n_blk = _n_blocks(distinct.count(), block_rows)
    return distinct.withColumn("blk", F.pmod(F.xxhash64(*keys, "vec"), F.lit(n_blk)).cast("int")), n_blk


def _every(n_blk: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n_blk - 1)))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mid = a.mean(axis=0)
    a, b = a - mid, b - mid
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _spread_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = int(pdf["ci"].iloc[0]), int(pdf["cj"].iloc[0])
    left, right = pdf[pdf["blk"] == lo], pdf[pdf["blk"] == hi]
    if not len(left) or not len(right):
        return pd.DataFrame({"part": [0.0]})
    a, b = _matrix(left), _matrix(right)
    wa, wb = left["w"].to_numpy(float), right["w"].to_numpy(float)
    mid = a.mean(axis=0)
    a, b = a - mid, b - mid
    # |x|^2 + |y|^2 - 2xy as one product, then in place: a pass over memory costs more than the arithmetic.
    rows = np.column_stack([-2.0 * a, (a * a).sum(1), np.ones(len(a))])
    columns = np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T.copy()
    total, step = 0.0, max(1, IN_CACHE // len(b))
    room = np.empty((min(step, len(a)), len(b)))
    for at in range(0, len(a), step):
        x = rows[at:at + step]
        d = np.matmul(x, columns, out=room[:len(x)])
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        if lo == hi:
            np.fill_diagonal(d[:, at:], 0.0)
        total += float(wa[at:at + step] @ (d @ wb))
    return pd.DataFrame({"part": [total / 2.0 if lo == hi else total]})


def reference_spread(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row ``(n, d_ref)``, the mean Euclidean distance of unordered pairs.

    1.0 below two points or when the cloud has no spread.
    """
    blocks, n_blk = _blocks(points.select("vec"), [], block_rows)
    cells = blocks.withColumn("other", _every(n_blk)).select(
        F.least("blk", "other").alias("ci"), F.greatest("blk", "other").alias("cj"), "blk", "w", "vec"
    )
    parts = cells.groupBy("ci", "cj").applyInPandas(_spread_cell, "part double")
    pairs_sum = parts.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("s"))
    n = blocks.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).withColumn("s", pairs_sum.scalar())
    mean = F.col("s") / (F.col("n") * (F.col("n") - 1) / 2.0)
    return n.select("n", F.when((F.col("n") >= 2) & (mean > 1e-9), mean).otherwise(F.lit(1.0)).alias("d_ref"))


def estimate_spread(points: DataFrame, pairs: int = 20_000, confidence: float = 0.95, cells: int = 16, seed: int = 0) -> DataFrame:
    """P08 from a sample of pairs: one row ``(n, d_ref, half_width)``, for callers who accept a bounded error.

    Pivots part the cloud; a stratum holds the pairs of two cells (or of one).  The
    cells' radii bound every distance of a stratum, so strata of narrow range and
    little weight need few pairs.  Each stratum draws its own pairs, in which no row
    occurs twice, by hash order.  By Hoeffding's inequality ``|d_ref - exact|`` is
    at most ``half_width`` with probability ``confidence``.  Small clouds and clouds
    without spread are as in :func:`reference_spread`.
    """
    numbered = settle(points.select("vec", F.monotonically_increasing_id().alias("pid")), "cloud")
    spark, n = points.sparkSession, numbered.count()
    if n < 2:
        return spark.createDataFrame([(n, 1.0, 0.0)], "n long, d_ref double, half_width double")
    some = numbered.select("vec").distinct().orderBy(F.xxhash64("vec", F.lit(seed)), "vec").limit(cells).collect()
    pivots = np.array([r.vec for r in some])

    def place(frames):
        for pdf in frames:
            if len(pdf):
                d = np.sqrt(_squared(_matrix(pdf), pivots))
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    placed = settle(numbered.mapInPandas(place, "vec array<double>, pid long, cell int, far double"), "cells")
    size, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("high")).collect():
        size[r.cell], radius[r.cell] = r.n, r.high
    between = np.sqrt(_squared(pivots, pivots))
    strata = []  # i, j, share of all pairs, width of the range of distances, its middle
    for i in range(len(pivots)):
        for j in range(i, len(pivots)):
            share = (size[i] * size[j] if i < j else size[i] * (size[i] - 1) / 2) / (n * (n - 1) / 2)
            low = max(0.0, between[i, j] - radius[i] - radius[j])
            if share > 0:
                high = between[i, j] + radius[i] + radius[j]
                strata.append((i, j, float(share), float(high - low), float(low + high) / 2))
    cost = sum(s * w for _, _, s, w, _ in strata) or 1.0
    plan = spark.createDataFrame(
        [(*s, max(1, round(pairs * s[2] * s[3] / cost))) for s in strata], "i int, j int, share double, width double, middle double, want int"
    )
    # A row of cell c takes part in the strata (c, j) on the left and (i, c) on the right; inside one cell on both by turns.
    most = max(1, round(pairs * max(s * w for _, _, s, w, _ in strata) / cost))
    order = Window.partitionBy("i", "j", "side").orderBy(F.xxhash64("i", "j", "pid", F.lit(seed)), "pid")
    sides = []
    for side, mine in ((0, "i"), (1, "j")):
        met = placed.join(F.broadcast(plan), F.col("cell") == F.col(mine))
        turn = F.pmod(F.xxhash64(F.lit(seed + 1), "pid"), F.lit(2)) == side
        sides.append(met.where((F.col("i") != F.col("j")) | turn).select("i", "j", F.lit(side).alias("side"), "pid", "vec", "want"))
    drawn = sides[0].unionByName(sides[1]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).where("k <= want")
    left, right = drawn.where("side = 0"), drawn.where("side = 1").select("i", "j", "k", F.col("vec").alias("other"))
    apart = F.sqrt(F.aggregate(F.zip_with("vec", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    means = left.join(right, ["i", "j", "k"]).groupBy("i", "j").agg(F.count("*").alias("m"), F.avg(apart).alias("mean"))
    filled = plan.join(means, ["i", "j"], "left").select(
        "share", "width", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("mean", "middle").alias("mean")
    )
    # A stratum without a pair (two rows of one cell on the same side) is known by its range alone.
    total = filled.agg(
        F.sum(F.col("share") * F.col("mean")).alias("d"), F.sum(F.when(F.col("m") > 0, F.pow(F.col("share") * F.col("width"), 2) / F.col("m"))).alias("v"),
        F.coalesce(F.sum(F.when(F.col("m") == 0, F.col("share") * F.col("width") / 2)), F.lit(0.0)).alias("unknown"),
    )
    half = F.sqrt(F.coalesce("v", F.lit(0.0)) * F.lit(np.log(2 / (1 - confidence)) / 2).cast("double")) + F.col("unknown")
    return total.select(
        F.lit(n).cast("long").alias("n"), F.when(F.col("d") > 1e-9, F.col("d")).otherwise(F.lit(1.0)).alias("d_ref"), half.alias("half_width")
    )


POINT, HUMAN, WHOLE = 0, 1, 2  # what a row of minima tells of: a point, a human for part of a group, a whole group
PIVOTS = 128
FEW = 64  # so many points are tried one by one
QUERY_BLOCKS = 4  # blocks of queries that share a copy of the data they need, and blocks of rows in a block of data
ROUTED = 32  # blocks of data that a block of queries is sent to at a time
_SLACK = 1e-9  # of the larger distance: rounding of bounds must not hide a neighbour


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squared(a, b))


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Distance of every row of ``a`` to its nearest of ``b``, and how many distances that took.

    About the square root of ``b``'s rows serve as pivots.  A point first tries the
    members of its nearest pivot, then those of other pivots whose farthest member
    leaves room for a smaller distance.
    """
    k = int(len(b) ** 0.5)
    if len(b) <= FEW:
        near = _squared(a, b).argmin(axis=1)
        return np.sqrt(((a - b[near]) ** 2).sum(1)), len(a) * len(b)
    pivots = b[np.linspace(0, len(b) - 1, k).astype(int)]
    to_b, to_a = _distances(b, pivots), _distances(a, pivots)
    cell, own = to_b.argmin(axis=1), to_a.argmin(axis=1)
    radius = np.zeros(k)
    np.maximum.at(radius, cell, to_b.min(axis=1))
    members = [np.flatnonzero(cell == c) for c in range(k)]
    best, index, tried = np.full(len(a), np.inf), np.zeros(len(a), int), k * (len(a) + len(b))

    def look(found: np.ndarray, c: int) -> None:
        nonlocal tried
        step = max(1, AT_ONCE // len(members[c]))
        for rows in (found[s:s + step] for s in range(0, len(found), step)):
            d2 = _squared(a[rows], b[members[c]])
            at = d2.argmin(axis=1)
            d = np.sqrt(d2[np.arange(len(rows)), at])
            closer = d < best[rows]
            best[rows[closer]], index[rows[closer]] = d[closer], members[c][at[closer]]
            tried += d2.size

    for c in range(k):
        if len(members[c]) and len(rows := np.flatnonzero(own == c)):
            look(rows, c)
    for c in range(k):
        bound = to_a[:, c] - radius[c]
        rows = np.flatnonzero((own != c) & (bound <= best + _SLACK * (to_a[:, c] + 1)))
        if len(members[c]) and len(rows):
            look(rows, c)
    return np.sqrt(((a - b[index]) ** 2).sum(1)), tried


def _count(counter, tried: int) -> None:
    if counter is not None:
        counter.add(tried)


def _distinct(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct vectors with weight ``w`` and a number ``pid``, written once."""
    found = points.groupBy(*keys, "vec").agg(F.count("*").alias("w"))
    return settle(found.withColumn("pid", F.monotonically_increasing_id()), "cloud")


def _pivots(distinct: DataFrame, n: int) -> np.ndarray:
    """At most ``PIVOTS`` vectors of the cloud, spread by hash, in the order of their longest axis."""
    some = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(PIVOTS, int(n**0.5) + 1)).collect()
    found = np.array([r.vec for r in some])
    mid = found - found.mean(axis=0)
    axis = mid @ np.linalg.svd(mid, full_matrices=False)[2][0] if np.isfinite(mid).all() else np.zeros(len(found))
    return found[np.argsort(axis, kind="stable")]


def _meeting(queries: DataFrame, n_queries: int, data: DataFrame, pivots: np.ndarray, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries as ``grp, sub, salt, pids, vecs``, packed for every block of ``data`` that may hold a neighbour, and
    the blocks' rows as ``grp, sub, salt, vec``."""
    grp_type, n_blk = dict(data.dtypes)["grp"], max(1, -(-n_queries // block_rows))

    def place(frames):
        for pdf in frames:
            if len(pdf):
                d = _distances(_matrix(pdf), pivots)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    placed = settle(data.select("grp", "vec").mapInPandas(place, f"grp {grp_type}, vec array<double>, cell int, far double"), "cells")
    # The cells of a group, one after the other, are cut into blocks of even size.
    sizes = placed.groupBy("grp", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
    upto, rows = F.sum("n").over(Window.partitionBy("grp").orderBy("cell")), QUERY_BLOCKS * block_rows
    ends = [F.floor((upto - F.col("n")) / rows).cast("int").alias("first"), F.floor((upto - 1) / rows).cast("int").alias("last")]
    cells = settle(sizes.select("grp", "cell", "low", "high", *ends), "cell-bounds")
    groups = cells.groupBy("grp").agg(
        (F.max("last") + 1).alias("n_sub"), F.sort_array(F.collect_list(F.struct("cell", "low", "high", "first", "last"))).alias("cells")
    )
    n_parts = max(1, -(-int(groups.agg(F.sum("n_sub")).first()[0] or 0) // ROUTED))
    maps = (
        groups.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("grp", "sub"), F.lit(n_parts)).cast("int"))
        .groupBy("part", "grp").agg(F.collect_list("sub").alias("subs"), F.first("cells").alias("cells"))
    )
    asking = queries.select(F.pmod(F.xxhash64("pid"), F.lit(n_blk)).cast("int").alias("blk"), _every(n_parts).alias("part"), "pid", "vec")

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            a = _matrix(left)
            d, pids = _distances(a, pivots), left["pid"].to_numpy()
            salt = int(left["blk"].iloc[0]) // QUERY_BLOCKS
            for grp, subs, cells in zip(right["grp"], right["subs"], right["cells"], strict=True):
                cell, low, high, first, last = (np.array([c[k] for c in cells]) for k in ("cell", "low", "high", "first", "last"))
                to = d[:, cell]
                # Some member lies as close to its pivot as the nearest one does.
                near = to - high <= (to + low).min(axis=1)[:, None] + _SLACK * (to + 1)
                for sub in subs:
                    rows = near[:, (first <= sub) & (sub <= last)].any(axis=1)
                    if rows.any():
                        out.append((grp, int(sub), salt, pids[rows].tobytes(), a[rows].tobytes()))
        return pd.DataFrame(out, columns=["grp", "sub", "salt", "pids", "vecs"], dtype=object)

    travelling = asking.groupBy("blk", "part").cogroup(maps.withColumn("blk", _every(n_blk)).groupBy("blk", "part")).applyInPandas(
        route, f"grp {grp_type}, sub int, salt int, pids binary, vecs binary"
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit((n_blk - 1) // QUERY_BLOCKS)))
    place_in = F.col("first") + F.pmod(F.xxhash64("vec"), F.col("last") - F.col("first") + 1).cast("int")
    at_home = placed.join(cells.select("grp", "cell", "first", "last"), ["grp", "cell"]).select(
        "grp", place_in.alias("sub"), salts.alias("salt"), "vec"
    )
    return travelling, at_home


def _routed(queries: DataFrame, n_queries: int, data: DataFrame, pivots: np.ndarray, block_rows: int, counter) -> DataFrame:
    """``grp, pid, d``: distance of every query (``pid, vec``) to the nearest of every group of ``data`` (``grp, vec``)."""
    grp_type, key = dict(data.dtypes)["grp"], ["grp", "sub", "salt"]
    travelling, at_home = _meeting(queries, n_queries, data, pivots, block_rows)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            b = _matrix(right)
            found, tried = nearest(np.frombuffer(b"".join(left["vecs"])).reshape(-1, b.shape[1]), b)
            ids = np.frombuffer(b"".join(left["pids"]), np.int64)
            _count(counter, tried)
        return pd.DataFrame({"grp": pd.Series([left["grp"].iloc[0]] * len(ids) if len(ids) else [], dtype=object), "pid": ids, "d": found})

    found = travelling.groupBy(*key).cogroup(at_home.groupBy(*key)).applyInPandas(solve, f"grp {grp_type}, pid long, d double")
    return found.groupBy("grp", "pid").agg(F.min("d").alias("d"))


def _whole_groups(groups: DataFrame, n_groups: int, humans: DataFrame, n_humans: int, block_rows: int, counter) -> DataFrame:
    """``grp, w, wd``: for every group, by block of humans, their weight and the weighted sum of distances to it.

    Every group meets every block of humans, as each has a distance to each.
    """
    grp_type = dict(groups.dtypes)["grp"]
    n_p, n_h = _n_blocks(n_groups, block_rows), _n_blocks(n_humans, block_rows)
    left = groups.select(F.pmod(F.xxhash64("grp"), F.lit(n_p)).cast("int").alias("cp"), _every(n_h).alias("ch"), "grp", "vec")
    right = humans.select(_every(n_p).alias("cp"), F.pmod(F.xxhash64("vec"), F.lit(n_h)).cast("int").alias("ch"), "w", "vec")

    def cell(p: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        grps, sums = [], []
        if len(p) and len(h):
            p = p.iloc[np.argsort(codes := pd.factorize(p["grp"])[0], kind="stable")]
            a, humans, w = _matrix(p), _matrix(h), h["w"].to_numpy(float)
            codes.sort()
            edges = [*np.flatnonzero(np.diff(codes, prepend=-1)), len(p)]
            for s, e in zip(edges, edges[1:]):
                d, tried = nearest(humans, a[s:e])
                _count(counter, tried)
                grps.append(p["grp"].iloc[s])
                sums.append(float(w @ d))
        return pd.DataFrame({"grp": pd.Series(grps, dtype=object), "w": float(h["w"].sum()), "wd": sums})

    return left.groupBy("cp", "ch").cogroup(right.groupBy("cp", "ch")).applyInPandas(cell, f"grp {grp_type}, w double, wd double")


def cell_minima(p: DataFrame, h: DataFrame, by: str, block_rows: int = BLOCK_ROWS, counter=None) -> tuple[DataFrame, DataFrame]:
    """The groups of ``p``, and ``side, grp, w, wd``: weights and weighted nearest distances in both directions.

    A point gives one row, with its distance to the nearest human.  A group gives a
    row per block of humans, unless it is larger than a block: then every human
    looks for its nearest in the group as points look for theirs.  ``counter``, an
    accumulator, adds up the distances computed.
    """
    points = _distinct(p.select(F.col(by).alias("grp"), "vec"), ["grp"])
    humans = _distinct(h.select("vec"), [])
    n_p, n_h = points.count(), humans.count()
    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    grp_type = dict(points.dtypes)["grp"]
    if not n_p or not n_h:
        return sizes.select("grp"), p.sparkSession.createDataFrame([], f"side int, grp {grp_type}, w double, wd double")
    sized = points.join(sizes, "grp")
    small, large = sized.where(F.col("n") <= block_rows), sized.where(F.col("n") > block_rows)
    pivots = _pivots(humans, n_h)
    near = _routed(points, n_p, humans.withColumn("grp", F.lit(0)), pivots, block_rows, counter)
    weighted = lambda side: (F.lit(side).alias("side"), "grp", F.col("w").cast("double").alias("w"), (F.col("w") * F.col("d")).alias("wd"))
    rows = near.select("pid", "d").join(points, "pid").select(*weighted(POINT))
    groups = _whole_groups(small, n_p, humans, n_h, block_rows, counter)
    rows = rows.unionByName(groups.select(F.lit(WHOLE).alias("side"), "grp", "w", "wd"))
    if not large.isEmpty():
        spread_out = _routed(humans, n_h, large, pivots, block_rows, counter)
        rows = rows.unionByName(spread_out.join(humans, "pid").select(*weighted(HUMAN)))
    return sizes.select("grp"), rows


def coverage_error(p: DataFrame, h: DataFrame, by: str, block_rows: int = BLOCK_ROWS, counter=None) -> DataFrame:
    """``(by, err)`` with err = mean_h min_p d + mean_p min_h d for every group of ``p``,
    null when ``h`` is empty.  ``by`` must be non-null."""
    groups, rows = cell_minima(p, h, by, block_rows, counter)
    err = (
        rows.groupBy("grp", "side").agg((F.sum("wd") / F.sum("w")).alias("mean_d"))
        .groupBy("grp").agg(F.sum("mean_d").alias("err"))
    )
    return groups.join(err, "grp", "left").withColumnRenamed("grp", by)


def chamfer(p: DataFrame, h: DataFrame, d_ref: DataFrame, by: str, block_rows: int = BLOCK_ROWS, counter=None) -> DataFrame:
    """``(by, chamfer)`` in [0, 1] for every group of ``p`` against cloud ``h``.

    ``d_ref`` is a one-row DataFrame with that column (:func:`reference_spread`).
    Groups score 0 when ``h`` is empty or ``d_ref`` is not positive.
    """
    scored = coverage_error(p, h, by, block_rows, counter).withColumn("_d", d_ref.select("d_ref").scalar())
    score = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col("err") / (2.0 * F.col("_d"))))
    return scored.select(
        by, F.coalesce(F.when((F.col("_d") > 0) & F.col("err").isNotNull(), score), F.lit(0.0)).alias("chamfer")
    )


def overall_chamfer(p: DataFrame, h: DataFrame, d_ref: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """P09 of the whole cloud ``p``: one row, 0 when ``p`` is empty."""
    scored = chamfer(p.withColumn("_all", F.lit(0)), h, d_ref, "_all", block_rows)
    return scored.agg(F.coalesce(F.max("chamfer"), F.lit(0.0)).alias("chamfer"))


def mean_task_chamfer(p, h, d_ref, task: str, by: list[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """P10: coverage per task group, then the mean over tasks (inside ``by``)."""
    keys = [*by, task]
    grouped = p.withColumn("_grp", F.to_json(F.struct(*keys)))
    names = grouped.select("_grp", *by).distinct()
    scored = chamfer(grouped, h, d_ref, "_grp", block_rows).join(names, "_grp")
    return scored.groupBy(*by).agg(F.avg("chamfer").alias("chamfer"))


CORESET = 20_000
TREE = 8


def coreset(points: DataFrame, size: int = CORESET, seed: int = 0) -> DataFrame:
    """``(vec, weight)``: at most ``size`` weighted points that stand for a larger cloud in k-means.

    Every partition draws points by half their share of the rows and half their
    share of the squared distances to the partition's mean, and weights them by the
    inverse of that chance, so that costs keep their expectation.  ``TREE``
    partitions at a time are put together and drawn from again, until one is left.
    """

    def draw(frames):
        vecs, weights = [np.zeros((0, 0))], [np.zeros(0)]
        rounds = 0

        def reduced(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if len(x) <= size:
                return x, w
            far = w * ((x - (w @ x) / w.sum()) ** 2).sum(1)
            chance = 0.5 * w / w.sum() + (0.5 * far / far.sum() if far.sum() > 0 else 0.5 * w / w.sum())
            taken = np.random.default_rng([seed, len(x), rounds]).choice(len(x), size, p=chance / chance.sum())
            return x[taken], w[taken] / (size * chance[taken])

        for pdf in frames:
            if len(pdf):
                vecs = [v for v in vecs if len(v)] + [_matrix(pdf)]
                weights.append(pdf["weight"].to_numpy(float))
                x, w = reduced(np.vstack(vecs), np.concatenate(weights))
                vecs, weights, rounds = [x], [w], rounds + 1
        if len(vecs[0]):
            yield pd.DataFrame({"vec": list(vecs[0]), "weight": weights[0]})

    schema = "vec array<double>, weight double"
    level = settle(points.select("vec", F.lit(1.0).alias("weight")).mapInPandas(draw, schema), "coreset")
    parts = max(1, -(-level.count() // size))
    while parts > 1:
        parts = -(-parts // TREE)
        level = settle(level.repartition(parts).mapInPandas(draw, schema), "coreset")
    return level


def compress_cloud(points: DataFrame, k: int, restarts: int = 10, seed: int = 0, sample: int = CORESET) -> DataFrame:
    """``k`` k-means centroids of the (already scaled) cloud, best of ``restarts``.

    The cloud comes back unchanged unless 0 < k < n.  Seeds are tried in order and
    the least training cost wins.  Beyond ``sample`` points the restarts run on
    their :func:`coreset`, which costs two passes over the cloud however many there
    are; None fits the whole cloud every time.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    settled = settle(points.select("vec"), "cloud")
    n = settled.count()
    if not 0 < k < n:
        return settled
    data, weight = settled, {}
    if sample is not None and n > sample:
        data, weight = coreset(settled, max(sample, k), seed), {"weightCol": "weight"}
    data = data.withColumn("features", array_to_vector("vec"))
    fits = [KMeans(k=k, seed=seed + i, **weight).fit(data) for i in range(restarts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    rows = [([float(x) for x in c],) for c in best.clusterCenters()]
    return points.sparkSession.createDataFrame(rows, "vec array<double>")


def project_2d(clouds: DataFrame, dim: int, label: str = "label", basis: list | None = None) -> DataFrame:
    """``label, pc1, pc2`` of every point plus ``var1, var2`` in percent.

    Scaler (zero spread becomes 1) and principal axes come from the clouds named
    in ``basis``, or from all.  The sign of an axis is arbitrary.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from talkprint.operators.stats import apply_scaler, fit_scaler

    pool = clouds if basis is None else clouds.where(F.col(label).isin(basis))
    scaler = fit_scaler(pool, dim, floor=5e-324)
    z_pool = apply_scaler(pool, scaler, dim).select(array_to_vector("vec").alias("x"))
    model = PCA(k=2, inputCol="x", outputCol="pc").fit(z_pool)
    var = [100.0 * float(v) for v in model.explainedVariance]
    z_all = apply_scaler(clouds, scaler, dim).select("*", array_to_vector("vec").alias("x"))
    pc = model.transform(z_all).withColumn("_pc", vector_to_array("pc"))
    return pc.select(
        label, F.col("_pc")[0].alias("pc1"), F.col("_pc")[1].alias("pc2"),
        F.lit(var[0]).alias("var1"), F.lit(var[1]).alias("var2"),
    )


def centroids(projected: DataFrame, group: str) -> DataFrame:
    """Mean projection per centroid group."""
    return projected.groupBy(group).agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
