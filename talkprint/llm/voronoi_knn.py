"""Exact top-k search by inner product with a Voronoi kNN join.

Inner product becomes distance by one more coordinate: with M the largest norm,
data ``x`` turn into ``(x, sqrt(M^2 - |x|^2))`` and queries ``q`` into
``(q, 0)``; then ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``, so the nearest are those
of highest product.

Pivots cut the space into Voronoi cells.  One pass assigns every row to the cell
of its nearest pivot and summarises the cells: numbers, smallest and largest
distance to the pivot, the distances of the k nearest ids.  From the
summaries alone follows, for each cell of queries, a radius that surely holds k
data rows, and so the range of pivot distances outside which the data of another
cell cannot matter to it.  Only data inside are sent to a group of queries.

Cells of data beyond ``DATA_BLOCK`` rows (copies of one vector, for instance)
are cut into blocks, cells of queries beyond ``QUERY_GROUP`` into groups and
small ones joined, so every local problem is bounded.  A block hands on k rows
per query.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkprint.llm.common import map_batches
from talkprint.sources.shared import settle

DATA_BLOCK = 4096
QUERY_GROUP = 1024
MAX_PIVOTS = 1024
LONG = (-(2**63), 2**63 - 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: rows with an id and a vector of finite components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")
    )


def _scaled(rows: list, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, shorter vectors filled with zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return np.floor(out * scale)


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.column_stack([x, extra])
    squared = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.clip(squared, 0, None))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the exact range of doubles in whole numbers, ending at a long's limits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object)
    return np.clip(whole(q) @ whole(x).T, *LONG).astype(np.int64)


def local_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best ids of a block for each query, by their best rows; ties to the smaller id, never the own id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ids = ids[starts]
    out = [[], [], []]
    for at in range(0, len(q), 256):
        scores = products(q[at:at + 256], x)
        if 0 < len(starts) < len(x):
            scores = np.maximum.reduceat(scores, starts, axis=1)
        for i, row in enumerate(scores):
            qid = q_ids[at + i]
            # One more, as the own id may be among them.
            need = min(len(ids), k + 1)
            if need == 0:
                continue
            bar = np.partition(row, len(row) - need)[len(row) - need]
            sure, tied = np.flatnonzero(row > bar), np.flatnonzero(row == bar)
            chosen = np.concatenate([sure, tied[:need - len(sure)]])
            chosen = chosen[ids[chosen] != qid]
            chosen = chosen[np.lexsort((ids[chosen], -row[chosen]))][:k]
            out[0].append(np.full(len(chosen), qid))
            out[1].append(ids[chosen])
            out[2].append(row[chosen])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def bounds(pivots: np.ndarray, q_far: np.ndarray, nearest: dict[int, list[tuple[float, int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per (query cell, data cell) the range of pivot distances that can hold one of the k best.

    ``q_far``: largest distance of a query to its pivot, ``nearest``: smallest
    distances of the data of each cell to its pivot, with their distinct ids.
    """
    apart = np.sqrt(np.clip(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1), 0, None))
    cells = sorted((i, j, d) for j, near in nearest.items() for d, i in near)
    ids, cell = np.array([i for i, _, _ in cells], np.int64), np.array([j for _, j, _ in cells], np.int64)
    upper = apart[:, cell] + np.array([d for _, _, d in cells])[None, :] if len(cells) else np.zeros((len(pivots), 0))
    if len(cells):
        # An id that lies in several cells counts once.
        upper = np.minimum.reduceat(upper, np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])), axis=1)
    # One more than k, as a query may itself be among the data.
    if upper.shape[1] > k:
        radius = q_far + np.partition(upper, k, axis=1)[:, k]
    else:
        radius = np.full(len(pivots), np.inf)
    slack = 1e-6 * (1 + apart.max(initial=0) + q_far.max(initial=0))
    reach = (q_far + radius)[:, None] + slack
    return apart - reach, apart + reach


def query_groups(counts: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """(first group, number of groups) of every query cell: large cells have several, small neighbouring ones share one."""
    out, group, filled = {}, -1, most
    left, here = dict(counts), None
    while left:
        options = sorted(left)
        here = options[0] if here is None else min(options, key=lambda c: (((pivots[c] - pivots[here]) ** 2).sum(), c))
        n = left.pop(here)
        if n > most:
            cuts = -(-n // most)
            out[here] = (group + 1, cuts)
            group, filled = group + cuts, most
        else:
            if filled + n > most:
                group, filled = group + 1, 0
            out[here] = (group, 1)
            filled += n
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, pivots: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for every row where ``is_query`` holds.

    Components become floor(scale * x).  Rows without id, and vectors that are
    null or hold a null or non-finite component, take no part; shorter vectors
    count as filled up with zeros.  Rows that share an id count as one, by their
    best score.  A table with fewer candidates than ``k`` gives all of them.
    """
    rows = usable(vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))), id_col, vector_col)
    flagged = usable(vectors.where(F.coalesce(is_query, F.lit(False))), id_col, vector_col).select("id", "x")
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") ** 2)
    seen = rows.agg(F.max(norm).alias("most"), F.max(F.size("x")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not seen.n:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, most = seen.dim, seen.most
    wanted = pivots or min(MAX_PIVOTS, max(4, int(math.sqrt(seen.n) / 4)))
    sample = [r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    points = np.unique(_scaled(sample, dim, scale), axis=0)
    lift = lambda x: np.sqrt(np.clip(most - (x**2).sum(1), 0, None))
    centres = np.column_stack([points, lift(points)])

    def assign(data: bool):
        def run(batches):
            for b in batches:
                x = _scaled(b["x"], dim, scale)
                d = _distances(x, lift(x) if data else np.zeros(len(x)), centres)
                cell = d.argmin(1)
                yield [b["id"], [r.tobytes() for r in x], cell.tolist(), d[np.arange(len(x)), cell].tolist()]

        return run

    schema = "id long, v binary, cell int, d double"
    # Rows of one id and one vector are one row.
    data = settle(map_batches(rows, assign(True), schema).dropDuplicates(["id", "v"]), "knn-data")
    asked = settle(map_batches(flagged, assign(False), schema).dropDuplicates(["id", "v"]), "knn-queries")

    # Summaries: a bounded number of rows (cells), each of bounded size.
    def nearest_of_task(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, d, ids = np.array(b["cell"]), np.array(b["d"]), np.array(b["id"], np.int64)
            for c in np.unique(cell).tolist():
                so_far = kept.get(c, (np.zeros(0), np.zeros(0, np.int64)))
                ds, names = np.concatenate([so_far[0], d[cell == c]]), np.concatenate([so_far[1], ids[cell == c]])
                order = np.lexsort((names, ds))
                ds, names = ds[order], names[order]
                first = np.sort(np.unique(names, return_index=True)[1])[:k + 1]
                kept[c] = ds[first], names[first]
        flat = [(c, d, i) for c, (ds, names) in kept.items() for d, i in zip(ds.tolist(), names.tolist(), strict=True)]
        yield [[x[p] for x in flat] for p in range(3)]

    nearest = {
        r.cell: [(x.d, x.id) for x in r.near]
        for r in map_batches(data.select("cell", "d", "id"), nearest_of_task, "cell int, d double, id long")
        .groupBy("cell", "id").agg(F.min("d").alias("d"))
        .groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near")).collect()
    }
    sizes = {r.cell: r.n for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_queries = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()
    if not of_queries:
        return vectors.sparkSession.createDataFrame([], empty)
    far = np.zeros(len(centres))
    for r in of_queries:
        far[r.cell] = r.far
    low, high = bounds(centres, far, nearest, k)
    groups = query_groups({r.cell: r.n for r in of_queries}, centres, QUERY_GROUP)
    cuts = {c: -(-n // DATA_BLOCK) for c, n in sizes.items()}

    def group_of(ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        first = np.array([groups[c][0] for c in cells.tolist()])
        number = np.array([groups[c][1] for c in cells.tolist()])
        return first + (ids * 0x9E3779B1 >> 16) % number

    # Blocks of data that each query cell needs at all, from the summaries; sent to every group of the cell.
    far_data = {r.cell: r.m for r in data.groupBy("cell").agg(F.max("d").alias("m")).collect()}
    needs = {}
    for i in groups:
        for j, ds in nearest.items():
            if low[i, j] <= far_data[j] and high[i, j] >= ds[0][0]:
                for g in range(groups[i][0], groups[i][0] + groups[i][1]):
                    needs.setdefault(g, set()).add(j)
    members: dict[int, list[int]] = {}
    for i, (g, n) in groups.items():
        for x in range(g, g + n):
            members.setdefault(x, []).append(i)

    def send_data(batches):
        for b in batches:
            ids, cell, d, v = np.array(b["id"], np.int64), np.array(b["cell"]), np.array(b["d"]), b["v"]
            salt = (ids * 0x85EBCA77 >> 13) % np.array([cuts[c] for c in cell.tolist()])
            for g, cells in members.items():
                inside = ((low[cells][:, cell] <= d) & (high[cells][:, cell] >= d)).any(0)
                at = np.flatnonzero(inside)
                if len(at):
                    yield [[g] * len(at), cell[at], salt[at], ids[at], [v[i] for i in at]]

    def send_queries(batches):
        for b in batches:
            ids, cell, v = np.array(b["id"], np.int64), np.array(b["cell"]), b["v"]
            if not len(ids):
                continue
            group = group_of(ids, cell)
            for g in np.unique(group).tolist():
                at = np.flatnonzero(group == g)
                for j in needs.get(g, ()):
                    for s in range(cuts[j]):
                        yield [[g] * len(at), [j] * len(at), [s] * len(at), ids[at], [v[i] for i in at]]

    sent = "g int, cell int, salt int, id long, v binary"
    keys = ["g", "cell", "salt"]

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")
        vectors_of = lambda f: np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), dim)
        a, b, s = local_top(q["id"].to_numpy(), vectors_of(q), x["id"].to_numpy(), vectors_of(x), k)
        return pd.DataFrame({"query_id": a, "id": b, "score": s})

    near = (
        map_batches(asked, send_queries, sent).groupBy(*keys).cogroup(map_batches(data, send_data, sent).groupBy(*keys))
        .applyInPandas(solve, "query_id long, id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
