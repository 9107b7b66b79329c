import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import distance, stats


@pytest.fixture
def cloud(spark):
    def make(rows, grp=None):
        data = [(i, str((grp or [0] * len(rows))[i]), [float(x) for x in r]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "id int, g string, vec array<double>")

    return make


def d_ref(spark, x):
    return spark.createDataFrame([(float(x),)], "d_ref double")


def brute_chamfer(p, h, d):
    m = np.linalg.norm(h[:, None] - p[None], axis=2)
    return max(0.0, 1 - min(1.0, (m.min(1).mean() + m.min(0).mean()) / (2 * d)))


def test_dice(spark):
    row = spark.range(1).select(
        stats.dice(F.lit(0.0), F.lit(0.0)).alias("a"), stats.dice(F.lit(5.0), F.lit(5.0)).alias("b"),
        stats.dice(F.lit(1.0), F.lit(-2.0)).alias("c"),
    ).first()
    assert (row.a, row.b) == (1.0, 1.0) and row.c == pytest.approx(2 / 3)


def test_chamfer_known_values(spark, cloud):
    h, p = cloud([[0] * 19]), cloud([[1] + [0] * 18])
    assert distance.overall_chamfer(p, h, d_ref(spark, 2)).first()[0] == pytest.approx(0.5)
    assert distance.overall_chamfer(p, h, d_ref(spark, 0.5)).first()[0] == 0.0
    same = cloud(np.ones((4, 19)))
    assert distance.overall_chamfer(same, same, d_ref(spark, 1)).first()[0] == pytest.approx(1.0)


def test_chamfer_empty_and_zero(spark, cloud):
    h, none = cloud(np.ones((4, 3))), cloud(np.ones((1, 3))).limit(0)
    assert distance.overall_chamfer(none, h, d_ref(spark, 1)).first()[0] == 0.0
    assert distance.overall_chamfer(h, none, d_ref(spark, 1)).first()[0] == 0.0
    assert distance.overall_chamfer(h, h, d_ref(spark, 0)).first()[0] == 0.0


def test_empty_sides_with_string_groups(spark, cloud):
    p, h = cloud(np.ones((4, 3)), ["a", "a", "b", "b"]), cloud(np.ones((4, 3)))
    assert {r.g: r.chamfer for r in distance.chamfer(p, h.limit(0), d_ref(spark, 1), "g").collect()} == {"a": 0.0, "b": 0.0}
    assert distance.chamfer(p.limit(0), h, d_ref(spark, 1), "g").count() == 0
    assert distance.mean_task_chamfer(p, h.limit(0), d_ref(spark, 1), "g").first()[0] == 0.0


def test_groups_of_a_block_are_one_row_per_block_of_humans(cloud):
    rng = np.random.default_rng(3)
    p, h = cloud(rng.random((200, 3)), [i % 100 for i in range(200)]), cloud(rng.random((150, 3)))
    _, rows = distance.cell_minima(p, h, "g", block_rows=50)
    sides = {r.side: r["count"] for r in rows.groupBy("side").count().collect()}
    blocks = 3
    assert sides[distance.WHOLE] <= 100 * blocks and sides[distance.POINT] <= 200 * blocks and distance.HUMAN not in sides


def test_one_large_group_is_split(spark, cloud):
    rng = np.random.default_rng(4)
    x, h = rng.random((60, 3)), rng.random((30, 3))
    groups = [0 if i < 50 else i for i in range(60)]
    got = {r.g: r.chamfer for r in distance.chamfer(cloud(x, groups), cloud(h), d_ref(spark, 1), "g", block_rows=8).collect()}
    want = {str(g): brute_chamfer(x[[k == g for k in groups]], h, 1) for g in set(groups)}
    assert got == pytest.approx(want)


def test_near_beats_far(spark, cloud):
    rng = np.random.default_rng(0)
    h = rng.random((6, 5))
    near, far = (distance.overall_chamfer(cloud(x), cloud(h), d_ref(spark, 1)).first()[0] for x in (h + 0.01, h + 10))
    assert near > far


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_blocks_change_nothing(spark, cloud, block_rows):
    """Many cells or one, a third of the points being copies."""
    rng = np.random.default_rng(1)
    h = np.vstack([rng.random((20, 4)), np.repeat(rng.random((1, 4)), 10, 0)])
    p = np.vstack([rng.random((17, 4)), h[:5]])
    groups = [i % 3 for i in range(len(p))]
    spread = distance.reference_spread(cloud(h), block_rows).first()
    pairs = [np.linalg.norm(h[i] - h[j]) for i in range(len(h)) for j in range(i)]
    assert spread.n == 30 and spread.d_ref == pytest.approx(np.mean(pairs))
    got = {r.g: r.chamfer for r in distance.chamfer(cloud(p, groups), cloud(h), d_ref(spark, spread.d_ref), "g", block_rows).collect()}
    want = {str(g): brute_chamfer(p[[k == g for k in groups]], h, spread.d_ref) for g in range(3)}
    assert got == pytest.approx(want)
    mean = distance.mean_task_chamfer(cloud(p, groups), cloud(h), d_ref(spark, spread.d_ref), "g", block_rows=block_rows).first()[0]
    assert mean == pytest.approx(np.mean(list(want.values())))


def test_a_spread_cell_holds_few_distances():
    rng = np.random.default_rng(3)
    x, w = rng.random((5000, 6)), rng.integers(1, 4, 5000)
    side = lambda blk, s: pd.DataFrame({"blk": blk, "w": w[s], "vec": list(x[s])})
    a, b = slice(0, 2000), slice(2000, 5000)
    tracemalloc.start()
    apart = distance._spread_cell(pd.concat([side(0, a), side(1, b)], ignore_index=True).assign(ci=0, cj=1)).part[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    inside = distance._spread_cell(side(0, a).assign(ci=0, cj=0)).part[0]
    far = lambda s: w[a] @ np.stack([np.sqrt(((p - x[s]) ** 2).sum(1)) for p in x[a]]) @ w[s]
    assert apart == pytest.approx(far(b)) and inside == pytest.approx(far(a) / 2)
    assert peak < 8e6  # a million distances alone take as much


def test_spread_of_tiny_clouds(cloud):
    assert distance.reference_spread(cloud([[1, 2]])).first().d_ref == 1.0
    assert distance.reference_spread(cloud([[1, 2], [1, 2]])).first().d_ref == 1.0
    assert distance.reference_spread(cloud([[1, 2]]).limit(0)).first().d_ref == 1.0


def test_scaler_constant_feature(cloud):
    c = cloud([[1, 5], [3, 5]])
    s = stats.fit_scaler(c, 2).first()
    assert s.mu == [2.0, 5.0] and s.sd == [1.0, 1.0]
    z = sorted(r.vec for r in stats.apply_scaler(c, stats.fit_scaler(c, 2), 2).collect())
    assert z == [[-1.0, 0.0], [1.0, 0.0]]


def test_standardised_identical_cloud_is_perfect(spark, cloud):
    raw = cloud(np.random.default_rng(1).random((5, 4)) * 10)
    z = stats.apply_scaler(raw, stats.fit_scaler(raw, 4), 4)
    assert distance.overall_chamfer(z, z, d_ref(spark, 1)).first()[0] == pytest.approx(1.0)


def test_assemble_missing_is_zero(spark):
    df = spark.createDataFrame([(1.0, None)], "words_per_turn double, opening_length double")
    assert stats.assemble(df, ["words_per_turn", "opening_length", "nothing"]).first().vec == [1.0, 0.0, 0.0]


def test_population_stats_and_alignment(spark):
    rows = [tuple([i, 2] + [float(i)] * 19) for i in (1, 3)]
    fps = spark.createDataFrame(rows, "dialog_id int, n_messages int, " + ", ".join(f"{f} double" for f in FEATURES))
    ref = stats.population_stats(fps, "src", "dom")
    assert {(r["mean"], r["std"], r.n, r.source) for r in ref.collect()} == {(2.0, 1.0, 2, "src")} and ref.count() == 19
    self_match = stats.overall_dice(fps, ref).first()
    assert all(v == pytest.approx(1.0) for v in self_match)
    assert list(stats.overall_dice(fps.limit(0), ref).first()) == [0.0] * 5
    with pytest.raises(Exception, match="no fingerprints"):
        stats.population_stats(fps.where("n_messages > 5")).collect()
    with pytest.raises(Exception, match="no fingerprints"):
        stats.population_stats(fps.where("n_messages > 5")).select("feature").collect()
    with pytest.raises(Exception, match="several references"):
        stats.overall_dice(fps, ref.union(stats.population_stats(fps, "src", "other"))).collect()
    assert {r["mean"] for r in stats.neutral_prior(spark).collect()} == {0.0}


def test_half_width(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, x double")
    got = {r.g: r.ci for r in df.groupBy("g").agg(stats.half_width(F.col("x")).alias("ci")).collect()}
    assert got == {"a": pytest.approx(1.96), "b": 0.0}


def test_compress_and_project(spark, cloud):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))
    both = cloud(np.vstack([a, b]))
    two = sorted(r.vec[0] for r in distance.compress_cloud(both, 2, restarts=2).collect())
    assert two[0] == pytest.approx(a[:, 0].mean(), abs=1e-6) and two[1] == pytest.approx(b[:, 0].mean(), abs=1e-6)
    assert distance.compress_cloud(both, 0).count() == 40 and distance.compress_cloud(both, 40).count() == 40
    labelled = both.withColumn("label", F.when(F.col("id") < 20, "a").otherwise("b"))
    pc = distance.project_2d(labelled, 3)
    row = pc.first()
    assert 90 < row.var1 <= 100 and row.var1 + row.var2 <= 100 + 1e-9
    c = {r.label: r.pc1 for r in distance.centroids(pc, "label").collect()}
    assert abs(c["a"] - c["b"]) > 2 and c["a"] == pytest.approx(-c["b"])


def test_nearest_equals_full_scan():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (50, 70), (300, 900)):
        a, b = rng.random((n, 5)), np.vstack([rng.random((m, 5)), np.full((3, 5), 0.5)])
        d, tried = distance.nearest(a, b)
        assert d == pytest.approx(np.linalg.norm(a[:, None] - b[None], axis=2).min(1), abs=1e-12) and tried > 0


@pytest.mark.parametrize("block_rows", [40, 100, 2048])
def test_clustered_clouds_need_few_distances(spark, cloud, block_rows):
    rng = np.random.default_rng(11)
    centres = rng.uniform(-50, 50, (30, 6))
    p, h = (centres[np.arange(n) % 30] + rng.normal(0, 0.1, (n, 6)) for n in (1500, 1200))
    counter = spark.sparkContext.accumulator(0)
    got = distance.chamfer(cloud(p), cloud(h), d_ref(spark, 5), "g", block_rows, counter).first().chamfer
    assert got == pytest.approx(brute_chamfer(p, h, 5))
    assert 0 < counter.value < 0.35 * 2 * len(p) * len(h)


def test_groups_of_all_sizes_and_copies(spark, cloud):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 1, (400, 3)), np.zeros((60, 3)), rng.normal(5, 1, (40, 3))])
    h = np.vstack([rng.normal(0, 1, (250, 3)), np.zeros((50, 3))])
    groups = [0 if i < 300 else i % 7 for i in range(len(x))]
    want = {str(g): brute_chamfer(x[[k == g for k in groups]], h, 3) for g in set(groups)}
    for block_rows in (16, 64):
        got = distance.chamfer(cloud(x, groups), cloud(h), d_ref(spark, 3), "g", block_rows)
        assert {r.g: r.chamfer for r in got.collect()} == pytest.approx(want)


def test_a_point_meets_blocks_not_cells_where_no_bound_helps(spark, cloud):
    """In many dimensions every cell is in reach; copies of a point must be as few as blocks, packed in rows of bounded size."""
    rng, block_rows, n = np.random.default_rng(14), 25, 1500
    p = cloud(rng.normal(0, 1, (n, 24)), [i % 3 for i in range(n)])
    h = cloud(rng.normal(0, 1, (400, 24))).select("vec", F.col("id").cast("long").alias("pid"))
    pivots = distance._pivots(h, 400)
    sent, home = distance._meeting(h, 400, p.select(F.col("g").alias("grp"), "vec"), pivots, block_rows)
    rows, blocks = sent.select("grp", "sub", (F.length("pids") / 8).alias("n")).collect(), home.groupBy("grp", "sub", "salt").count().collect()
    fill = distance.QUERY_BLOCKS * block_rows
    assert sum(r.n for r in rows) <= 400 * (n / fill + 3) < 400 * 3 * len(pivots)
    assert len({(r.grp, r.sub) for r in rows}) <= n / fill + 3 and max(r["count"] for r in blocks) <= 3 * fill
    assert max(r.n for r in rows) <= 3 * block_rows
    got = {r.g: r.chamfer for r in distance.chamfer(p, h, d_ref(spark, 30), "g", block_rows).collect()}
    x, hs = np.array([r.vec for r in p.orderBy("id").collect()]), np.array([r.vec for r in h.collect()])
    assert got == pytest.approx({str(g): brute_chamfer(x[g::3], hs, 30) for g in range(3)})


def test_blocks_grow_before_they_multiply():
    """Copies of a row are as many as blocks of its cloud."""
    assert [distance._n_blocks(n, 2048) for n in (0, 2048, 2049, 32_768, 51_000, 262_144, 307_000)] == [1, 1, 2, 16, 16, 16, 19]


def test_spread_estimate_keeps_its_bound(spark, cloud):
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(0, 1, (700, 4)), rng.normal(9, 0.2, (300, 4)), np.zeros((200, 4))])
    exact = distance.reference_spread(cloud(x)).first().d_ref
    for seed in range(3):
        found = distance.estimate_spread(cloud(x), pairs=20_000, seed=seed).first()
        assert found.n == 1200 and abs(found.d_ref - exact) <= found.half_width < 0.06 * exact
    few = distance.estimate_spread(cloud(x), pairs=200).first()
    assert abs(few.d_ref - exact) <= few.half_width and few.half_width > found.half_width


def test_spread_estimate_of_tiny_clouds(cloud):
    assert distance.estimate_spread(cloud([[1, 2]])).first().d_ref == 1.0
    assert distance.estimate_spread(cloud([[1, 2]]).limit(0)).first().n == 0
    assert distance.estimate_spread(cloud([[1, 2], [1, 2]])).first().d_ref == 1.0
    two = distance.estimate_spread(cloud([[0, 0], [3, 4]])).first()
    assert abs(two.d_ref - 5) <= two.half_width + 1e-9


def test_coreset_keeps_the_cost_of_clusters(spark, cloud):
    rng = np.random.default_rng(21)
    centres = rng.uniform(-10, 10, (6, 3))
    x = centres[rng.integers(0, 6, 5000)] + rng.normal(0, 1, (5000, 3))
    points = cloud(x).repartition(9)
    small = distance.coreset(points, 300).collect()
    assert len(small) <= 300 and sum(r.weight for r in small) == pytest.approx(5000, rel=0.15)
    cost = lambda df: (np.linalg.norm(x[:, None] - np.array([r.vec for r in df.collect()])[None], axis=2).min(1) ** 2).sum()
    sampled, full = (cost(distance.compress_cloud(points, 6, restarts=4, sample=s)) for s in (300, None))
    assert sampled <= 1.2 * full
