"""Top-k search, near duplicates and substring deduplication against brute force."""

import datetime
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talkprint.llm import shingle_join, simhash, suffix_dedup, voronoi_knn

# ------------------------------------------------------------------ top-k search


def brute_top(rows, is_query, k, scale=1024):
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    usable = [
        (i, np.floor(np.array([*v, *[0.0] * (dim - len(v))]) * scale).astype(np.int64))
        for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        best = {}
        for _, a in (r for r in usable if r[0] == q):
            for i, b in usable:
                if i != q:
                    best[i] = max(best.get(i, -(2**62)), int(a @ b))
        ranked = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(voronoi_knn, "DATA_BLOCK", 40)
        monkeypatch.setattr(voronoi_knn, "QUERY_GROUP", 5)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)) * rng.uniform(0.1, 3, (400, 1))
    x[:130] = x[0]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 6), (1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 6), (1030, [float("inf")]), (1040, []), (1050, [2.0, 1.0]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int, id int")
    got = voronoi_knn.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda i: i % 10 == 0, 7)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 10 == 0
    assert [tuple(r) for r in voronoi_knn.top_k(df, is_query).collect()] == [(0, 1, 1, 2048 * 1024)]
    for none in (df.limit(0), df.where("vec_id = 0"), df.where("vec_id = 1")):
        assert voronoi_knn.top_k(none, is_query).count() == 0


@pytest.mark.parametrize("pivots", [1, 12])
def test_an_id_on_many_rows_counts_once(spark, pivots):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(7, (np.array([6.0, 6.0, 6.0, 6.0]) + rng.normal(size=4) * 0.1).tolist()) for _ in range(40)]
    rows += [(8, [5.0, 5.0, 5.0, 5.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = voronoi_knn.top_k(df, F.col("vec_id") % 10 == 0, k=5, pivots=pivots).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_clustered_data_prune_and_stay_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 20
    rows = [(i, (centres[i % 6] + rng.normal(size=5)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = voronoi_knn.top_k(df, F.col("vec_id") % 15 == 0, k=4, pivots=12).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda i: i % 15 == 0, 4)


def test_products_beyond_doubles_are_exact():
    q, x = np.array([[2.0**40 + 2**8, 3.0]]), np.array([[2.0**20 + 1, 5.0]])
    assert int(voronoi_knn.products(q, x)[0, 0]) == (2**40 + 2**8) * (2**20 + 1) + 15
    assert int(voronoi_knn.products(np.array([[1e30]]), np.array([[1e30]]))[0, 0]) == 2**63 - 1


# ------------------------------------------------------------------ SimHash


def brute_fingerprint(text, k):
    words = [w for w in text.encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, k, radius):
    fps = [brute_fingerprint(t or "", k) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and bin(fps[i] ^ fps[j]).count("1") <= radius:
                    low = min(label[i], label[j])
                    label = [low if v in (label[i], label[j]) else v for v in label]
                    changed = True
    out = []
    for (i, _), f, v in zip(rows, fps, label, strict=True):
        ids = [rows[n][0] for n in range(len(rows)) if label[n] == v and rows[n][0] is not None]
        out.append((i, f"{f:016x}", min(ids) if ids else None))
    return out


def near_copies(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄé") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(1, 250))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = word()
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t"), (None, "x"), (n + 3, "ABC"), (n + 4, "abc"), (n + 4, "abc"), (None, None)]


def canon(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("shingle", "radius", "block"), [(3, 3, 4096), (3, 3, 7), (5, 9, 4096)])
def test_components_equal_brute_force(spark, monkeypatch, shingle, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_copies(120, shingle)
    df = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in rows], "doc_id long, text string, fp string, rank int, id int")
    got = simhash.near_duplicates(df, shingle, radius).select("doc_id", simhash.hex_fingerprint("fp").alias("f"), "component_id")
    assert canon(map(tuple, got.collect())) == canon(brute_components(rows, shingle, radius))


def test_unequal_thresholds_find_all_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 12, dtype=np.int64)
    flips = [(1 << a) | (1 << b) for a, b in rng.integers(0, 63, (300, 2)).tolist()]
    fps = sorted({int(c) ^ f for c in centre for f in flips[:40]})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    parts = [(list(range(0, 10)), 1), (list(range(10, 30)), 0), (list(range(30, 64)), 0)]
    got = simhash.components(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("rank")), simhash.links(nodes, 3, parts))
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    assert {r.node: r.component for r in got.collect()} == {f: fps[label[i]] for i, f in enumerate(fps)}


def test_allocation_is_optimal_and_sums_up():
    rng = np.random.default_rng(1)
    for _ in range(20):
        costs = [[0.0, *np.cumsum(rng.random(4) * 10)] for _ in range(4)]
        cost, chosen = simhash.allocate(costs, 3)
        assert sum(t + 1 for t in chosen) == 4
        every = [c for c in np.ndindex(5, 5, 5, 5) if sum(c) == 4]
        assert cost == pytest.approx(min(sum(costs[i][t] for i, t in enumerate(c)) for c in every))


def test_bits_are_grouped_once_and_by_correlation():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    groups = simhash.group_bits(500, bits.T @ bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 40} <= set(g) for g in groups)


def test_empty_tables_and_representatives(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(4, text, "a"), (2, text, "b"), (9, "something else entirely here", "c"), (None, text, "d")]
    kept = simhash.representatives(spark.createDataFrame(rows, empty.schema))
    assert sorted(r.lang for r in kept.collect()) == ["b", "c", "d"]


# ------------------------------------------------------------------ verified near duplicates


def brute_likeness_groups(texts, k=5):
    """Smallest place of each text's group by exact Jaccard likeness of word shingles, 0.8 or more."""
    sets = []
    for t in texts:
        words = t.encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split()
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


def edited_copies(seed, groups=40, copies=6):
    """Texts whose likeness to each other lies around 0.8: words are changed until a share of the shingles is new."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 30))):
                words[at] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return out + ["one two", "One  two", "three", "", " "]


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates_are_those_of_exact_likeness(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    monkeypatch.setattr(shingle_join, "FAN", 2)
    texts = edited_copies(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in shingle_join.one_of_each(df).collect()}
    assert kept == set(brute_likeness_groups(texts))


def test_pairs_of_other_components_are_compared_in_place():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 40, 12)]
    size, low = np.full(4, 100), np.stack([shingle_join.minima(s * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint8) for s in sets])
    at = np.arange(4)
    assert sorted(map(sorted, zip(*shingle_join.linked(at, size, low, sets, at, at, 800)))) == [[0, 1], [1, 3]]


# ------------------------------------------------------------------ substrings


def brute_removed(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        out.append(mask)
    return out


@pytest.mark.parametrize("bucket", [2048, 3])
def test_removal_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [para(30) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.5 else para(rng.randint(1, 60)) for _ in range(rng.randint(0, 4))]
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, "a" * 500), (502, "ab" * 300), (503, rows[3][1]), (503, rows[3][1]), (None, rows[4][1] + "zz"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, th string, doc int, id int")
    want = []
    for (i, t), mask in zip(rows, brute_removed([(t or "").encode() for _, t in rows], 100), strict=True):
        data = (t or "").encode()
        kept = bytes(c for c, m in zip(data, mask, strict=True) if not m)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        want.append((i, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.removal_digests(df, 100).collect()
    assert canon(map(tuple, got)) == canon(want)


def test_fingerprints_of_sets_lead_to_pairs_within_the_radius(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(30):
        words = [f"{w}x{i // 6}" for w in base]
        for _ in range(i % 6):
            words[rng.randrange(400)] = f"new{rng.random()}"
        texts[i] = " ".join(words)
    texts[30] = texts[0] + " "
    rows = spark.createDataFrame(sorted(texts.items()), "__row long, text string")
    nodes = shingle_join.probes(rows, 5, "text").dropDuplicates(["node"])
    fps = {r.node: r.fp % 2**64 for r in nodes.collect()}
    assert len(fps) == 30 and all(
        fps[r.node] == sum((2 * sum(int(h) >> b & 1 for h in s) > len(s)) << b for b in range(64))
        for r in shingle_join.probes(rows, 5, "text").where("row < 3").collect() for s in [shingle_join.shingle_set(texts[r.row].encode())]
    )

    def closed(pairs):
        least = {n: n for n in fps}
        for _ in fps:
            for x, y in pairs:
                least[x] = least[y] = min(least[x], least[y])
        return least

    found = [(r.a, r.b) for r in shingle_join.near_fingerprints(nodes).collect()]
    near = [(x, y) for x in fps for y in fps if x < y and (fps[x] ^ fps[y]).bit_count() <= shingle_join.RADIUS]
    assert near and closed(found) == closed(near)


def test_suffix_sort_orders_and_finds_pairs():
    rng = random.Random(1)
    for trial in range(40):
        rows = ["".join(rng.choice("ab" if trial % 2 else "abcd") for _ in range(rng.randint(12, 60))).encode() for _ in range(5)]
        data = b"".join(rows)
        at = np.cumsum([0, *map(len, rows[:-1])])
        starts = np.concatenate([a + np.arange(len(r) - 11) for a, r in zip(at, rows, strict=True)])
        group = np.sort(np.random.default_rng(trial).integers(0, 3, len(starts)))
        key = [(int(g), data[s:s + 12]) for s, g in zip(starts.tolist(), group.tolist(), strict=True)]
        ext = suffix_dedup.Extensions(np.frombuffer(data, np.uint8), 12)
        order = suffix_dedup.sorted_suffixes(ext, starts, group)
        assert [key[i] for i in order] == sorted(key)
        count = Counter(key)
        assert suffix_dedup.repeated(data, starts, group, 12).tolist() == [count[k] > 1 for k in key]


def test_a_hash_collision_is_noticed(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Extensions, "common", lambda self, a, b: np.full(len(a), self.length))
    data = b"abcabdabc"
    twice = suffix_dedup.repeated(data, np.array([0, 3, 6]), np.zeros(3, int), 3)
    assert twice.tolist() == [True, False, True]


def test_windows_of_one_anchor_are_a_partition():
    data = bytes(random.Random(0).randrange(97, 101) for _ in range(3000))
    runs = list(suffix_dedup.anchored_runs(data, 400, 256))
    assert [r[0] for r in runs[1:]] == [r[1] + 1 for r in runs[:-1]] and runs[0][0] == 0 and runs[-1][1] == 2600
    assert all(a - 255 <= lo <= hi <= a for lo, hi, a in runs)


def test_removal_without_rows_and_kept_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removal_digests(empty).count() == 0
    passage = "pässage " * 60
    rows = [(1, "first " + passage + "end"), (2, "other " + passage), (3, None), (4, "short")]
    df = spark.createDataFrame(rows, empty.schema)
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    assert left[3] is None and left[4] == "short" and len(left[1].encode()) < 60 and left[1].startswith("first")


def test_kept_text_is_computed_once_and_leaves_other_columns(spark):
    passage = "pässage " * 60
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, "first " + passage, [1.5], at[0]), (2, None, None, None), (None, passage + "ünd", [], at[1]), (2, "", [None], at[2])]
    df = spark.createDataFrame(rows, "n long, body string, v array<double>, t timestamp")
    left = suffix_dedup.without_repeats(df, id_col="n", text_col="body").where(F.char_length("body") > 0)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1
    kept = [tuple(r) for r in suffix_dedup.without_repeats(df, id_col="n", text_col="body").collect()]
    assert left.count() == 2 and left.schema == df.schema
    assert canon([(n, v, t) for n, _, v, t in kept]) == canon([(n, v, t) for n, _, v, t in rows])
    assert sorted(str(b) for _, b, *_ in kept) == sorted(["first", "None", "ünd", ""])
