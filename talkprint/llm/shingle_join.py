"""Near duplicates by SimHash, verified on the exact Jaccard likeness of their shingle sets.

Every set has a 64-bit SimHash; fingerprints within ``RADIUS`` bits are found with
the generalised pigeonhole principle (:mod:`talkprint.llm.simhash`), and every link
is verified on the hashed shingles themselves.

At likeness 0.8 fingerprints differ in 9.7 of 64 bits on average, and a radius that
misses next to nothing takes in unrelated pairs by the million.  What the
fingerprints leave apart therefore probes by bands of minimum hashes as well: sets of
likeness J agree in one of ``BANDS`` bands of ``ROWS`` minima with probability
``1 - (1 - J^ROWS)^BANDS``, which falls short of 1 by 1.1e-9 at 0.8.

* Equal sets are one node; equal fingerprints are one in the search by SimHash.
* A node that its fingerprint did not join yet is first verified against one other
  only, the smallest node that it meets in a band; groups of copies fall together
  here, in as many comparisons as nodes.
* In buckets whose nodes are not in one component yet, a spanning forest of the
  pairs with the most agreeing minima joins all that sizes and minima do not rule
  out (``SLACK`` is over six deviations).  Its links are verified too.
* What that forest joins and verified links do not is compared in place, all pairs
  of different components on their sets.  Pairs never become rows.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm import simhash
from talkprint.llm.common import SLICE_ROWS, give_back, map_batches, utf8
from talkprint.sources.shared import settle

RADIUS = 6
ROWS, BANDS = 5, 52
SLACK = 0.16
BLOCK = 4096
FAN = 256
_DRAW = np.random.default_rng(simhash.SEED)
_TIMES = (_DRAW.integers(0, 2**31, ROWS * BANDS, np.uint32) * 2 + 1)[:, None]
_MASK = _DRAW.integers(0, 2**32, ROWS * BANDS, np.uint32)[:, None]


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the runs of ``shingle`` words; fewer words are one run, no words the empty set."""
    words = simhash.words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[j:] for j in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), simhash.SEED) for r in runs], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each of ``ROWS * BANDS`` mixings."""
    out = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(out, ((short[None, at:at + 1024] ^ _MASK) * _TIMES).min(1), out=out)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the set, as a signed long: bit ``b`` is set if it is set in more than half of the hashes."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(hashes), simhash.SHINGLES_AT_ONCE):
        part = hashes[at:at + simhash.SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def alike(a: np.ndarray, b: np.ndarray, permille: int) -> bool:
    """Whether the likeness is at least ``permille`` thousandths, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 1000 >= permille * (len(a) + len(b) - both)


def probes(rows: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``row, node, size, fp, keys, minima`` of every row: a hash of its set, its SimHash, the values of its bands, a byte of
    each minimum."""

    def run(batches):
        for b in batches:
            out = [b["row"], [], [], [], [], []]
            for t in b["text"]:
                found = shingle_set(t, shingle)
                low = minima(found)
                keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
                out[1].append(xxhash.xxh64_intdigest(found.tobytes()))
                out[2].append(len(found))
                out[3].append(fingerprint(found))
                out[4].append(np.array(keys, np.uint64).view(np.int64).tolist())
                out[5].append(low.astype(np.uint8).tobytes())
            out[1] = np.array(out[1], np.uint64).view(np.int64).tolist()
            yield out

    narrow = rows.select(F.col("__row").alias("row"), utf8(text_col).alias("text"))
    return map_batches(narrow, run, "row long, node long, size int, fp long, keys array<long>, minima binary")


def near_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of nodes with equal fingerprints, and of the first nodes of fingerprints within ``radius`` bits.

    Their closure is that of all pairs of nodes whose fingerprints are that near.
    """
    first = settle(nodes.groupBy("fp").agg(F.min("node").alias("b")), "fingerprint-nodes")
    equal = nodes.join(first, "fp").where("node != b").select(F.col("node").alias("a"), "b")
    near = simhash.links(first.select("fp"), radius).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    ends = [first.select(F.col("fp").alias(f"fp_{x}"), F.col("b").alias(x)) for x in ("a", "b")]
    return settle(equal.unionByName(near.join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b")), "near-fingerprints")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``node, hashes`` of the wanted nodes."""
    texts = rows.join(nodes.join(wanted, "node", "left_semi").select("node", F.col("row").alias("__row")), "__row")

    def run(batches):
        for b in batches:
            yield [b["node"], [shingle_set(t, shingle).tobytes() for t in b["text"]]]

    return settle(map_batches(texts.select("node", utf8(text_col).alias("text")), run, "node long, hashes binary"), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, text_col: str, permille: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are alike; a ``b`` of many pairs is sent once to every ``FAN`` of them."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = shingle_sets(ends, nodes, rows, shingle, text_col)
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("cuts")).where("cuts > 1")
    dealt = pairs.join(many, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("cuts", F.lit(1))).cast("int"))
    right = dealt.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    left = dealt.select("a", "b", "salt").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")

    def compare(batches):
        of = lambda x: np.frombuffer(x, np.uint64)
        for b in batches:
            good = [k for k, (x, y) in enumerate(zip(b["of_a"], b["of_b"], strict=True)) if alike(of(x), of(y), permille)]
            yield [[b[c][k] for k in good] for c in ("a", "b")]

    return settle(map_batches(left.join(right, ["b", "salt"]).select("a", "b", "of_a", "of_b"), compare, "a long, b long"), "verified")


def likeliest(label: np.ndarray, size: np.ndarray, low: np.ndarray, permille: int) -> tuple[list, list]:
    """Places of the pairs of a spanning forest (Prim) over components: it joins what the minima do not rule out."""
    out_a, out_b = [], []
    share, parent = np.full(len(label), -1.0), np.zeros(len(label), np.int64)
    left, at = np.ones(len(label), bool), 0
    for _ in range(len(label) - 1):
        left[at] = False
        rest = np.flatnonzero(left)
        now = (low[rest] == low[at]).mean(1)
        now[np.minimum(size[rest], size[at]) * 1000 < permille * np.maximum(size[rest], size[at])] = -1
        now[label[rest] == label[at]] = 2
        better = now > share[rest]
        share[rest[better]], parent[rest[better]] = now[better], at
        at = int(rest[share[rest].argmax()])
        if permille / 1000 - SLACK <= share[at] < 2:
            out_a.append(at)
            out_b.append(int(parent[at]))
    return out_a, out_b


def linked(label: np.ndarray, size: np.ndarray, low: np.ndarray, sets: list, left: np.ndarray, right: np.ndarray, permille: int) -> tuple[list, list]:
    """Places of pairs of ``left`` x ``right`` that join all components between which a pair is alike."""
    out_a, out_b = [], []
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    of = [place[e - n:e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    mark = np.zeros(int(place.max(initial=0)) + 1, bool)
    label, least = label.copy(), (permille / 1000 - SLACK) * low.shape[1]
    for i in left.tolist():
        near = right[(label[right] != label[i]) & (np.minimum(size[right], size[i]) * 1000 >= permille * np.maximum(size[right], size[i]))]
        near = near[(low[near] == low[i]).sum(1) >= least]
        if not len(near) or not size[i]:
            continue
        mark[of[i]] = True
        both = np.add.reduceat(mark[np.concatenate([of[k] for k in near.tolist()])], np.cumsum(size[near]) - size[near], dtype=np.int64)
        mark[of[i]] = False
        for k in near[both * 1000 >= permille * (size[near] + size[i] - both)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out_a.append(i)
                out_b.append(k)
    return out_a, out_b


def met(rows: DataFrame, permille: int, forest: bool) -> DataFrame:
    """``a, b``: pairs of different components under one ``key``, from ``key, node, size, label, minima, hashes``.

    Either a forest of the likeliest, or verified pairs that join the components which any verified pair joins.
    """
    rows = settle(rows, "met")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts"))
    # Cells (i, j), i <= j, of a large group: a row of block r goes to the cells of its row and column.
    dealt = (
        rows.join(large, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .withColumn("r", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("key", F.least("r", "x").alias("i"), F.greatest("r", "x").alias("j"), "r", "node", "size", "label", "minima", "hashes")
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        # Few rows at a time: a row's set may be as long as a text.
        slices = (f.iloc[at:at + SLICE_ROWS] for f in batches for at in range(0, len(f), SLICE_ROWS))
        for frame in itertools.chain(slices, [None]):
            if frame is not None:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if held is None or not len(held):
                continue
            keys = held[["key", "i", "j"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            # The last cell may go on in the next batch.
            ready = starts if frame is None else starts[:-1]
            node, size, label, r = (held[c].to_numpy().astype(np.int64) for c in ("node", "size", "label", "r"))
            low = np.frombuffer(b"".join(held["minima"]), np.uint8).reshape(len(held), -1)
            a, b = [], []
            for s, e in zip(ready.tolist(), ready[1:].tolist()):
                cell = label[s:e], size[s:e], low[s:e]
                if forest:
                    found = likeliest(*cell, permille)
                else:
                    at, (_, i, j) = np.arange(e - s), keys[s]
                    if i == j:
                        # Pairs inside the largest component need no look.
                        names, counts = np.unique(cell[0], return_counts=True)
                        sides = at[cell[0] != names[counts.argmax()]], at
                    else:
                        sides = at[r[s:e] == i], at[r[s:e] != i]
                    found = linked(*cell, [np.frombuffer(h, np.uint64) for h in held["hashes"].iloc[s:e]], *sides, permille)
                a += [s + k for k in found[0]]
                b += [s + k for k in found[1]]
            held = held.iloc[ready[-1]:] if frame is not None else None
            yield pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])}, dtype=np.int64)
        give_back()

    cells = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInPandas(meet, "a long, b long").distinct()


def row_components(rows: DataFrame, shingle: int, permille: int, text_col: str) -> DataFrame:
    """``__row, component`` of every row of a written table with a unique ``__row``."""
    probed = settle(probes(rows, shingle, text_col), "probes")
    reps = probed.groupBy("node").agg(F.min("row").alias("row"))
    nodes = settle(probed.join(reps.select("row"), "row", "left_semi"), "nodes")
    named = nodes.select("node", F.col("node").alias("rank"))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    label_of = lambda found: settle(simhash.components(named, found), "components")
    # Groups of nodes under a key that are not in one component yet.
    parted = lambda keyed, label: keyed.join(label, "node").groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    known = lambda label: nodes.join(label, "node").select("node", "size", F.col("component").alias("label"), "minima")

    found = verified(near_fingerprints(nodes), nodes, rows, shingle, text_col, permille)
    label = label_of(found)
    centres = buckets.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    met_first = buckets.join(centres, "key").where("node != b").groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    first = settle(met_first.join(of("a"), "a").join(of("b"), "b").where("of_a != of_b").select("a", "b"), "first")
    found = found.unionByName(verified(first, nodes, rows, shingle, text_col, permille))

    label = label_of(found)
    active = buckets.join(parted(buckets, label), "key").join(known(label), "node").withColumn("hashes", F.lit(None).cast("binary"))
    likely = settle(met(active, permille, True), "likely")
    found = found.unionByName(verified(likely, nodes, rows, shingle, text_col, permille))

    label = label_of(found)
    groups = label_of(found.unionByName(likely)).withColumnRenamed("component", "key")
    active = settle(groups.join(parted(groups, label), "key"), "groups")
    sets = shingle_sets(active.select("node"), nodes, rows, shingle, text_col)
    found = found.unionByName(settle(met(active.join(known(label), "node").join(sets, "node"), permille, False), "joined"))
    label = label_of(found)
    return probed.select(F.col("row").alias("__row"), "node").join(label, "node").select("__row", "component")


def one_of_each(docs: DataFrame, shingle: int = 5, permille: int = 800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near duplicates is kept.

    Rows whose shingle sets have a Jaccard likeness of at least ``permille``
    thousandths are linked, and groups are what links connect.  The row that
    stays is the first by id (nulls last), hash of the text and row number; rows
    are told by their number, so repeated rows, null ids and ids of several texts
    are rows like any other.
    """
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = row_components(rows, shingle, permille, text_col)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col("__row"))
    first = (
        rows.select("__row", order.alias("__order")).join(found, "__row").groupBy("component")
        .agg(F.min_by("__row", "__order").alias("__row")).select("__row")
    )
    return rows.join(first, "__row", "left_semi").select(*docs.columns)
