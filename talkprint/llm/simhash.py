"""Near duplicates by SimHash, found with the generalised pigeonhole principle.

Two 64-bit fingerprints within ``radius`` bits of each other, cut into
partitions with thresholds ``t_i`` such that ``sum(t_i + 1) = radius + 1``, agree
up to ``t_i`` bits in at least one partition ``i``.  The thresholds need not be
equal, and the partitions need not be runs of bits:

* bits that go together over the corpus are put into the same partition, so that
  the partitions stay independent of each other;
* a dynamic program over the partitions picks the thresholds (from -1, partition
  unused) with the fewest estimated candidates, for each number of partitions.

A fingerprint is filed under its value in every used partition and probes the
values within the threshold.  Everything filed or probing under one value meets
in one bucket, where all pairs are checked in place against the full radius; a
bucket hands on only a spanning forest of its links, never its pairs.  Buckets
beyond ``BLOCK`` rows are dealt over a grid of cells of bounded size.

Equal fingerprints are one node throughout, so groups of copies cost one row.
"""

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import map_batches, utf8
from talkprint.sources.shared import settle

BITS = 64
SEED = 42
BLOCK = 4096
#: The white space of the word pattern.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
SHINGLES_AT_ONCE = 200_000
#: A row that is written, shuffled and sorted takes microseconds, a comparison in place nanoseconds.
PROBE_COST = 2000.0


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return [w for w in text.lower().translate(_TO_SPACE).split(b" ") if w]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit ``b`` is set if it is set in more than half of the shingles' hashes; repeats count, no words give 0."""
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, ones = functools.partial(xxhash.xxh64_intdigest, seed=SEED), np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        end = min(n, at + SHINGLES_AT_ONCE)
        runs = zip(*(words[at + j:end + j] for j in range(shingle)), strict=True) if len(words) >= shingle else [words]
        h = np.fromiter(map(digest, map(b" ".join, runs)), np.uint64, end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (as a signed long) of every whole text; null counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield [b["id"], fps.view(np.int64).tolist()]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return map_batches(narrow, run, "id long, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them.

    Tasks send one matrix each of fixed size, which Spark adds up.
    """

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            bits = np.unpackbits(np.array(b["fp"], np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for at in range(0, len(bits), 20_000):
                part = bits[at:at + 20_000].astype(np.float32)
                total += (part.T @ part).astype(np.int64)
            n += len(bits)
        yield [list(range(BITS)), total.tolist(), [n] * BITS]

    rows = (
        map_batches(nodes.select("fp"), run, "bit int, together array<long>, n long")
        .select("bit", "n", F.posexplode("together").alias("other", "c"))
        .groupBy("bit", "other").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    )
    out = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        out[r.bit, r.other] = r.c
    return (rows[0].n if rows else 0), out


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups: each is opened by the free bit with the most correlation left and takes its closest."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        seed = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def estimated(n: int, together: np.ndarray, group: list[int], most: int) -> list[float]:
    """Expected candidates of a partition for thresholds -1 .. ``most``.

    Every bit differs between two fingerprints with probability 2p(1 - p);
    correlation inside the partition lowers the number of bits that count.
    """
    p = np.diag(together)[group] / max(n, 1)
    differ = 2 * p * (1 - p)
    cov = together[np.ix_(group, group)] / max(n, 1) - np.outer(p, p)
    values = np.clip(np.linalg.eigvalsh(cov), 0, None)
    free = (values.sum() ** 2 / max((values**2).sum(), 1e-12)) / len(group)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return [0.0] + [float(n) * n * min(1.0, max(c, 1e-30) ** free) for c in np.cumsum(chance)]


def probes(width: int, threshold: int) -> int:
    out = term = 1
    for j in range(threshold):
        term = term * (width - j) // (j + 1)
        out += term
    return out if threshold >= 0 else 0


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with ``sum(t + 1) = radius + 1`` of least total cost; ``costs[i][t + 1]``."""
    best = {0: (0.0, [])}
    for row in costs:
        following = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                spent = used + t + 1
                if spent <= radius + 1 and (spent not in following or cost + row[t + 1] < following[spent][0]):
                    following[spent] = (cost + row[t + 1], [*chosen, t])
        best = following
    return best[radius + 1]


def plan(n: int, together: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the used partitions: the cheapest number of partitions and their thresholds.

    A candidate pair costs a comparison, a probe a shuffled row: ``PROBE_COST`` comparisons.
    """
    found = []
    for parts in range(1, min(radius + 1, 12) + 1):
        groups = group_bits(n, together, parts)
        costs = []
        for g in groups:
            most = min(radius, len(g), 3)
            pairs = estimated(n, together, g, most)
            costs.append([c + PROBE_COST * n * (probes(len(g), t) + (t > 0)) for t, c in zip(range(-1, most + 1), pairs, strict=True)])
        try:
            cost, chosen = allocate(costs, radius)
        except KeyError:
            continue
        found.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for place, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(place)
    return out


def filed(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, value, probe, fp``: every fingerprint under its own value, and as a probe under the values near it.

    With threshold 0 the own value serves for both.
    """
    masks = [
        np.array([sum(1 << b for b in flips) for k in range(1, t + 1) for flips in itertools.combinations(range(len(g)), k)], np.uint64)
        for g, t in parts
    ]

    def run(batches):
        for b in batches:
            all_fps = np.array(b["fp"], np.int64)
            for at in range(0, len(all_fps), 2000):
                fps = all_fps[at:at + 2000]
                for i, (g, _) in enumerate(parts):
                    own = _values(fps.view(np.uint64), g)
                    near = (own[:, None] ^ masks[i][None, :]).ravel()
                    value = np.concatenate([own, near]).view(np.int64)
                    probe = np.concatenate([np.zeros(len(own), bool), np.ones(len(near), bool)])
                    yield [np.full(len(value), i, np.int32), value, probe, np.concatenate([fps, np.repeat(fps, len(masks[i]))])]

    return map_batches(nodes.select("fp"), run, "part int, value long, probe boolean, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of ``a`` x ``b`` within the radius connect."""
    ids = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
    root = np.arange(len(ids))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    # Few rows at a time: among near copies nearly all pairs are listed.
    for at in range(0, len(a), 64):
        near = np.bitwise_count(a[at:at + 64, None] ^ b[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = top(ia[at + i]), top(ib[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[max(x, y)], ids[min(x, y)]))
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(nodes: DataFrame, radius: int = 3, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints whose closure is that of all pairs within ``radius`` bits."""
    parts = parts or plan(*bit_statistics(nodes), radius)
    rows = settle(filed(nodes, parts), "filed")
    large = settle(
        rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        .select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts")), "large-buckets",
    )
    # Cells (i, j), i <= j, of a large bucket: a row of block r goes to the cells of its row and column.
    r = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    dealt = (
        rows.join(large, ["part", "value"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("r", r)
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("part", "value", F.least("r", "x").alias("i"), F.greatest("r", "x").alias("j"), "r", "probe", "fp")
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in itertools.chain(batches, [None]):
            if frame is not None:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if held is None or not len(held):
                continue
            keys = held[["part", "value", "i", "j"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            # The last cell may go on in the next batch.
            ready = starts if frame is None else starts[:-1]
            probe, fp, r = held["probe"].to_numpy(), held["fp"].to_numpy().view(np.uint64), held["r"].to_numpy()
            found = []
            for s, e in zip(ready, ready[1:]):
                if e - s < 2:
                    continue
                own, asks, i, j = ~probe[s:e], fp[s:e], keys[s, 2], keys[s, 3]
                if i == j:
                    found.append(_forest(asks, asks[own], radius))
                else:
                    first = r[s:e] == i
                    found.append(_forest(asks[first], asks[own & ~first], radius))
                    found.append(_forest(asks[~first], asks[own & first], radius))
            held = held.iloc[ready[-1]:] if frame is not None else None
            if found:
                a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    cells = dealt.repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j")
    return cells.mapInPandas(meet, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest ``rank`` reachable, for nodes ``(node, rank)`` and links ``(a, b)``.

    Every round takes the smallest label among the neighbours, then the label of
    the label's holder, so that paths halve; each round is written to the shared
    folder and read back.  Only nodes with a link take part.
    """
    edges = settle(edges, "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    holders = nodes.join(ends, "node").select("node", "rank", F.col("rank").alias("label"))
    state = settle(holders, "labels")
    while True:
        labels = {end: state.select(F.col("node").alias(end), "label") for end in ("a", "b")}
        to_b = edges.join(labels["a"], "a").select(F.col("b").alias("node"), "label")
        to_a = edges.join(labels["b"], "b").select(F.col("a").alias("node"), "label")
        from_near = to_a.unionByName(to_b).groupBy("node").agg(F.min("label").alias("near"))
        lower = state.join(from_near, "node", "left").withColumn("to", F.least("label", F.coalesce("near", "label")))
        by_rank = lower.groupBy("rank").agg(F.min("to").alias("onward"))
        hopped = (
            lower.join(by_rank.withColumnRenamed("rank", "to"), "to", "left")
            .select("node", "rank", F.least("to", F.coalesce("onward", "to")).alias("new"), F.col("label").alias("old"))
        )
        written = settle(hopped, "labels")
        changed = written.where("new < old").limit(1).count()
        state = written.select("node", "rank", F.col("new").alias("label"))
        if not changed:
            break
    return nodes.join(state.select("node", F.col("label").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "rank").alias("component")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component_id`` of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable.  Null texts are empty and have
    fingerprint 0, as has every text without words.  Null ids never are the
    smallest; a component of null ids only has a null ``component_id``.
    """
    fps = settle(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # A component of null ids gets a stand-in above every id while components are formed.
    nodes = settle(fps.groupBy("fp").agg(F.min("id").alias("rank")), "fingerprint-nodes")
    named = nodes.select(F.col("fp").alias("node"), F.coalesce("rank", F.lit(2**63 - 1)).alias("rank"))
    found = settle(components(named, links(nodes, radius)), "components")
    return fps.join(found.withColumnRenamed("node", "fp"), "fp").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("component") < 2**63 - 1, F.col("component")).alias("component_id")
    )


def hex_fingerprint(fp):
    """16 lowercase hex digits of a signed long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(docs: DataFrame, shingle: int = 5, radius: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept: the one with the smallest id.

    The default radius is that of a shingle similarity of 0.8: sets with Jaccard
    likeness J have cosine 2J / (1 + J), and each bit differs with probability
    arccos(cosine) / pi, which gives 9.7 of 64 bits at 0.8.  Rows that share the
    smallest id stay together; rows without an id stay, as they name no document.
    """
    groups = near_duplicates(docs, shingle, radius, id_col, text_col)
    dropped = groups.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti")
