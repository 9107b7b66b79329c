"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if the smallest of its inner s-mers (by hash) is
the first or the last of them.  That depends on the k-mer alone and not on what
stands around it, so an unchanged stretch of text keeps exactly its anchors
wherever it moves, and any two neighbouring anchors are a bounded distance apart.

``anchors`` gives positions and hashes of all anchors of a text; the fingerprint
keeps the smallest distinct hashes of all of them, a bottom sketch from which
the Jaccard likeness of two anchor sets is estimated (and exact below
``SKETCH`` anchors).  Positions are in UTF-8 bytes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkprint.llm.common import map_batches

K, S = 14, 8  # an s-mer is one machine word, a k-mer at most two
SPAN = K - S + 1
SKETCH = 96
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_R = np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _R)) * _A
    return (x ^ (x >> _R)) * _B


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of a text.

    A text without one (shorter than a k-mer, mostly) is its own single anchor;
    the empty text has none.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data) - K + 1
    at = np.zeros(0, np.int64)
    if n > 0:
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), S)
        inner = _mixed(np.ascontiguousarray(view).view("<u8")[:, 0])
        low2 = np.minimum(inner[:-1], inner[1:])
        low4 = np.minimum(low2[:-2], low2[2:])
        low = np.minimum(low4[:n], low4[SPAN - 4:SPAN - 4 + n])
        at = np.flatnonzero((inner[:n] == low) | (inner[SPAN - 1:SPAN - 1 + n] == low))
    if not len(at):
        return np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(data, 5)], np.uint64)
    # Its first and last s-mer cover all bytes of a k-mer.
    return at, _mixed(_mixed(inner[at] + _C) + inner[at + K - S])


def sketch(data: bytes) -> np.ndarray:
    """The smallest distinct anchor hashes, upper 32 bits, ascending."""
    small = (anchors(data)[1] >> np.uint64(32)).astype(np.uint32)
    if len(small) > 8 * SKETCH:
        # The sketch lies far below this bound unless hashes repeat; then all are taken.
        few = small[small < np.uint32(min(2**32 - 1, 4 * SKETCH * 2**32 // len(small)))]
        few = np.unique(few)
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(small)[:SKETCH]


def written(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from two sketches: the share of common hashes among the smallest of both together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SKETCH]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= both[-1]) / len(both))


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, position, hash`` of every anchor: what a positional match joins on."""

    def run(batches):
        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                at, h = anchors((t or "").encode())
                yield [[i] * len(at), at.tolist(), h.view(np.int64).tolist()]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, position long, hash long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every whole text (null: empty, whose fingerprint is empty)."""

    def run(batches):
        for b in batches:
            yield [b["id"], [written(sketch((t or "").encode())) for t in b["text"]]]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, fingerprint string")


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows laid out so that each meets the next in descending id, the last the first.

    Ids are cut into ranges; a range goes to one partition, in order, and ends
    with a copy of the row that follows it (the head of the next range), marked
    ``ghost``.  One shuffle carries each text once.  Rows that share an id follow
    each other by text; null ids come last.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(narrow.select("id").approxQuantile("id", [i / pieces for i in range(1, pieces)], 0.2 / pieces)))

    @F.pandas_udf("long")
    def piece(ids):
        # Range 0 holds the largest ids; null ids have a range of their own at the end.
        place = len(bounds) - np.searchsorted(np.array(bounds), ids.to_numpy(float, na_value=np.nan), side="right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, place))

    placed = narrow.withColumn("piece", piece("id"))
    heads = (
        placed.select("piece", "id").groupBy("piece").agg(F.max("id").alias("id")).orderBy("piece").collect()
    )
    if not heads:
        return placed.withColumn("ghost", F.lit(0))
    # At most one row per range: a bounded list.
    before = {h.piece: heads[i - 1].piece for i, h in enumerate(heads)}
    wanted = F.col("id").isin([h.id for h in heads if h.id is not None])
    if heads[-1].id is None:
        wanted = wanted | F.col("id").isNull()
    first = Window.partitionBy("piece").orderBy(F.col("text"))
    target = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = (
        placed.where(wanted).withColumn("n", F.row_number().over(first)).where("n = 1")
        .select("id", "text", F.element_at(target, F.col("piece")).alias("piece"), F.lit(1).alias("ghost"))
    )
    rows = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return rows.repartition(F.col("piece")).sortWithinPartitions("piece", "ghost", F.col("id").desc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    third = len(text) // 3
    return text[:len(text) - third] + after[:third]


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they are.

    Per row: ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited``
    (its fingerprint against the edited text's) and ``near_next`` (against the
    next document's).  Two empty texts are alike (1.0), an empty and another one
    are not (0.0).  The next document is that of :func:`followed`.
    """

    def run(batches) -> Iterator[list]:
        held = None
        for b in batches:
            out = [[] for _ in range(7)]
            for i, t, p, ghost in zip(b["id"], b["text"], b["piece"], b["ghost"], strict=True):
                own = sketch(t.encode())
                if held is not None and held[0] == p:
                    _, before_id, before, before_sketch = held
                    changed = edited(before, t).encode()
                    other = sketch(changed)
                    row = (
                        before_id, len(before), hashlib.sha256(changed).hexdigest(), written(before_sketch), written(other),
                        likeness(before_sketch, other), likeness(before_sketch, own),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if ghost else (p, i, t, own)
            yield out

    return map_batches(
        followed(docs, id_col, text_col), run,
        f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
