"""Product quantisation of vectors with exact integer arithmetic on Hilbert-sorted blocks.

Vectors become integers and are cut into parts.  The parts of one position are
sorted along a Hilbert curve and cut into flat blocks of neighbours; a block
stores its members row by row with their componentwise minima, maxima and sums.
The blocks are built once and written; every round of the codebook reads them:

* the distances from an entry to the near and the far side of a block's box bound
  those to all members, so only entries whose near side is no farther than the
  least far side can be the nearest of any member: the block's shortlist;
* a shortlist of one entry takes the block as a whole, by its stored sums;
* any other is evaluated by a kernel in 64-bit integers, ties to the lower index.

Tasks hand on one row per entry they met (counts and sums), Spark adds those up,
and only the codebooks, whose size is fixed, pass through the driver.
"""

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import map_batches
from talkprint.sources.shared import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 128
CURVE_BITS = 4
BLOCKS_PER_TASK = 256


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place on the Hilbert curve of every row of small non-negative integers below ``2 ** bits``.

    The usual transposed form: undo the rotations from the highest bit down, take
    the Gray code across components, then interleave the bits of all components.
    """
    x = cells.astype(np.int64).T.copy()
    if not x.size:
        return [b""] * cells.shape[0]
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for row in x:
            turned = (row & top) != 0
            swapped = np.where(turned, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(turned, low, swapped)
            row ^= swapped
    for below, row in zip(x, x[1:]):
        row ^= below
    carry = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8), axis=0).T
    return [key.tobytes() for key in np.ascontiguousarray(packed)]


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Ascending indexes of the entries that may be nearest to a point of the box."""
    under, over = low - entries, entries - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(high - entries, entries - low)
    near, far = (near * near).sum(1), (far * far).sum(1)
    return np.flatnonzero(near <= far.min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every point, ties to the lower index, and the squared distance."""
    base = points[0]
    p, e = points - base, entries - base
    d = (e * e).sum(1) - 2 * (p @ e.T)
    code = d.argmin(1)
    return code, d[np.arange(len(p)), code] + (p * p).sum(1)


def assign(flat: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and squared distances of a block's members, and the length of its shortlist."""
    chosen = shortlist(low, high, entries)
    if len(chosen) == 1:
        rest = flat - entries[chosen[0]]
        return np.full(len(flat), chosen[0]), (rest * rest).sum(1), 1
    code, d = nearest(flat, entries[chosen])
    return chosen[code], d, len(chosen)


def _long_array(data: bytes, width: int | None = None) -> np.ndarray:
    a = np.frombuffer(data, "<i8")
    return a if width is None else a.reshape(-1, width)


class Quantizer:
    """Codebooks of fixed size trained on every vector of a table.

    Rows with a null vector, or a null or non-finite component, take no part.
    Components become ``floor(scale * x)``.  Repeated rows count as often as they
    stand there; a null id is like any other, but comes last where the smallest
    ids start the codebooks (equal ids: by vector).  An empty table gives an empty
    result and empty codebooks.  Columns other than id, vector and label are not
    read.  Vectors of unlike lengths, lengths that the number of parts does not
    divide, and components so large that a squared distance is no 64-bit integer
    are an error.
    """

    def __init__(
        self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
        parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
    ):
        self.parts, self.entries, self.block_rows = parts, entries, block_rows
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        narrow = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
        self.kept = settle(
            narrow.where(F.col("v").isNotNull() & ~bad)
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("x")), "vectors",
        )
        self.width, low, high = self._shape()
        self.codebooks: list[np.ndarray] = []
        self.evaluated: list[tuple[int, int]] = []
        if self.width:
            self.blocks = settle(self._blocks(low, high), "blocks")
            self.codebooks = self._start()
            for _ in range(rounds):
                self.codebooks = self._round()

    def _shape(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Width of a part, and the least and greatest integer of every component."""
        d = F.size("x")
        n, least, most = self.kept.agg(F.count("*"), F.min(d), F.max(d)).first()
        if not n:
            return 0, np.zeros(0), np.zeros(0)
        if least != most or not most or most % self.parts:
            raise ValueError(f"vectors must have one length that {self.parts} divides, found {least} to {most}")
        found = self.kept.agg(*[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(most)]).first()
        low, high = np.array(found[:most]), np.array(found[most:])
        # Differences reach twice the largest component, and a part adds up their squares.
        if max(-int(low.min()), int(high.max())) > isqrt(2**62 // (most // self.parts)) // 4:
            raise ValueError("components are too large for 64-bit distances")
        return most // self.parts, low, high

    def _blocks(self, low: np.ndarray, high: np.ndarray) -> DataFrame:
        """``part, rows, flat, low, high, sums``: neighbours on the curve, as flat arrays of longs."""
        parts, width, block_rows, levels = self.parts, self.width, self.block_rows, 1 << CURVE_BITS
        extent = np.maximum(high - low + 1, 1)

        def keys(batches: Iterator[dict]):
            for b in batches:
                x = np.array(b["x"], np.int64)
                cells = (x - low) * levels // extent
                cut = lambda a, p: a[:, p * width:(p + 1) * width]
                for p in range(parts):
                    flat = np.ascontiguousarray(cut(x, p))
                    yield [[p] * len(x), b["row"], hilbert_keys(cut(cells, p)), [f.tobytes() for f in flat]]

        keyed = settle(map_batches(self.kept.select("row", "x"), keys, "part int, row long, key binary, flat binary"), "curve")
        n = max(1, -(-self.kept.count() * parts // (block_rows * BLOCKS_PER_TASK)))
        n = max(n, min(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * BLOCKS_PER_TASK // 16)))
        # Equal keys are told apart by their rows: copies of one vector fill as many ranges as they need.
        along = keyed.repartitionByRange(n, "part", "key", "row").sortWithinPartitions("part", "key", "row").select("part", "row", "flat")

        def cut_blocks(batches: Iterator[dict]):
            part, rows, held = None, [], []

            def block() -> list:
                x = _long_array(b"".join(held), width)
                edges = [a.tobytes() for a in (x.min(0), x.max(0), x.sum(0))]
                return [[part], [np.array(rows, "<i8").tobytes()], [x.tobytes()], *[[e] for e in edges]]

            for b in batches:
                for p, row, flat in zip(b["part"], b["row"], b["flat"], strict=True):
                    if rows and (p != part or len(rows) == block_rows):
                        yield block()
                        rows, held = [], []
                    part = p
                    rows.append(row)
                    held.append(flat)
            if rows:
                yield block()

        return map_batches(along, cut_blocks, "part int, rows binary, flat binary, low binary, high binary, sums binary")

    def _start(self) -> list[np.ndarray]:
        """The parts of the vectors with the smallest ids: a bounded number of rows."""
        first = self.kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(self.entries).select("x").collect()
        x = np.array([r.x for r in first], np.int64)
        return [np.ascontiguousarray(x[:, p * self.width:(p + 1) * self.width]) for p in range(self.parts)]

    def _round(self) -> list[np.ndarray]:
        books, width = self.codebooks, self.width

        def run(batches: Iterator[dict]):
            counts = [np.zeros(len(e), np.int64) for e in books]
            sums = [np.zeros((len(e), width), np.int64) for e in books]
            met = members = 0
            for b in batches:
                for part, flat, low, high, total in zip(b["part"], b["flat"], b["low"], b["high"], b["sums"], strict=True):
                    x = _long_array(flat, width)
                    chosen = shortlist(_long_array(low), _long_array(high), books[part])
                    members += len(x) * len(books[part])
                    if len(chosen) == 1:
                        counts[part][chosen[0]] += len(x)
                        sums[part][chosen[0]] += _long_array(total)
                        continue
                    code = nearest(x, books[part][chosen])[0]
                    met += len(x) * len(chosen)
                    counts[part][chosen] += np.bincount(code, minlength=len(chosen))
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                    sums[part][chosen[code[order][starts]]] += np.add.reduceat(x[order], starts)
            used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
            yield [
                [p for p, _ in used] + [-1], [e for _, e in used] + [-1], [int(counts[p][e]) for p, e in used] + [met],
                [sums[p][e].tolist() for p, e in used] + [[members] + [0] * (width - 1)],
            ]

        partial = map_batches(self.blocks.select("part", "flat", "low", "high", "sums"), run, "part int, entry int, n long, sums array<long>")
        totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        moved = [e.copy() for e in books]
        for part, entry, n, *total in totals.collect():
            if part < 0:
                self.evaluated.append((n, total[0]))
            else:
                moved[part][entry] = [s // n for s in total]
        return moved

    def digest(self) -> str:
        """SHA-256 of all entries' integers by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for e in self.codebooks for v in e.ravel().tolist()).encode()).hexdigest()

    def encode(self) -> DataFrame:
        """``id, label, codes, error`` of every vector that takes part: an index per part and the summed squared distances."""
        if not self.width:
            return self.kept.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        books, width = self.codebooks, self.width

        def run(batches: Iterator[dict]):
            for b in batches:
                for part, rows, flat, low, high in zip(b["part"], b["rows"], b["flat"], b["low"], b["high"], strict=True):
                    x = _long_array(flat, width)
                    code, d, _ = assign(x, _long_array(low), _long_array(high), books[part])
                    yield [_long_array(rows), [part] * len(x), code, d]

        coded = map_batches(self.blocks.select("part", "rows", "flat", "low", "high"), run, "row long, part int, code int, d long")
        by_part = [F.max(F.when(F.col("part") == p, F.col("code"))) for p in range(self.parts)]
        codes = coded.groupBy("row").agg(F.array(*by_part).alias("codes"), F.sum("d").alias("error"))
        return self.kept.select("row", "id", "label").join(codes, "row").drop("row")


def code_digests(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` of every vector that takes part (see :class:`Quantizer`).

    ``label_error`` adds up the errors of all vectors of the same label, null labels together.
    """
    q = Quantizer(rows, id_col, vector_col, label_col, **options)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    coded = settle(q.encode().select("id", "label", F.array_join(digits, "").alias("code"), "error"), "codes")
    # A table of its own, so that a label that many rows share can be split in the join.
    totals = settle(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(q.digest()).alias("codebooks_sha256"))
