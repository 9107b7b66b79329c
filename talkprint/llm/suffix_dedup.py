"""Exact substring deduplication by a hash-compared suffix sort.

Every byte that lies in a string of ``length`` bytes which also starts somewhere
else is removed.  In the suffix array of the corpus those are the starts whose
neighbour shares ``length`` bytes; no two suffixes further apart share more.

The array is never built whole.  Starts are first grouped by content, in levels:

* *Anchors.*  The smallest k-mer (by hash) among the first ``REACH`` of a window
  anchors it.  Equal windows have equal anchors at equal places, and the windows
  of one anchor are a run of starts around it.  All of them share a *core* after
  the anchor.  A core that occurs once settles its run: nothing repeats.  Runs
  that are equal as a whole (the *hull* of their windows) are settled too:
  everything repeats.  Both are counts of hashes, combined before the shuffle;
  copies of documents end here.
* *Slots.*  What is left, runs that repeat in part, near the ends of repeated
  passages, is cut into slots of ``SLOTS`` starts and settled the same way.
* *Suffix sort.*  The slots that still repeat in part meet by their core, and
  their suffixes are sorted by mergesort.  Two suffixes are compared by binary
  search for their common extension over prefix polynomial hashes, so in
  logarithmic time; the sorted neighbours are verified byte by byte and sorted
  plainly in the case of a collision.
* Cores with more than ``BUCKET`` slots (the edge of a passage that a large part
  of the corpus shares) are cut into finer slots instead, down to single windows,
  which the counts settle without any task holding the group.

No row ever stands for a pair.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import SLICE_ROWS, give_back, map_batches, utf8
from talkprint.sources.shared import settle

LENGTH = 400
REACH = 256
KMER = 16
SLOTS = (32, 8, 2, 1)
BUCKET = 2048
CHUNK = 1 << 22
SUFFIXES_AT_ONCE, BYTES_AT_ONCE = 120_000, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D | 1
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


def _hash(data) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def anchored_runs(data: bytes, length: int = LENGTH, reach: int = REACH) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, anchor) of the runs of windows that share an anchor, in order."""
    last = len(data) - length
    for begin in range(0, last + 1, CHUNK):
        end = min(last, begin + CHUNK - 1)
        part = np.frombuffer(data, np.uint8)[begin:end + reach + KMER - 1]
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8")[:, 0]
        h = _mixed(_mixed(word[:-8]) + word[8:])
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step < reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        anchor = (low & _PLACE).astype(np.int64) + begin
        cut = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        starts = cut + begin
        yield from zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), anchor[cut[:-1]].tolist(), strict=True)


# A run or slot: windows ``lo`` .. ``hi`` of a document, of the ``span`` starts that end at ``ref``.
# ``src`` names the anchored run it was cut from, ``weight`` is 2 for a stand-in of several equal ones.
ROW = "core long, hull long, weight int, doc long, th long, src long, lo long, hi long, ref long"
PLACE = ["doc", "th", "src", "lo", "hi", "ref"]


def key_columns(id_col: str, text_col: str) -> tuple:
    """A key of two longs, which rows of one id and one text share, and the text in bytes."""
    body, none = utf8(text_col), F.col(id_col).isNull()
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.xxhash64(none, body), body


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, th, __body``: the key and the bytes of every row."""
    doc, th, body = key_columns(id_col, text_col)
    return docs.select(doc.alias("doc"), th.alias("th"), body.alias("__body"))


def anchor_rows(docs: DataFrame, length: int, reach: int) -> DataFrame:
    core = length - reach + 1

    def run(batches):
        for b in batches:
            out = [[] for _ in range(9)]
            for doc, th, data in zip(b["doc"], b["th"], b["__body"], strict=True):
                if len(data) < length:
                    continue
                view = memoryview(data)
                for lo, hi, a in anchored_runs(data, length, reach):
                    row = (_hash(view[a:a + core]), _hash(view[lo:hi + length]), 1, doc, th, lo, lo, hi, a)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) > 100_000:
                    yield out
                    out = [[] for _ in range(9)]
            yield out

    return map_batches(docs.select("doc", "th", "__body"), run, ROW)


def slot_rows(runs: DataFrame, span: int, length: int) -> DataFrame:
    """Cut runs with their text (``body`` from ``lo``) into slots of ``span`` starts, counted back from ``ref``."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(9)]
            for weight, doc, th, src, lo, hi, ref, body in zip(
                b["weight"], b["doc"], b["th"], b["src"], b["lo"], b["hi"], b["ref"], b["body"], strict=True
            ):
                view = memoryview(body)
                for t in range((ref - hi) // span, (ref - lo) // span + 1):
                    own = ref - t * span
                    first, last = max(lo, own - span + 1), min(hi, own)
                    core = view[own - lo:own - span + 1 + length - lo]
                    row = (_hash(core), _hash(view[first - lo:last + length - lo]), weight, doc, th, src, first, last, own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield out

    return map_batches(runs.select("weight", *PLACE, "body"), run, ROW)


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows that surely repeat (``doc, th, lo, hi``), and the runs that may in part, one of each kind.

    Of equal hulls one run stands for all, with weight 2 if there are several.
    """
    # Written, so that both sides of the join are plain exchanges and a core that many rows share is split.
    common = settle(rows.groupBy("core").agg(F.sum("weight").alias("n")).where("n > 1").select("core"), "common-cores")
    shared = settle(rows.join(common, "core", "left_semi"), "shared-cores")
    kinds = settle(
        shared.groupBy("core", "hull").agg(
            F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"), F.min(F.struct(*PLACE)).alias("one")
        ), "kinds",
    )
    whole = shared.join(kinds.where("weight > 1").select("core", "hull"), ["core", "hull"], "left_semi").select("doc", "th", "lo", "hi")
    single = settle(kinds.where("weight = 1").select("core").distinct(), "single-cores")
    partly = kinds.join(single, "core", "left_semi").select("core", "weight", "one.*")
    return whole, partly


class Extensions:
    """Common extensions of substrings of a buffer, from prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        n = len(data) + 1
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        # prefix[i] = sum of code[j] * BASE^j for j < i; differences are aligned by a power when compared.
        code = _mixed(data.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1])])
        self.power = power

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``length``."""
        left, right = np.minimum(a, b), np.maximum(a, b)
        shift, low = self.power[right - left], np.zeros(len(a), np.int64)
        at_left, at_right = self.prefix[left], self.prefix[right]
        step = 1 << (self.length.bit_length() - 1)
        while step:
            tried = low + step
            fits = tried <= self.length
            reach = np.where(fits, tried, 0)
            equal = (self.prefix[left + reach] - at_left) * shift == self.prefix[right + reach] - at_right
            low = np.where(fits & equal, tried, low)
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0, 1 as the window at ``a`` sorts before, with or after that at ``b``."""
        n = self.common(a, b)
        inside = n < self.length
        k = np.where(inside, n, 0)
        x, y = self.data[a + k].astype(np.int16), self.data[b + k].astype(np.int16)
        return np.where(inside, np.sign(x - y), 0)


def sorted_suffixes(ext: Extensions, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of ``starts`` by window inside each group (groups are consecutive): bottom-up mergesort.

    All merges of a level run together.  An element's place in the merged run is
    its own rank plus its rank in the sibling run, found by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, n)))
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    local, run = np.arange(n) - begin, 1
    while run < size.max(initial=0):
        block = local // (2 * run) * (2 * run)
        is_left = local - block < run
        other = np.where(is_left, block + run, block)
        low = np.zeros(n, np.int64)
        high = np.clip(size - other, 0, run)
        high = np.where(is_left, high, np.minimum(high, run))
        full = high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            sibling = order[begin[open_] + other[open_] + mid]
            sign = ext.before(starts[sibling], starts[order[open_]])
            # Elements of the left run come first among equals.
            goes = np.where(is_left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(goes, mid + 1, low[open_])
            high[open_] = np.where(goes, high[open_], mid)
        rank = np.where(full > 0, low, 0)
        own = local - block - np.where(is_left, 0, run)
        placed = np.empty_like(order)
        placed[begin + block + own + rank] = order
        order, run = placed, run * 2
    return order


def repeated(data: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows occur twice in their group (equal numbers, consecutive)."""
    buffer = np.frombuffer(data, np.uint8)
    ext = Extensions(buffer, length)
    order = sorted_suffixes(ext, starts, group)
    a, b = starts[order[:-1]], starts[order[1:]]
    same_group = group[order[:-1]] == group[order[1:]]
    common = np.where(same_group, ext.common(a, b), 0)
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)
    sound = np.ones(len(a), bool)
    for at in range(0, len(a), 20_000):
        s = slice(at, at + 20_000)
        x, y = windows[a[s]], windows[b[s]]
        differ = x != y
        first = np.where(differ.any(1), differ.argmax(1), length)
        inside = np.minimum(first, length - 1)
        row = np.arange(len(x))
        sound[s] = ~same_group[s] | (first == common[s]) & ((first == length) | (x[row, inside] < y[row, inside]))
    out = np.zeros(len(starts), bool)
    if sound.all():
        twice = common == length
        out[order[:-1]] |= twice
        out[order[1:]] |= twice
    else:  # a hash collision: compare the bytes themselves
        seen: dict = {}
        for i, (s, g) in enumerate(zip(starts.tolist(), group.tolist(), strict=True)):
            seen.setdefault((g, data[s:s + length]), []).append(i)
        for places in seen.values():
            out[places] = len(places) > 1
    return out


def sorted_slots(slots: DataFrame, length: int) -> DataFrame:
    """``doc, th, lo, hi`` of the windows that repeat among slots (with ``core`` and ``body``) of the same core."""

    def solve(cores: list, rows: list) -> list:
        """Equal windows of a core stand equally far from ``ref``: only those are compared."""
        data = b"".join(r[-1] for r in rows)
        offset = np.cumsum([0] + [len(r[-1]) for r in rows[:-1]])
        n = np.array([r[4] - r[3] + 1 for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo, ref = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
        core = np.array(cores)
        distance = ref[row] - lo[row] - within
        order = np.lexsort((row, distance, core[row]))
        row, within, distance = row[order], within[order], distance[order]
        group = np.concatenate([[0], np.cumsum((core[row[1:]] != core[row[:-1]]) | (distance[1:] != distance[:-1]))])
        twice = repeated(data, offset[row] + within, group, length)
        out = [[], [], [], []]
        back = np.lexsort((within, row))
        row, within, twice = row[back], within[back], twice[back]
        hit = np.flatnonzero(twice)
        if len(hit):
            cut = np.flatnonzero((row[hit][1:] != row[hit][:-1]) | (within[hit][1:] != within[hit][:-1] + 1)) + 1
            for piece in np.split(hit, cut):
                r = rows[row[piece[0]]]
                for column, value in zip(out, (r[0], r[1], r[3] + int(within[piece[0]]), r[3] + int(within[piece[-1]])), strict=True):
                    column.append(value)
        return out

    def run(batches):
        cores, rows, windows, size = [], [], 0, 0
        for b in batches:
            for r in zip(b["core"], b["doc"], b["th"], b["src"], b["lo"], b["hi"], b["ref"], b["body"], strict=True):
                if (windows > SUFFIXES_AT_ONCE or size > BYTES_AT_ONCE) and r[0] != cores[-1]:
                    yield solve(cores, rows)
                    cores, rows, windows, size = [], [], 0, 0
                cores.append(r[0])
                rows.append(r[1:])
                windows += r[5] - r[4] + 1
                size += len(r[-1])
        if rows:
            yield solve(cores, rows)

    laid = slots.select("core", *PLACE, "body").repartition("core").sortWithinPartitions("core")
    return map_batches(laid, run, "doc long, th long, lo long, hi long")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, th, lo, hi``: runs of starts whose windows of ``length`` bytes also start elsewhere (docs from ``keyed``)."""
    reach = REACH
    while reach > length - KMER:
        reach //= 2
    found, partly = settled(settle(anchor_rows(docs, length, reach), "anchors"))
    whole = [found]
    partly = partly.join(docs.select("doc", "th", "__body"), ["doc", "th"])
    partly = settle(partly.selectExpr("core", "weight", *PLACE, f"substring(__body, int(lo) + 1, int(hi - lo) + {length}) as body"), "runs")
    texts, level = partly, 0
    for span in SLOTS:
        if span >= reach:
            continue
        if level:
            # Cores with few slots are sorted, the others cut again.
            many = partly.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("core")
            many = settle(many, "large-cores")
            whole.append(settle(sorted_slots(partly.join(many, "core", "left_anti"), length), "sorted"))
            if many.isEmpty():
                break
            partly = settle(partly.join(many, "core", "left_semi"), "large-slots")
        found, slots = settled(settle(slot_rows(partly, span, length), "slots"))
        whole.append(found)
        bodies = texts.select("doc", "th", "src", F.col("lo").alias("from"), "body")
        partly = settle(
            slots.join(bodies, ["doc", "th", "src"])
            .selectExpr("core", "weight", *PLACE, f"substring(body, int(lo - from) + 1, int(hi - lo) + {length}) as body"), "slot-texts",
        )
        level += 1
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def merged(ranges: list | np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans (start, end) covered by the windows."""
    spans: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in (() if ranges is None else ranges)):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    return [(s, e) for s, e in spans]


def with_ranges(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__body`` and ``__ranges``, the starts whose windows repeat."""
    narrow = keyed(docs, id_col, text_col)
    ranges = settle(
        repeated_windows(narrow, length).groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th"))
        .agg(F.collect_set(F.struct("lo", "hi")).alias("__ranges")), "ranges",
    )
    doc, th, body = key_columns(id_col, text_col)
    return docs.withColumns({"__doc": doc, "__th": th, "__body": body}).join(ranges, ["__doc", "__th"], "left")


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``n_bytes, n_removed, n_spans`` and the digest of the bytes that are left.

    Null text is empty.  Rows that repeat a text of at least ``length`` bytes are
    removed in full, as each occurs elsewhere; null ids are ids like any other.
    """

    def run(batches):
        for b in batches:
            out = [b["id"], [], [], [], []]
            for data, ranges in zip(b["__body"], b["__ranges"], strict=True):
                spans = merged(ranges, length)
                out[1].append(len(data))
                out[2].append(sum(e - s for s, e in spans))
                out[3].append(len(spans))
                out[4].append(hashlib.sha256(kept_bytes(data, spans)).hexdigest())
            yield out

    rows = with_ranges(docs.select(id_col, text_col), length, id_col, text_col)
    return map_batches(
        rows.select(F.col(id_col).cast("long").alias("id"), "__body", "__ranges"), run,
        f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left.

    Where a span ends inside a character, the rest of that character goes with it.
    A map over Arrow batches, unlike a function in a column, is not computed again by
    a filter on the text; a task then needs one Python worker, not one for each copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
                text = b.column(text_col)
                bodies, ranges = b.column("__body").to_pylist(), b.column("__ranges").to_pylist()
                left = [
                    None if r is None else kept_bytes(d, merged(r, length)).decode("utf-8", "ignore")
                    for d, r in zip(bodies, ranges, strict=True)
                ]
                text = pc.coalesce(pa.array(left, text.type), text)
                yield pa.RecordBatch.from_arrays([text if c == text_col else b.column(c) for c in names], names)
        finally:
            b = text = bodies = ranges = left = None
            give_back()

    names = docs.columns
    rows = with_ranges(docs, length, id_col, text_col)
    hit = F.col("__ranges").isNotNull()
    return rows.select(*names, F.when(hit, F.col("__body")).alias("__body"), "__ranges").mapInArrow(run, docs.schema)
