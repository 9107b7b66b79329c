"""Alignment of the tokens of two vocabularies over the same bytes.

Both encodings of a text end tokens at byte offsets.  Offsets where both do cut
the tokens into groups; inside a group every two tokens whose bytes overlap are
linked.  A stretch of bytes, wherever it begins and ends, yields a fragment:

* an open prefix, the tokens up to the first common end, whose group began before;
* closed groups between common ends;
* an open suffix, the tokens after the last common end.

Fragments of neighbouring stretches compose: the suffix of the left and the
prefix of the right become one closed group.  A stretch without a common end is
all prefix.  Composition is associative, so any tree over the stretches of a
document gives the document.

Tokens and their ends are arrays, so that a stretch is aligned by a few sorted
searches, however many groups it holds.  A document of usual length is one
stretch.  Long documents are dealt out as byte ranges of fixed size, whose tokens
are found by tasks of their own, and composed level by level in a tree of Spark
jobs.

How many documents hold a pair of ids is counted inside blocks of documents
first; blocks then get the counts of their own pairs back.  No table of all
pairs is broadcast or gathered.
"""

import functools
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from talkprint.llm import packing
from talkprint.llm.common import Recent, map_batches
from talkprint.sources.shared import settle

SPACE = "▁"
CACHE_WORDS = 400_000
SHORT_WORD = 200
#: Documents beyond ``LONG_BYTES`` are dealt out in ranges, composed ``FAN`` at a time.
LONG_BYTES, RANGE_BYTES, FAN = 1 << 16, 1 << 14, 8
#: Text of a block of documents that counts its pairs together.
BLOCK_BYTES = 4 << 20
RANGES_PER_TASK = 16
#: White space inside of these stays with its neighbours: only a single space between two other characters parts words.
UNIT_EDGE = re.compile(r"(?<=\S) (?=\S)")


class Tokens(NamedTuple):
    """Arrays of the tokens of both encodings, and of the offsets at which they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def then(self, other: "Tokens") -> "Tokens":
        return Tokens(*map(np.concatenate, zip(self, other, strict=True)))

    def between(self, low: int, high: int) -> "Tokens":
        """The tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        m, n = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[m:n], self.b_ends[m:n])


NONE = Tokens(*[np.zeros(0, np.int64)] * 4)


class Groups(NamedTuple):
    """Closed groups: their spelling, the linked pairs as bytes, and the number of tokens of the first encoding."""

    text: str = ""
    pairs: bytes = b""
    n_a: int = 0

    def then(self, other: "Groups") -> "Groups":
        text = f"{self.text};{other.text}" if self.text and other.text else self.text or other.text
        return Groups(text, self.pairs + other.pairs, self.n_a + other.n_a)


class Fragment(NamedTuple):
    """What a stretch of bytes tells of its document; see the module's text."""

    cut: bool = False
    head: Tokens = NONE
    closed: Groups = Groups()
    tail: Tokens = NONE


def _ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends in order, and the common ones."""
    ends = np.concatenate([a_ends, b_ends])
    ends.sort(kind="stable")
    again = np.zeros(len(ends), bool)
    again[1:] = ends[1:] == ends[:-1]
    return ends[~again], ends[again]


START = Fragment(cut=True)  # the place before a document's first byte, where both encodings begin


class Aligner:
    """Both encodings of a text: a byte-level file of ``tokenizers`` (A) and a ``sentencepiece`` file (B)."""

    def __init__(self, path_a: str, path_b: str, cache_words: int = CACHE_WORDS):
        self.first = packing.codec(path_a)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.span = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(self.span)]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError("a piece holds a space after another character: words are not independent")
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
        ]
        self.a_sizes = np.array([len(self.first.texts.get(i, b"")) for i in range(self.first.span)], np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.kind = "u4" if self.first.span * self.span < 1 << 32 else "u8"
        ids = range(max(self.first.span, self.span))
        self.spelled = [f"{i}{mark}" for mark in ",|;" for i in ids]
        self.words = Recent(self.word, cache_words // 2, lambda word: len(word) <= SHORT_WORD)

    def second_ids(self, unit: str) -> bytes | bool:
        """Ids in B of a unit, before which B puts a space; False if they do not spell it byte by byte."""
        ids = self.second.encode(unit)
        spelled = b"".join(map(self.b_bytes.__getitem__, ids)) == b" " + unit.encode()
        return spelled and array("I", ids).tobytes()

    def word(self, word: str) -> bytes | bool | None:
        """Ids in B of a word that a space precedes; None for what is no word."""
        return None if not word or word[0].isspace() or word[-1].isspace() else self.second_ids(word)

    def tokens(self, text: str, start: int = 0) -> Tokens | None:
        """Tokens of a space and ``text``, or None if B does not spell them; A spells any text.

        Both encodings part words at single spaces, so that words are encoded one by one.
        """
        words = text.split(" ")
        a, b = list(map(self.first.chunks.__getitem__, words)), list(map(self.words.__getitem__, words))
        if None in a or None in b:
            a, b = [self.first.pack(" " + text)], list(map(self.second_ids, UNIT_EDGE.split(text)))
        if False in b:
            return None
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
        return Tokens(a, start + np.cumsum(self.a_sizes[a]), b, start + np.cumsum(self.b_sizes[b]))

    def close(self, tokens: Tokens) -> Groups:
        """Groups of tokens between two common ends.  A pair of ids is the number ``a * span + b``."""
        a, a_ends, b, b_ends = tokens
        if not len(a):
            return Groups()
        # Between two neighbouring ends, of whichever encoding, lies the overlap of one token of each.
        ends, common = _ends(a_ends, b_ends)
        pairs = a[np.searchsorted(a_ends, ends)] * self.span + b[np.searchsorted(b_ends, ends)]
        # Places in the spelling: a token of A comes after all of B in earlier groups, one of B after all of A up to its own.
        last_a, last_b = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        group_a, group_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        at_a = np.arange(len(a)) + np.concatenate([[0], last_b[:-1] + 1])[group_a]
        at_b = np.arange(len(b)) + (last_a + 1)[group_b]
        spelling, n = np.empty(len(a) + len(b), np.int64), len(self.spelled) // 3
        spelling[at_a], spelling[at_b] = a, b
        spelling[at_a[last_a]] += n
        spelling[at_b[last_b]] += 2 * n
        text = "".join(map(self.spelled.__getitem__, spelling.tolist()))
        return Groups(text[:-1], pairs.astype(self.kind).tobytes(), len(a))

    def fragment(self, tokens: Tokens) -> Fragment:
        """The fragment of the tokens that end in a stretch."""
        common = _ends(tokens.a_ends, tokens.b_ends)[1]
        if not len(common):
            return Fragment(head=tokens)
        first, last = int(common[0]), int(common[-1])
        return Fragment(True, tokens.between(-1, first), self.close(tokens.between(first, last)), tokens.between(last, 1 << 62))

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        """The fragment of two neighbouring stretches."""
        if not x.cut:
            return y._replace(head=x.head.then(y.head))
        if not y.cut:
            return x._replace(tail=x.tail.then(y.head))
        closed = x.closed.then(self.close(x.tail.then(y.head))).then(y.closed)
        return Fragment(True, x.head, closed, y.tail)

    def document(self, text: str) -> Groups | None:
        """Groups of a whole text; None if it has no tokens."""
        tokens = self.tokens(text) if text else None
        return tokens and self.compose(START, self.fragment(tokens)).closed

    def stretch(self, text: str, start: int, low: int, high: int) -> Fragment | None:
        """The fragment of bytes ``low`` to ``high`` of a document, of which ``text`` is a part beginning at ``start``.

        ``text`` begins with the space before a word and covers the range.
        """
        tokens = self.tokens(text[1:], start)
        return tokens and self.fragment(tokens.between(low, high))


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def ranges(data: bytes, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``low, high, start, part``: byte ranges of a document, and for each the part of it that tells the range's tokens.

    A part goes from a space between two printable characters to another, where
    words are parted.  A range begins at a multiple of ``size`` unless no such
    space lies between it and the range before; then the two are one.
    """
    b = np.frombuffer(data, np.uint8)
    shown = (b > 32) & (b < 127)
    spaces = np.concatenate([[0], np.flatnonzero((b[1:-1] == 32) & shown[:-2] & shown[2:]) + 1, [len(b)]])
    lows = [0]
    for at in range(size, len(b), size):
        if np.searchsorted(spaces, at, "right") > np.searchsorted(spaces, lows[-1], "right"):
            lows.append(at)
    for low, high in zip(lows, [*lows[1:], len(b)]):
        start = int(spaces[np.searchsorted(spaces, low, "right") - 1])
        yield low, high, start, data[start:int(spaces[np.searchsorted(spaces, high)])]


_TOKENS = "{0}_a array<int>, {0}_a_ends array<long>, {0}_b array<int>, {0}_b_ends array<long>"
_FRAGMENT = f"row long, at int, id long, ok boolean, cut boolean, {_TOKENS.format('head')}, text string, pairs binary, n_a long, {_TOKENS.format('tail')}"
_DOCUMENT = "block long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _document_row(block: int, doc_id, groups: Groups | None, kind: str) -> tuple:
    """A row of ``_DOCUMENT``: distinct pairs in order, and how often each is linked."""
    if groups is None:
        return block, doc_id, 0, 0, 0, "", b"", b""
    pairs, times = np.unique(np.frombuffer(groups.pairs, kind), return_counts=True)
    links, n_groups = int(times.sum()), groups.text.count(";") + 1
    digest = hashlib.sha256(groups.text.encode()).hexdigest()
    return block, doc_id, groups.n_a, links + n_groups - groups.n_a, n_groups, digest, pairs.tobytes(), times.astype(np.uint32).tobytes()


def _fragment_row(row: int, at: int, doc_id, f: Fragment | None) -> tuple:
    ok, f = f is not None, f or Fragment()
    return row, at, doc_id, ok, f.cut, *(x.tolist() for x in f.head), *f.closed, *(x.tolist() for x in f.tail)


def _fragment_of(values: Iterable) -> Fragment:
    cut, *rest = values
    tokens = lambda lists: Tokens(*(np.array(x, np.int64) for x in lists))
    return Fragment(cut, tokens(rest[:4]), Groups(*rest[4:7]), tokens(rest[7:]))


def _columns(rows: list[tuple]) -> list[list]:
    return list(map(list, zip(*rows, strict=True)))


def _long_documents(parts: DataFrame, tasks: int, path_a: str, path_b: str) -> DataFrame:
    """``_DOCUMENT`` rows of documents dealt out as ``row, at, id, low, high, start, part``."""

    def find(batches: Iterator[dict]):
        both = aligner(path_a, path_b)
        for b in batches:
            columns = (b[c] for c in ("row", "at", "id", "low", "high", "start", "part"))
            for row, at, doc_id, low, high, start, part in zip(*columns, strict=True):
                yield _columns([_fragment_row(row, at, doc_id, both.stretch(part.decode(), start, low, high))])

    def fold(rows: pa.Table) -> pa.Table:
        both = aligner(path_a, path_b)
        rows = rows.select(names).sort_by("at").to_pylist()
        row, at, doc_id, *_ = rows[0].values()
        whole = None
        if all(r["ok"] for r in rows):
            found = (_fragment_of([*r.values()][4:]) for r in rows)
            whole = functools.reduce(both.compose, found)
        out = dict(zip(names, _fragment_row(row, at // FAN, doc_id, whole), strict=True))
        return pa.Table.from_pylist([out], schema=arrow)

    def finish(batches: Iterator[dict]):
        both = aligner(path_a, path_b)
        for b in batches:
            for row, _, doc_id, ok, *values in zip(*b.values(), strict=True):
                groups = both.compose(START, _fragment_of(values)).closed if ok else None
                yield _columns([_document_row(-1 - row, doc_id, groups, both.kind)])

    level = settle(map_batches(parts.repartition(tasks, "row", "at"), find, _FRAGMENT), "fragments")
    names, arrow = level.columns, to_arrow_schema(level.schema)
    top = level.agg(F.max("at")).first()[0]
    while top:
        level = level.withColumn("_up", F.floor(F.col("at") / FAN)).groupBy("row", "_up").applyInArrow(fold, _FRAGMENT)
        top //= FAN
    return map_batches(level, finish, _DOCUMENT)


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    long_bytes: int = LONG_BYTES, range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``block, id, n_a, n_b, n_groups, groups_sha256, pairs, times`` of every document, written once.

    ``pairs`` and ``times`` are arrays as bytes: the distinct linked id pairs, as
    ``a * size of B + b``, and how often each is linked.
    """
    out = f"{_DOCUMENT}, row long, at int, low long, high long, start long, part binary"

    def run(batches: Iterator[dict]):
        both = aligner(path_a, path_b)
        block, held = None, 0
        for b in batches:
            rows = []
            for row, doc_id, text in zip(b["row"], b["id"], b["text"], strict=True):
                # Blocks take the number of their first row, which is unique.
                if block is None or held > block_bytes:
                    block, held = row, 0
                if len(text) > long_bytes or 4 * len(text) > long_bytes and len(data := text.encode()) > long_bytes:
                    data = b" " + text.encode()
                    for at, (low, high, start, part) in enumerate(ranges(data, range_bytes)):
                        rows.append((None, doc_id, *[None] * 6, row, at, low, high, start, part))
                else:
                    held += len(text)
                    rows.append((*_document_row(block, doc_id, both.document(text), both.kind), *[None] * 6))
            if rows:
                yield _columns(rows)

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = settle(map_batches(narrow, run, out), "aligned")
    names = [c.split()[0] for c in _DOCUMENT.split(", ")]
    whole, parts = found.where(F.col("at").isNull()).select(names), found.where(F.col("at").isNotNull())
    parts = parts.select("row", "at", "id", "low", "high", "start", "part")
    n = parts.count()
    return whole.unionByName(settle(_long_documents(parts, -(-n // RANGES_PER_TASK), path_a, path_b), "aligned-long")) if n else whole


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``block, pair, n``: in how many documents of a block a pair is linked."""

    def run(batches: Iterator[dict]):
        block, held = None, []

        def counted() -> list:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return [[block] * len(pairs), pairs.astype(np.int64), n.astype(np.int64)]

        for b in batches:
            for own, pairs in zip(b["block"], b["pairs"], strict=True):
                if own != block:
                    if held:
                        yield counted()
                    block, held = own, []
                if pairs:
                    held.append(np.frombuffer(pairs, kind))
        if held:
            yield counted()

    return map_batches(aligned.select("block", "pairs"), run, "block long, pair long, n long")


def alignment_digests(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", **sizes,
) -> DataFrame:
    """Per document ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair's count is the number of documents that hold it linked; ``n_best`` are
    the links whose count is the highest of their A id, ties included.  Texts that
    are null, empty or that either encoding does not spell byte by byte have no
    tokens: zeros and an empty digest.  Special strings inside texts are plain
    text.  Null ids and repeated rows are documents like any other, an empty table
    gives an empty result, further columns are not read, and texts of any length
    are encoded whole.
    """
    both = aligner(path_a, path_b)
    span, kind = both.span, both.kind
    aligned = align(docs, path_a, path_b, id_col, text_col, **sizes)
    in_blocks = settle(pair_counts(aligned, kind), "pairs")
    count = in_blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    # An A id meets at most as many pairs as B has ids.
    best = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / span)))
    totals = count.withColumn("best", F.col("count") == best)
    known = in_blocks.join(totals, "pair").select("block", "pair", "count", "best")

    types = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], types).schema)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pair, counts, tops = (right[c].to_numpy() for c in ("pair", "count", "best"))
        added = {"n_links": [], "n_best": [], "count_sum": []}
        for pairs, times in zip(left["pairs"].to_pylist(), left["times"].to_pylist(), strict=True):
            at = np.searchsorted(pair, np.frombuffer(pairs, kind))
            m = np.frombuffer(times, np.uint32).astype(np.int64)
            added["n_links"].append(int(m.sum()))
            added["n_best"].append(int((m * tops[at]).sum()) if len(m) else 0)
            added["count_sum"].append(int((m * counts[at]).sum()) if len(m) else 0)
        return pa.Table.from_arrays(
            [pa.array(added[f.name], f.type) if f.name in added else left[f.name] for f in arrow], schema=arrow
        )

    summed = aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(sums, types)
    return summed.withColumnRenamed("id", id_col)
