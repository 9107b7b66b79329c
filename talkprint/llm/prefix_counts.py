"""Exact token counts of every prefix of a text, by dynamic programming.

The vocabulary is a byte-pair encoding in the sentencepiece file format: pieces
with scores, where the best-scored adjacent pair is merged first, the leftmost
on ties.  Such an encoding has two properties that make a prefix table possible:

* a sequence of pieces is the encoding of its own text exactly if every two
  neighbours, taken alone, encode to just those two pieces;
* hence dropping the last piece of an encoding leaves the encoding of the
  shorter text, and every prefix ends in exactly one piece that its shorter
  prefix accepts as a neighbour.

``count[i] = count[i - len(last[i])] + 1`` then holds for every prefix ``i``,
so one pass over a text answers "how many tokens has the first part" and "how
much text fits a budget" for all parts at once, without encoding again.

No piece holds a space mark after another character, so counts start afresh at
every space that follows a non-space: texts are handled word by word and the
tables of words are kept in a bounded cache per Python worker.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import Recent, map_batches

SPACE = "▁"
CACHE_WORDS = 400_000
LONG_WORD = 200
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    at, end = 0, len(buf)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, buf[at:at + size]
            at += size


class PieceCounter:
    """Prefix tables for one vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.scores: dict[str, float] = {}
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, NORMAL) in (USER_DEFINED, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces are not supported")
                if piece.get(3, NORMAL) == NORMAL:
                    self.scores[piece[1].decode()] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            elif number == 3:
                rule = dict(_fields(value))
                # name 1, compiled map 2, dummy prefix 3, drop extra spaces 4, escape spaces 5
                if rule.get(2) or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece holds a space after another character: words are not independent")
        # A piece that its own text does not encode to never ends a prefix.
        pieces = {p for p in self.scores if len(p) == 1 or self.encode(p) == [p]}
        # Every ending of a piece, and whether it is a piece itself: a walk back from a position stops early.
        self.endings = {p[i:]: p[i:] in pieces for p in pieces for i in range(len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        # Last entry of the prefix table of a space mark and a word.
        self.ends = Recent(lambda word: self.table(SPACE + word)[-1], cache_words // 2, lambda word: len(word) <= LONG_WORD)
        self.cache_words = cache_words

    def encode(self, text: str) -> list[str]:
        """Pieces of a short text by plain merging; used for two neighbours at a time."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their joined text is encoded."""
        if len(self.fits) > 2 * self.cache_words:
            self.fits.clear()
        stay = self.fits[left, right] = left + right not in self.scores and self.encode(left + right) == [left, right]
        return stay

    def word(self, word: str) -> list[int]:
        """The table of a word, kept for the next time."""
        counts = self.words.get(word)
        if counts is None:
            if len(self.words) >= self.cache_words // 4:
                self.words.clear()
            counts = self.table(word)
            if len(word) <= LONG_WORD:
                self.words[word] = counts
        return counts

    def table(self, word: str) -> list[int]:
        """``counts[i]``: tokens of the first ``i`` characters of a word in its escaped form."""
        endings, fits = self.endings, self.fits
        counts, last = [0], [""]
        for i in range(1, len(word) + 1):
            for start in range(i - 1, -1, -1):
                piece = word[start:i]
                whole = endings.get(piece)
                if whole is None:
                    break
                if whole:
                    before = last[start]
                    if before:
                        stay = fits.get((before, piece))
                        if stay is None:
                            stay = self.neighbours(before, piece)
                        if not stay:
                            continue
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            if len(last) == i:
                # A character outside the vocabulary counts as its bytes, and nothing merges across it.
                counts.append(counts[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass")))
                last.append("")
        return counts

    def split(self, text: str) -> list[str]:
        """The escaped text with its dummy prefix, cut where a space mark follows another character."""
        if not text:
            return []
        words = (SPACE + text.replace(" ", SPACE)).split(SPACE)
        # Runs of space marks belong to the word after them.
        out, run = [], 0
        for w in words[1:]:
            run += 1
            if w:
                out.append(SPACE * run + w)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        if not text:
            return 0
        words = text.split(" ")
        if SPACE not in text and "" not in words:
            return sum(map(self.ends.__getitem__, words))
        return sum(self.word(w)[-1] for w in self.split(text))

    def prefixes(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of ``text[:i]`` for every ``i`` from 0 to ``len(text)``."""
        out, base = [0], 0
        for w in self.split(text):
            counts = self.word(w)
            out.extend([base + c for c in counts[1:]])
            base += counts[-1]
        # The dummy prefix is a character of its own: text[:i] ends at escaped position i + 1.
        return np.array([0] + out[2:] if text else [0], np.int64)

    def fitting(self, text: str, budget: int) -> int:
        """Length of the longest prefix that no shorter-or-equal prefix pushes over ``budget`` tokens.

        Counts are not monotone: one more character can merge pieces.  Of all
        prefixes within the budget the longest is returned.
        """
        counts = self.prefixes(text)
        inside = np.flatnonzero(counts <= budget)
        return int(inside[-1]) if len(inside) else 0


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter per file and Python worker."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether ``limit`` is passed, for every whole text.

    A map over the rows: no shuffle, bounded memory.  Null text counts as empty
    (0 tokens), null ids and repeated rows pass through, other columns are ignored.
    """

    def run(batches):
        count = counter(path)
        for b in batches:
            n = [count.total(t) for t in b["text"]]
            yield [b["id"], b["n_bytes"], n, [x > limit for x in n]]

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return map_batches(narrow, run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, path: str, every: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The prefix tables themselves: per row the counts after each ``every`` characters and at the end.

    ``counts[j]`` belongs to the first ``min(j * every, n_chars)`` code points.
    """

    def run(batches):
        count = counter(path)
        for b in batches:
            rows = []
            for t in b["text"]:
                c = count.prefixes(t)
                at = list(range(0, len(c), every))
                rows.append(c[at + ([len(c) - 1] if at[-1] != len(c) - 1 else [])].tolist())
            yield [b["id"], [len(t) for t in b["text"]], rows]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, n_chars long, counts array<long>")


def truncated(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text cut to its longest prefix of at most ``budget`` tokens, read off the prefix table."""

    def run(batches):
        count = counter(path)
        for b in batches:
            kept = [t[:count.fitting(t, budget)] for t in b["text"]]
            yield [b["id"], kept, [count.total(t) for t in kept]]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, text string, n_tokens long")
