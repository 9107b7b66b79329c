"""Byte-level byte-pair encoding and decoding with a contiguous rank array.

A short word is held as the list of its part boundaries next to the list of
the ranks of adjacent part pairs.  One step scans the ranks for the smallest,
deletes the boundary between the two parts and refreshes the one or two ranks
beside it.  For words of a few bytes this beats heaps and linked lists, and
words recur, so each Python worker keeps a bounded cache of encoded words.
Words that a batch of texts brings in are merged side by side: words of equal
length are the rows of one array of parts and one of ranks, and as a step takes
one boundary from every row that still has a rank, rows stay equally long.
Only words beyond ``SHORT_WORD`` bytes use a heap, as the scans would grow with
the square of their length.

The vocabulary is read from a tokenizers JSON file: merges give the ranks,
byte-level letters stand for bytes, special strings of the file are matched in
the text before anything else, as that library does.
"""

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import Recent, map_batches

# The word pattern of the byte-level pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 800_000
NO_RANK = 1 << 60
SHORT_WORD = 200
GROUP_CHARS = 1_000_000
SIDE_BY_SIDE = 50_000


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _short(key: str) -> bool:
    return len(key) <= SHORT_WORD


def _slices(ids: np.ndarray) -> Iterator[np.ndarray]:
    return (ids[at:at + SIDE_BY_SIDE] for at in range(0, len(ids), SIDE_BY_SIDE))


class ByteBPE:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or not plain:
            raise ValueError("only plain byte-level vocabularies are supported")
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.letters = [self.ids.get(bytes([b])) for b in range(256)]
        # A pair of ids as one number, its rank, and the id that the rank makes.
        self.span = max(model["vocab"].values()) + 1
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[self.ids[left] * self.span + self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int32)
        self.made_ids = np.array(self.made, np.int32)
        self.letter_ids = np.array(self.letters, np.int32)
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.words = regex.compile(WORD)
        self.cache_words = cache_words
        self.chunks = Recent(self.chunk, cache_words // 2, _short)
        self.known = Recent(self.word, cache_words // 4, _short)
        # Ids of chunks by packed_all: new ones, and those from before the last turn of generations.
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Decimal digits and a comma of every id, padded with zero bytes; bytes of every id, end to end.
        last = max(self.texts)
        self.decimal = np.array([f"{i},".encode() for i in range(last + 1)]).view(np.uint8).reshape(last + 1, -1)
        spelt = [self.texts.get(i, b"") for i in range(last + 1)]
        self.lengths = np.array([len(t) for t in spelt], np.int64)
        self.starts, self.spelt = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(spelt), np.uint8)

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """Part boundaries of one word and the ids of its parts."""
        rank_of, made, span = self.ranks.get, self.made, self.span
        parts = list(map(self.letters.__getitem__, word))
        bounds = list(range(len(word) + 1))
        near = [rank_of(a * span + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == NO_RANK:
                break
            i = near.index(low)
            # The pair (i, i + 1) becomes one part: its inner boundary goes, and so does its rank.
            del bounds[i + 1], near[i], parts[i + 1]
            parts[i] = part = made[low]
            if i < len(near):
                near[i] = rank_of(part * span + parts[i + 1], NO_RANK)
            if i:
                near[i - 1] = rank_of(parts[i - 1] * span + part, NO_RANK)
        return bounds, parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a word too long to scan its ranks again for every merge: a heap of pairs, links for neighbours."""
        rank_of, made, span = self.ranks.get, self.made, self.span
        parts = list(map(self.letters.__getitem__, word))
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of(parts[i] * span + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = made[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``len(made)``, above all ranks, where there is none."""
        keys = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], np.int32(len(self.made)))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of words of equal length: the steps of ``merge`` on all of them at once."""
        none, out = len(self.made), [b""] * len(words)
        which = np.arange(len(words))
        parts = self.letter_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        near = self.ranks_of(parts[:, :-1], parts[:, 1:])
        while len(which):
            at = near.argmin(1) if near.shape[1] else np.zeros(len(which), np.int64)
            low = near[np.arange(len(which)), at] if near.shape[1] else np.full(len(which), none, np.int32)
            done = low == none
            if done.any():
                width, ids = 4 * parts.shape[1], parts[done].astype("<u4").tobytes()
                for k, row in enumerate(which[done].tolist()):
                    out[row] = ids[width * k:width * k + width]
                which, parts, near, at, low = (x[~done] for x in (which, parts, near, at, low))
                if not len(which):
                    break
            rows, (n, m) = np.arange(len(which)), parts.shape
            # The pair (at, at + 1) becomes one part: its inner boundary goes, and so does its rank.
            stays = np.ones((n, m), bool)
            stays[rows, at + 1] = False
            parts = parts[stays].reshape(n, m - 1)
            parts[rows, at] = self.made_ids[low]
            stays = np.ones((n, m - 1), bool)
            stays[rows, at] = False
            near = near[stays].reshape(n, m - 2)
            before, after = rows[at > 0], rows[at < m - 2]
            near[before, at[before] - 1] = self.ranks_of(parts[before, at[before] - 1], parts[before, at[before]])
            near[after, at[after]] = self.ranks_of(parts[after, at[after]], parts[after, at[after] + 1])
        return out

    def merge_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids, as bytes, of every word of the pre-tokenizer; short ones side by side."""
        by_length: dict[int, list[str]] = {}
        out = {}
        for word in words:
            n = len(word) if word.isascii() else len(word.encode())
            if n <= SHORT_WORD:
                by_length.setdefault(n, []).append(word)
            else:
                out[word] = self.word(word)
        for same in by_length.values():
            for at in range(0, len(same), SIDE_BY_SIDE):
                some = same[at:at + SIDE_BY_SIDE]
                out.update(zip(some, self.merge_all([w.encode() for w in some]), strict=True))
        return out

    def merge_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids, as bytes, of chunks of text without spaces that a space precedes."""
        if not chunks:
            return {}
        order = list(chunks)
        # Each chunk opens with a space and holds no other, so that words with a space begin the chunks.
        words = self.words.findall(" " + " ".join(order))
        ids = self.merge_words(set(words))
        found = list(map(ids.__getitem__, words))
        starts = [k for k, word in enumerate(words) if word[0] == " "]
        return {
            chunk: found[s] if e == s + 1 else b"".join(found[s:e])
            for chunk, s, e in zip(order, starts, [*starts[1:], len(words)], strict=True)
        }

    def packed_all(self, texts: list[str]) -> Iterator[bytes]:
        """``packed`` of every text; what is new in about ``GROUP_CHARS`` characters of text is merged together."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[end])
                end += 1
            yield from self._packed_group(texts[start:end])
            start = end

    def _packed_group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.held) >= self.cache_words // 2:
            self.older, self.held = self.held, {}
        rows, wanted = [], set()
        for text in texts:
            if self.special and self.special.search(text):
                rows.append(None)
                continue
            first, *rest = text.split(" ")
            found = list(map(self.held.get, rest))
            places = [k for k, ids in enumerate(found) if ids is None]
            lacking = [rest[k] for k in places]
            # An empty chunk, or one that opens with white space, may share its space with the one before.
            if any(not c or c[0].isspace() for c in lacking):
                rows.append(None)
                continue
            wanted.update(lacking)
            rows.append((first, found, places, lacking))
        made = {c: self.older[c] for c in wanted if c in self.older}
        made.update(self.merge_chunks(wanted.difference(made)))
        self.held.update((c, ids) for c, ids in made.items() if len(c) <= SHORT_WORD)
        for text, row in zip(texts, rows, strict=True):
            if row is None:
                yield self.packed(text)
                continue
            first, found, places, lacking = row
            for k, chunk in zip(places, lacking, strict=True):
                found[k] = made[chunk]
            yield self.pack(first) + b"".join(found)

    def word(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a word of the pre-tokenizer."""
        data = word.encode()
        return array("I", self.merge_long(data) if len(data) > SHORT_WORD else self.merge(data)[1]).tobytes()

    def chunk(self, chunk: str) -> bytes | None:
        """Ids, as bytes, of a chunk of text that a space precedes; None if the space may belong to other white space."""
        return None if not chunk or chunk[0].isspace() else self.pack(" " + chunk)

    def pack(self, text: str) -> bytes:
        """Ids of a text without special strings, packed as 32-bit little-endian numbers."""
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def packed(self, text: str) -> bytes:
        """Ids of a whole text.

        Words never start inside a run of letters, digits or marks, and a space
        joins the word after it.  A text without runs of white space can
        therefore be cut at its single spaces, which needs no pattern.
        """
        if self.special and self.special.search(text):
            return b"".join(
                self.specials[part].to_bytes(4, "little") if i % 2 else self.packed(part)
                for i, part in enumerate(self.special.split(text))
            )
        first, *rest = text.split(" ")
        found = list(map(self.chunks.__getitem__, rest))
        if None in found:
            return self.pack(text)
        return self.pack(first) + b"".join(found)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join((d := self.decimal[some])[d > 0].tobytes() for some in _slices(ids))[:-1]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        out = []
        for some in _slices(np.asarray(ids, np.int64)):
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            out.append(self.spelt[np.arange(ends[-1]) + np.repeat(self.starts[some] - ends + lengths, lengths)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> ByteBPE:
    """One codec per file and Python worker."""
    return ByteBPE(path)


def encode_decode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every whole text.

    A map over the rows.  Null text counts as empty (no ids, digests of the
    empty string); null ids and repeated rows pass through.
    """

    def run(batches):
        bpe = codec(path)
        for b in batches:
            out = [b["id"], [], [], []]
            for packed in bpe.packed_all(b["text"]):
                ids = np.frombuffer(packed, "<u4")
                out[1].append(len(ids))
                out[2].append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                out[3].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every text."""

    def run(batches):
        bpe = codec(path)
        for b in batches:
            yield [b["id"], [memoryview(p).cast("I").tolist() for p in bpe.packed_all(b["text"])]]

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; a null list is the empty text."""

    def run(batches):
        bpe = codec(path)
        for b in batches:
            yield [b["id"], [bpe.decode(x or []) for x in b["ids"]]]

    return map_batches(
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, f"{id_col} long, text string"
    )
