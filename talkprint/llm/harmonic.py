"""Harmonic packing of documents into training sequences, with almost nothing cut and nothing padded.

Lengths fall into classes by reciprocals of the capacity: class ``k`` holds the
lengths above ``capacity / (k + 1)`` and up to ``capacity / k``, so any ``k`` of
them share a sequence.  A sequence of class ``k`` takes exactly ``k`` documents
and closes; lengths below ``capacity / (classes + 1)`` are the last class, a
stream.  No class waits for another and no worker for another: a partition of
the table is packed by itself, in one pass, with a bounded number of open
sequences.

A closed sequence still has a gap, less than what one more document of its class
would need.  As pieces may be cut freely, gaps are filled from the stream of the
last class.  Where that runs dry, closed sequences with the widest gaps join the
stream: one dissolved sequence is worth ``capacity`` tokens of gaps.  What is
left of a partition becomes full sequences and then sequences whose lengths are
powers of two, which need no padding either.
"""

import functools
import heapq
import json
import re
import zlib
from array import array
from collections import deque

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkprint.llm.bpe import byte_letters
from talkprint.llm.common import Recent, map_batches

CAPACITY = 4096
CLASSES = 16
END_ID = 2
#: Closed sequences that wait for their gaps to be filled, and the stream's reserve in sequences: bounds of a worker's memory.
WAITING, RESERVE = 256, 16
CACHE_WORDS = 400_000
SHORT_WORD = 200
#: Words of these characters are handled here, all others by the library.
PLAIN = re.compile("[!-~¡-ſ]+")
#: White space to Python, but maybe not to the library.
SEPARATORS = re.compile("[\x1c-\x1f\x85]")
MARK = "\0"  # stands for the end of a word; no plain word holds it


class WordBPE:
    """Ids of a vocabulary with word ends, lower case and dropped white space, as its library gives them.

    Words of plain characters that are not in the cache are merged by rank of
    the joined bytes in a second public library, one byte standing for the end of
    a word.  Everything else goes to the vocabulary's own library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or letters["type"] != "ByteLevel" or not split["invert"]:
            raise ValueError("only lower-case vocabularies that drop white space are supported")
        suffix = spec["model"]["end_of_word_suffix"]
        byte_of = {c: b for b, c in byte_letters().items()}
        special = {a["content"] for a in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix(suffix)
                ranks[bytes(map(byte_of.__getitem__, body)) + (MARK.encode() if body != token else b"")] = i
        self.special = special
        self.library = Tokenizer.from_file(path)
        self.merger = tiktoken.Encoding("word ends", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.known = Recent(self.word, cache_words // 2, lambda word: len(word) <= SHORT_WORD)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a stretch of text without white space."""
        if len(word) > SHORT_WORD or not PLAIN.fullmatch(word) or any(s in word for s in self.special):
            return self.whole(word)
        pieces = self.pieces.findall(word.lower())
        return array("I", self.merger.encode_ordinary(MARK.join(pieces) + MARK)).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a whole text.  White space parts words for good, so that words can be encoded one by one."""
        if SEPARATORS.search(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, text.split()))


@functools.cache
def codec(path: str) -> WordBPE:
    return WordBPE(path)


class Packer:
    """Packs the documents of one partition; ``out`` gathers the placed pieces.

    A piece is ``(document, start, length)``, a document ``(id, ids, tokens)`` with
    its ids as bytes.  Rows of ``out`` are those of :func:`pack_documents`.
    """

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, first_sequence: int = 0):
        self.capacity, self.classes, self.sequence = capacity, classes, first_sequence
        self.open: list[list] = [[] for _ in range(classes + 1)]
        self.stream: deque = deque()
        self.streamed = 0
        self.waiting: list[tuple] = []  # heap of (-gap, number, pieces)
        self.gaps = self.closed = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        tokens = len(ids) // 4
        doc = (doc_id, memoryview(ids), tokens)
        start = 0
        while tokens - start >= self.capacity:
            self.emit([(doc, start, self.capacity)])
            start += self.capacity
        length = tokens - start
        if not length:
            return
        k = self.capacity // length
        if k > self.classes:
            self.feed([(doc, start, length)])
        else:
            mates = self.open[k]
            mates.append((doc, start, length))
            if len(mates) == k:
                self.open[k] = []
                self.close(mates)
        self.settle()

    def close(self, pieces: list) -> None:
        gap = self.capacity - sum(p[2] for p in pieces)
        if gap:
            self.closed += 1
            self.gaps += gap
            heapq.heappush(self.waiting, (-gap, self.closed, pieces))
        else:
            self.emit(pieces)

    def feed(self, pieces: list) -> None:
        self.stream.extend(pieces)
        self.streamed += sum(p[2] for p in pieces)

    def dissolve(self) -> None:
        """The sequence with the widest gap joins the stream."""
        gap, _, pieces = heapq.heappop(self.waiting)
        self.gaps += gap
        self.feed(pieces)

    def draw(self, need: int) -> list:
        """Pieces of the stream with ``need`` tokens, the last one cut where it must be."""
        taken = []
        self.streamed -= need
        while need:
            doc, start, length = self.stream.popleft()
            use = min(length, need)
            taken.append((doc, start, use))
            need -= use
            if use < length:
                self.stream.appendleft((doc, start + use, length - use))
        return taken

    def fill(self) -> None:
        while self.waiting and self.streamed >= -self.waiting[0][0]:
            gap, _, pieces = heapq.heappop(self.waiting)
            self.gaps += gap
            self.emit(pieces + self.draw(-gap))

    def settle(self) -> None:
        self.fill()
        while self.gaps >= self.capacity or len(self.waiting) > WAITING:
            self.dissolve()
            self.fill()
        while self.streamed > RESERVE * self.capacity:
            self.emit(self.draw(self.capacity))

    def finish(self) -> None:
        """Unfinished sequences wait for filling like closed ones; the rest ends in powers of two."""
        for pieces in self.open:
            if pieces:
                self.close(pieces)
        self.open = [[] for _ in self.open]
        while self.gaps > self.streamed:
            self.dissolve()
        self.fill()
        while self.streamed:
            self.emit(self.draw(self.capacity if self.streamed >= self.capacity else 1 << self.streamed.bit_length() - 1))

    def emit(self, pieces: list) -> None:
        offset = 0
        for (doc_id, ids, tokens), start, length in pieces:
            crc = zlib.crc32(ids[4 * start:4 * (start + length)])
            self.out.append((doc_id, start, length, crc, tokens, self.sequence, offset))
            offset += length
        self.sequence += 1


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every piece of every document: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A map over the partitions of ``docs``, which keep nothing but their unfinished
    sequences.  Only documents beyond the capacity and those that fill gaps are
    cut.  Null text is an empty document of one token, the end id.  Null ids and
    repeated rows are documents like any other, texts of any length are encoded as
    a whole, an empty table gives an empty result, and further columns of ``docs``
    are not read.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode, packer = codec(path).packed, None
        for b in batches:
            if packer is None:
                packer = Packer(capacity, classes, b["part"][0] << 40)
            for i, t in zip(b["id"], b["text"], strict=True):
                packer.add(i, encode(t) + end)
            if packer.out:
                yield list(map(list, zip(*packer.out, strict=True)))
                packer.out = []
        if packer is not None:
            packer.finish()
            if packer.out:
                yield list(map(list, zip(*packer.out, strict=True)))

    narrow = docs.select(
        F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return map_batches(
        narrow, run, f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
