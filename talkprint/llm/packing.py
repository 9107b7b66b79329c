"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

A chromosome is a packing: its genes are whole sequences, not single documents.
Crossover injects well-filled sequences of one parent into the other, removes
the sequences of the other that now hold a document twice, and puts the
documents which those leave behind back by best fit, largest first.  Mutation
dissolves badly filled sequences the same way.

Documents are dealt at random into blocks of bounded size.  Each block is
evolved by several islands, populations that do not see each other; between
epochs every island also receives the elite of its neighbour.  An epoch is one
Spark job over (block, island) rows, written to the shared folder.  Sequences
that a block fills well are final; the documents of the others are dealt anew
into fewer blocks, until one block is left or dealing no longer helps.
"""

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm import bpe
from talkprint.llm.common import map_batches
from talkprint.sources.shared import settle

CAPACITY = 2048
BLOCK_ITEMS = 2000
WELL_FILLED = 0.985
CACHE_WORDS = 800_000


class Shelf:
    """Open sequences by free room: the tightest that still fits is found in a bit mask."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, room: int, which: int) -> None:
        self.by_room[room].append(which)
        self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``need``."""
        fitting = self.mask >> need
        if not fitting:
            return None
        room = need + (fitting & -fitting).bit_length() - 1
        which = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return room, which


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Add the items of ``order`` to ``bins`` in place."""
    shelf = Shelf(capacity)
    for b, fill in enumerate(fills):
        if fill < capacity:
            shelf.add(capacity - fill, b)
    for item in order:
        size = sizes[item]
        found = shelf.take(size)
        if found is None:
            bins.append([item])
            fills.append(size)
            if size < capacity:
                shelf.add(capacity - size, len(bins) - 1)
        else:
            room, b = found
            bins[b].append(item)
            fills[b] += size
            if room > size:
                shelf.add(room - size, b)


def fitness(packing: tuple, capacity: int) -> float:
    """Mean squared fill: fewer sequences, and of as many the more uneven ones, score higher."""
    fills = np.array(packing[1])
    return float(((fills / capacity) ** 2).mean()) if len(fills) else 1.0


def crossover(receiver: tuple, donor: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple:
    fills = np.array(donor[1])
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    injected = good[rng.random(len(good)) < rng.uniform(0.1, 0.6)].tolist()
    inside = {i for b in injected for i in donor[0][b]}
    bins, kept, displaced = [], [], []
    for content, fill in zip(*receiver, strict=True):
        if inside.isdisjoint(content):
            bins.append(list(content))
            kept.append(fill)
        else:
            displaced += [i for i in content if i not in inside]
    for b in injected:
        bins.append(list(donor[0][b]))
        kept.append(donor[1][b])
    best_fit(sorted(displaced, key=lambda i: -sizes[i]), sizes, bins, kept, capacity)
    return bins, kept


def mutate(packing: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple:
    """Dissolve the worst sequence and a few others, and put their items back in a shaken order."""
    fills = np.array(packing[1])
    gone = {int(fills.argmin()), *rng.integers(0, len(fills), max(1, len(fills) // 30)).tolist()}
    bins = [list(b) for k, b in enumerate(packing[0]) if k not in gone]
    kept = [f for k, f in enumerate(packing[1]) if k not in gone]
    loose = [i for k in sorted(gone) for i in packing[0][k]]
    shaken = {i: sizes[i] * rng.uniform(0.8, 1.2) for i in loose}
    best_fit(sorted(loose, key=lambda i: -shaken[i]), sizes, bins, kept, capacity)
    return bins, kept


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int, population: int = 6, generations: int = 8) -> list[list[int]]:
    """One epoch of one island: from elites (sequence number per item) to the two best packings found.

    Ends early once a packing has no more sequences than the items' total demands.
    """
    rng, need = np.random.default_rng(seed), -(-sum(sizes) // capacity)

    def unpacked(numbers: list[int]) -> tuple:
        bins: dict[int, list[int]] = {}
        for item, b in enumerate(numbers):
            bins.setdefault(b, []).append(item)
        contents = list(bins.values())
        return contents, [sum(sizes[i] for i in c) for c in contents]

    def packed(packing: tuple) -> list[int]:
        numbers = [0] * len(sizes)
        for b, content in enumerate(packing[0]):
            for i in content:
                numbers[i] = b
        return numbers

    people = [unpacked(e) for e in elites]
    while len(people) < population and not any(len(p[0]) <= need for p in people):
        noise = rng.uniform(0.75, 1.25, len(sizes)) if people else np.ones(len(sizes))
        order = np.argsort(-np.array(sizes) * noise, kind="stable").tolist()
        bins: list[list[int]] = []
        fills: list[int] = []
        best_fit(order, sizes, bins, fills, capacity)
        people.append((bins, fills))
    score = lambda p: fitness(p, capacity)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(people[0][0]) <= need:
            break
        children = []
        for _ in range(population // 2):
            a, b = sorted(rng.integers(0, len(people), 2).tolist())
            child = crossover(people[b], people[a], sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        people = sorted(people + children, key=score, reverse=True)[:population]
    return [packed(p) for p in people[:2]]


def _islands(blocks: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """``block, number`` (sequence per item, in the order of ``items``) of the best packing of every block."""
    state = blocks.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn(
        "elites", F.lit(None).cast("array<array<int>>")
    )
    for epoch in range(epochs):

        def run(batches: Iterator[dict], epoch=epoch):
            for b in batches:
                for block, island, items, elites in zip(b["block"], b["island"], b["items"], b["elites"], strict=True):
                    sizes = [i["length"] for i in items]
                    seed = zlib.crc32(f"{block}/{island}/{epoch}/{len(items)}".encode())
                    found = evolve(sizes, elites or [], capacity, seed)
                    yield [[block], [island], [found], [fitness(_filled(sizes, found[0]), capacity)]]

        evolved = settle(
            map_batches(
                state.repartition(F.col("block"), F.col("island")), run, "block long, island int, elites array<array<int>>, score double"
            ), "islands",
        )
        if epoch + 1 < epochs:
            # Elite migration: an island keeps its best and gets the best of the one before it.
            own = evolved.select("block", "island", F.element_at("elites", 1).alias("elite"))
            moved = own.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            met = own.unionByName(moved).groupBy("block", "island").agg(F.collect_list("elite").alias("elites"))
            state = blocks.join(met, "block")
    best = evolved.groupBy("block").agg(F.max_by(F.element_at("elites", 1), F.struct("score", -F.col("island"))).alias("number"))
    return blocks.join(best, "block")


def _filled(sizes: list[int], numbers: list[int]) -> tuple:
    fills = np.bincount(numbers, weights=sizes)
    return None, fills


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 2, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item, sequence_id, offset`` for items (``item long, length int``, 1 to ``capacity``)."""
    left, level, done = settle(items.select("item", "length"), "items"), 0, []
    n = left.count()
    while n:
        count = -(-n // block_items)
        block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(count))
        blocks = settle(
            left.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("items")),
            "blocks",
        )
        packed = _islands(blocks, capacity, islands, epochs)

        def spell(batches: Iterator[dict]):
            for b in batches:
                for block, items, number in zip(b["block"], b["items"], b["number"], strict=True):
                    at: dict[int, int] = {}
                    offsets = []
                    for i, s in zip(items, number, strict=True):
                        offsets.append(at.get(s, 0))
                        at[s] = offsets[-1] + i["length"]
                    yield [
                        [i["item"] for i in items], [i["length"] for i in items], [block] * len(items), number, offsets,
                        [at[s] for s in number],
                    ]

        placed = settle(
            map_batches(packed, spell, "item long, length int, block long, number int, offset long, fill long"), "placed"
        )
        loose = placed.where(F.col("fill") < WELL_FILLED * capacity)
        rest = loose.count() if count > 1 else 0
        last = count == 1 or rest == 0 or 2 * rest > n
        final = placed if last else placed.where(F.col("fill") >= WELL_FILLED * capacity)
        number = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("block") * F.lit(1 << 20) + F.col("number")
        done.append(final.select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        left, n, level = loose.select("item", "length"), rest, level + 1
    if not done:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class LibraryBPE(bpe.ByteBPE):
    """The same ids with words that are not in the cache encoded by a public library.

    Packing needs ids, not a way to make them.  The library merges by the rank of
    the joined bytes; that is the order of the merges where ids ascend with them,
    which is checked here.
    """

    def __init__(self, path: str):
        super().__init__(path, CACHE_WORDS)
        if any(a >= b for a, b in zip(self.made, self.made[1:])) or max(self.letters) >= self.made[0]:
            raise ValueError("ids do not follow the order of the merges")
        self.library = tiktoken.Encoding("vocabulary", pat_str=bpe.WORD, mergeable_ranks=self.mergeable(), special_tokens={})

    def mergeable(self) -> dict[bytes, int]:
        special = set(self.specials.values())
        return {t: i for t, i in self.ids.items() if i not in special}

    def merge_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        return {c: self.pack(" " + c) for c in chunks}

    def pack(self, text: str) -> bytes:
        if len(text) > bpe.SHORT_WORD:
            return super().pack(text)
        return array("I", self.library.encode_ordinary(text)).tobytes()


@functools.cache
def codec(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every document's ids with ``end_id`` after them.

    Documents beyond the capacity are cut into pieces of exactly it, but for the
    first, which takes what is over.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = codec(path).packed_all
        for b in batches:
            out = [[] for _ in range(5)]
            for i, found in zip(b["id"], encode(b["text"]), strict=True):
                ids = memoryview(found + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (i, k, s, e - s, zlib.crc32(ids[4 * s:4 * e])), strict=True):
                        column.append(value)
            yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(narrow, run, f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Null text is an empty document of one token.  Repeated rows and null ids are
    documents like any other.  Pieces of full length are sequences of their own.
    """
    cut = settle(pieces(docs, path, capacity, 0, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("item") - 1).withColumn("offset", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < capacity)
    placed = pack(short.select("item", F.col("length").cast("int").alias("length")), capacity)
    return whole.unionByName(short.join(placed, "item").select(*whole.columns)).drop("item")
