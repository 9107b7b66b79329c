"""BPE encoding, prefix counts and packing against the public libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from talkprint.llm import bpe, packing, prefix_counts
from talkprint.llm.common import tokenizer_path
from tests.conftest import SF

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a  b", "a \n b", "a ", "\n", "don't we'll", "<|endoftext|>", "x <|endoftext|>  y", "é漢字ñ", "a½ 12３ Ⅷ",
    "<s> </s> <unk>", "\x00\x1c\x85", "▁ a▁b", "aaaa" * 100, "x" * 5000, "😀 é", "a\r\nb\tc", "   ",
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "é", "漢", "'s", "1", "２", "the", " ing", " ", "　", "😀", "!?", "_", "▁", "<s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("texts", [ODD, random_texts(500)], ids=["odd", "random"])
def test_bpe_equals_library(library, texts):
    ours = bpe.codec(BPE)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want, t
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)
        cut = want[: len(want) // 2]
        assert ours.decode(cut) == library.decode(cut, skip_special_tokens=False)


@pytest.mark.parametrize("texts", [ODD, random_texts(500, 9)], ids=["odd", "random"])
def test_ids_for_packing_equal_library(library, texts):
    ours = packing.codec(BPE)
    assert [ours.encode(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_for_packing_of_real_documents(library):
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    ours = packing.codec(BPE)
    assert [ours.encode(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("texts", [ODD, random_texts(500, 7), ["a b" * 3, "x" * 300 + " y", "w " * 5000, "q\n z"] * 3], ids=["odd", "random", "long"])
def test_texts_encoded_together_equal_library(library, texts):
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for ours in (bpe.ByteBPE(BPE), bpe.ByteBPE(BPE, cache_words=10), packing.LibraryBPE(BPE)):
        for _ in range(2):
            assert [np.frombuffer(p, "<u4").tolist() for p in ours.packed_all(texts)] == want
    for ids in want:
        assert ours.decimals(np.array(ids, np.uint32)) == ",".join(map(str, ids)).encode()


def test_words_side_by_side_equal_words_alone():
    ours, rng = bpe.ByteBPE(BPE), random.Random(3)
    for n in (1, 2, 9, 60):
        words = [bytes(rng.choice(b"abehinorst \xc3\xa9") for _ in range(n)) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.merge_all(words)] == [ours.merge(w)[1] for w in words]


def test_groups_and_tables_of_chunks_are_bounded():
    small = bpe.ByteBPE(BPE, cache_words=10)
    texts = [f"a{i} b{i} " + "z" * 250 + f"{i}" for i in range(100)]
    for t in texts:
        list(small.packed_all([t]))
        assert len(small.held) + len(small.older) <= 14 and not any(len(c) > bpe.SHORT_WORD for c in small.held)


def test_bounds_of_merged_words():
    bounds, parts = bpe.codec(BPE).merge(b" hello")
    assert bounds[0] == 0 and bounds[-1] == 6 and len(bounds) == len(parts) + 1
    long = ("abcdefgh" * 40).encode()
    assert bpe.codec(BPE).merge_long(long) == bpe.codec(BPE).merge(long)[1]


def test_cache_is_bounded():
    small = bpe.ByteBPE(BPE, cache_words=10)
    text = " ".join(f"word{i}" for i in range(100))
    assert small.encode(text) == bpe.codec(BPE).encode(text) and len(small.chunks) <= 10
    counter = prefix_counts.PieceCounter(PIECES, cache_words=10)
    assert counter.total(text) == prefix_counts.counter(PIECES).total(text) and len(counter.ends) <= 10


@pytest.mark.parametrize("texts", [ODD, random_texts(300, 2)], ids=["odd", "random"])
def test_every_prefix_count_equals_library(pieces, texts):
    count = prefix_counts.counter(PIECES)
    for t in texts:
        t = t[:200]
        want = [len(pieces.encode(t[:i])) for i in range(len(t) + 1)]
        assert count.prefixes(t).tolist() == want, t
        assert count.total(t) == want[-1]


def test_budget_is_read_off_the_table(pieces):
    count, text = prefix_counts.counter(PIECES), "the quick brown fox jumps over naïve 漢字 words"
    for budget in range(12):
        n = count.fitting(text, budget)
        assert len(pieces.encode(text[:n])) <= budget
        assert all(len(pieces.encode(text[:i])) > budget for i in range(n + 1, len(text) + 1))


def odd_docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, None, None, None), (3, "a  b", "x", 1), (3, "a  b", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")


def test_token_counts_of_odd_rows(spark, pieces):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_counts.token_counts(odd_docs(spark), PIECES, 40).collect())
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ""), (3, "a  b"), (3, "a  b")]
    want = sorted((i is None, i or 0, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 40) for i, t in rows)
    assert got == want
    assert prefix_counts.token_counts(odd_docs(spark).limit(0), PIECES).count() == 0


def test_prefix_table_and_truncation(spark, pieces):
    docs = spark.createDataFrame([(1, "hello wide world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in prefix_counts.prefix_table(docs, PIECES, every=5).collect()}
    assert rows[1].counts == [len(pieces.encode("hello wide world"[:i])) for i in (0, 5, 10, 15, 16)] and rows[2].counts == [0]
    kept = {r.doc_id: r for r in prefix_counts.truncated(docs, PIECES, 2).collect()}
    assert kept[1].n_tokens <= 2 and "hello wide world".startswith(kept[1].text) and kept[2].text == ""


def test_encode_decode_digests(spark, library):
    got = {r.doc_id: r for r in bpe.encode_decode_digests(odd_docs(spark), BPE).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest, back)
    assert got[None].n_tokens == 0


def test_encoded_and_decoded_tables(spark):
    docs = spark.createDataFrame([(1, "round trip é"), (2, None)], "doc_id long, text string")
    back = bpe.decoded(bpe.encoded(docs, BPE), BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "round trip é", 2: ""}


# ------------------------------------------------------------------ packing


def check_packing(docs, rows, library, capacity):
    """Every id of every document once, in order, gapless in sequences that fit."""
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs]
    fills = {}
    for r in rows:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fills.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:i]) for i, (o, _) in enumerate(spans))
        assert sum(n for _, n in spans) <= capacity
    want = []
    for (i, _), x in zip(docs, ids, strict=True):
        cuts = [0, *range(len(x) % capacity or min(len(x), capacity), len(x) + 1, capacity)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, s, e - s, zlib.crc32(np.array(x[s:e], "<u4").tobytes())))
    key = lambda t: tuple((v is not None, v or 0) for v in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(fills), sum(map(len, ids))


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing_is_whole_and_tight(spark, library, capacity):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "déjà"]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, None), (7, "twice"), (7, "twice"), (900, "word " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as piece", "2 as sequence_id")
    n, total = check_packing(docs, packing.pack_documents(df, BPE, capacity).collect(), library, capacity)
    assert n <= -(-total // capacity) * 1.06 + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_many_blocks_and_islands_pack_everything(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 100)) for i in range(600)]
    placed = packing.pack(spark.createDataFrame(rows, "item long, length int"), 100, islands=3, epochs=2, block_items=60).collect()
    size = dict(rows)
    assert sorted(r.item for r in placed) == list(range(600))
    fills = {}
    for r in placed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + size[r.item]
    assert max(fills.values()) <= 100 and len(fills) <= 1.06 * sum(size.values()) / 100 + 1


def test_crossover_keeps_every_item_once_and_evolution_does_not_lose():
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 60, 90).tolist()
    bins, fills = [], []
    packing.best_fit(list(range(90)), sizes, bins, fills, 100)
    other, other_fills = [], []
    packing.best_fit(sorted(range(90), key=lambda i: -sizes[i]), sizes, other, other_fills, 100)
    child = packing.crossover((bins, fills), (other, other_fills), sizes, 100, rng)
    child = packing.mutate(child, sizes, 100, rng)
    assert sorted(i for b in child[0] for i in b) == list(range(90))
    assert [sum(sizes[i] for i in b) for b in child[0]] == child[1] and max(child[1]) <= 100
    numbers = packing.evolve(sizes, [], 100, seed=1, generations=10)[0]
    assert len(set(numbers)) <= min(len(bins), len(other))
