"""Token alignment, harmonic packing and product codes against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkprint.llm import alignment, harmonic, product_codes
from talkprint.llm.common import tokenizer_path
from talkprint.llm.queries import ORACLE
from tests.conftest import SF
from tests.llm.test_tokens import ODD, random_texts

A, B, WORDS = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
TEXTS = ["one two three", None, "", "tab\there  and\n\nthere", "▁ no piece", "<s> <|endoftext|> x", "naïve ça 漢字 😀", "one two three"]


@pytest.fixture(scope="module")
def both():
    return alignment.aligner(A, B)


@pytest.fixture(scope="module")
def byte_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    return library


def brute_tokens(both, library, text):
    """(ids, ends) of both encodings by the libraries alone, or None."""
    if not text:
        return None
    data, out = f" {text}".encode(), []
    a, b = library.encode(f" {text}", add_special_tokens=False).ids, both.second.encode(text)
    for ids, spell in ((a, both.first.texts), (b, both.b_bytes)):
        if b"".join(spell[i] for i in ids) != data:
            return None
        out.append((ids, np.cumsum([len(spell[i]) for i in ids]).tolist()))
    return out


def brute_alignment(both, library, texts):
    """Rows of the digest by trying all token pairs of a document."""
    links, rows, holders = [], [], Counter()
    for text in texts:
        found, groups, own = brute_tokens(both, library, text), [], []
        if found:
            (a, ae), (b, be) = found
            own = [
                (x, y) for i, x in enumerate(a) for j, y in enumerate(b)
                if max(ae[i - 1] if i else 0, be[j - 1] if j else 0) < min(ae[i], be[j])
            ]
            cuts = sorted(set(ae) & set(be))
            for low, high in zip([0, *cuts], cuts):
                groups.append("|".join(",".join(str(t) for t, e in zip(ids, ends) if low < e <= high) for ids, ends in found))
        links.append(own)
        holders.update(set(own))
        text = ";".join(groups)
        rows.append([len(found[0][0]) if found else 0, len(found[1][0]) if found else 0, len(groups), len(own),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""])
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    return [
        (*r[:4], sum(holders[p] == best[p[0]] for p in own), sum(holders[p] for p in own), r[4])
        for r, own in zip(rows, links, strict=True)
    ]


@pytest.mark.parametrize("texts", [ODD, random_texts(300, 4)], ids=["odd", "random"])
def test_tokens_equal_libraries(both, byte_library, texts):
    for t in texts:
        want, got = brute_tokens(both, byte_library, t), both.tokens(t) if t else None
        assert (want is None) == (got is None), t
        if want:
            assert [x.tolist() for x in got] == [*want[0], *want[1]], t


def test_composition_is_associative(both):
    rng = random.Random(5)
    for text in [t for t in random_texts(150, 6) if t and both.tokens(t) is not None]:
        tokens = both.tokens(text)
        end = int(tokens.a_ends[-1])
        cuts = sorted({0, end, *(rng.randrange(1, end + 1) for _ in range(4))})
        parts = [both.fragment(tokens.between(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [both.compose(parts[i], parts[i + 1])]
        assert both.compose(alignment.START, parts[0]).closed == both.document(text)


def test_ranges_cover_every_byte():
    for text in ["a b " * 50, "x" * 300 + " y z " + "é" * 200, "word " * 3]:
        data = b" " + text.encode()
        found = list(alignment.ranges(data, 16))
        assert [r[0] for r in found][1:] == [r[1] for r in found][:-1] and found[0][0] == 0 and found[-1][1] == len(data)
        assert all(s <= lo and s + len(p) >= hi and data[s:s + len(p)] == p for lo, hi, s, p in found)


@pytest.mark.parametrize("sizes", [{}, {"long_bytes": 40, "range_bytes": 16, "block_bytes": 100}], ids=["whole", "ranges"])
def test_alignment_equals_brute_force(spark, both, byte_library, sizes):
    texts = TEXTS + ODD[:-5] + [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if len(t or "") < 400][:40]
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    got = alignment.alignment_digests(docs, A, B, **sizes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(None if i == 3 else i, *r) for i, r in enumerate(brute_alignment(both, byte_library, texts))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignment_digests(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("texts", [
    [*ODD, "Don't SHOUT", "ΑΣ Σ", "İ ŉ ſ", "a\x1cb", "x<|startoftext|>y", "½²ª", "Á é"], random_texts(500, 8),
], ids=["odd", "random"])
def test_word_ids_equal_library(word_library, texts):
    codec = harmonic.codec(WORDS)
    for t in texts:
        want = word_library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.packed(t), np.uint32).tolist() == want, t


def test_word_ids_of_real_documents(word_library):
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    small = harmonic.WordBPE(WORDS, cache_words=50)
    for t, x in zip(texts, word_library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(small.packed(t), np.uint32).tolist() == x.ids
    assert len(small.known) <= 50


def check_packing(rows, ids_of, capacity):
    """Every id in one piece, no gaps, nothing padded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, tokens, sequence, offset in rows:
        ids = ids_of[doc_id]
        assert tokens == len(ids) and crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
        pieces[doc_id].append((start, length))
        sequences[sequence].append((offset, length))
    assert set(pieces) == set(ids_of)
    for where, total in [*((p, len(ids_of[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(where):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at == capacity or at & (at - 1) == 0


def test_packing_fills_sequences(spark, word_library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("start", F.lit("clash"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids_of = {d: [*word_library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for frame, capacity in ((docs, 4096), (docs.repartition(5), 300)):
        rows = [tuple(r) for r in harmonic.pack_documents(frame, WORDS, capacity=capacity).collect()]
        check_packing(rows, ids_of, capacity)


@pytest.mark.parametrize("lengths", [[1], [700] * 500, [2049] * 40, [4096, 8192, 1], [1500, 2500] * 60, [3] * 5000, [5000] * 30], ids=str)
def test_packer_on_awkward_lengths(lengths):
    packer = harmonic.Packer()
    ids_of = {i: list(range(n)) for i, n in enumerate(lengths)}
    for i, ids in ids_of.items():
        packer.add(i, np.array(ids, "<u4").tobytes())
        assert len(packer.waiting) <= harmonic.WAITING and packer.streamed <= (harmonic.RESERVE + 1) * 4096
    packer.finish()
    check_packing(packer.out, ids_of, 4096)


def test_sequences_of_a_class_hold_its_count():
    packer = harmonic.Packer(capacity=1200, classes=4)
    for i in range(12):
        packer.add(i, b"\1\0\0\0" * 400)
    packer.finish()
    assert Counter(Counter(r[5] for r in packer.out).values()) == {3: 4} and all(r[1] == 0 for r in packer.out)


def test_packing_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x y"), (None, "z")]
    found = harmonic.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in found if not r.start) == {(None, 1): 1, (1, 1): 2, (2, 3): 1, (None, 2): 1}
    assert harmonic.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codes and errors by Python integers and full scans."""
    rows = [(i, lab, [int(np.floor(1024 * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(rows[0][2]) // parts
    cut = lambda x, p: x[p * width:(p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(x, p) for _, _, x in first] for p in range(parts)]

    def find(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, x in rows:
                members[find(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    coded = [(i, lab, [find(cut(x, p), books[p]) for p in range(parts)]) for i, lab, x in rows]
    by_label = Counter()
    for _, lab, c in coded:
        by_label[lab] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), by_label[lab], digest) for i, lab, c in coded]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(0, 3, 2).repeat(4) + rng.normal(0, .05, 8)).tolist(), int(i % 3) if i % 7 else None) for i in range(400)]
    rows += [(5, rows[5][1], 0), (None, rows[6][1], 1), (500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1),
             (503, [float("inf")] * 8, 1), (504, [-0.0] * 8, 9), (505, rows[7][1], 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, row string").repartition(5)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = product_codes.code_digests(frame, entries=20, block_rows=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_codes(single, entries=20), key=repr)


def test_shortlists_prune_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.uniform(-1, 1, (40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(0, .01, 8)).tolist(), 0) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = product_codes.Quantizer(frame, entries=40, block_rows=32)
    assert len(q.evaluated) == 4 and all(total == 4000 * 40 * 4 for _, total in q.evaluated)
    assert all(met < 0.2 * total for met, total in q.evaluated)
    assert q.encode().count() == 4000


def test_hilbert_neighbours_share_a_side():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = product_codes.hilbert_keys(cells, bits)
        along = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(6)
    for _ in range(200):
        points, entries = rng.integers(-9, 9, (12, 3)), rng.integers(-9, 9, (15, 3))
        chosen = product_codes.shortlist(points.min(0), points.max(0), entries)
        code, d = product_codes.nearest(points, entries)
        assert set(code.tolist()) <= set(chosen.tolist())
        again = product_codes.assign(points, points.min(0), points.max(0), entries)
        assert again[0].tolist() == code.tolist() and again[1].tolist() == d.tolist()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert product_codes.code_digests(spark.createDataFrame([(1, None, 2)], schema)).count() == 0
    one = product_codes.code_digests(spark.createDataFrame([(7, [1.0] * 8, None)], schema)).first()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    for bad in ([1.0] * 6, [1e30] * 8):
        with pytest.raises(ValueError):
            product_codes.code_digests(spark.createDataFrame([(1, bad, 0)], schema))


def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(ORACLE["op13_product_codes"])
    names = [c[0] for c in want.description]
    got = product_codes.code_digests(spark.read.parquet(f"{SF}/embeddings.parquet")).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
