"""The pipeline's stages and the registered queries."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from talkprint.llm import language, simhash
from talkprint.llm.common import map_batches
from talkprint.llm.queries import ORACLE, QUERIES
from tests.conftest import SF
from tests.llm.test_search_and_dedup import brute_removed


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    want = sorted(repr([r[columns.index(c)] for c in df.columns]) for r in found.fetchall())
    assert sorted(df.columns) == sorted(columns) and sorted(repr(list(r)) for r in df.collect()) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_module.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLE) <= set(entry_module.oracle_sql())


def test_whole_tables_come_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for name in ("op2_suffix_array_dedup", "op4_simhash_near_dedup", "op8_bpe_rank_array"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids


def brute_groups(texts):
    """Smallest id that each document reaches over pairs whose sets of five words are alike by 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    least = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    return least


def documents(spark):
    long = " ".join(f"the house number {i} of the other street and" for i in range(40))
    passage = " ".join(f"and that was the thing with the {i} people" for i in range(20))
    rows = [
        (1, long, "en"), (2, long, "en"), (3, None, "en"), (4, "12345 !!", "en"), (5, "the first of them. " + passage, "en"),
        (6, " ".join(f"for this is word {i * i} of another one" for i in range(60)) + passage, "en"), (7, "the and of to in is it", "en"),
        (8, long.replace("number 7 ", "numbers 7 "), "en"), (9, "", None),
    ]
    return spark.createDataFrame([(i, t, y, "src", None if t is None else len(t)) for i, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_by_one(spark, monkeypatch):
    trained = language.train(spark.read.parquet(f"{SF}/documents.parquet"), steps=200)
    monkeypatch.setattr(language, "train", lambda docs: trained)
    docs = documents(spark)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and {1, 2, 5, 6, 7, 8} == {r.doc_id for r in kept.collect()}

    unique = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    groups = brute_groups({r.doc_id: r.text for r in kept.collect()})
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == set(groups.values())
    assert groups[2] == groups[8] == 1

    cut = corpus_pipeline.remove_repeats(spark, unique, SF)
    rows = unique.collect()
    masks = brute_removed([r.text.encode() for r in rows], corpus_pipeline.PASSAGE_BYTES)
    want = {r.doc_id: bytes(c for c, m in zip(r.text.encode(), mask) if not m).decode() for r, mask in zip(rows, masks)}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in got.values()) and "people" not in got[5].text

    packed = corpus_pipeline.pack_sequences(spark, cut, SF).collect()
    assert {r.doc_id for r in packed} == set(got) and max(r.offset + r.length for r in packed) <= 2048


def test_columns_of_clashing_names_pass_through(spark, monkeypatch):
    trained = language.train(spark.read.parquet(f"{SF}/documents.parquet"), steps=100)
    monkeypatch.setattr(language, "train", lambda docs: trained)
    names = ["score", "lang_pred", "doc", "th", "lo", "fp", "component_id", "item", "core", "body"]
    docs = documents(spark).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == names and {tuple(r) for r in docs.select(*names).collect()} == {tuple(f"own {n}" for n in names)}
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0


def test_an_unlabelled_table_keeps_every_text_with_a_letter(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 7, 8}


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = lambda n: " ".join(f"word{n}x{i}" for i in range(120))
    a, b, c, d = map(text, range(4))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (2, a + " end"), (None, d), (7, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, a), (None, b), (2, c), (7, d)]))
    left = corpus_pipeline.remove_repeats(spark, kept, SF)
    assert sorted(r.text for r in left.collect()) == sorted([a, b, c, d])


def test_stages_take_empty_tables(spark):
    none = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_end_to_end(spark):
    out = corpus_pipeline.run(spark, SF)
    fills = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and fills.where("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert simhash.BITS == 64


def test_a_task_gives_its_memory_back(spark):
    one = spark.range(1).coalesce(1)

    def used():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) / 1024

    def fill(batches):
        for _ in batches:
            held = [np.ones(12_500) for _ in range(2_000)]
            sys.pinned_by_test = held.pop()  # freed memory below it stays with the allocator
            yield [[os.getpid()], [used()]]

    def look(batches):
        for _ in batches:
            yield [[os.getpid()], [used()]]

    schema = "pid long, mb double"
    [(pid, full)] = map_batches(one, fill, schema).collect()
    later = map_batches(one, look, schema)
    found = (later.collect()[0] for _ in range(16))  # idle workers take turns
    assert next(r.mb for r in found if r.pid == pid) < full - 150
