"""From raw documents to packed training sequences.

Four stages over the ``documents`` table, each written as Parquet in the
session's shared folder and read back as the next one's input:

1. language identification drops documents without a recognisable language, if there are labels to learn from;
2. one document of each group of near duplicates stays: SimHash with the pigeonhole principle, then verified likeness;
3. suffix-array deduplication removes passages that occur elsewhere too;
4. best-fit packing places what is left in training sequences.

All but the last return the columns of ``documents``.
"""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprint.llm import language, packing, shingle_join, suffix_dedup
from talkprint.llm.common import table, tokenizer_path
from talkprint.sources.shared import recorded, remove_unread, settle

#: A document stays if its pooled probability reaches this much for some language.
MIN_LANGUAGE_SCORE = 0.4
#: Passages of over 50 words are to go; few of them are shorter in bytes.
PASSAGE_BYTES = 250

_left_behind: list[str] = []


def stage(fn):
    """A stage that first deletes what the one before it wrote for itself, but for what ``docs`` still reads."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still_read = remove_unread(_left_behind, docs)
        with recorded() as paths:
            out = fn(spark, docs, sf_dir)
        _left_behind[:] = still_read + paths
        return out

    return run_stage


@stage

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go.

    Without a labelled document to learn from, every text with a letter stays.
    """
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, keep=tuple(docs.columns), out=("__pred", "__score"))
    sure = (F.col("__pred") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more.

    Links are found by SimHash and, where fingerprints are too far apart at that
    likeness, by bands of minimum hashes; every link is verified.
    """
    return shingle_join.one_of_each(docs)


@stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE_BYTES`` that also start elsewhere; documents of which nothing is left go."""
    kept = suffix_dedup.without_repeats(docs, PASSAGE_BYTES).where(F.char_length("text") > 0)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

#: A trained network decides in the first stage: SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
