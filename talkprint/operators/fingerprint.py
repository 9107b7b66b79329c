"""The 19-feature behavioural fingerprint of every dialogue.

Input is the long table ``turns(dialog_id, turn, role, content)`` with one row
per message and ``turn`` unique and ascending in a dialogue.

Plan, and why it holds when one dialogue owns a large share of all rows:

* all rates, counts and moments are plain aggregates of ``dialog_id``, which
  Spark combines on the map side;
* the two opening turns come from ``row_number() <= 2``, which Spark prunes to
  two rows per dialogue and task before the shuffle;
* trigrams are counted inside blocks of 64 turns where their text lands, and only
  dialogues of several blocks send counts on (see :func:`repeating_turns`).

No step gathers a long dialogue in one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprint.functions import text as T
from talkprint.functions.banks import ACKNOWLEDGMENTS, BANKS, FEATURES
from talkprint.sources.shared import settle

TRIGRAM_LIMIT = 3
BLOCK = 64  # turns per block: their set fits the bits of a long


def mark_turns(turns: DataFrame, role: str = "user") -> DataFrame:
    """``spoken``: role matches and content is neither null nor empty (blank stays)."""
    spoken = F.coalesce((F.col("role") == role) & (F.col("content") != ""), F.lit(False))
    return turns.select("dialog_id", "turn", spoken.alias("spoken"), "content")


def spoken_turns(turns: DataFrame, role: str = "user") -> DataFrame:
    """The turns a fingerprint looks at."""
    return turns.where((F.col("role") == role) & (F.col("content") != ""))


def turn_tokens(turns: DataFrame, role: str = "user") -> DataFrame:
    """one row per spoken turn with its word runs."""
    return spoken_turns(turns, role).select(
        "dialog_id", "turn", T.tokens(F.lower("content")).alias("tokens")
    )


def opening_tokens(turns: DataFrame, role: str = "user", n: int = 2) -> DataFrame:
    """Token total of the first ``n`` spoken turns of each dialogue."""
    rank = F.row_number().over(Window.partitionBy("dialog_id").orderBy("turn"))
    first = spoken_turns(turns, role).select("dialog_id", "turn", "content").withColumn("rn", rank).where(F.col("rn") <= n)
    # Cut into words after the pruning, so that only opening turns are.
    sized = first.select("dialog_id", F.size(T.tokens(F.lower("content"))).alias("n_tokens"))
    return sized.groupBy("dialog_id").agg(F.sum("n_tokens").alias("first_tokens"))


def _block_grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, gram, n, mask)``: trigram counts per key and the turns of the block
    holding each, as a 64-bit mask.

    The texts move by ``keys``; trigrams are cut after that and counted in the
    same stage, so they never travel.
    """
    toks = rows.repartition(*keys).select(*keys, "bit", T.tokens(F.lower("content")).alias("tokens"))
    cut = toks.select(*keys, "bit", T.explode_trigrams("tokens").alias("g")).where(F.col("g").isNotNull())
    grams = cut.select(*keys, "bit", T.trigram_text("g").alias("gram"))
    return grams.groupBy(*keys, "gram").agg(
        F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")
    )


def repeating_turns(turns: DataFrame, role: str = "user", limit: int = TRIGRAM_LIMIT) -> DataFrame:
    """Per dialogue, the number of turns holding a trigram seen more than ``limit`` times.

    Turns fall into blocks of 64.  Text moves once, to its block, where trigrams
    are cut and counted in the same stage; however long a dialogue is, no task
    holds more than a block of it.  What leaves the stage is written: the
    repeating trigrams of a block, and all counts of dialogues with several
    blocks, which meet by ``(dialog_id, gram)`` with map-side combining.
    """
    said = spoken_turns(turns, role).select(
        "dialog_id", "content", F.floor(F.col("turn") / BLOCK).alias("blk"),
        F.pmod("turn", F.lit(BLOCK)).cast("int").alias("bit"),
    )
    several = said.where(F.col("blk") != 0).select("dialog_id").distinct().withColumn("several", F.lit(True))
    counted = _block_grams(said, ["dialog_id", "blk"]).join(several, "dialog_id", "left")
    kept = settle(counted.where(F.col("several") | (F.col("n") > limit)), "trigrams")

    in_one = kept.where(F.col("several").isNull()).groupBy("dialog_id").agg(
        F.bit_count(F.bit_or("mask")).cast("long").alias("n_repeating")
    )
    long = kept.where(F.col("several"))
    frequent = long.groupBy("dialog_id", "gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    in_many = (
        long.join(frequent, ["dialog_id", "gram"], "left_semi")
        .groupBy("dialog_id", "blk")
        .agg(F.bit_count(F.bit_or("mask")).alias("n"))
        .groupBy("dialog_id")
        .agg(F.sum("n").cast("long").alias("n_repeating"))
    )
    return in_one.unionByName(in_many)


def fingerprint(
    turns: DataFrame,
    role: str = "user",
    banks: dict[str, list[str]] | None = None,
    features: list[str] | None = None,
) -> DataFrame:
    """one row per dialogue, ``n_messages`` and one double per feature.

    Dialogues without a spoken turn get zeros.  ``banks`` replaces the pattern
    banks (every key becomes a rate column); ``features`` limits the output,
    and branches nobody asked for are not planned at all.
    """
    banks = BANKS if banks is None else banks
    known = FEATURES + [name for name in banks if name not in FEATURES]
    features = known if features is None else features

    spoken, low = F.col("spoken"), F.col("low")
    marked = mark_turns(turns, role).withColumn("low", F.when(spoken, F.lower("content")))
    per_turn = marked.select(
        "dialog_id",
        F.when(spoken, F.col("turn")).alias("pos"),
        F.when(spoken, F.size(T.tokens(low))).alias("n_tokens"),
        F.when(spoken, T.matches_whole(low, ACKNOWLEDGMENTS)).alias("ack"),
        F.when(spoken, T.identifier_count(F.col("content"))).alias("n_ids"),
        *[F.when(spoken, T.matches_bank(low, pats)).alias(name) for name, pats in banks.items()],
    )

    def rate(flag):
        return F.avg(F.col(flag).cast("double"))

    n = F.col("n_tokens")
    measures = {
        "words_per_turn": F.avg(n),
        "short_utterance_rate": F.avg(F.when(n.isNotNull(), (n <= 3).cast("double"))),
        "acknowledgment_rate": rate("ack"),
        "verbosity_cv": F.when((F.count(n) > 1) & (F.avg(n) > 0), F.stddev_pop(n) / F.avg(n)),
        "identifiers_per_turn": F.avg("n_ids"),
        "opening_length": F.min_by(n, "pos").cast("double"),
        **{name: rate(name) for name in banks},
    }
    out = per_turn.groupBy("dialog_id").agg(
        F.count("*").alias("n_messages"),
        F.count("pos").alias("_spoken"),
        F.sum("n_tokens").alias("_tokens"),
        *[measures[name].alias(name) for name in features if name in measures],
    )
    if "repetition_rate" in features:
        out = out.join(repeating_turns(turns, role), "dialog_id", "left").withColumn(
            "repetition_rate", F.col("n_repeating") / F.col("_spoken")
        )
    if "front_loading_ratio" in features:
        out = out.join(opening_tokens(turns, role), "dialog_id", "left").withColumn(
            "front_loading_ratio",
            F.when(F.col("_tokens") > 0, F.col("first_tokens") / F.col("_tokens")),
        )
    return out.select(
        "dialog_id", "n_messages", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features]
    )


def individual_fingerprints(fps: DataFrame) -> DataFrame:
    """Dialogues with at least two messages, the cloud that coverage uses."""
    return fps.where(F.col("n_messages") >= 2)
