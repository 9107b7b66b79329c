"""Cleaning, truncation and per-turn text rules over ``turns``.

Rules of the form "from / up to the first turn that ..." are an aggregate
(first such turn per dialogue, map-side combined) joined back to the turns, not
a running window: a window would sort a whole dialogue in one task.  AQE
broadcasts the small side or splits a skewed one.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprint.functions import text as T
from talkprint.operators.ordering import running_max

# --- fixed values: literal markers of the recorded dialogues -----------------
DONE_MARKER = "[DONE]"
CLOSE_MARKER = "/close"
OUTPUT_MARKER = "OUTPUT:"
ANSWER_MARKER = "I WANT TO ANSWER:"
NO_ANSWER = "No answer"
SETUP_PREFIX = "\\tau "
SETUP_TAG = "<|canvas|>"
FENCE = "```"
CODE_INTENTS = ["create new code", "refactor", "debug", "test", "understand"]
# Tokens that void a code answer, and tokens that void its test outputs.
BLOCKED_ANSWER = [
    "import os", "from os", "import sys", "from sys", "sudo", "transformers", "exit(", "quit(", "argparse",
]
BLOCKED_RUN = ["import os", "from os", "import sys", "from sys", "open(", "print(", "write"]
AGENT_GAVE_UP = ["i'm unable to", "i cannot help", "i can't assist"]
AGENT_CLARIFIES = ["could you please clarify", "can you clarify"]
AGENT_ASSUMES = ["i'll go ahead and", "i'll proceed with", "assuming you want"]
USER_GAVE_UP = [r"\b(?:never mind|forget it|i give up)\b"]
LONG_EPISODE = 28


def is_prose(content: Column, max_line_chars: int = 400, max_newlines: int = 15) -> Column:
    """Natural language, not a pasted artefact: not blank, no fence, no markup
    tag, fewer than ``max_newlines`` line breaks, no line over ``max_line_chars``."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (
        ~T.is_blank(content)
        & ~F.contains(content, F.lit(FENCE))
        & ~content.rlike("<[A-Za-z/]")
        & (breaks < max_newlines)
        & ~content.rlike(rf"(?dm)^[^\n]{{{max_line_chars + 1}}}")
    )


def register_match(rows: DataFrame, intents: list[str] = CODE_INTENTS) -> DataFrame:
    """Human, conversational, English coding turns; all four tests push to the scan."""
    return rows.where(
        (F.col("role") == "user")
        & F.col("is_conversational")
        & (F.col("language") == "ENGLISH")
        & F.col("prompt_intent").isin(intents)
    )


def normalise_messages(turns: DataFrame) -> DataFrame:
    """User and assistant messages with non-blank content."""
    return turns.where(F.col("role").isin("user", "assistant") & ~T.is_blank(F.col("content")))


def strip_leading_setup(turns: DataFrame) -> DataFrame:
    """Drop the leading run of setup turns; keep dialogues with two or more left."""
    text = T.trim_ws(F.coalesce("content", F.lit("")))
    setup = F.startswith(text, F.lit(SETUP_PREFIX)) | F.contains(F.coalesce("content", F.lit("")), F.lit(SETUP_TAG))
    spans = turns.groupBy("dialog_id").agg(
        F.min(F.when(~setup, F.col("turn"))).alias("_from"), F.max("turn").alias("_last")
    )
    kept = spans.where(F.col("_last") > F.col("_from")).drop("_last")
    return turns.join(kept, "dialog_id").where(F.col("turn") >= F.col("_from")).drop("_from")


def first_turn_with(turns: DataFrame, marker: str, role: str = "user") -> DataFrame:
    hit = (F.col("role") == role) & F.contains("content", F.lit(marker))
    return turns.where(hit).groupBy("dialog_id").agg(F.min("turn").alias("_stop"))


def truncate_keeping_stop(turns: DataFrame, marker: str = DONE_MARKER) -> DataFrame:
    """End at the first user turn holding the marker, which stays without it."""
    stop = first_turn_with(turns, marker)
    kept = turns.join(stop, "dialog_id", "left").where(
        F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop"))
    )
    bare = T.trim_ws(F.replace("content", F.lit(marker), F.lit("")))
    return kept.withColumn(
        "content", F.when(F.col("role") == "user", bare).otherwise(F.col("content"))
    ).drop("_stop")


def truncate_before_stop(turns: DataFrame, marker: str = CLOSE_MARKER) -> DataFrame:
    """End before the first user turn holding the marker."""
    stop = first_turn_with(turns, marker)
    return (
        turns.join(stop, "dialog_id", "left")
        .where(F.col("_stop").isNull() | (F.col("turn") < F.col("_stop")))
        .drop("_stop")
    )


def cap_turns(turns: DataFrame, n: int, by_role: bool = True) -> DataFrame:
    """The first ``n`` messages of each role (or of the dialogue).

    The rank filter is pruned to ``n`` rows per key and task before the shuffle.
    """
    keys = ["dialog_id", "role"] if by_role else ["dialog_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("turn"))
    return turns.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def truncate_reply(turns: DataFrame, limit: int = 500, role: str = "user") -> DataFrame:
    """First ``limit`` characters of the role's replies."""
    cut = F.substring("content", 1, limit)
    return turns.withColumn("content", F.when(F.col("role") == role, cut).otherwise(F.col("content")))


def _after(text: Column, marker: str) -> Column:
    """Text between the first ``marker`` and the next one."""
    return F.get(F.split(text, re.escape(marker)), F.lit(1))


def answer_text(content: Column, reached_cap: Column) -> Column:
    """The answer in one agent reply."""
    has_output = F.contains(content, F.lit(OUTPUT_MARKER))
    reply = F.when(has_output, _after(content, OUTPUT_MARKER)).otherwise(content)
    return (
        F.when(F.contains(reply, F.lit(ANSWER_MARKER)), _after(reply, ANSWER_MARKER))
        .when(reached_cap, reply)
        .otherwise(F.lit(NO_ANSWER))
    )


def final_answers(turns: DataFrame, max_steps: int = 10) -> DataFrame:
    """B10 per dialogue: the first agent reply that answers, or the one at the cap."""
    agent = turns.where(F.col("role") == "assistant")
    step = F.row_number().over(Window.partitionBy("dialog_id").orderBy("turn"))
    steps = agent.withColumn("step", step).where(F.col("step") <= max_steps)
    at_cap = F.col("step") == max_steps
    reply = F.when(F.contains("content", F.lit(OUTPUT_MARKER)), _after(F.col("content"), OUTPUT_MARKER)).otherwise(
        F.col("content")
    )
    answers = F.contains(reply, F.lit(ANSWER_MARKER)) | at_cap
    found = steps.groupBy("dialog_id").agg(
        F.min_by(answer_text(F.col("content"), at_cap), F.when(answers, F.col("step"))).alias("answer")
    )
    dialogs = turns.select("dialog_id").distinct()
    return dialogs.join(found, "dialog_id", "left").select(
        "dialog_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer")
    )


def strip_code_fence(code: Column) -> Column:
    """Body of the first python fence, else of the first plain closed fence."""
    parts = F.split(code, FENCE)
    tagged = F.get(F.split(_after(code, FENCE + "python"), FENCE), F.lit(0))
    return (
        F.when(F.contains(code, F.lit(FENCE + "python")), tagged)
        .when(F.size(parts) >= 3, F.get(parts, F.lit(1)))
        .otherwise(code)
    )


def has_any(text: Column, needles: list[str]) -> Column:
    """Any of the literal tokens occurs; one pass over the text."""
    return text.rlike("|".join(re.escape(n) for n in needles))


def excerpts(turns: DataFrame, max_turns: int = 20, max_chars: int = 2400) -> DataFrame:
    """``(dialog_id, excerpt)`` from the first ``max_turns`` messages."""
    text = F.col("content")
    short = F.concat(F.left(text, F.lit(100)), F.lit(" ... "), F.right(text, F.lit(100)))
    role = F.upper("role")
    shown = F.when((role == "ASSISTANT") & (F.length(text) > 250), short).otherwise(text)
    line = F.concat(role, F.lit(": "), shown)
    lines = cap_turns(turns, max_turns, by_role=False).groupBy("dialog_id").agg(
        F.array_sort(F.collect_list(F.when(~T.is_blank(text), F.struct("turn", line.alias("line"))))).alias("ls")
    )
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return lines.select("dialog_id", F.substring(joined, 1, max_chars).alias("excerpt"))


def flip_roles(turns: DataFrame, system: DataFrame, primer: str = "How can I help you?") -> DataFrame:
    """``(dialog_id, pos, role, content)`` as the simulated user sees it.

    ``system(dialog_id, content)`` goes in front; a primer follows when the
    first message would otherwise be the simulator's own.
    """
    flipped = turns.select(
        "dialog_id", F.col("turn").cast("long").alias("pos"),
        F.when(F.col("role") == "user", "assistant").otherwise("user").alias("role"), "content",
    )
    head = system.select("dialog_id", F.lit(-2).cast("long").alias("pos"), F.lit("system").alias("role"), "content")
    first = turns.groupBy("dialog_id").agg(F.min_by("role", "turn").alias("r"))
    primed = first.where(F.col("r") == "user").select(
        "dialog_id", F.lit(-1).cast("long").alias("pos"), F.lit("user").alias("role"), F.lit(primer).alias("content")
    )
    return flipped.unionByName(head).unionByName(primed)


def judge_verdict(verdict: Column, conditions: Column) -> Column:
    """1.0 when the verdict says ADDRESSED and not NOT, given conditions to judge by."""
    v = F.upper(verdict)
    ok = F.contains(v, F.lit("ADDRESSED")) & ~F.contains(v, F.lit("NOT")) & (F.coalesce(conditions, F.lit("")) != "")
    return F.when(ok, 1.0).otherwise(0.0)


def instance_task_id(key: Column, domain: str) -> Column:
    """``retail_12_ann2`` is task ``12``; a key of another domain gives ''."""
    rest = F.substring(key, len(domain) + 2, 1 << 30)
    return F.when(F.startswith(key, F.lit(domain + "_")), F.substring_index(rest, "_ann", 1)).otherwise("")


def first_filled(*cols) -> Column:
    """The first non-empty of the given columns, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def _occurrences(text: Column, phrase: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)


def failure_modes(turns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(dialog_id, failure_mode)``; null for a success.

    The rules read the whole text, agent turns and all turns each joined by a
    space.  Dialogues below 28 messages are assembled, at most 27 rows each.
    Longer ones are ``max_turns_exceeded`` unless the agent gave up, and that
    only needs each agent turn next to the edges of the two before it, since the
    phrases have three words.
    """
    outcomes = outcomes.select("dialog_id", "success")
    low = turns.select("dialog_id", "turn", "role", F.lower("content").alias("text"))
    sizes = turns.groupBy("dialog_id").agg(F.count("*").alias("n"))
    sized = low.join(sizes, "dialog_id")

    short = sized.where(F.col("n") < LONG_EPISODE).groupBy("dialog_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts")
    )
    agent = F.array_join(
        F.transform(F.filter("ts", lambda t: t["role"] == "assistant"), lambda t: t["text"]), " "
    )
    everyone = F.array_join(F.transform("ts", lambda t: t["text"]), " ")
    short = short.select("dialog_id", agent.alias("agent"), everyone.alias("everyone"))
    a = F.col("agent")
    short = short.select(
        "dialog_id",
        F.when(has_any(a, AGENT_GAVE_UP), "agent_gave_up")
        .when(
            F.greatest(*[_occurrences(a, p) for p in AGENT_CLARIFIES]) > 2, "clarification_loop"
        )
        .when(has_any(a, AGENT_ASSUMES), "agent_assumed")
        .when(T.matches_bank(F.col("everyone"), USER_GAVE_UP), "user_abandoned")
        .otherwise("other")
        .alias("mode"),
    )

    edge = 16
    long_agent = sized.where((F.col("n") >= LONG_EPISODE) & (F.col("role") == "assistant")).select(
        "dialog_id", "turn",
        has_any(F.col("text"), AGENT_GAVE_UP).alias("inside"),
        F.left("text", F.lit(edge)).alias("head"),
        F.struct("turn", F.right("text", F.lit(edge)).alias("tail"), (F.length("text") <= edge).alias("whole")).alias("e"),
    )
    keyed = running_max(long_agent, ["dialog_id"], "turn", F.col("e"), "p1", inclusive=False)
    keyed = running_max(keyed, ["dialog_id"], "turn", F.struct("turn", "p1"), "p2", inclusive=False)
    before = F.when(F.col("p1.whole"), F.col("p2.p1.tail"))
    joined = F.concat_ws(" ", before, F.col("p1.tail"), F.col("head"))
    gave_up = keyed.groupBy("dialog_id").agg(
        F.max(F.col("inside") | has_any(joined, AGENT_GAVE_UP)).alias("gave_up")
    )

    return (
        outcomes.join(sizes, "dialog_id")
        .join(short, "dialog_id", "left")
        .join(gave_up, "dialog_id", "left")
        .select(
            "dialog_id",
            F.when(F.col("success"), F.lit(None).cast("string"))
            .when(F.col("n") < LONG_EPISODE, F.col("mode"))
            .when(F.coalesce("gave_up", F.lit(False)), "agent_gave_up")
            .otherwise("max_turns_exceeded")
            .alias("failure_mode"),
        )
    )


def clean_dialogs(
    turns: DataFrame,
    group: str | None = None,
    min_user_turns: int = 2,
    min_per_group: int = 3,
    max_line_chars: int = 400,
    max_newlines: int = 15,
    max_dialogs: int | None = None,
) -> DataFrame:
    """Prose user turns of dialogues that have at least ``min_user_turns`` of
    them, in groups with at least ``min_per_group`` such dialogues.

    ``max_dialogs`` keeps the first that many by dialogue id.
    """
    prose = turns.where(
        (F.col("role") == "user") & is_prose(F.col("content"), max_line_chars, max_newlines)
    ).withColumn("content", T.trim_ws(F.col("content")))
    keys = ["dialog_id"] + ([group] if group else [])
    formed = prose.groupBy(*keys).count().where(F.col("count") >= min_user_turns).drop("count")
    if group:
        enough = formed.groupBy(group).count().where(F.col("count") >= min_per_group).select(group)
        formed = formed.join(enough, group, "left_semi")
    if max_dialogs:
        formed = formed.orderBy(*keys).limit(max_dialogs)
    return prose.join(formed, keys, "left_semi")
