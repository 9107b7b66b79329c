"""Readers and writers for dialogue and task files.

JSON comes in two layouts: ``array`` (one array per file) and ``lines`` (one object
per line).  Both are split by byte ranges, lines by the scan itself, arrays by
:mod:`talkprint.sources.json_members`, which scans twice.  Records are read as
VARIANT, which keeps unknown keys and lets every record be checked once.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkprint.functions import text as T
from talkprint.sources.json_members import read_array, read_object

TURN = "struct<role:string,content:string>"


def _require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail where ``condition`` does not hold.  A filter, so that it stays whatever columns are read."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message))))


def _file_columns() -> list[Column]:
    names = {"file": "file_name", "path": "file_path", "block": "file_block_start"}
    return [F.col(f"_metadata.{field}").alias(name) for name, field in names.items()]


def _numbered(raw: DataFrame) -> DataFrame:
    """Adds ``i``, the 0-based place of a record in its file, however the file is split.

    ``raw`` has ``path`` and ``block``, the offset of the split a record was read
    from.  Places are counted inside a split, and a table of one row per split
    carries the counts on.
    """
    marked = raw.withColumn("_m", F.monotonically_increasing_id())
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("_n"))
    starts = counts.select("path", "block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("_m")) - 1
    placed = marked.withColumn("_in", inside).join(starts, ["path", "block"])
    return placed.withColumn("i", F.col("_start") + F.col("_in")).drop("_m", "_in", "_start", "path", "block")


def _records(spark: SparkSession, path, layout: str, what: str) -> DataFrame:
    """``(file, i, v)``: one variant per record, ``i`` its place in the file."""
    if layout == "array":
        return read_array(spark, path, what)
    raw = spark.read.option("singleVariantColumn", "v").option("mode", "FAILFAST").json(path).select(*_file_columns(), "v")
    return _numbered(raw).select("file", "i", "v")


def read_dialogs(spark: SparkSession, path, layout: str = "array", empty_falls_back: bool = False) -> DataFrame:
    """``(dialog_id, conversation, metadata)``.

    A record without the key ``conversation`` (or ``turns``) fails the read.  The
    id is ``metadata.dialog_id`` when given, else ``<file>#<place>``.  With
    ``empty_falls_back`` an empty ``conversation`` gives way to ``turns``, the
    rule of the per-dialogue table; the population means do not do that.
    """
    rec = _records(spark, path, layout, "dialogs")

    def trace(key):
        return F.try_variant_get("v", F.lit(f"$.{key}"), f"array<{TURN}>")

    def has(key):
        return F.try_variant_get("v", F.lit(f"$.{key}"), "variant").isNotNull()

    found = F.when(has("conversation"), trace("conversation")).otherwise(trace("turns"))
    if empty_falls_back:
        found = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.coalesce(trace("turns"), found))
    meta = F.try_variant_get("v", F.lit("$.metadata"), "map<string,string>")
    given = F.try_variant_get("v", F.lit("$.metadata.dialog_id"), "string")
    return _require(rec, has("conversation") | has("turns"), "a dialog must have a 'conversation' key").select(
        F.coalesce(given, F.concat_ws("#", "file", F.col("i").cast("string"))).alias("dialog_id"),
        found.alias("conversation"),
        meta.alias("metadata"),
    )


def to_turns(dialogs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Nested dialogues to the long table; ``turn`` is the place in the list."""
    return dialogs.select("dialog_id", *keep, F.posexplode("conversation").alias("turn", "m")).select(
        "dialog_id", *keep, F.col("turn").cast("long").alias("turn"), "m.role", "m.content"
    )


def to_dialogs(turns: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Long table to nested dialogues.  The nested form holds a dialogue in one
    record by nature; keep turns long (:func:`write_turns`) where that is too much."""
    out = turns.groupBy("dialog_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("c")
    )
    meta = F.create_map(F.lit("dialog_id"), F.col("dialog_id").cast("string")) if metadata is None else metadata
    return out.select(
        F.transform("c", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("conversation"),
        meta.alias("metadata"),
    )


def write_dialogs(turns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested records, one JSON object per line."""
    to_dialogs(turns).write.mode(mode).json(path)


def write_turns(turns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A04, columnar: the long table."""
    turns.write.mode(mode).parquet(path)


def read_tasks(spark: SparkSession, path, layout: str = "array") -> DataFrame:
    """``(task_id, description, context, metadata)``.

    A missing ``task_id`` becomes the place in the file, a missing
    ``description`` fails, keys beyond the known three go to ``metadata``.
    """
    rec = _records(spark, path, layout, "tasks")
    all_keys = F.col("v").cast("map<string,variant>")
    known = ["task_id", "description", "context"]
    extra = F.map_filter(F.transform_values(all_keys, lambda k, x: x.cast("string")), lambda k, x: ~k.isin(known))

    def field(name):
        return F.try_variant_get("v", F.lit(f"$.{name}"), "string")

    return _require(rec, field("description").isNotNull(), "a task is missing 'description'").select(
        F.coalesce(field("task_id"), F.col("i").cast("string")).alias("task_id"),
        field("description").alias("description"),
        F.coalesce(field("context"), F.lit("")).alias("context"),
        extra.alias("metadata"),
    )


def write_tasks(tasks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, metadata keys at the top level."""
    head = F.create_map(
        F.lit("task_id"), "task_id", F.lit("description"), "description", F.lit("context"), "context"
    )
    extra = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    tasks.select(F.to_json(F.map_concat(head, extra)).alias("value")).write.mode(mode).text(path)


def read_text_dialogs(spark: SparkSession, path, separator: str = "---") -> DataFrame:
    """``(dialog_id, conversation, metadata)`` from plain text.

    The separator is a substring and doubles as the record delimiter of the
    scan, so large files split.  Inside a block lines opening with ``USER:`` or
    ``ASSISTANT:`` start a turn, other non-blank lines continue it, lines before
    the first turn and empty turns drop, as do dialogues without a turn.
    """
    blocks = _numbered(
        spark.read.option("lineSep", separator).text(path).select(*_file_columns(), "value")
    )
    lines = F.filter(
        F.transform(F.split("value", T.NEWLINE), T.trim_ws), lambda x: x != ""
    )
    head = r"(?i)\A(?:USER|ASSISTANT):"
    # A header line opens a turn: mark it with a form feed, which no trimmed
    # line can hold because it separates lines, and cut there.
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(head), F.concat(F.lit("\f"), x)).otherwise(x)), "\n")
    pieces = F.filter(F.split(marked, "\f"), lambda p: p.rlike(head))

    def turn(p):
        role = F.when(p.rlike(r"(?i)\AUSER:"), "user").otherwise("assistant")
        body = F.regexp_replace(F.regexp_replace(p, head, ""), "\n", " ")
        return F.struct(role.alias("role"), T.trim_ws(body).alias("content"))

    turns = F.filter(F.transform(pieces, turn), lambda t: t["content"] != "")
    return blocks.select(
        F.concat_ws("#", "file", F.col("i").cast("string")).alias("dialog_id"),
        turns.alias("conversation"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    ).where(F.size("conversation") > 0)


def read_keyed_dialogs(spark: SparkSession, path, domain: str, layout: str = "object") -> DataFrame:
    """``(instance_id, conversation)`` of objects keyed by instance id, for the
    keys opening with ``<domain>_``; entries without turns drop.

    ``object`` is one object per file (of equal keys the last counts), ``lines`` one (smaller) object per line.
    """
    if layout == "object":
        items = read_object(spark, path, "dialogs")
    else:
        raw = spark.read.option("singleVariantColumn", "whole").json(path)
        items = raw.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer())).withColumnRenamed("value", "v")
    rows = items.select(F.col("key").alias("instance_id"), "v")
    trace = F.try_variant_get("v", F.lit("$.conversation"), f"array<{TURN}>")
    return rows.where(F.startswith("instance_id", F.lit(domain + "_"))).select(
        "instance_id", trace.alias("conversation")
    ).where(F.size("conversation") > 0)


def read_record_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """A10: several JSONL files as one table with an explicit schema; nested columns that
    vary between files are declared ``string`` and stay raw.  Blank lines drop."""
    return spark.read.schema(schema).json(paths)


# --- fixed values: the columns of the developer-chat table -------------------
CHAT_COLUMNS = [
    "session_id", "repo_id", "conversation_turn_number", "role", "is_conversational", "language",
    "prompt_intent", "content", "word_count",
]


def read_chat_columns(spark: SparkSession, path, columns: list[str] = CHAT_COLUMNS) -> DataFrame:
    """Only the named columns of a wide parquet table reach the scan."""
    return spark.read.parquet(path).select(*columns)
