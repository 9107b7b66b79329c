"""Registered queries A01-A15: tables written in the file layouts and read back.

Each query writes a fresh folder below the session's checkpoint folder.
"""

from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators.fingerprint import fingerprint, individual_fingerprints
from talkprint.operators.stats import population_stats
from talkprint.plans.bindings import CONV, PHRASE, RATE_DIGITS, SPACE, conv_turns, phrase_turns, sql_fp, sql_r6, table, with_r6
from talkprint.plans.registry import query
from talkprint.sources import dialogs as D
from talkprint.sources import tables as T
from talkprint.sources.shared import scratch


@query("a01_read_dialogs", f"WITH {CONV} SELECT dialog_id::VARCHAR AS dialog_id, turn, role, content FROM turns")
def a01(spark, d):
    path = scratch(spark, "dialogs")
    D.write_dialogs(conv_turns(spark, d), path)
    return D.to_turns(D.read_dialogs(spark, path, "lines"))


@query(
    "a02_read_tasks",
    "SELECT doc_id::VARCHAR AS task_id, text AS description, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS context, source, n_chars::VARCHAR AS n_chars FROM documents",
)
def a02(spark, d):
    path = scratch(spark, "tasks")
    D.write_tasks(_doc_tasks(spark, d), path)
    back = D.read_tasks(spark, path, "lines")
    return back.select("task_id", "description", "context", F.col("metadata.source").alias("source"), F.col("metadata.n_chars").alias("n_chars"))


def _doc_tasks(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("context"),
        F.create_map(F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"),
    )


@query(
    "a03_read_text_dialogs",
    f"""WITH {CONV}, t AS (SELECT dialog_id, turn, role, array_to_string(list_filter(list_transform(string_split(content, chr(10)),
      lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> ''), ' ') AS content FROM (SELECT * REPLACE (CASE WHEN role = 'user' THEN role ELSE 'assistant' END AS role) FROM turns))
    SELECT role, content, row_number() OVER (PARTITION BY dialog_id ORDER BY turn) - 1 AS turn FROM t WHERE content <> ''""",
)
def a03(spark, d):
    path = scratch(spark, "text")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("ASSISTANT:"), "content")
    blocks = (
        conv_turns(spark, d).groupBy("dialog_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
        .select(F.concat(F.lit("dropped head\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("value"))
    )
    blocks.write.option("lineSep", "====\n").text(path)
    return D.to_turns(D.read_text_dialogs(spark, path, "====")).select("role", "content", "turn")


FILE_BYTES = 16 << 20


def write_files_of_one_value(values, key: str, join, path: str) -> None:
    """Layouts that are one JSON value per file: records of a hash bucket share a file of some ``FILE_BYTES``."""
    size = F.octet_length(F.to_json(F.struct("*")))
    n = 2 + (values.agg(F.sum(size)).first()[0] or 0) // FILE_BYTES
    buckets = values.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(join.alias("value")).select("value")
    buckets.write.option("maxRecordsPerFile", 1).text(path)


def json_array(record):
    return F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]"))


@query("a01_read_dialogs_array", f"WITH {CONV} SELECT dialog_id::VARCHAR AS dialog_id, turn, role, content FROM turns")
def a01b(spark, d):
    path = scratch(spark, "dialog-arrays")
    nested = D.to_dialogs(conv_turns(spark, d)).select(F.to_json(F.struct("conversation", "metadata")).alias("record"))
    write_files_of_one_value(nested, "record", json_array("record"), path)
    return D.to_turns(D.read_dialogs(spark, path))


@query(
    "a02_read_tasks_array",
    "SELECT doc_id::VARCHAR AS task_id, text AS description, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS context, source FROM documents",
)
def a02b(spark, d):
    path = scratch(spark, "task-arrays")
    tasks = _doc_tasks(spark, d).select(
        F.to_json(F.struct("task_id", "description", "context", F.col("metadata.source").alias("source"))).alias("record")
    )
    write_files_of_one_value(tasks, "record", json_array("record"), path)
    return D.read_tasks(spark, path).select("task_id", "description", "context", F.col("metadata.source").alias("source"))


@query("a12_keyed_dialogs_object", f"WITH {CONV} SELECT 'retail_' || dialog_id || '_ann1' AS instance_id, turn, role, content FROM turns")
def a12b(spark, d):
    path = scratch(spark, "keyed-objects")
    key = F.concat(F.lit("retail_"), F.col("metadata.dialog_id"), F.lit("_ann1"))
    entries = D.to_dialogs(conv_turns(spark, d)).select(key.alias("k"), F.struct("conversation").alias("v"))
    write_files_of_one_value(entries, "k", F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))), path)
    back = D.read_keyed_dialogs(spark, path, "retail").withColumnRenamed("instance_id", "dialog_id")
    return D.to_turns(back).withColumnRenamed("dialog_id", "instance_id")


@query("a04_write_dialogs", f"WITH {CONV} SELECT dialog_id::VARCHAR AS dialog_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM turns GROUP BY 1")
def a04(spark, d):
    path = scratch(spark, "dialogs")
    D.write_dialogs(conv_turns(spark, d), path)
    raw = spark.read.schema("conversation array<struct<role:string,content:string>>, metadata map<string,string>").json(path)
    chars = F.aggregate("conversation", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return raw.select(F.col("metadata.dialog_id").alias("dialog_id"), F.size("conversation").cast("long").alias("n"), chars.alias("chars"))


@query("a04_write_turns", f"WITH {CONV} SELECT * FROM turns")
def a04b(spark, d):
    path = scratch(spark, "turns")
    D.write_turns(conv_turns(spark, d), path)
    return spark.read.parquet(path)


@query("a05_write_tasks", "SELECT doc_id::VARCHAR AS task_id, text AS description, source, n_chars::VARCHAR AS n_chars FROM documents")
def a05(spark, d):
    path = scratch(spark, "tasks")
    D.write_tasks(_doc_tasks(spark, d), path)
    return spark.read.schema("task_id string, description string, source string, n_chars string").json(path)


@query(
    "a06_reference_stats",
    f"WITH {sql_fp(CONV)} " + " UNION ALL ".join(
        f"SELECT 'conversations' AS source, 'chat' AS domain, '{f}' AS feature, round(avg({f}), {RATE_DIGITS}) + 0.0 AS mean, NULL::DOUBLE AS std, count(*) AS n FROM fp" for f in FEATURES
    ),
)
def a06(spark, d):
    path = scratch(spark, "stats")
    old_layout = population_stats(fingerprint(conv_turns(spark, d)), "conversations", "chat").drop("std")
    T.save_stats(old_layout, path)
    return with_r6(T.load_stats(spark, path), ["mean"], RATE_DIGITS).select("source", "domain", "feature", "mean", "std", "n")


@query("a07_individual_fingerprints", f"WITH {sql_fp(PHRASE)} SELECT dialog_id, n_messages, {sql_r6(FEATURES, RATE_DIGITS)} FROM fp WHERE n_messages >= 2")
def a07(spark, d):
    path = scratch(spark, "fingerprints")
    T.write_table(individual_fingerprints(fingerprint(phrase_turns(spark, d))), path)
    return with_r6(spark.read.parquet(path), FEATURES, RATE_DIGITS)


@query(
    "a08_baseline_episodes",
    f"WITH {sql_fp(CONV, features=['words_per_turn'])} SELECT dialog_id, round(words_per_turn, 6) + 0.0 AS words_per_turn FROM fp WHERE dialog_id % 2 = 0 AND dialog_id % 3 <> 0",
)
def a08(spark, d):
    path = scratch(spark, "episodes")
    fps = fingerprint(conv_turns(spark, d), features=["words_per_turn"]).select(
        "dialog_id", F.when(F.col("dialog_id") % 2 == 0, "default").otherwise("other").alias("condition"),
        F.when(F.col("dialog_id") % 3 != 0, F.col("words_per_turn")).alias("words_per_turn"),
    )
    T.save_episodes(fps, path)
    return with_r6(T.load_episodes(spark, path, "default").select("dialog_id", "words_per_turn"), ["words_per_turn"])


@query(
    "a09_curve",
    "SELECT event_id::INT AS iteration, user_id::INT AS epoch, value AS final_combined_score FROM events UNION ALL SELECT event_id::INT, user_id::INT, value FROM events WHERE event_type = 'view'",
)
def a09(spark, d):
    path = scratch(spark, "curve")
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("int").alias("iteration"), F.col("user_id").cast("int").alias("epoch"), F.col("value").alias("final_combined_score"), "event_type"
    )
    T.append_curve(rows.drop("event_type"), path)
    T.append_curve(rows.where("event_type = 'view'").drop("event_type"), path)
    rows.select(F.concat(F.lit("{broken "), F.col("iteration").cast("string"))).write.mode("append").text(path)
    return T.load_curve(spark, path).select("iteration", "epoch", "final_combined_score")


@query("a09_curve_feed", "SELECT event_id::INT AS iteration, value AS final_combined_score FROM events")
def a09b(spark, d):
    from talkprint.streaming.curve_feed import follow_curve

    base = scratch(spark, "feed")
    rows = table(spark, d, "events").select(F.col("event_id").cast("int").alias("iteration"), F.col("value").alias("final_combined_score"))
    T.append_curve(rows.where("iteration % 2 = 0"), f"{base}/in")
    follow_curve(spark, f"{base}/in", f"{base}/table", f"{base}/state").awaitTermination()
    T.append_curve(rows.where("iteration % 2 = 1"), f"{base}/in")
    follow_curve(spark, f"{base}/in", f"{base}/table", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("iteration", "final_combined_score")


@query("a10_record_files", "SELECT event_id, user_id, event_type, props FROM events")
def a10(spark, d):
    base = scratch(spark, "records")
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    rows.write.partitionBy("event_type").json(base)
    schema = "event_id long, user_id long, event_type string, props string"
    paths = [f"{base}/event_type={k}" for k in kinds]
    back = D.read_record_files(spark, paths, schema)
    kind = F.regexp_extract(F.col("_metadata.file_path"), "event_type=([a-z]+)", 1)
    return back.select("event_id", "user_id", kind.alias("event_type"), "props")


@query("a11_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def a11(spark, d):
    return D.read_chat_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("a12_keyed_dialogs", f"WITH {CONV} SELECT 'retail_' || dialog_id || '_ann1' AS instance_id, turn, role, content FROM turns WHERE dialog_id % 3 <> 0")
def a12(spark, d):
    path = scratch(spark, "keyed")
    key = F.concat(F.when(F.col("metadata.dialog_id").cast("int") % 3 == 0, "retailx_").otherwise("retail_"), F.col("metadata.dialog_id"), F.lit("_ann1"))
    nested = D.to_dialogs(conv_turns(spark, d)).select(F.create_map(key, F.struct("conversation")).alias("m"))
    nested.select(F.to_json("m").alias("value")).write.text(path)
    back = D.read_keyed_dialogs(spark, path, "retail", "lines").withColumnRenamed("instance_id", "dialog_id")
    return D.to_turns(back).withColumnRenamed("dialog_id", "instance_id")


@query(
    "a13_human_fallback",
    f"""WITH {sql_fp(CONV)} SELECT 'individual' AS source, dialog_id::VARCHAR AS dialog_id, {sql_r6(FEATURES, RATE_DIGITS)} FROM fp WHERE n_messages >= 2
    UNION ALL SELECT 'episodes', dialog_id::VARCHAR, {sql_r6(FEATURES, RATE_DIGITS)} FROM fp
    UNION ALL SELECT 'mean', 'mean', {', '.join(f'round(avg({f}), {RATE_DIGITS}) + 0.0' for f in FEATURES)} FROM fp""",
)
def a13(spark, d):
    turns = conv_turns(spark, d)
    stats, individual = T.build_reference(turns)
    picks = {
        "individual": T.human_fingerprints(individual, turns, stats),
        "episodes": T.human_fingerprints(None, turns, stats),
        "mean": T.human_fingerprints(None, None, stats),
    }
    out = None
    for name, df in picks.items():
        tagged = with_r6(df, FEATURES, RATE_DIGITS).withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("a15_iteration_log", "SELECT user_id AS iteration, event_id AS task_id, 0 AS pos, round(avg(value) OVER (PARTITION BY user_id), 6) + 0.0 AS combined_score, 'train' AS phase FROM events")
def a15(spark, d):
    path = scratch(spark, "log")
    ev = table(spark, d, "events").withColumnRenamed("user_id", "iteration")
    metrics = ev.groupBy("iteration").agg(F.avg("value").alias("combined_score"), F.count("*").alias("not_logged"))
    personas = ev.select("iteration", F.col("event_id").alias("task_id"), F.lit(0).alias("pos"))
    T.append_iteration_log(metrics, personas, path)
    back = spark.read.parquet(path).withColumn("iteration", F.col("iteration").cast("long"))
    return with_r6(back.select("iteration", "task_id", "pos", "combined_score", "phase"), ["combined_score"])
