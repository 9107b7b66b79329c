"""Registered queries B15-B21, B24 and W11."""

from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import clean, prompts
from talkprint.operators.fingerprint import fingerprint
from talkprint.plans.bindings import CONV, SPACE, conv_turns, sql_fp, sql_trim, table
from talkprint.plans.cleaning import sql_excerpt
from talkprint.plans.registry import query
from talkprint.sources.shared import settle

TEMPLATE = "\n## Style\n{persona_policy_text}\n--- \n"


def _persona_pairs(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("base"), F.when(F.col("doc_id") % 3 == 0, "  \n").otherwise(F.concat(F.lit(" be "), "lang", F.lit("\n"))).alias("persona")
    )


PAIRS = "pairs AS (SELECT doc_id, text AS base, CASE WHEN doc_id % 3 = 0 THEN '  ' || chr(10) ELSE ' be ' || lang || chr(10) END AS persona FROM documents)"
FULL = f"{sql_trim('base')} || chr(10) || chr(10) || '## Style' || chr(10) || {sql_trim('persona')} || chr(10) || '---'"


@query("b15_render_persona", f"WITH {PAIRS} SELECT doc_id, CASE WHEN regexp_matches(persona, '[^{SPACE}]') THEN {FULL} ELSE base END AS prompt FROM pairs")
def b15(spark, d):
    rows = _persona_pairs(spark, d)
    return rows.select("doc_id", prompts.render_persona(F.col("base"), F.col("persona"), TEMPLATE).alias("prompt"))


@query("b15_render_always", f"WITH {PAIRS} SELECT doc_id, {FULL} AS prompt FROM pairs")
def b15b(spark, d):
    rows = _persona_pairs(spark, d)
    return rows.select("doc_id", prompts.render_persona(F.col("base"), F.col("persona"), TEMPLATE, skip_blank=False).alias("prompt"))


@query("b16_task_context", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE text || chr(10) || chr(10) || 'Context: ' || source END AS prompt FROM documents")
def b16(spark, d):
    i = F.col("doc_id") % 4
    context = F.when(i == 0, F.lit(None).cast("string")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", prompts.task_context(F.col("text"), context).alias("prompt"))


def sql_indent(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '[^{SPACE}]') THEN chr(9) || x ELSE x END), chr(10))"
    )


@query(
    "b17_scenario",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Base Persona:' || chr(10) || {sql_indent('text')} || chr(10) END || 'Given Instructions:' || chr(10) || "
    f"{sql_indent(chr(39) + 'a_source: ' + chr(39) + ' || source || chr(10) || ' + chr(39) + 'lang: ' + chr(39) + ' || lang || chr(10) || ' + chr(39) + 'n: ' + chr(39) + ' || n_chars')} AS scenario FROM documents",
)
def b17(spark, d):
    facts = F.create_map(F.lit("lang"), "lang", F.lit("n"), F.col("n_chars").cast("string"), F.lit("a_source"), "source")
    persona = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", prompts.scenario(persona, facts).alias("scenario"))


@query(
    "b17_scenario_text",
    f"SELECT doc_id, 'Given Instructions:' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN chr(9) || 'None' ELSE {sql_indent('text')} END AS scenario FROM documents",
)
def b17b(spark, d):
    body = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return table(spark, d, "documents").select("doc_id", prompts.scenario(F.lit(None).cast("string"), body, is_map=False).alias("scenario"))


# Axes per nation: every nation is one behaviour, its region the axis set.
AXES = """axes AS (SELECT n_regionkey AS grp, n_nationkey AS pos, CASE WHEN n_nationkey = 3 THEN ' ' ELSE n_name || ' ' END AS behavior,
  CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'about ' || n_name END AS definition, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE ' on ' || n_nationkey END AS on_text,
  'off' AS off_text FROM nation)"""


def axes(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.col("n_regionkey").alias("grp"), k.alias("pos"), F.when(k == 3, " ").otherwise(F.concat("n_name", F.lit(" "))).alias("behavior"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("about "), "n_name")).alias("definition"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" on "), k.cast("string"))).alias("on_text"), F.lit("off").alias("off_text"),
    )


@query(
    "b18_axes_description",
    f"""WITH {AXES} SELECT grp, string_agg(CASE WHEN trim(behavior) = '' THEN '?' ELSE trim(behavior) END || chr(10) ||
      CASE WHEN definition = '' THEN '' ELSE '  - definition: ' || trim(definition) || chr(10) END || '  - presence true (on): ' || trim(on_text) || chr(10) ||
      '  - presence false (off): ' || off_text, chr(10) ORDER BY pos) AS axes_description FROM axes GROUP BY grp""",
)
def b18(spark, d):
    return prompts.axes_description(axes(spark, d), ["grp"])


@query(
    "b18_active_traits",
    f"""WITH {AXES}, a AS (SELECT trim(behavior) AS b, trim(definition) AS df, trim(on_text) AS ot FROM axes WHERE trim(behavior) <> ''),
    p AS (SELECT c_custkey AS persona_key, i, (SELECT n_name FROM nation WHERE n_nationkey = (c_custkey * (i + 1) + i * 7) % 25) AS b, (c_custkey + i) % 3 <> 0 AS active
      FROM customer, range(0, 3) t(i)), u AS (SELECT persona_key, i, b, active FROM p),
    l AS (SELECT persona_key, i, CASE WHEN df <> '' THEN '- ' || b || ' (on)' || chr(10) || '  Definition: ' || df || chr(10) || '  Playbook: ' || ot
      WHEN ot <> '' THEN '- ' || b || ' (on): ' || ot END AS line FROM u JOIN a USING (b) WHERE active)
    SELECT c_custkey AS persona_key, coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM l WHERE l.persona_key = c_custkey AND line IS NOT NULL),
      '- (neutral baseline — no strongly active behavioral traits)') AS active_traits FROM customer""",
)
def b18b(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    slots = table(spark, d, "customer").select(
        F.col("c_custkey").alias("persona_key"), F.posexplode(F.sequence(F.lit(0), F.lit(2))).alias("i", "j")
    )
    k = F.col("persona_key")
    named = slots.withColumn("n_nationkey", (k * (F.col("i") + 1) + F.col("i") * 7) % 25).join(nations, "n_nationkey")
    value = F.when((k + F.col("i")) % 3 != 0, F.when(F.col("i") == 0, " Yes").otherwise("true")).otherwise("off")
    packed = named.groupBy("persona_key").agg(F.array_sort(F.collect_list(F.struct("i", "n_name", value.alias("v")))).alias("es"))
    # Keys may repeat in these rows, so each gets trailing blanks by position; names are trimmed on use.
    entries = F.transform("es", lambda e: F.struct(F.concat(e["n_name"], F.repeat(F.lit(" "), e["i"])).alias("k"), e["v"].alias("v")))
    return prompts.active_traits(packed.select("persona_key", F.map_from_entries(entries).alias("axis_placement")), axes(spark, d))


@query(
    "b19_truthy",
    "SELECT event_id, coalesce(lower(trim(v)) IN ('true', '1', 'yes', 'on'), false) AS on_flag FROM (SELECT event_id, [' TRUE', 'on', '1', 'yes ', 'off', '0', NULL, 'y'][event_id % 8 + 1] AS v FROM events)",
)
def b19(spark, d):
    values = F.array(*[F.lit(x) for x in [" TRUE", "on", "1", "yes ", "off", "0", None, "y"]])
    return table(spark, d, "events").select("event_id", prompts.truthy(values[(F.col("event_id") % 8).cast("int")]).alias("on_flag"))


B20_SQL = """
WITH r AS (SELECT doc_id AS response_id, doc_id % 5 AS i, text FROM documents),
found AS (SELECT response_id, i, text, p::INT AS pos FROM r, range(0, 2) t(p) WHERE (i IN (0, 1)) OR (i IN (2, 4) AND p = 0))
SELECT response_id, pos, response_id::VARCHAR AS persona_id, length(text)::INT AS n, true AS terse, false AS skeptical, i IN (0, 1) AS complete FROM found
UNION ALL SELECT response_id, NULL, NULL, NULL, NULL, NULL, false FROM r WHERE i = 3"""


@query("b20_parse_personas", B20_SQL)
def b20(spark, d):
    """Raw responses in several broken shapes, the document text inside as a JSON string."""
    i = F.col("doc_id") % 5
    obj = F.to_json(F.struct(F.col("doc_id").cast("string").alias("persona_id"), F.col("text").alias("expanded_instruction"), F.create_map(F.lit("terse"), F.lit("Yes")).alias("axis_placement")))
    raw = (
        F.when(i == 0, F.concat(F.lit("```json\n["), obj, F.lit(", 3, "), obj, F.lit("]\n```")))
        .when(i == 1, F.concat(F.lit("Here [1, 2] they are: "), obj, F.lit(" and "), obj))
        .when(i == 2, F.concat(F.lit("["), obj, F.lit(", {broken")))
        .when(i == 3, "no json at all")
        .otherwise(F.concat(F.lit("{oops "), obj))
    )
    responses = table(spark, d, "documents").select(F.col("doc_id").alias("response_id"), raw.alias("raw"))
    rows = prompts.parse_personas(responses, ["terse", "skeptical"], 2)
    return rows.select(
        "response_id", "pos", "persona_id", F.length("expanded_instruction").alias("n"), F.col("axis_placement.terse").alias("terse"),
        F.col("axis_placement.skeptical").alias("skeptical"), "complete",
    )


@query(
    "b21_normalise_personas",
    "SELECT doc_id, t AS text FROM (SELECT doc_id, " + sql_trim("coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '  ' ELSE text END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), '')")
    + " AS t FROM documents) WHERE t <> ''",
)
def b21(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, "").when(i % 3 == 1, "  ").otherwise(F.col("text")).alias("expanded_instruction"), F.when(i % 2 == 0, F.col("source")).alias("instruction")
    )
    return prompts.normalise_personas(rows, ["expanded_instruction", "instruction"])


def sql_block() -> str:
    names = sorted(FEATURES)
    cells = [f"'{n}=' || format('{{:.3f}}', {n})" for n in names]
    lines = ["'  ' || " + " || '  ' || ".join(cells[i : i + 5]) for i in range(0, len(cells), 5)]
    return " || chr(10) || ".join(lines)


@query("b24_fingerprint_block", f"WITH {sql_fp(CONV)} SELECT dialog_id, {sql_block()} AS block FROM fp")
def b24(spark, d):
    return fingerprint(conv_turns(spark, d)).select("dialog_id", prompts.fingerprint_block().alias("block"))


# Reflection: batch = dialogue id // 10, one episode per dialogue, tasks by id % 3.
@query(
    "w11_reflection_dataset",
    f"""WITH {sql_fp(CONV)}, {sql_excerpt()}, e AS (SELECT dialog_id // 10 AS batch, dialog_id AS pos, repeat('persona ', (dialog_id % 7) * 40 + 1) AS persona,
      trim(excerpt) AS excerpt, {sql_block()} AS blk, CASE WHEN dialog_id // 10 % 4 = 0 THEN NULL ELSE ((dialog_id * 53) % 97) / 97.0 END AS p_human FROM fp JOIN ex USING (dialog_id)),
    s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY p_human DESC, pos DESC) AS hi, row_number() OVER (PARTITION BY batch ORDER BY p_human, pos) AS lo FROM e WHERE p_human IS NOT NULL),
    pick AS (SELECT * EXCLUDE (hi, lo), hi AS slot FROM s WHERE hi <= 2 UNION ALL SELECT * EXCLUDE (hi, lo), lo + 2 FROM s WHERE lo <= 2
      UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS slot FROM e WHERE p_human IS NULL) WHERE slot <= 4),
    pairs AS (SELECT batch, string_agg('## Sample (human_likeness=' || coalesce(format('{{:.4f}}', p_human), 'n/a') || ')' || chr(10) || 'Persona policy:' || chr(10) ||
      left(rtrim(persona), 1200) || CASE WHEN length(rtrim(persona)) > 1200 THEN chr(10) || '[...]' ELSE '' END || chr(10) || chr(10) || 'Behavioral features:' || chr(10) || blk || chr(10) || chr(10) ||
      'Dialogue:' || chr(10) || excerpt, chr(10) || chr(10) ORDER BY slot) AS pairs_block FROM pick GROUP BY batch),
    pl AS (SELECT batch, pos % 3 AS task_no, string_agg('  - human_likeness=' || coalesce(format('{{:.4f}}', p_human), 'n/a') || '; behaviors: [' ||
      CASE WHEN pos % 2 = 0 AND pos % 5 = 0 THEN '"terse", "skeptical"' WHEN pos % 2 = 0 THEN '"terse"' WHEN pos % 5 = 0 THEN '"skeptical"' ELSE '' END || ']', chr(10) ORDER BY pos) AS ls FROM e GROUP BY 1, 2),
    tb AS (SELECT batch, string_agg('## Task ' || task_no || chr(10) || 'Original context: ' || left(repeat('context ' || task_no || ' ', 300), 2200) || chr(10) || 'Generated Personas:' || chr(10) || ls, chr(10) || chr(10) ORDER BY task_no) AS task_context_block FROM pl GROUP BY batch),
    m AS (SELECT batch, '- combined_score: ' || format('{{:.4f}}', avg(pos)) || chr(10) || '- human_likeness: ' || format('{{:.4f}}', max(pos)::DOUBLE) || chr(10) || '- intra_set_diversity: ' || format('{{:.4f}}', min(pos)::DOUBLE) AS metrics_block FROM e GROUP BY batch)
    SELECT batch, metrics_block, pairs_block, task_context_block FROM m JOIN pairs USING (batch) JOIN tb USING (batch)""",
)
def w11(spark, d):
    turns = conv_turns(spark, d)
    batch = F.floor(F.col("dialog_id") / 10)
    p_human = F.when(batch % 4 != 0, ((F.col("dialog_id") * 53) % 97) / F.lit(97.0))
    episodes = settle(fingerprint(turns).join(clean.excerpts(turns), "dialog_id").select(
        batch.alias("batch"), F.col("dialog_id").alias("pos"), F.repeat(F.lit("persona "), ((F.col("dialog_id") % 7) * 40 + 1).cast("int")).alias("persona"),
        "excerpt", prompts.fingerprint_block().alias("fp_block"), p_human.alias("p_human"),
    ), "episodes")
    pos = F.col("pos")
    personas = episodes.select(
        "batch", (pos % 3).alias("task_no"), "pos", F.create_map(F.lit("terse"), pos % 2 == 0, F.lit("skeptical"), pos % 5 == 0).alias("axis_placement"), "p_human"
    )
    contexts = personas.select("batch", "task_no").distinct().withColumn(
        "task_context", F.repeat(F.concat(F.lit("context "), F.col("task_no").cast("string"), F.lit(" ")), F.lit(300))
    )
    metrics = episodes.groupBy("batch").agg(
        F.avg("pos").alias("combined_score"), F.max("pos").alias("human_likeness"), F.min("pos").alias("intra_set_diversity")
    )
    return prompts.reflection_dataset(metrics, episodes, contexts, personas)

