"""Registered queries B02-B14, B22, B23, B25, B26 and J18."""

from pyspark.sql import functions as F

from talkprint.operators import clean
from talkprint.plans.bindings import (
    CONV, PHRASE, SPACE, SQL_PHRASE_DIALOG, W, conv_turns, lit, phrase_dialog, phrase_turns, sql_trim, table,
)
from talkprint.plans.registry import query



def sql_prose(c: str, line: int = 400, breaks: int = 15) -> str:
    return (
        f"(regexp_matches({c}, '[^{SPACE}]') AND NOT contains({c}, '```') AND NOT regexp_matches({c}, '<[A-Za-z/]') "
        f"AND length({c}) - length(replace({c}, chr(10), '')) < {breaks} "
        f"AND list_max(list_transform(string_split({c}, chr(10)), lambda x: length(x))) <= {line})"
    )


@query("b02_prose_filter", f"SELECT doc_id, {sql_prose('text')} AS prose FROM documents")
def b02(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.is_prose(F.col("text")).alias("prose"))


@query("b02_prose_pages", f"SELECT page_id, {sql_prose('html')} AS prose FROM pages")
def b02b(spark, d):
    return table(spark, d, "pages").select("page_id", clean.is_prose(F.col("html")).alias("prose"))


# Developer-chat columns derived from conversations.
CHAT = """chat AS (SELECT conv_id AS session_id, conv_id % 7 AS repo_id, turn AS conversation_turn_number, role,
  conv_id % 3 <> 0 AS is_conversational, CASE WHEN conv_id % 5 = 0 THEN 'FRENCH' ELSE 'ENGLISH' END AS language,
  ['debug', 'refactor', 'chat', 'test'][turn % 4 + 1] AS prompt_intent, text AS content FROM conversations)"""


def chat(spark, d):
    intents = F.array(*[F.lit(x) for x in ["debug", "refactor", "chat", "test"]])
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") % 7).alias("repo_id"),
        F.col("turn").alias("conversation_turn_number"), "role", (F.col("conv_id") % 3 != 0).alias("is_conversational"),
        F.when(F.col("conv_id") % 5 == 0, "FRENCH").otherwise("ENGLISH").alias("language"),
        intents[(F.col("turn") % 4).cast("int")].alias("prompt_intent"), F.col("text").alias("content"),
    )


@query(
    "b03_register_match",
    f"WITH {CHAT} SELECT session_id, conversation_turn_number, prompt_intent FROM chat WHERE role = 'user' AND is_conversational "
    "AND language = 'ENGLISH' AND prompt_intent IN ('create new code', 'refactor', 'debug', 'test', 'understand')",
)
def b03(spark, d):
    return clean.register_match(chat(spark, d)).select("session_id", "conversation_turn_number", "prompt_intent")


@query(
    "b04_normalise_messages",
    f"WITH {CONV}, marked AS (SELECT dialog_id, turn, role, CASE WHEN (dialog_id + turn) % 5 = 0 THEN '  ' || chr(10) ELSE content END AS content FROM turns) "
    f"SELECT dialog_id, turn, role FROM marked WHERE role IN ('user', 'assistant') AND regexp_matches(content, '[^{SPACE}]')",
)
def b04(spark, d):
    blanked = F.when((F.col("dialog_id") + F.col("turn")) % 5 == 0, F.lit("  \n")).otherwise(F.col("content"))
    return clean.normalise_messages(conv_turns(spark, d).withColumn("content", blanked)).select("dialog_id", "turn", "role")


@query(
    "b05_strip_leading_setup",
    f"""WITH {CONV}, marked AS (SELECT dialog_id, turn, role, CASE WHEN turn = 0 AND dialog_id % 2 = 0 THEN ' \\tau task ' || content
      WHEN turn <= 1 AND dialog_id % 3 = 0 THEN content || '<|canvas|>' WHEN turn = 2 THEN '\\tau later ' || content ELSE content END AS content FROM turns),
    flagged AS (SELECT *, starts_with({sql_trim('content')}, '\\tau ') OR contains(content, '<|canvas|>') AS setup FROM marked),
    seen AS (SELECT *, max((NOT setup)::INT) OVER (PARTITION BY dialog_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS past FROM flagged),
    kept AS (SELECT *, count(*) OVER (PARTITION BY dialog_id) AS n FROM seen WHERE past = 1)
    SELECT dialog_id, turn, role, content FROM kept WHERE n >= 2""",
)
def b05(spark, d):
    c, t, i = F.col("content"), F.col("turn"), F.col("dialog_id")
    marked = (
        F.when((t == 0) & (i % 2 == 0), F.concat(F.lit(" \\tau task "), c))
        .when((t <= 1) & (i % 3 == 0), F.concat(c, F.lit("<|canvas|>")))
        .when(t == 2, F.concat(F.lit("\\tau later "), c))
        .otherwise(c)
    )
    return clean.strip_leading_setup(conv_turns(spark, d).withColumn("content", marked)).select("dialog_id", "turn", "role", "content")


STOPPED = """marked AS (SELECT dialog_id, turn, role, CASE WHEN role = 'user' AND (dialog_id + turn) % 3 = 0 THEN ' ' || content || ' {m} '
  WHEN role = 'assistant' THEN content || '{m}' ELSE content END AS content FROM turns),
seen AS (SELECT *, coalesce(max((role = 'user' AND contains(content, '{m}'))::INT) OVER (PARTITION BY dialog_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 0) AS stopped FROM marked)"""


def stopped(spark, d, marker):
    c = F.col("content")
    text = (
        F.when((F.col("role") == "user") & ((F.col("dialog_id") + F.col("turn")) % 3 == 0), F.concat(F.lit(" "), c, F.lit(f" {marker} ")))
        .when(F.col("role") == "assistant", F.concat(c, F.lit(marker)))
        .otherwise(c)
    )
    return conv_turns(spark, d).withColumn("content", text)


@query(
    "b06_truncate_keeping_stop",
    f"WITH {CONV}, {STOPPED.format(m='[DONE]', end='1 PRECEDING')} SELECT dialog_id, turn, role, CASE WHEN role = 'user' THEN "
    + sql_trim("replace(content, '[DONE]', '')") + " ELSE content END AS content FROM seen WHERE stopped = 0",
)
def b06(spark, d):
    return clean.truncate_keeping_stop(stopped(spark, d, "[DONE]")).select("dialog_id", "turn", "role", "content")


@query(
    "b07_truncate_before_stop",
    f"WITH {CONV}, {STOPPED.format(m='/close', end='CURRENT ROW')} SELECT dialog_id, turn, role, content FROM seen WHERE stopped = 0",
)
def b07(spark, d):
    return clean.truncate_before_stop(stopped(spark, d, "/close")).select("dialog_id", "turn", "role", "content")


@query(
    "b08_cap_turns",
    f"WITH {PHRASE} SELECT dialog_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY dialog_id, role ORDER BY turn) AS rn FROM turns) WHERE rn <= 4",
)
def b08(spark, d):
    return clean.cap_turns(phrase_turns(spark, d), 4).select("dialog_id", "turn")


@query(
    "b08_cap_messages",
    f"WITH {CONV} SELECT dialog_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY turn) AS rn FROM turns) WHERE rn <= 3",
)
def b08b(spark, d):
    return clean.cap_turns(conv_turns(spark, d), 3, by_role=False).select("dialog_id", "turn", "role")


@query(
    "b09_truncate_reply",
    f"WITH {CONV} SELECT dialog_id, turn, CASE WHEN role = 'user' THEN left(content, 60) ELSE content END AS content FROM turns",
)
def b09(spark, d):
    return clean.truncate_reply(conv_turns(spark, d), 60).select("dialog_id", "turn", "content")


ANSWERED = """CASE WHEN {k} % 5 = 0 THEN 'x OUTPUT: ' || {t} || ' OUTPUT: tail' WHEN {k} % 5 = 1 THEN 'I WANT TO ANSWER:' || {t}
 || 'I WANT TO ANSWER: again' WHEN {k} % 5 = 2 THEN 'OUTPUT: then I WANT TO ANSWER: ' || {t} ELSE {t} END"""
SQL_REPLY = "CASE WHEN contains(reply, 'OUTPUT:') THEN string_split(reply, 'OUTPUT:')[2] ELSE reply END"


def answered(key, text):
    return (
        F.when(key % 5 == 0, F.concat(F.lit("x OUTPUT: "), text, F.lit(" OUTPUT: tail")))
        .when(key % 5 == 1, F.concat(F.lit("I WANT TO ANSWER:"), text, F.lit("I WANT TO ANSWER: again")))
        .when(key % 5 == 2, F.concat(F.lit("OUTPUT: then I WANT TO ANSWER: "), text))
        .otherwise(text)
    )


@query(
    "b10_answer_text",
    f"WITH {CONV}, r AS (SELECT dialog_id, turn, {ANSWERED.format(k='(dialog_id + turn)', t='content')} AS reply FROM turns), "
    f"s AS (SELECT dialog_id, turn, {SQL_REPLY} AS r2 FROM r) SELECT dialog_id, turn, CASE WHEN contains(r2, 'I WANT TO ANSWER:') "
    "THEN string_split(r2, 'I WANT TO ANSWER:')[2] WHEN turn >= 4 THEN r2 ELSE 'No answer' END AS answer FROM s",
)
def b10(spark, d):
    t = conv_turns(spark, d)
    reply = answered(F.col("dialog_id") + F.col("turn"), F.col("content"))
    return t.select("dialog_id", "turn", clean.answer_text(reply, F.col("turn") >= 4).alias("answer"))


@query(
    "b10_final_answers",
    f"""WITH {CONV}, r AS (SELECT dialog_id, turn, {ANSWERED.format(k='(dialog_id + turn)', t='content')} AS reply,
      row_number() OVER (PARTITION BY dialog_id ORDER BY turn) AS step FROM turns WHERE role = 'assistant'),
    s AS (SELECT dialog_id, step, {SQL_REPLY} AS r2 FROM r WHERE step <= 2),
    a AS (SELECT dialog_id, step, CASE WHEN contains(r2, 'I WANT TO ANSWER:') THEN string_split(r2, 'I WANT TO ANSWER:')[2] ELSE r2 END AS answer
      FROM s WHERE contains(r2, 'I WANT TO ANSWER:') OR step = 2)
    SELECT dialog_id, coalesce(min_by(answer, step), 'No answer') AS answer FROM (SELECT DISTINCT dialog_id FROM turns) LEFT JOIN a USING (dialog_id) GROUP BY dialog_id""",
)
def b10b(spark, d):
    t = conv_turns(spark, d)
    return clean.final_answers(t.withColumn("content", answered(F.col("dialog_id") + F.col("turn"), F.col("content"))), max_steps=2)


FENCED = "CASE WHEN doc_id % 4 = 0 THEN 'a ```python' || chr(10) || {t} || '``` b ```python no```' WHEN doc_id % 4 = 1 THEN '```' || {t} || '```' WHEN doc_id % 4 = 2 THEN '```' || {t} ELSE {t} END"


@query(
    "b11_strip_code_fence",
    f"WITH f AS (SELECT doc_id, {FENCED.format(t='text')} AS code FROM documents) SELECT doc_id, CASE WHEN contains(code, '```python') "
    "THEN string_split(string_split(code, '```python')[2], '```')[1] WHEN len(string_split(code, '```')) >= 3 THEN string_split(code, '```')[2] ELSE code END AS code FROM f",
)
def b11(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 4
    code = (
        F.when(k == 0, F.concat(F.lit("a ```python\n"), t, F.lit("``` b ```python no```")))
        .when(k == 1, F.concat(F.lit("```"), t, F.lit("```")))
        .when(k == 2, F.concat(F.lit("```"), t))
        .otherwise(t)
    )
    return table(spark, d, "documents").select("doc_id", clean.strip_code_fence(code).alias("code"))


def sql_any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(n)})" for n in needles) + ")"


@query(
    "b12_blocklist",
    f"WITH c AS (SELECT page_id, html || CASE WHEN page_id % 6 = 0 THEN ' exit(0)' WHEN page_id % 6 = 1 THEN 'print(1)' ELSE '' END AS code FROM pages) "
    f"SELECT page_id, {sql_any('code', clean.BLOCKED_ANSWER)} AS blocked, {sql_any('code', clean.BLOCKED_RUN)} AS run_blocked FROM c",
)
def b12(spark, d):
    k = F.col("page_id") % 6
    code = F.concat("html", F.when(k == 0, " exit(0)").when(k == 1, "print(1)").otherwise(""))
    return table(spark, d, "pages").select(
        "page_id", clean.has_any(code, clean.BLOCKED_ANSWER).alias("blocked"), clean.has_any(code, clean.BLOCKED_RUN).alias("run_blocked")
    )


def sql_excerpt(turns: str = "turns") -> str:
    return f"""ex AS (SELECT dialog_id, left(coalesce(string_agg(line, chr(10) ORDER BY turn), ''), 2400) AS excerpt FROM
      (SELECT dialog_id, turn, CASE WHEN regexp_matches(content, '[^{SPACE}]') THEN upper(role) || ': ' || CASE WHEN role = 'assistant' AND length(content) > 250
        THEN left(content, 100) || ' ... ' || right(content, 100) ELSE content END END AS line,
        row_number() OVER (PARTITION BY dialog_id ORDER BY turn) AS rn FROM {turns}) WHERE rn <= 20 GROUP BY dialog_id)"""


@query("b13_excerpts", f"WITH {CONV}, {sql_excerpt()} SELECT dialog_id, excerpt FROM ex")
def b13(spark, d):
    return clean.excerpts(conv_turns(spark, d))


@query("b13_excerpts_phrases", f"WITH {PHRASE}, {sql_excerpt()} SELECT dialog_id, excerpt FROM ex")
def b13b(spark, d):
    return clean.excerpts(phrase_turns(spark, d))


@query(
    "b14_flip_roles",
    f"""WITH {CONV}, t AS (SELECT * FROM turns), firsts AS (SELECT dialog_id, min_by(role, turn) AS r FROM t GROUP BY dialog_id)
    SELECT dialog_id, turn AS pos, CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS role, content FROM t
    UNION ALL SELECT dialog_id, -2, 'system', 'task ' || dialog_id FROM firsts
    UNION ALL SELECT dialog_id, -1, 'user', 'How can I help you?' FROM firsts WHERE r = 'user'""",
)
def b14(spark, d):
    t = conv_turns(spark, d)
    head = t.select("dialog_id").distinct().withColumn("content", F.concat(F.lit("task "), F.col("dialog_id").cast("string")))
    return clean.flip_roles(t, head)


@query(
    "b22_judge_verdict",
    "SELECT doc_id, CASE WHEN contains(upper(v), 'ADDRESSED') AND NOT contains(upper(v), 'NOT') AND c <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM "
    "(SELECT doc_id, ['Addressed', 'not_addressed', 'ADDRESSED.', 'unclear'][doc_id % 4 + 1] AS v, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS c FROM documents)",
)
def b22(spark, d):
    v = F.array(*[F.lit(x) for x in ["Addressed", "not_addressed", "ADDRESSED.", "unclear"]])[(F.col("doc_id") % 4).cast("int")]
    cond = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", clean.judge_verdict(v, cond).alias("reward"))


@query(
    "b23_instance_task_id",
    "SELECT k, CASE WHEN starts_with(k, 'retail_') THEN string_split(substr(k, 8), '_ann')[1] ELSE '' END AS task_id FROM "
    "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'airline_' ELSE 'retail_' END || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_ann' || o_custkey ELSE '' END AS k FROM orders)",
)
def b23(spark, d):
    key = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "airline_").otherwise("retail_"), F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_ann"), F.col("o_custkey").cast("string"))).otherwise(""),
    )
    return table(spark, d, "orders").select(key.alias("k")).select("k", clean.instance_task_id(F.col("k"), "retail").alias("task_id"))


EPISODE_SQL = f"""ep AS (SELECT dialog_id, event_id AS turn, CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN dialog_id % 9 = 1 AND event_type = 'error' THEN 'Sorry, I''m unable to' WHEN dialog_id % 9 = 2 AND event_id % 2 = 0 THEN 'I cannot'
  WHEN dialog_id % 9 = 3 AND event_id % 4 = 0 THEN 'Could you please clarify? could you please clarify' WHEN dialog_id % 9 = 4 AND event_id % 6 = 0 THEN 'help me out, I''ll proceed with it'
  WHEN dialog_id % 9 = 5 AND event_id % 2 = 1 THEN 'Never mind' WHEN dialog_id % 9 = 6 AND event_id % 4 = 0 THEN 'well i cannot'
  WHEN dialog_id % 9 = 6 AND event_id % 4 = 2 THEN 'help you' WHEN dialog_id % 9 = 7 AND event_id % 2 = 0 THEN ['i', 'can''t', 'assist', 'x'][(event_id // 2) % 4 + 1] ELSE event_type END AS content FROM (SELECT *, {SQL_PHRASE_DIALOG} AS dialog_id FROM events))"""


def _episodes(spark, d):
    u, e = phrase_dialog() % 9, F.col("event_id")
    words = F.array(*[F.lit(x) for x in ["i", "can't", "assist", "x"]])[(F.floor(e / 2) % 4).cast("int")]
    content = (
        F.when((u == 1) & (F.col("event_type") == "error"), "Sorry, I'm unable to")
        .when((u == 2) & (e % 2 == 0), "I cannot")
        .when((u == 3) & (e % 4 == 0), "Could you please clarify? could you please clarify")
        .when((u == 4) & (e % 6 == 0), "help me out, I'll proceed with it")
        .when((u == 5) & (e % 2 == 1), "Never mind")
        .when((u == 6) & (e % 4 == 0), "well i cannot")
        .when((u == 6) & (e % 4 == 2), "help you")
        .when((u == 7) & (e % 2 == 0), words)
        .otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select(
        phrase_dialog().alias("dialog_id"), e.alias("turn"), F.when(e % 2 == 0, "assistant").otherwise("user").alias("role"), content.alias("content")
    )


@query(
    "b25_failure_modes",
    f"""WITH {EPISODE_SQL}, j AS (SELECT dialog_id, count(*) AS n, lower(string_agg(content, ' ' ORDER BY turn)) AS everyone,
      coalesce(lower(string_agg(content, ' ' ORDER BY turn) FILTER (role = 'assistant')), '') AS agent FROM ep GROUP BY dialog_id)
    SELECT dialog_id, CASE WHEN dialog_id % 11 = 0 THEN NULL WHEN {sql_any('agent', clean.AGENT_GAVE_UP)} THEN 'agent_gave_up' WHEN n >= 28 THEN 'max_turns_exceeded'
    WHEN (length(agent) - length(replace(agent, 'could you please clarify', ''))) / 24 > 2 OR (length(agent) - length(replace(agent, 'can you clarify', ''))) / 15 > 2
    THEN 'clarification_loop' WHEN {sql_any('agent', clean.AGENT_ASSUMES)} THEN 'agent_assumed'
    WHEN regexp_matches(everyone, '(?:^|[^{W}])(?:never mind|forget it|i give up)(?:$|[^{W}])') THEN 'user_abandoned' ELSE 'other' END AS failure_mode FROM j""",
)
def b25(spark, d):
    ep = _episodes(spark, d)
    outcomes = ep.select("dialog_id").distinct().withColumn("success", F.col("dialog_id") % 11 == 0)
    return clean.failure_modes(ep, outcomes)


@query(
    "b26_goal_fallback",
    "SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') AS goal FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS a, "
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS b, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'task' END AS c FROM documents)",
)
def b26(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(i % 2 == 0, F.col("lang")).alias("user_goal"), F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("problem_desc"),
        F.when(i % 5 != 0, "task").alias("task_description"),
    )
    return rows.select("doc_id", clean.first_filled("user_goal", "problem_desc", "task_description").alias("goal"))


@query(
    "j18_clean_dialogs",
    f"""WITH {CHAT}, prose AS (SELECT session_id AS dialog_id, repo_id, conversation_turn_number AS turn, {sql_trim('content')} AS content FROM chat
      WHERE role = 'user' AND {sql_prose('content', 400, 4)}), formed AS (SELECT dialog_id, repo_id FROM prose GROUP BY ALL HAVING count(*) >= 2),
    enough AS (SELECT repo_id FROM formed GROUP BY repo_id HAVING count(*) >= 3)
    SELECT dialog_id, repo_id, turn, content FROM prose WHERE dialog_id IN (SELECT dialog_id FROM formed WHERE repo_id IN (SELECT repo_id FROM enough))""",
)
def j18(spark, d):
    turns = chat(spark, d).withColumnsRenamed({"session_id": "dialog_id", "conversation_turn_number": "turn"})
    return clean.clean_dialogs(turns, "repo_id", max_newlines=4).select("dialog_id", "repo_id", "turn", "content")


@query(
    "j18_clean_dialogs_documents",
    f"""WITH t AS (SELECT source AS g, doc_id // 4 AS dialog_id, doc_id % 4 AS turn, text FROM documents), prose AS (SELECT * FROM t WHERE {sql_prose('text')}),
    formed AS (SELECT dialog_id FROM prose GROUP BY ALL HAVING count(*) >= 2)
    SELECT dialog_id, turn, length({sql_trim('text')}) AS n FROM prose WHERE dialog_id IN (SELECT dialog_id FROM formed)""",
)
def j18b(spark, d):
    turns = table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("dialog_id"), (F.col("doc_id") % 4).alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content")
    )
    return clean.clean_dialogs(turns).select("dialog_id", "turn", F.length("content").cast("long").alias("n"))


