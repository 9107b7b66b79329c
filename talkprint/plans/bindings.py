"""How the given tables bind to the operators' inputs, in Spark and in SQL.

``conversations`` are dialogues as they are.  Their text fires few pattern
banks, so ``events`` serve as a second set of dialogues in which the event
type and id choose a phrase.  Every hundred consecutive events make dialogues of
1, 3, 16 and 80 turns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprint.functions.banks import ACKNOWLEDGMENTS, BANKS, FEATURES

PHRASES = {
    "click": ["please send it, thanks", "ok", "definitely #A1B2C order 12345678", "what do you mean"],
    "error": [
        "ugh this is ridiculous and useless", "i already told you that", "maybe, not sure really",
        "that is a waste of time, scam",
    ],
    "purchase": [
        "let me check that for you", "however, i would rather pay later; thus wait", "how do i pay with Élan card", "yes",
    ],
    "signup": [
        "actually let us try another way", "mail me at bob@example.com", "any update on the new plan",
        "i want my money back now please",
    ],
    "view": ["i want my money back now please", "i want my money back now please", "huh?", "   "],
}

STARTS = [0, 1, 4, 20]  # where a dialogue begins among a hundred events


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def conv_turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("dialog_id"), "turn", "role", F.col("text").alias("content")
    )


def phrase_dialog():
    """The dialogue of an event: the id of its first event."""
    place, start = F.col("event_id") % 100, F.lit(0)
    for first in STARTS[1:]:
        start = F.when(place >= first, first).otherwise(start)
    return F.floor(F.col("event_id") / 100) * 100 + start


def phrase_turns(spark, d) -> DataFrame:
    content = F.lit(None).cast("string")
    for kind, texts in PHRASES.items():
        for i, t in enumerate(texts):
            content = F.when((F.col("event_type") == kind) & (F.col("event_id") % 4 == i), t).otherwise(content)
    return table(spark, d, "events").select(
        phrase_dialog().alias("dialog_id"), (F.col("event_id") - phrase_dialog()).alias("turn"),
        F.lit("user").alias("role"), content.alias("content"),
    )


RATE_DIGITS = 10  # shares of small counts end within these digits, so they never sit on a rounding edge


def r6(col, name: str | None = None, digits: int = 6):
    """Round and drop the sign of zero."""
    out = F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)
    return out.alias(name or col)


def with_r6(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[r6(c, digits=digits) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ SQL side

W = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same pattern for an engine without look-around and Unicode word edges."""
    if pattern == r"\b100\s*%\b":
        return rf"(?:^|[^{W}])100\s*%[{W}]"
    if pattern == r"\bactually(?:,| let| i| we)\b":
        return rf"(?:^|[^{W}])actually(?:,[{W}]|(?: let| i| we)(?:$|[^{W}]))"
    if pattern.startswith(r"\b"):
        pattern = rf"(?:^|[^{W}])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + rf"(?:$|[^{W}])"
    elif pattern.endswith("$"):
        pattern = pattern[:-1] + r"\n?$"
    return pattern


def sql_bank(col: str, name: str) -> str:
    return f"regexp_matches({col}, {lit('|'.join('(?:' + re2(p) + ')' for p in BANKS[name]))})"


def sql_trim(col: str) -> str:
    return f"regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_ids(col: str) -> str:
    solid = f"[^{SPACE}]"
    pattern = rf"#[A-Z0-9]{{5,}}|[A-Z0-9]{{6,}}|\b[0-9]{{7,}}\b|{solid}+@{solid}+\.{solid}+"
    return f"len(regexp_extract_all({col}, {lit(pattern)}))"


CONV = "turns AS (SELECT conv_id AS dialog_id, turn, role, text AS content FROM conversations)"
_START = "CASE WHEN event_id % 100 >= 20 THEN 20 WHEN event_id % 100 >= 4 THEN 4 WHEN event_id % 100 >= 1 THEN 1 ELSE 0 END"
SQL_PHRASE_DIALOG = f"event_id // 100 * 100 + {_START}"
PHRASE = (
    f"turns AS (SELECT {SQL_PHRASE_DIALOG} AS dialog_id, event_id % 100 - {_START} AS turn, 'user' AS role, CASE "
    + " ".join(
        f"WHEN event_type = '{k}' AND event_id % 4 = {i} THEN {lit(t)}" for k, ts in PHRASES.items() for i, t in enumerate(ts)
    )
    + " END AS content FROM events)"
)


def sql_fp(turns: str = CONV, role: str = "user", features: list[str] = FEATURES, p: str = "") -> str:
    """Common table expressions ending in ``{p}fp(dialog_id, n_messages, features)``."""
    ack = "|".join(ACKNOWLEDGMENTS)
    flags = "".join(f", ({sql_bank('low', f)})::INT AS {f}" for f in features if f in BANKS)
    if "acknowledgment_rate" in features:
        flags += f", regexp_full_match({sql_trim('low')}, {lit('(?:' + ack + ')[.!,]*')})::INT AS acknowledgment_rate"
    if "identifiers_per_turn" in features:
        flags += f", {sql_ids('content')} AS identifiers_per_turn"
    exprs = {
        "words_per_turn": "avg(n)",
        "short_utterance_rate": "avg((n <= 3)::INT)",
        "verbosity_cv": "CASE WHEN count(*) > 1 AND avg(n) > 0 THEN stddev_pop(n) / avg(n) END",
        "front_loading_ratio": "CASE WHEN sum(n) > 0 THEN sum(n) FILTER (rn <= 2) / sum(n) END",
        "opening_length": "min_by(n, turn)::DOUBLE",
    }
    aggs = ", ".join(f"{exprs.get(f, f'avg({f})')} AS {f}" for f in features if f != "repetition_rate")
    aggs = (aggs + ", " if aggs else "") + "count(*) AS spoken"
    outs = ", ".join(
        "coalesce(n_rep / spoken, 0)::DOUBLE AS repetition_rate" if f == "repetition_rate" else f"coalesce({f}, 0)::DOUBLE AS {f}"
        for f in features
    )
    src = turns + ", " if turns else ""
    return f"""{src}
{p}spoken AS (SELECT dialog_id, turn, content, lower(content) AS low,
  regexp_extract_all(lower(content), '[{W}]+') AS toks FROM turns WHERE role = '{role}' AND content <> ''),
{p}per AS (SELECT dialog_id, turn, len(toks) AS n,
  row_number() OVER (PARTITION BY dialog_id ORDER BY turn) AS rn{flags} FROM {p}spoken),
{p}agg AS (SELECT dialog_id, {aggs} FROM {p}per GROUP BY dialog_id),
{p}grams AS (SELECT dialog_id, turn, unnest(list_transform(range(1, len(toks) - 1),
  lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])) AS g FROM {p}spoken WHERE len(toks) >= 3),
{p}freq AS (SELECT dialog_id, g FROM {p}grams GROUP BY ALL HAVING count(*) > 3),
{p}rep AS (SELECT dialog_id, count(DISTINCT turn) AS n_rep FROM {p}grams JOIN {p}freq USING (dialog_id, g) GROUP BY dialog_id),
{p}dialogs AS (SELECT dialog_id, count(*) AS n_messages FROM turns GROUP BY dialog_id),
{p}fp AS (SELECT dialog_id, n_messages, {outs} FROM {p}dialogs LEFT JOIN {p}agg USING (dialog_id) LEFT JOIN {p}rep USING (dialog_id))"""


def sql_r6(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def sql_list(cols: list[str], prefix: str = "") -> str:
    return "[" + ", ".join(prefix + c for c in cols) + "]"


def sql_scaler(src: str, name: str = "scaler", where: str = "", features: list[str] = FEATURES) -> str:
    cols = ", ".join(
        f"avg({f}) AS mu_{f}, CASE WHEN stddev_pop({f}) < 1e-9 THEN 1.0 ELSE stddev_pop({f}) END AS sd_{f}" for f in features
    )
    return f"{name} AS (SELECT {cols} FROM {src} {where})"


def sql_z(features: list[str] = FEATURES) -> str:
    """z-scored vector of a row joined to ``scaler``."""
    return "[" + ", ".join(f"({f} - mu_{f}) / sd_{f}" for f in features) + "]"


def sql_spread(src: str, key: str, name: str = "spread") -> str:
    """``name(d_ref)`` over ``src(key, vec)``."""
    return (
        f"{name} AS (SELECT CASE WHEN count(*) > 0 AND avg(list_distance(a.vec, b.vec)) > 1e-9 "
        f"THEN avg(list_distance(a.vec, b.vec)) ELSE 1.0 END AS d_ref FROM {src} a JOIN {src} b ON a.{key} < b.{key})"
    )


def sql_chamfer(p: str, pkey: str, h: str, hkey: str, by: str, name: str = "cham", spread: str = "spread") -> str:
    """``name(by, chamfer)`` of ``p(by, pkey, vec)`` against ``h(hkey, vec)``."""
    return f"""{name}_d AS (SELECT p.{by}, p.{pkey} AS pk, h.{hkey} AS hk, list_distance(p.vec, h.vec) AS dd FROM {p} p CROSS JOIN {h} h),
{name}_h AS (SELECT {by}, avg(m) AS eh FROM (SELECT {by}, hk, min(dd) AS m FROM {name}_d GROUP BY ALL) GROUP BY {by}),
{name}_p AS (SELECT {by}, avg(m) AS ep FROM (SELECT {by}, pk, min(dd) AS m FROM {name}_d GROUP BY ALL) GROUP BY {by}),
{name} AS (SELECT {by}, greatest(0.0, 1.0 - least(1.0, (eh + ep) / (2.0 * d_ref))) AS chamfer
  FROM {name}_h JOIN {name}_p USING ({by}) CROSS JOIN {spread})"""


def sql_dice(m: str, h: str) -> str:
    return f"CASE WHEN abs({m}) + abs({h}) < 1e-12 THEN 1.0 ELSE 2 * least(abs({m}), abs({h})) / (abs({m}) + abs({h})) END"


def sql_dims(means: str, ref: str, by: str, name: str = "dice") -> str:
    """``name(by, D1..D4, overall)`` from wide means and a one-row wide reference."""
    from talkprint.functions.banks import DIMENSIONS

    dims = {
        d: "(" + " + ".join(sql_dice(f"m.{f}", f"r.{f}") for f in fs) + f") / {len(fs)}.0" for d, fs in DIMENSIONS.items()
    }
    inner = ", ".join(f"{e} AS {d}" for d, e in dims.items())
    return (
        f"{name} AS (SELECT *, (D1 + D2 + D3 + D4) / 4.0 AS overall FROM "
        f"(SELECT m.{by}, {inner} FROM {means} m CROSS JOIN {ref} r))"
    )


def sql_means(src: str, name: str, by: str | None = None, where: str = "") -> str:
    cols = ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {head}{cols} FROM {src} {where}{tail})"
