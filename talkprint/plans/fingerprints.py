"""Registered queries F00-F20 and P01-P14."""

from pyspark.sql import functions as F

from talkprint.functions.text import matches_bank
from talkprint.functions.banks import BANKS, FEATURES
from talkprint.operators import distance, stats
from talkprint.operators.fingerprint import fingerprint, individual_fingerprints, spoken_turns, turn_tokens
from talkprint.plans.bindings import (
    CONV, PHRASE, RATE_DIGITS, W, conv_turns, phrase_turns, r6, sql_bank, sql_chamfer, sql_dice, sql_dims, sql_fp, sql_list, sql_means, sql_r6,
    sql_scaler, sql_spread, sql_z, table, with_r6,
)
from talkprint.plans.registry import query
from talkprint.sources.shared import settle

@query("b01_spoken_turns", f"WITH {CONV} SELECT dialog_id, turn, content FROM turns WHERE role = 'user' AND content <> ''")
def spoken(spark, d):
    return spoken_turns(conv_turns(spark, d)).select("dialog_id", "turn", "content")


@query(
    "f00_tokens",
    f"""WITH {CONV} SELECT dialog_id, turn, (i - 1)::INT AS pos, toks[i] AS token FROM
    (SELECT dialog_id, turn, toks, unnest(range(1, len(toks) + 1)) AS i FROM
    (SELECT dialog_id, turn, regexp_extract_all(lower(content), '[{W}]+') AS toks FROM turns WHERE role = 'user' AND content <> ''))""",
)
def tokens(spark, d):
    rows = turn_tokens(conv_turns(spark, d))
    return rows.select("dialog_id", "turn", F.posexplode("tokens").alias("pos", "token"))


def _single(number, name):
    sql = f"WITH {sql_fp(PHRASE, features=[name])} SELECT dialog_id, {sql_r6([name], RATE_DIGITS)} FROM fp"

    @query(f"f{number:02d}_{name}", sql)
    def run(spark, d):
        return with_r6(fingerprint(phrase_turns(spark, d), features=[name]), [name], RATE_DIGITS).drop("n_messages")


for _i, _name in enumerate(FEATURES, start=1):
    _single(_i, _name)


def _full(key, turns, sql_turns, role):
    @query(key, f"WITH {sql_fp(sql_turns, role)} SELECT dialog_id, n_messages, {sql_r6(FEATURES, RATE_DIGITS)} FROM fp")
    def run(spark, d):
        return with_r6(fingerprint(turns(spark, d), role), FEATURES, RATE_DIGITS)


_full("f20_fingerprint", phrase_turns, PHRASE, "user")
_full("f20_fingerprint_conversations", conv_turns, CONV, "user")
_full("f20_fingerprint_agent_role", conv_turns, CONV, "assistant")


@query(
    "f20_custom_bank",
    f"WITH {PHRASE} SELECT dialog_id, round(avg(regexp_matches(lower(content), '(?:^|[^{W}])money(?:$|[^{W}])')::INT), 6) + 0.0 AS money_rate "
    "FROM turns GROUP BY dialog_id",
)
def custom_bank(spark, d):
    fps = fingerprint(phrase_turns(spark, d), banks={"money_rate": [r"\bmoney\b"]}, features=["money_rate"])
    return fps.select("dialog_id", r6("money_rate"))


@query(
    "f03_politeness_documents",
    f"SELECT doc_id, CAST({sql_bank('lower(text)', 'politeness_rate')} AS INT) AS polite FROM documents",
)
def polite_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", matches_bank(F.lower("text"), BANKS["politeness_rate"]).cast("int").alias("polite"))


AWKWARD_BANK = [r"(?:very )?good", "pay|thanks", r"\bwait\b|\bscam\b", r"#\w+ order \d+$", r"[?.,]\s", r"(?:re|un)?al|x{2}", r"\b(?:i|a) wan?t"]


@query(
    "f20_awkward_bank",
    rf"WITH {PHRASE} SELECT dialog_id, round(avg(regexp_matches(lower(content), '(?:very )?good|pay|thanks|\bwait\b|\bscam\b|#\w+ order \d+$|[?.,]\s|(?:re|un)?al|x{{2}}|\b(?:i|a) wan?t')::INT), 6) + 0.0 "
    "AS hit_rate FROM turns GROUP BY dialog_id",
)
def awkward_bank(spark, d):
    fps = fingerprint(phrase_turns(spark, d), banks={"hit_rate": AWKWARD_BANK}, features=["hit_rate"])
    return fps.select("dialog_id", r6("hit_rate"))


# ---------------------------------------------------------------- statistics

HUMAN = sql_fp(CONV)
SIM = sql_fp("", "assistant", p="s_")


def humans(spark, d):
    return fingerprint(conv_turns(spark, d))


def simulated(spark, d):
    return fingerprint(conv_turns(spark, d), "assistant")


@query(
    "p01_population_stats",
    f"WITH {sql_fp(PHRASE)} "
    + " UNION ALL ".join(
        f"SELECT 'events' AS source, 'custom' AS domain, '{f}' AS feature, round(avg({f}), {RATE_DIGITS}) + 0.0 AS mean, "
        f"round(stddev_pop({f}), {RATE_DIGITS}) + 0.0 AS std, count(*) AS n FROM fp" for f in FEATURES
    ),
)
def p01(spark, d):
    return with_r6(stats.population_stats(fingerprint(phrase_turns(spark, d)), "events"), ["mean", "std"], RATE_DIGITS)


@query(
    "p02_mean_fingerprint",
    f"WITH {HUMAN} SELECT dialog_id % 4 AS condition, " + ", ".join(f"round(avg({f}), {RATE_DIGITS}) + 0.0 AS {f}" for f in FEATURES) + " FROM fp GROUP BY 1",
)
def p02(spark, d):
    fps = humans(spark, d).withColumn("condition", F.col("dialog_id") % 4)
    return with_r6(stats.mean_fingerprint(fps, ["condition"]), FEATURES, RATE_DIGITS)


P03_SQL = (
    f"WITH {HUMAN}, {SIM}, {sql_means('fp', 'hm')}, {sql_means('s_fp', 'sm')} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round({sql_dice('sm.' + f, 'hm.' + f)}, 6) + 0.0 AS dice FROM hm CROSS JOIN sm" for f in FEATURES
    )
)


@query("p03_dice", P03_SQL)
def p03(spark, d):
    means = stats.mean_fingerprint(simulated(spark, d).withColumn("g", F.lit(1)), ["g"])
    per = stats.dice_per_feature(means, stats.population_stats(humans(spark, d)), ["g"])
    return per.select("feature", r6("dice"))


DIM_COLS = [*stats.DIMS, "overall"]


@query(
    "p04_dice_alignment",
    f"WITH {HUMAN}, {SIM}, {sql_means('fp', 'hm')}, {sql_means('(SELECT dialog_id % 4 AS condition, * FROM s_fp)', 'cm', 'condition')}, "
    f"{sql_dims('cm', 'hm', 'condition')} SELECT condition, {sql_r6(DIM_COLS)} FROM dice",
)
def p04(spark, d):
    sims = simulated(spark, d).withColumn("condition", F.col("dialog_id") % 4)
    return with_r6(stats.dice_alignment(sims, stats.population_stats(humans(spark, d)), ["condition"]), DIM_COLS)


@query(
    "p05_neutral_prior",
    f"WITH {HUMAN}, zero AS (SELECT {', '.join(f'0.0 AS {f}' for f in FEATURES)}), "
    f"{sql_means('(SELECT dialog_id % 4 AS condition, * FROM fp)', 'cm', 'condition')}, {sql_dims('cm', 'zero', 'condition')} "
    f"SELECT condition, {sql_r6(DIM_COLS)} FROM dice",
)
def p05(spark, d):
    fps = humans(spark, d).withColumn("condition", F.col("dialog_id") % 4)
    return with_r6(stats.dice_alignment(fps, stats.neutral_prior(spark), ["condition"]), DIM_COLS)


SUBSET = ["opening_length", "words_per_turn", "accusatory_rate", "not_a_feature"]


@query(
    "p06_assemble",
    f"WITH {HUMAN} " + " UNION ALL ".join(
        f"SELECT dialog_id, {i} AS pos, round({'0.0' if f == 'not_a_feature' else f}, 6) + 0.0 AS value FROM fp" for i, f in enumerate(SUBSET)
    ),
)
def p06(spark, d):
    rows = stats.assemble(humans(spark, d), SUBSET)
    return rows.select("dialog_id", F.posexplode("vec").alias("pos", "value")).select("dialog_id", "pos", r6("value"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )


EMB = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"


@query(
    "p07_scaler_fit",
    f"WITH {EMB} SELECT (i - 1)::INT AS pos, round(avg(vec[i]), 6) + 0.0 AS mu, round(CASE WHEN stddev_pop(vec[i]) < 1e-9 THEN 1.0 "
    "ELSE stddev_pop(vec[i]) END, 6) + 0.0 AS sd FROM emb, range(1, 65) t(i) WHERE label >= 5 GROUP BY i",
)
def p07(spark, d):
    s = stats.fit_scaler(vectors(spark, d).where("label >= 5"), 64)
    both = s.select(F.posexplode(F.arrays_zip("mu", "sd")).alias("pos", "z"))
    return both.select("pos", r6(F.col("z.mu"), "mu"), r6(F.col("z.sd"), "sd"))


@query(
    "p07_scaler_apply",
    f"WITH {HUMAN}, {sql_scaler('fp', where='WHERE dialog_id % 2 = 0')}, z AS (SELECT dialog_id, {sql_z()} AS vec FROM fp CROSS JOIN scaler) "
    "SELECT dialog_id, (i - 1)::INT AS pos, round(vec[i], 6) + 0.0 AS z FROM z, range(1, 20) t(i)",
)
def p07b(spark, d):
    fps = stats.assemble(humans(spark, d))
    z = stats.apply_scaler(fps, stats.fit_scaler(fps.where("dialog_id % 2 = 0"), 19), 19)
    return z.select("dialog_id", F.posexplode("vec").alias("pos", "z")).select("dialog_id", "pos", r6("z"))


HP = "h AS (SELECT * FROM emb WHERE label >= 5), p AS (SELECT *, 0 AS one FROM emb WHERE label < 5)"


@query("p08_reference_spread", f"WITH {EMB}, {sql_spread('emb', 'vec_id')} SELECT (SELECT count(*) FROM emb) AS n, round(d_ref, 6) + 0.0 AS d_ref FROM spread")
def p08(spark, d):
    return with_r6(distance.reference_spread(vectors(spark, d)), ["d_ref"])


@query(
    "p08_spread_fingerprints",
    f"WITH {HUMAN}, v AS (SELECT dialog_id, {sql_list(FEATURES)} AS vec FROM fp WHERE n_messages >= 2), {sql_spread('v', 'dialog_id')} "
    "SELECT (SELECT count(*) FROM v) AS n, round(d_ref, 6) + 0.0 AS d_ref FROM spread",
)
def p08b(spark, d):
    cloud = stats.assemble(individual_fingerprints(humans(spark, d)))
    return with_r6(distance.reference_spread(cloud), ["d_ref"])


@query(
    "p09_chamfer",
    f"WITH {EMB}, {HP}, {sql_spread('h', 'vec_id')}, {sql_chamfer('p', 'vec_id', 'h', 'vec_id', 'one')} "
    "SELECT round(chamfer, 6) + 0.0 AS chamfer FROM cham",
)
def p09(spark, d):
    v = vectors(spark, d)
    h, p = v.where("label >= 5"), v.where("label < 5")
    return with_r6(distance.overall_chamfer(p, h, distance.reference_spread(h)), ["chamfer"])




@query(
    "p09_chamfer_standardised",
    f"WITH {HUMAN}, {SIM}, {sql_scaler('fp')}, h AS (SELECT dialog_id, {sql_z()} AS vec FROM fp CROSS JOIN scaler), "
    f"p AS (SELECT 0 AS one, dialog_id, {sql_z()} AS vec FROM s_fp CROSS JOIN scaler), {sql_spread('h', 'dialog_id')}, "
    f"{sql_chamfer('p', 'dialog_id', 'h', 'dialog_id', 'one')} SELECT round(chamfer, 6) + 0.0 AS chamfer FROM cham",
)
def p09b(spark, d):
    h, p = stats.assemble(settle(humans(spark, d), "humans")), stats.assemble(settle(simulated(spark, d), "simulated"))
    s = stats.fit_scaler(h, len(FEATURES))
    h, p = stats.apply_scaler(h, s, len(FEATURES)), stats.apply_scaler(p, s, len(FEATURES))
    return with_r6(distance.overall_chamfer(p, h, distance.reference_spread(h)), ["chamfer"])


@query(
    "p10_task_chamfer",
    f"WITH {EMB}, {HP}, {sql_spread('h', 'vec_id')}, {sql_chamfer('p', 'vec_id', 'h', 'vec_id', 'label')} "
    "SELECT round(avg(chamfer), 6) + 0.0 AS chamfer FROM cham",
)
def p10(spark, d):
    v = vectors(spark, d)
    h, p = v.where("label >= 5"), v.where("label < 5")
    return with_r6(distance.mean_task_chamfer(p, h, distance.reference_spread(h), "label"), ["chamfer"])


@query(
    "p10_chamfer_per_task",
    f"WITH {EMB}, {HP}, {sql_spread('h', 'vec_id')}, {sql_chamfer('p', 'vec_id', 'h', 'vec_id', 'label')} "
    "SELECT label, round(chamfer, 6) + 0.0 AS chamfer FROM cham",
)
def p10b(spark, d):
    v = vectors(spark, d)
    h, p = v.where("label >= 5"), v.where("label < 5")
    return with_r6(distance.chamfer(p, h, distance.reference_spread(h), "label"), ["chamfer"])


@query("p11_compress_cloud")
def p11(spark, d):
    return distance.compress_cloud(vectors(spark, d), 8).select(F.posexplode("vec").alias("pos", "value"))


def _projected(spark, d):
    h = stats.assemble(humans(spark, d)).select(F.lit("human").alias("label"), "vec")
    p = stats.assemble(simulated(spark, d)).select(F.lit("simulated").alias("label"), "vec")
    return distance.project_2d(h.unionByName(p), 19, basis=["human"])


@query(
    "p11_parted_clusters",
    "SELECT label, round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS m1, round(avg(embedding[2]::DOUBLE), 6) + 0.0 AS m2 FROM embeddings GROUP BY label",
)
def p11b(spark, d):
    """As many well-parted clusters as centroids: the centroids are the means of the clusters."""
    far = F.array(F.col("label") * 1000.0, F.col("vec")[0], F.col("vec")[1])
    v = vectors(spark, d).select("label", far.alias("vec"))
    found = distance.compress_cloud(v, v.select("label").distinct().count()).select(
        F.round(F.col("vec")[0] / 1000).cast("int").alias("label"), F.col("vec")[1].alias("m1"), F.col("vec")[2].alias("m2")
    )
    return with_r6(found, ["m1", "m2"])


PAIR = """z AS (SELECT vec_id, label, (embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER () AS a,
  (embedding[2]::DOUBLE - avg(embedding[2]::DOUBLE) OVER ()) / stddev_pop(embedding[2]::DOUBLE) OVER () AS b FROM embeddings),
c AS (SELECT avg(a * b) AS r FROM z),
pc AS (SELECT vec_id, label, (a + sign(r) * b) / sqrt(2) AS pc1, (a - sign(r) * b) / sqrt(2) AS pc2, 50 * (1 + abs(r)) AS var1, 50 * (1 - abs(r)) AS var2 FROM z CROSS JOIN c)"""


def _pair(spark, d, name):
    v = vectors(spark, d).select(F.col(name).cast("string").alias("label"), F.slice("vec", 1, 2).alias("vec"))
    return distance.project_2d(v, 2)


@query(
    "p12_pair_projection",
    f"WITH {PAIR} SELECT vec_id::VARCHAR AS label, round(pc1 * pc1, 6) + 0.0 AS pc1, round(pc2 * pc2, 6) + 0.0 AS pc2, round(var1, 6) + 0.0 AS var1, round(var2, 6) + 0.0 AS var2 FROM pc",
)
def p12b(spark, d):
    """Two standardised features: the axes are their sum and difference, up to a sign."""
    pc = _pair(spark, d, "vec_id")
    squares = pc.withColumn("pc1", F.col("pc1") * F.col("pc1")).withColumn("pc2", F.col("pc2") * F.col("pc2"))
    return with_r6(squares, ["pc1", "pc2", "var1", "var2"])


@query(
    "p13_pair_centroids",
    f"WITH {PAIR} SELECT label::VARCHAR AS label, round(avg(pc1) * avg(pc1), 6) + 0.0 AS pc1, round(avg(pc2) * avg(pc2), 6) + 0.0 AS pc2 FROM pc GROUP BY label",
)
def p13b(spark, d):
    c = distance.centroids(_pair(spark, d, "label"), "label")
    return with_r6(c.select("label", (F.col("pc1") * F.col("pc1")).alias("pc1"), (F.col("pc2") * F.col("pc2")).alias("pc2")), ["pc1", "pc2"])


@query("p12_project_2d")
def p12(spark, d):
    return _projected(spark, d)


@query("p13_centroids")
def p13(spark, d):
    return distance.centroids(_projected(spark, d), "label")


@query(
    "p14_half_width",
    "SELECT user_id, round(CASE WHEN count(value) < 2 THEN 0.0 ELSE 1.96 * stddev_samp(value) / sqrt(count(value)) END, 6) + 0.0 AS ci "
    "FROM events GROUP BY user_id",
)
def p14(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r6(stats.half_width(F.col("value")), "ci"))
