"""The registered queries of this subpackage: thin digests of the operators' results over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprint.llm import (
    alignment, bpe, extract, harmonic, language, packing, prefix_counts, product_codes, simhash, suffix_dedup, syncmers,
    voronoi_knn, warc,
)
from talkprint.llm.common import table, tokenizer_path

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


OP1_SQL = """
with v as (select vec_id, [floor(1024 * e::double) for e in embedding] as x from embeddings
           where embedding is not null and len([e for e in embedding if e is null or not isfinite(e)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op1_voronoi_top_k", OP1_SQL)
def op1(spark: SparkSession, d: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, d: str) -> DataFrame:
    digests = suffix_dedup.removal_digests(table(spark, d, "documents"))
    return digests.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


@query("op3_language_id")
def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language.train(docs.where(~language.held_out()))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query("op5_syncmer_fingerprints")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return syncmers.edit_study(table(spark, d, "documents"))


@query("op6_tag_path_extraction")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(table(spark, d, "pages"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op8_bpe_rank_array")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_decode_digests(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"))


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
firsts as (select digest, min(page_id) as first_id from p where n >= 100 group by digest)
select p.page_id, p.n as payload_bytes, p.digest as payload_digest,
       case when f.first_id is not null and p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
       case when f.first_id is not null and p.page_id is distinct from f.first_id then f.first_id end as refers_to
from p left join firsts f on p.digest = f.digest and p.n >= 100
"""


@query("op9_warc_normaliser", OP9_SQL)
def op9(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


@query("op10_prefix_token_counts")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op11_token_alignment")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return alignment.alignment_digests(
        table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


@query("op12_harmonic_packing")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


def _op13_sql(parts: int = 4, rounds: int = 4) -> str:
    """The rounds one after the other; squared distances by inner products of doubles, exact at this size."""
    assign = """a{0} as materialized (
  select p.row, p.part, arg_min(c.entry, list_inner_product(c.s, c.s) - 2 * list_inner_product(p.s, c.s) + p.q + c.entry / 1e6) as entry,
         min(list_inner_product(c.s, c.s) - 2 * list_inner_product(p.s, c.s) + p.q) as d
  from p join c{0} c on p.part = c.part group by p.row, p.part)"""
    move = """m{0} as (select a.part, a.entry, i, floor(sum(p.s[i]) / count(*)) as v
  from a{0} a join p using (row, part), range(1, 17) t(i) group by a.part, a.entry, i),
c{1} as materialized (select c.part, c.entry, coalesce(any_value(n.s), any_value(c.s)) as s from c{0} c
  left join (select part, entry, list(v order by i) as s from m{0} group by part, entry) n
    on c.part = n.part and c.entry = n.entry group by c.part, c.entry)"""
    steps = [assign.format(0)]
    for k in range(rounds):
        steps += [move.format(k, k + 1), assign.format(k + 1)]
    return f"""
with v as materialized (select row_number() over () as row, vec_id, label, [floor(1024 * e::double) for e in embedding] as x from embeddings
  where embedding is not null and len([e for e in embedding if e is null or not isfinite(e)]) = 0),
p as materialized (select row, cast(part as int) as part, x[part * 16 + 1:part * 16 + 16] as s, list_inner_product(s, s) as q
  from v, range({parts}) t(part)),
f as (select row, row_number() over (order by vec_id, x) - 1 as entry from v qualify entry < 256),
c0 as materialized (select p.part, f.entry, p.s from f join p using (row)),
{", ".join(steps)},
books as (select sha256(string_agg(cast(u.v as bigint)::varchar, ',' order by part, entry, u.i)) as h
  from (select part, entry, unnest(s) as v, generate_subscripts(s, 1) as i from c{rounds}) u),
e as (select row, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by row),
r as (select v.vec_id, e.code, e.error, cast(sum(e.error) over (partition by v.label) as bigint) as label_error from v join e using (row))
select r.*, books.h as codebooks_sha256 from r, books
"""


@query("op13_product_codes", _op13_sql())
def op13(spark: SparkSession, d: str) -> DataFrame:
    return product_codes.code_digests(table(spark, d, "embeddings"))
