"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontam, hard_negatives, html_text, language_id, near_dedup, quality, runs, sharding, substring,
               token_counts, topk, url_reputation)
from .common import held_out, read_table


TOKENIZER = "word_bpe_49k.json"


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    words = language_id.fit(docs)
    return language_id.identify(docs, words).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sharding.shard(docs, shards=40)


def op4_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op5_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), 20, is_query=lambda i: i % 20 == 0)


OP5_SQL = """
with v as (select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return near_dedup.near_duplicates(docs, k=3, threshold=0.85).drop("text_key")


OP6_SQL = r"""
with recursive d as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end)) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
    join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
    where 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
    group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on r.other = l.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.other) as component_id,
  d.doc_id = min(r.other) as kept
from d join r using (doc_id) left join n using (doc_id) group by d.doc_id
"""


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled where its url ends in the number of a labelled
    document; it is bad if that is of low quality or toxic."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    number = F.regexp_extract(url_reputation.host_path(F.col("url"))[1], "^/[a-z]+/([0-9]{1,18})", 1)
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    outcomes = pages.select(F.col("page_id").alias("id"), F.when(number != "", number).cast("long").alias("doc_id")) \
        .join(known, "doc_id").select("id", "bad")
    return url_reputation.judge(pages, outcomes, URL_RULES) \
        .select("page_id", "host", "path", "rule", "verdict", F.round("bad_bound", 6).alias("bad_bound"))


OP7_SQL = r"""
with known as (select doc_id, max(greatest(1 - quality, toxic)) as bad from labels group by doc_id),
p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
o as (select page_id, max(bad) as bad from p join known
        on try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') as bigint) = doc_id
        where bad is not null group by page_id),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join o using (page_id) group by host),
h1 as (select *, regexp_extract(host, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))$', 1) as found from h0),
h2 as (select host, n, bad, case when found = '' then host else found end as domain from h1),
h as (select *, regexp_replace(domain, '^[^.]*\.', '') as suffix from h2),
d as (select domain, sum(n) as n, sum(bad) as bad from h group by domain),
s as (select suffix, sum(n) as n, sum(bad) as bad from h group by suffix),
c as (select 'host' as level, n, bad from h union all select 'domain', n, bad from d
      union all select 'suffix', n, bad from s),
a as (select level, count(*) as k, sum(n)::double as t, sum(bad)::double as b, sum(bad * bad / n::double) as q,
        sum(n * n)::double as n2 from c where n > 0 group by level),
r as (select level, k, t, (q - b * b / t) / (k - 1) as btw, (b - q) / (t - k) as wth,
        (t - n2 / t) / (k - 1) as n0 from a),
r2 as (select level, k, t, (btw - wth) / (btw + (n0 - 1) * wth) as rho from r),
m as (select level, case when k > 1 and t > k and rho is not null and not isnan(rho)
        then (1 - greatest(1.0 / 1001, least(0.5, rho))) / greatest(1.0 / 1001, least(0.5, rho))
        else 20.0 end as m from r2),
g as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 10)::double as rate,
        coalesce((select m from m where level = 'suffix'), 20.0) as ms,
        coalesce((select m from m where level = 'domain'), 20.0) as md,
        coalesce((select m from m where level = 'host'), 20.0) as mh from h),
e as (select h.host, h.n + g.mh as mass, (h.bad + g.mh * ((d.bad + g.md * ((s.bad + g.ms * g.rate)
        / (s.n + g.ms))) / (d.n + g.md))) / (h.n + g.mh) as mean
      from h join d using (domain) join s using (suffix) cross join g),
v as (select page_id, p.host, path, mean - 1.645 * sqrt(mean * (1 - mean) / (mass + 1)) as bound,
        case when (p.host = 'www.example.com' or p.host like '%.www.example.com') and path like '/en/%'
               then 'www.example.com/en/'
             when (p.host = 'example.com' or p.host like '%.example.com') and path like '/en/%' then 'example.com/en/'
             when (p.host = 'net' or p.host like '%.net') and path like '/es/%' then 'net/es/'
             when (p.host = 'net' or p.host like '%.net') and path like '/fr/%' then 'net/fr/'
             when (p.host = 'com' or p.host like '%.com') and path like '/%' then 'com/' end as rule
      from p join e using (host))
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when bound > 0.25 then 'block' else 'allow' end as verdict, round(bound, 6) as bad_bound
from v
"""


def op8_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = quality.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontam.find_leaks(docs, items).drop("text_key")


def op11_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), is_anchor=lambda i: i % 100 == 0, scale=256)


OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum([p[1] * p[2] for p in list_zip(a.v, c.v)])::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r
  from s where same) where r <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score,
    s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512) \
        .select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def periodised(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where the unsigned crc32 h of the id ends in 0, the
    words from the (g % n)-th on, g = h div 10, repeat with a period of
    1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("h", F.coalesce(h, F.lit(1))).withColumn("g", F.expr("h div 10")) \
        .withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))) \
        .withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    period = F.expr("1 + (n - a) div (3 + g % 8)")
    word = F.expr("transform(sequence(0, n - 1), i -> w[if(i < a, i, cast(a + (i - a) % p as int))])")
    return chosen.withColumn("a", a).withColumn("p", period) \
        .select("doc_id", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op13_square_catchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return runs.digests(runs.find_runs(periodised(docs)))


QUERIES = {
    "op1_cross_parsing": op1_cross_parsing,
    "op2_bpe_digests": op2_bpe_digests,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_block_rules": op4_block_rules,
    "op5_norm_buckets": op5_norm_buckets,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_host_reputation": op7_host_reputation,
    "op8_collinear_chains": op8_collinear_chains,
    "op9_random_indexing": op9_random_indexing,
    "op10_templates": op10_templates,
    "op11_gnat": op11_gnat,
    "op12_prefix_counts": op12_prefix_counts,
    "op13_square_catchers": op13_square_catchers,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op5_norm_buckets": OP5_SQL,
    "op6_hyperminhash": OP6_SQL,
    "op7_host_reputation": OP7_SQL,
    "op11_gnat": OP11_SQL,
}
