"""The queries of the numbered operators and the pipeline, and their SQL where SQL can express them.

Each applies its operator, with production parameters, to its whole table; what it gives for nulls, empty and very long texts, ties,
repeated rows, empty tables and other columns is said at the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import divergence, licenses, merkle, mixing, packing, quality, resampling, secretscan, simhash, tokencount, topk, toxicity, urls
from tidemark.llm.shared import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_offending"), F.get("spans", F.lit(0))["start"].alias("first_offending"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch", "place")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(table(spark, sf_dir, "documents"))


NUMBERED = (op1_mixing, op2_toxicity, op3_fingerprints, op4_quality, op5_url_filter, op6_top_k, op7_simhash, op8_packing, op9_token_counts, op10_licenses, op11_divergence, op12_resampling, op13_secrets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NUMBERED} | {"pipeline": corpus_pipeline.run}


OP5_SQL = r"""
with parts as (
  select page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), cut as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits as (
  select c.page_id, r.verdict, r.rule_host || r.rule_path as rule,
         row_number() over (partition by c.page_id order by length(r.rule_host || r.rule_path) desc, length(r.rule_host) desc) as place
  from cut c join rules r
    on (c.host = r.rule_host or ends_with(c.host, '.' || r.rule_host)) and starts_with(c.path, r.rule_path)
)
select c.page_id, coalesce(c.host, '') as host, coalesce(c.path, '') as path, f.rule, coalesce(f.verdict, 'allow') as verdict
from cut c left join fits f on f.page_id = c.page_id and f.place = 1
"""

OP6_SQL = """
with good as (
  select row_number() over () as line, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), scored as (
  select q.line, q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from good q join good c on q.vec_id % 20 = 0 and q.line <> c.line and len(q.v) = len(c.v)
), ranked as (
  select *, row_number() over (partition by line order by score desc, vec_id) as place from scored
)
select query_id, place::int as rank, vec_id, score from ranked where place <= 20
"""


OP11_SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), groups as (
  select distinct lang, source from docs
), seen as (
  select id, lang, source, unnest(terms) as term from docs
), kept as (
  select lang, term, count(*) as n from seen group by lang, term having count(distinct id) >= 3
), of_lang as (
  select lang, count(*) as v, sum(n)::hugeint as total from kept group by lang
), counts as (
  select s.lang, s.source, s.term, count(*) as n from seen s join kept k on s.lang = k.lang and s.term = k.term group by all
), totals as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from groups g left join counts c on g.lang = c.lang and g.source = c.source group by all
), shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
         1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + o.v) as p,
         1 + 1000000000::hugeint * (k.n + 1) // (o.total + o.v) as whole
  from totals t join of_lang o on t.lang = o.lang join kept k on k.lang = t.lang
       left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
       left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, ((p - whole) * (p - whole) // whole)::bigint from shares where n > 0 and p > whole
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""


#: CRC-32 of each different feature by the reflected polynomial, a bit at a time; all else is counts.
OP12_SQL = r"""
with docs as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), goal as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), of_docs as (
  select id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from docs
), of_goal as (
  select unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from goal
), bytes(byte, rest) as (
  select b, list_reduce(list_concat([b::bigint], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) from range(256) t(b)
), crcs as (
  select list(rest order by byte) as of_byte from bytes
), hexes as (
  select feature, hex(encode(feature)) as digits from (select feature from of_docs union select feature from of_goal)
), named as (
  select feature, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint)),
                                              lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1]))) % 10000 as bucket
  from hexes, crcs
), s as (
  select bucket, count(*) as n from of_docs join named using (feature) group by bucket
), t as (
  select bucket, count(*) as n from of_goal join named using (feature) group by bucket
), sums as (
  select coalesce((select sum(n) from s), 0)::double as s_all, coalesce((select sum(n) from t), 0)::double as t_all
), gains as (
  select b as bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (s_all + 10000) / ((coalesce(s.n, 0) + 1.0::double) * (t_all + 10000))))::bigint as gain
  from range(10000) r(b) cross join sums left join s on s.bucket = b left join t on t.bucket = b
), weights as (
  select id, count(*) as n_features, sum(gain)::bigint as total from of_docs join named using (feature) join gains using (bucket) group by id
), scored as (
  select d.id, d.doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as weight,
         ('0x' || substr(sha256('7:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h
  from docs d left join weights w on d.id = w.id
), noisy as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored
), ranked as (
  select id, row_number() over (order by score desc, doc_id) as place from noisy where n_words >= 20
)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score, case when place <= 25 * (select count(*) from ranked) // 100 then place end as rank
from noisy left join ranked using (id)
"""


def _op13_sql() -> str:
    """Ends of matches are running sums of the lengths of what lies between matches and of the matches."""
    rules = "\nunion all\n".join(
        f"select {i} as no, '{kind}' as kind, id, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}', 0) as found, regexp_extract_all(text, '{p}', {rule.group}) as part, {rule.least} as least from docs where contains(text, '{rule.holds}') and regexp_matches(text, '{p}')"
        for i, (kind, rule) in enumerate(secretscan.RULES.items())
        for p in [rule.pattern.replace("'", "''")]
    )
    return f"""
with docs as (
  select row_number() over () as id, doc_id, coalesce(text, '') as text from documents
), runs as (
{rules}
), pieces as (
  select no, kind, id, least, unnest(range(1, len(found) + 1)) as k, gaps, found, part from runs where len(found) > 0
), placed as (
  select no, kind, id, length(part[k]) >= least as kept, length(found[k]) as size,
         sum(length(gaps[k]) + length(found[k])) over (partition by no, id order by k)::bigint as upto
  from pieces
), spans as (
  select no, kind, id, upto - size as start, kind || ':' || (upto - size) || ':' || upto as told from placed where kept
), by_doc as (
  select id, count(*) filter (where no = 0) as n_assign, count(*) filter (where no = 1) as n_access, count(*) filter (where no = 2) as n_hex,
         string_agg(told, ',' order by start, no) filter (where no < 3) as base, string_agg(told, ',' order by start, no) as spans
  from spans group by id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join by_doc b on d.id = b.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op6_top_k": OP6_SQL, "op11_divergence": OP11_SQL, "op12_resampling": OP12_SQL, "op13_secrets": _op13_sql()}
