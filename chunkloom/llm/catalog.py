"""Registered queries of this subpackage, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, edit_fingerprint, language_id, mixing, secret_scan, sharding, simhash_dedup, substring_dedup, url_filter
from .common import table

#: Verdict, host and path start, as the contract of the url query gives them.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from what was written."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    turns = own.unionByName(probe).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    out = chat_format.format_chats(turns)
    read = out.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "attachment_tokens")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "attachment_tokens",
    )


OP1_SQL = r"""
with own as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/s>|s>|INST\]|/INST\])', '\1\\\2', 'g') as er,
  regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/s>|s>|INST\]|/INST\])', '\1\\\2', 'g') as et from own)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(er) + length(et) + 23)::bigint as formatted_chars, 0::bigint as attachment_tokens
from t group by conv_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    x = mixing.mix(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.round("mix_target", 6).alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").cast("long").alias("copies"))


OP2_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('17:' || coalesce(doc_id::varchar, '')) as h from documents),
c as (select *, case when size <= 0 then -1 else len(bin(size)) * 8 + ((size * 16) >> len(bin(size))) - 8 end as cls from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::double as w, 3.0 * source_size::double as cap from s),
l as (select *, cap / w as full_at, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, source is null, encode(source) rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, coalesce((select level from l where level <= full_at order by full_at limit 1) * w, cap)) as target from l),
u as (select *, coalesce(round(target / nullif(source_size, 0) * 67108864.0), 0)::bigint as step,
  ('0x' || substr(md5('17/' || coalesce('s' || source, '')), 1, 6))::bigint * 4 as off from t),
r as (select c.*, u.source_size, u.target, u.step, row_number() over (partition by c.source order by cls, h, size) * step + off as reached from c join u on c.source is not distinct from u.source)
select doc_id, size, source_size, round(target, 6) as target, (size * ((reached >> 26) - ((reached - step) >> 26)))::bigint as taken, ((reached >> 26) - ((reached - step) >> 26))::bigint as copies from r
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, read from the shuffled records."""
    x = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    key = F.xxhash64(F.lit(29), F.lit("shard"), "doc_id")
    return x.select("doc_id", sharding.record_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(key, 25).alias("grown_shard"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then host reputation from the labels that carry a page's id."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = pages.join(labels.select("doc_id", bad.alias("bad")), F.col("page_id") == F.col("doc_id")).select("url", "bad")
    x = url_filter.judge(pages, outcomes, URL_RULES)
    return x.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_labels").alias("host_labels"), F.col("url_bound").alias("bound"))


def _op4_strength(counts: str) -> str:
    """A scalar query for the prior strength of the groups in ``counts`` (n, k, m)."""
    return f"""(select case when coalesce(g, 0) = 0 or t = 0 then 1000.0 when (x - g) / t <= 1.0 / 1001.0 then 1000.0 when (x - g) / t >= 0.5 then 1.0 else 1.0 / ((x - g) / t) - 1.0 end
  from (select sum(round((k - n * m) ** 2 / (n * m * (1 - m)), 9)::decimal(30, 9))::double as x, count(*)::double as g, sum(n - 1)::double as t from {counts} where n > 0 and m > 0 and m < 1))"""


def _op4_bound(a: str, n: str) -> str:
    return f"greatest(0.0, ({a}) / ({n}) - 1.645 * sqrt(({a}) / ({n}) * (1 - ({a}) / ({n})) / ({n} + 1)))"


_SLD = "|".join(url_filter.SECOND_LEVEL)
OP4_SQL = rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
b as (select p.host, case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end as bad from p join labels on page_id = doc_id),
n0 as (select distinct host, regexp_extract(host, '((?:[^.]+\.)?(?:(?:{_SLD})\.[a-z]{{2}}|[^.]*))$', 1) as domain from p),
names as (select host, domain, case when regexp_matches(domain, '(^|\.)({_SLD})\.[a-z]{{2}}$') then regexp_extract(domain, '((?:{_SLD})\.[a-z]{{2}})$', 1) else regexp_extract(domain, '([^.]*)$', 1) end as suffix from n0),
h as (select host, domain, suffix, count(*)::double as n, sum(bad)::double as k from b join names using (host) where bad is not null group by all),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k, (select case when sum(n) > 0 then (sum(k) + 0.5) / (sum(n) + 1.0) else 0.0 end from d) as m from d group by suffix),
s0 as (select {_op4_strength('s')} as v),
sr as (select suffix, (k + v * m) / (n + v) as m from s, s0),
dm as (select d.domain, d.n, d.k, sr.m from d join sr using (suffix)),
s1 as (select {_op4_strength('dm')} as v),
dr as (select domain, (k + v * m) / (n + v) as m from dm, s1),
hm as (select h.host, h.n, h.k, dr.m from h join dr using (domain)),
s2 as (select {_op4_strength('hm')} as v),
hr as (select host, n, {_op4_bound('k + v * m', '(n + v)')} as bound from hm, s2),
a as (select names.host, coalesce(hr.n, 0)::bigint as host_labels, round(coalesce(hr.bound, {_op4_bound('v * dr.m', 'v')}, {_op4_bound('v * sr.m', 'v')},
  (select greatest(0.0, m - 1.645 * sqrt(m * (1 - m) / (v + 1))) from (select case when count(*) > 0 then (sum(k) + 0.5) / (sum(n) + 1.0) else 0.0 end as m from d))), 6) as bound
  from names cross join s2 left join hr using (host) left join dr using (domain) left join sr using (suffix)),
r as (select p.*, case when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
  when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
  when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
  when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
  when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from p)
select r.page_id, r.host, r.path, r.rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when bound > 0.2 then 'block' else 'allow' end as verdict, host_labels, bound
from r join a using (host)
"""

def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and linked group of every document."""
    x = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes, and its repeated passages of over 50 words."""
    x = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, words=51)
    digests = ["doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return x.select(*digests, F.size("passages").cast("long").alias("n_passages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base matches, and weak parts that complete each other."""
    x = secret_scan.scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return x.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_mixing, op3_sharding, op4_url_filter, op5_simhash_dedup, op6_substring_dedup, op7_secret_scan, op8_language_id, op9_edit_fingerprint, op10_decontaminate)}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op2_mixing": OP2_SQL, "op4_url_filter": OP4_SQL}
