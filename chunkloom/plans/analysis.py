"""Registered queries that analyse two builds, with their SQL.

Documents are packs whose extension tells the engine. In the new build each
language's files change in their own way: a frequent word everywhere, a shift,
an edit in the middle, or growth; benchmark items are new files. Sizes and
thresholds are those of the defaults, scaled down to the documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analysis, cost
from ..sources.builds import spread, table
from .sessions import shared_folder

T = analysis.Thresholds(advisory=3000, warning=8000, critical=20000, interesting=1000, scattered_windows=4, toc_runs=8, entropy=4.2, growth=2000)
FIXED, FINE, COARSE = 64, 64, 512
ENGINE_LEAST = 2000
PROFILES = [("fixed-64", "fixed", 64, 64, 64, 0), ("fixed-256", "fixed", 256, 256, 256, 0), ("fixed-1k", "fixed", 1024, 1024, 1024, 0)]


def _texts(spark, sf_dir):
    """Both builds as (path, content string)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang"))
    lang, half = F.col("lang"), F.floor(F.length("text") / 2).cast("int")
    ext = F.when(lang == "en", ".pak").when(lang == "de", ".assets").when(lang == "fr", ".pck").when(lang == "es", ".bundle").otherwise(".txt")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path")
    edited = (
        F.when(lang == "en", F.replace("text", F.lit(" the "), F.lit(" THE "))).when(lang == "de", F.concat(F.lit(">>shift:"), "text"))
        .when(lang == "fr", F.concat(F.substr("text", F.lit(1), half), F.lit("#edit#"), F.substr("text", half + 7))).otherwise(F.concat("text", "text"))
    )
    added = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return d.select(path, F.col("text").alias("content")), d.select(path, edited.alias("content")).unionByName(added)


def _builds(spark, sf_dir):
    binary = lambda b: b.select("path", F.col("content").cast("binary").alias("content"))
    texts = _texts(spark, sf_dir)
    return *map(binary, texts), texts


def _signals(spark, sf_dir):
    old, new, texts = _builds(spark, sf_dir)
    return analysis.signals(old, new, FIXED, FINE, COARSE, analysis.delimited_chunks, texts)


def _kept_signals(spark, sf_dir):
    """The same, written once for plans that read them several times: a row a file."""
    root = f"{shared_folder(spark)}/signals"
    _signals(spark, sf_dir).write.parquet(root)
    return spark.read.parquet(root)


_HEAT = ("windows", "changed", "runs", "scatteredness", "span", "density", "mean_run")


def build_heat(spark, sf_dir):
    """Where in each file bytes differ, in windows of 512 bytes."""
    old, new, _ = _builds(spark, sf_dir)
    h = analysis.heat(old, new, {"h": COARSE})
    return h.select("path", *[scalars.rounded(F.col(f"h.{c}"), 9).alias(c) if c in _HEAT[3:] else F.col(f"h.{c}").alias(c) for c in _HEAT])


def build_signals(spark, sf_dir):
    x = _signals(spark, sf_dir)
    return x.select("path", "status", "is_pack", "old_size", "new_size", scalars.rounded("fixed_reuse", 9).alias("fixed_reuse"), scalars.rounded("cdc_reuse", 9).alias("cdc_reuse"), "fixed_download", "cdc_download", scalars.rounded("entropy", 6).alias("entropy"), F.col("fine.runs").alias("runs"), F.col("coarse.changed").alias("changed"))


def build_analysis(spark, sf_dir):
    """The whole comparison in one row."""
    old, new = _texts(spark, sf_dir)
    x = analysis.rollup(_signals(spark, sf_dir), old.select("path").join(new.select("path"), "path", "left_anti"))
    return x.withColumns({c: scalars.rounded(c, 9) for c in ("fixed_reuse", "cdc_reuse")})


def detector_findings(spark, sf_dir):
    """Most severe first, then by wasted bytes."""
    return analysis.detector_findings(_signals(spark, sf_dir), T).orderBy(F.desc("severity"), F.desc("wasted"), "path", "kind")


def build_findings(spark, sf_dir):
    return analysis.build_findings(_kept_signals(spark, sf_dir), T)


def layout_plan(spark, sf_dir):
    x = _kept_signals(spark, sf_dir)
    return analysis.layout_plan(analysis.detector_findings(x, T).unionByName(analysis.build_findings(x, T)), x)


def engine_hint(spark, sf_dir):
    return analysis.engine_hint(_signals(spark, sf_dir), least=ENGINE_LEAST)


def engine_hint_forced(spark, sf_dir):
    """No file is as large as the default asks for, so the caller's engine is taken."""
    return analysis.engine_hint(_signals(spark, sf_dir), forced="unity")


def profile_sweep(spark, sf_dir):
    """Fixed-size profiles measured on both builds."""
    old, new, _ = _builds(spark, sf_dir)
    return analysis.profile_sweep(old, new, PROFILES, unit=1)


def profile_sweep_compressed(spark, sf_dir):
    """Content-defined profiles beside a fixed one, with zstd at level 3."""
    old, new, _ = _builds(spark, sf_dir)
    return analysis.profile_sweep(old, new, [*PROFILES[1:2], ("cdc-256", "cdc", 64, 256, 1024, 1), ("cdc-1k", "cdc", 256, 1024, 4096, 1)], level=3, unit=1)


def profile_estimates(spark, sf_dir):
    x = cost.profile_estimates(profile_sweep(spark, sf_dir), 1.0)
    return x.select("profile", "chunks", *[F.col(c).cast("long").alias(c) for c in ("storage", "cold", "update")], "manifest", "reuse").withColumnRenamed("update", "update_bytes")


def profile_score(spark, sf_dir):
    return cost.score_profiles(cost.profile_estimates(profile_sweep(spark, sf_dir), 1.0), "live").select("profile", "score", "best")


QUERIES = {f.__name__: f for f in (build_heat, build_signals, build_analysis, detector_findings, build_findings, layout_plan, engine_hint, engine_hint_forced, profile_sweep, profile_sweep_compressed, profile_estimates, profile_score)}

_BUILDS = """d as (select source || '/' || doc_id || case lang when 'en' then '.pak' when 'de' then '.assets' when 'fr' then '.pck' when 'es' then '.bundle' else '.txt' end as path, lang, coalesce(text, '') as text from documents),
old as (select path, text as content from d),
new as (select path, case lang when 'en' then replace(text, ' the ', ' THE ') when 'de' then '>>shift:' || text when 'fr' then substr(text, 1, length(text) // 2) || '#edit#' || substr(text, length(text) // 2 + 7) else text || text end as content from d
  union all select 'bench/' || item_id || '.txt', text from benchmark),
oh as (select path, hex(encode(content)) as h from old), nh as (select path, hex(encode(content)) as h from new)"""


def _heat(name: str, size: int) -> str:
    return f"""{name}_w as (select path, i, substr(o, i * {2 * size} + 1, {2 * size}) as a, substr(n, i * {2 * size} + 1, {2 * size}) as b from (select path, coalesce(oh.h, '') as o, coalesce(nh.h, '') as n from oh full join nh using (path)), unnest(range(0, (greatest(length(o), length(n)) // 2 + {size - 1}) // {size})) u(i)),
{name}_c as (select path, i, greatest(length(a), length(b)) // 2 as len, i - row_number() over (partition by path order by i) as island,
  abs(length(a) - length(b)) // 2 + coalesce(list_sum(list_transform(range(0, least(length(a), length(b)) // 2), lambda k: (substr(a, 2 * k + 1, 2) <> substr(b, 2 * k + 1, 2))::int)), 0) as differ from {name}_w where a <> b),
{name}_t as (select path, count(*) as windows from {name}_w group by path),
{name} as (select path, windows, coalesce(changed, 0) as changed, coalesce(runs, 0) as runs, case when changed > 1 then (runs - 1) / (changed - 1)::double else 0.0 end as scatteredness, coalesce((hi - lo + 1) / windows::double, 0.0) as span, coalesce(density, 0.0) as density, coalesce(changed / runs::double, 0.0) as mean_run
  from {name}_t left join (select path, count(*) as changed, count(distinct island) as runs, min(i) as lo, max(i) as hi, sum(differ) / sum(len)::double as density from {name}_c group by path) using (path))"""


_SIGNALS = f"""{_BUILDS}, {_heat('fine', FINE)}, {_heat('coarse', COARSE)},
b as (select path, substr(h, i * {2 * FIXED} + 1, {2 * FIXED}) as hash, length(substr(h, i * {2 * FIXED} + 1, {2 * FIXED})) // 2 as len, is_new from (select *, 0 as is_new from oh union all select *, 1 from nh), unnest(range(0, (length(h) // 2 + {FIXED - 1}) // {FIXED})) u(i)),
c as (select path, hash, max(len) as len, count(*) filter (is_new = 0) as n_old, count(*) filter (is_new = 1) as n_new from b group by all),
fx as (select path, sum(n_old) as o, sum(n_new)::bigint as n_chunks, count(*) filter (n_old > 0) as k, sum(case when n_old = 0 then n_new else 0 end)::bigint as new_chunks, sum(case when n_old = 0 then n_new * len else 0 end)::bigint as fixed_download, sum(n_old * len)::bigint as old_size, sum(n_new * len)::bigint as new_size from c group by path),
oc as (select path, unnest(regexp_extract_all(content, '(?s)[^.]*\\.|[^.]+')) as piece from old), nc as (select path, unnest(regexp_extract_all(content, '(?s)[^.]*\\.|[^.]+')) as piece from new),
cd as (select path, 1 - count(*) filter (not known) / count(*)::double as cdc_reuse, sum(case when known then 0 else strlen(piece) + 36 end)::bigint as cdc_download from (select *, piece in (select piece from oc) as known from nc) group by path),
ub as (select path, v, count(*) as n from (select path, unnest(regexp_extract_all(h, '..')) as v from nh) group by all), ut as (select path, sum(n) as t from ub group by path),
en as (select path, sum(-(n / t::double) * log2(n / t::double)) as entropy from ub join ut using (path) group by path),
f as (select path, case when o = 0 then 'added' when new_chunks = 0 and k = n_chunks and old_size = new_size then 'unchanged' else 'modified' end as status, path not like '%.txt' as is_pack, old_size, new_size, 1 - new_chunks / greatest(n_chunks, 1)::double as fixed_reuse,
  coalesce(cdc_reuse, 1.0) as cdc_reuse, fixed_download, coalesce(cdc_download, 0) as cdc_download, coalesce(entropy, 0.0) as entropy from fx left join cd using (path) left join en using (path) where n_chunks > 0),
g as (select f.*, fine.runs, fine.mean_run, fine.density, fine.span, fine.changed as fine_changed, coarse.changed, coarse.scatteredness, greatest(fixed_download - cdc_download, 0)::bigint as w, status = 'modified' and new_size >= {T.interesting} as seen from f join fine using (path) join coarse using (path)),
t as (select *, seen and runs >= {T.toc_runs} and mean_run <= {T.toc_mean_run} and density < {T.toc_density} and span >= {T.toc_span} as toc from g),
fi as (select path, 'oversized_pack' as kind, case when new_size > {T.critical} then 3 when new_size > {T.warning} then 2 else 1 end as severity, 0::bigint as wasted from t where is_pack and new_size > {T.advisory}
  union all select path, 'toc_churn', 3, w from t where toc
  union all select path, 'scattered_pack_churn', case when new_size > {T.advisory} then 3 else 2 end, w from t where seen and not toc and is_pack and changed >= {T.scattered_windows} and scatteredness >= {T.scattered}
  union all select path, 'asset_shuffling', 3, w from t where seen and cdc_reuse - fixed_reuse > {T.shuffle_gap}
  union all select path, 'compressed_blob', 2, fixed_download from t where seen and entropy >= {T.entropy} and fixed_reuse < 0.20 and cdc_reuse < 0.25),
bf as (select null::varchar as path, 'metadata_churn' as kind, 2 as severity, sum(fixed_download)::bigint as wasted from t where status = 'modified' and new_size = old_size and fine_changed between 1 and {T.metadata_windows} having count(*) >= {T.metadata_files}
  union all select path, 'new_content_in_old_pack', 2, greatest(fixed_download - (new_size - old_size), 0)::bigint from t where is_pack and status = 'modified' and new_size - old_size >= {T.growth} and (select coalesce(sum(new_size), 0) from t where status = 'added') < (new_size - old_size) // 4)"""
_SWEEP = f"""{_BUILDS}, pr(profile, size) as (values {', '.join(f"('{p[0]}', {p[3]})" for p in PROFILES)}),
pc as (select profile, is_new, substr(h, i * 2 * size + 1, 2 * size) as hash from (select *, 0 as is_new from oh union all select *, 1 from nh), pr, unnest(range(0, (length(h) // 2 + size - 1) // size)) u(i)),
pg as (select profile, hash, length(hash) // 2 as len, count(*) filter (is_new = 1) as n, count(*) filter (is_new = 0) as o from pc group by profile, hash),
ps as (select profile, sum(n)::bigint as chunks, count(*) as unique_chunks, sum(len)::bigint as bytes, count(*) filter (o = 0) as new_chunks, coalesce(sum(len) filter (o = 0), 0)::bigint as new_bytes from pg where n > 0 group by profile)"""
_ADVICE = f"(values {', '.join(f"('{k}', '{a}')" for k, a in analysis.ADVICE)}) a(kind, advice)"

ORACLE_SQL = {
    "build_heat": f"with {_BUILDS}, {_heat('h', COARSE)} select path, windows, changed, runs, round(scatteredness, 9) as scatteredness, round(span, 9) as span, round(density, 9) as density, round(mean_run, 9) as mean_run from h",
    "build_signals": f"with {_SIGNALS} select path, status, is_pack, old_size, new_size, round(fixed_reuse, 9) as fixed_reuse, round(cdc_reuse, 9) as cdc_reuse, fixed_download, cdc_download, round(entropy, 6) as entropy, runs, changed from t",
    "build_analysis": f"""with {_SIGNALS} select sum(new_size)::bigint as new_size, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'modified') as modified, count(*) filter (status = 'added') as added, sum(fixed_download)::bigint as fixed_download, sum(cdc_download)::bigint as cdc_download,
        (select count(*) from old where path not in (select path from new)) as deleted, round(greatest(0.0, 1 - sum(fixed_download) / sum(new_size)::double), 9) as fixed_reuse, round(greatest(0.0, 1 - sum(cdc_download) / sum(new_size)::double), 9) as cdc_reuse from t""",
    "detector_findings": f"with {_SIGNALS} select * from fi",
    "build_findings": f"with {_SIGNALS} select * from bf",
    "layout_plan": f"with {_SIGNALS}, x as (select * from fi union all select * from bf) select x.path, x.kind, severity, advice, coalesce(fixed_download, wasted)::bigint as now, coalesce(cdc_download, 0)::bigint as after from x join {_ADVICE} using (kind) left join t on t.path = x.path",
    "engine_hint": f"""with {_SIGNALS} select case regexp_extract(path, '\\.([a-z]+)$', 1) when 'pak' then 'unreal' when 'pck' then 'godot' else 'unity' end as engine, path from t where status <> 'unchanged' and fixed_reuse < 0.6 and new_size > {ENGINE_LEAST} and path not like '%.txt' order by path limit 1""",
    "engine_hint_forced": "select 'unity' as engine, null::varchar as path",
    "profile_sweep": f"with {_SWEEP} select * from ps",
    "profile_estimates": f"with {_SWEEP} select profile, chunks, bytes as storage, bytes + chunks * 78 as cold, new_bytes + chunks * 78 as update_bytes, chunks * 36 as manifest, round(1 - new_bytes / bytes::double, 9) as reuse from ps",
    "profile_score": f"with {_SWEEP}, s as (select profile, round((bytes + chunks * 78) * 0.2::double + (new_bytes + chunks * 78) * 0.4::double + bytes * 0.15::double + chunks * 36 * 0.1::double + 64000.0::double * 3 * 0.1::double, 6) as score from ps) select *, row_number() over (order by score, profile) = 1 as best from s",
}
