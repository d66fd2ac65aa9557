"""Registered queries over bytes, names and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import chunking, compare, delta, integrity
from ..sources import builds
from ..sources.builds import SQL, table
from .store import _STORE, _ledger, _refs


def _bytes(build):
    return build.select("path", F.col("content").cast("binary").alias("content"))


def byte_entropy(spark, sf_dir):
    """Bits per byte of every old file."""
    return _bytes(builds.old_build(spark, sf_dir)).select("path", scalars.rounded(scalars.entropy(F.col("content")), 9).alias("entropy"))


def weak32_blocks(spark, sf_dir):
    """Block signatures: weak and strong hashes of 256-byte blocks of every old file."""
    return chunking.signature(_bytes(builds.old_build(spark, sf_dir)), 256)


def candidate_blocks(spark, sf_dir):
    """Aligned blocks of 512 bytes that the new build can copy, from the best old block of each."""
    return delta.two_stage_match(_bytes(builds.old_build(spark, sf_dir)), _bytes(builds.new_build(spark, sf_dir)), 512)


def cdc_chunks(spark, sf_dir):
    """Content-defined chunks of the new build's files."""
    return chunking.cdc_chunks(_bytes(builds.new_build(spark, sf_dir)), 128, 512, 2048, 1)


def cdc_update_estimate(spark, sf_dir):
    """Content-defined chunks to download for the files that the fixed model calls changed."""
    old, new = _bytes(builds.old_build(spark, sf_dir)), _bytes(builds.new_build(spark, sf_dir))
    changed = compare.file_estimates(builds.both_chunks(spark, sf_dir)).where("status in ('added', 'modified')").select("path")
    c = lambda b: chunking.cdc_chunks(b, 128, 512, 2048, 1)
    fresh = c(new).join(changed, "path", "left_semi").join(c(old).select("hash").distinct(), "hash", "left_anti")
    return fresh.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))


def cdc_coverage(spark, sf_dir):
    """Files whose content-defined chunks tile them and keep to their bounds."""
    b = _bytes(builds.new_build(spark, sf_dir))
    c = chunking.cdc_chunks(b, 128, 512, 2048, 1).groupBy("path").agg(F.sum("len").alias("covered"), F.max("len").alias("longest"))
    x = b.select("path", F.length("content").alias("size")).where("size > 0").join(c, "path", "left")
    return x.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("covered") == F.col("size")) & (F.col("longest") <= 2048)).alias("sound"))


def block_diff(spark, sf_dir):
    """Copies and inline bytes that make each new file from the old build."""
    ops = delta.block_diff(_bytes(builds.old_build(spark, sf_dir)), _bytes(builds.new_build(spark, sf_dir)), 256)
    return delta.plan_summary(ops)


def delta_round_trip(spark, sf_dir):
    """New files, and those that their plan rebuilds byte for byte."""
    old, new = _bytes(builds.old_build(spark, sf_dir)), _bytes(builds.new_build(spark, sf_dir))
    rebuilt = delta.apply_plan(old, delta.block_diff(old, new, 256)).select("path", F.sha2("content", 256).alias("h"))
    x = new.select("path", F.sha2("content", 256).alias("want")).join(rebuilt, "path", "left")
    return x.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("h") == F.col("want")).alias("equal"))


def reconstruct_files(spark, sf_dir):
    """New files put together from a store of distinct chunks."""
    new = builds.new_build(spark, sf_dir).where("length(content) > 0")
    n = F.floor((F.length("content") - 1) / 64).cast("int")
    pieces = new.select("path", F.explode(F.sequence(F.lit(0), n)).alias("ord"), "content").select("path", "ord", F.substr("content", F.col("ord") * 64 + 1, F.lit(64)).cast("binary").alias("data")).withColumn("hash", F.sha2("data", 256))
    got = delta.reconstruct(pieces.select("path", "ord", "hash"), pieces.groupBy("hash").agg(F.min("data").alias("data")))
    return got.select("path", F.sha2("content", 256).alias("digest"), "sound")


def merkle_root(spark, sf_dir):
    return chunking.merkle_roots(builds.new_chunks(spark, sf_dir))


def tree_hash(spark, sf_dir):
    b = builds.new_build(spark, sf_dir)
    return chunking.tree_hash(b.select("path", F.sha2("content", 256).alias("hash"), F.length("content").alias("size")))


def bloom_have(spark, sf_dir):
    """Chunks of the new build that a filter over the old one's takes for known: all known ones are among them."""
    known, new = (c(spark, sf_dir).select("hash").distinct() for c in (builds.old_chunks, builds.new_chunks))
    parts = max(1, -(-known.count() // delta.PART_KEYS))
    x = delta.filtered(new, delta.bloom_filters(known, parts), parts).join(known.withColumn("known", F.lit(True)), "hash", "left")
    return x.agg(F.count_if(F.col("known")).alias("known"), F.count_if(F.col("known") & F.col("maybe")).alias("found"), (F.count_if(F.col("known").isNull() & F.col("maybe")) * 50 < F.count_if(F.col("known").isNull())).alias("few_false"))


def stored_forms(spark, sf_dir):
    """Files stored compressed or raw, and those that load back the same."""
    b = _bytes(builds.old_build(spark, sf_dir)).withColumn("s", scalars.stored(F.col("content")))
    x = b.withColumn("back", scalars.loaded(F.col("s.form"), F.col("s.bytes")))
    return x.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("back") == F.col("content")).alias("equal"), F.count_if((F.col("s.form") == "raw") & (F.length("content") < 512)).alias("small_raw"))


def zstd_lengths(spark, sf_dir):
    """Compressed bytes by level and language."""
    b = builds.old_build(spark, sf_dir).select("language", F.col("content").cast("binary").alias("content"))
    return b.select("language", F.length("content").alias("raw"), *[scalars.compressed_length(F.col("content"), k).alias(f"z{k}") for k in (1, 3, 9)]).groupBy("language").agg(F.sum("raw").alias("raw"), *[F.sum(f"z{k}").alias(f"zstd_{k}") for k in (1, 3, 9)])



def _paths(spark, sf_dir):
    """Part names as paths in a tree with several extensions."""
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    ext = pick("pak", "txt", "PCK", "json", "zip", "", "tar")
    name = F.concat(pick("data", "bin", "logs", "..", "a b"), F.lit("/"), F.when(k % 3 == 0, "sub/").otherwise(""), F.lit("f"), k.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "part").select(k.alias("id"), name.alias("path"))


_PATHS_SQL = """p0 as (select p_partkey as id, ['pak', 'txt', 'PCK', 'json', 'zip', '', 'tar'][p_partkey % 7 + 1] as ext, ['data', 'bin', 'logs', '..', 'a b'][p_partkey % 5 + 1] as dir from part),
p as (select id, dir || '/' || case when id % 3 = 0 then 'sub/' else '' end || 'f' || id || case when ext = '' then '' else '.' || ext end as path, lower(ext) as ext from p0)"""


def path_predicates(spark, sf_dir):
    """Extension, pack or not, safe or not, and a file name for each path."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("id", scalars.extension(p).alias("ext"), scalars.is_pack(p).alias("pack"), scalars.path_is_safe(p).alias("safe"), scalars.safe_name(p).alias("name"))


def ignore_rules(spark, sf_dir):
    """Files that rules leave: no logs, nothing below a ``sub`` folder of data, no text files, and two anchored patterns."""
    return _paths(spark, sf_dir).where(~scalars.ignored(F.col("path"), ["logs/", "data/sub/", "*.txt", "# no rule", "bin/*7.zip", "**/f1?.json"]))


def glob_filter(spark, sf_dir):
    """Pages by the path-aware dialect, in which a star stays within a segment, and by the other."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.rlike(scalars.path_glob("http*://*/en/*")).alias("by_path"), u.rlike(scalars.path_glob("http*://**/*.html")).alias("deep"), u.rlike(scalars.version_glob("http*//*.org*")).alias("by_version"))


def natural_sort_versions(spark, sf_dir):
    """Documents of a source as versions, in the order of their numbers."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("v"), F.floor(F.col("n_chars") / 100).cast("string"), F.lit("."), F.col("doc_id").cast("string")).alias("version"))
    w = Window.partitionBy("source").orderBy(scalars.natural_key(F.col("version")), "version")
    return x.withColumn("place", F.row_number().over(w))


def human_sizes(spark, sf_dir):
    n = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 97
    return table(spark, sf_dir, "part").select("p_partkey", scalars.human_bytes(n).alias("size"))


def parsed_sizes(spark, sf_dir):
    """Sizes, budgets, percentages and levels read from labels."""
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("", "KiB", "MB", "g", "q")]), (k % 5 + 1).cast("int"))
    text = F.concat((k % 900).cast("string"), F.when(k % 2 == 0, ".5").otherwise(""), unit)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.parse_size(text).alias("size"), scalars.parse_budget(F.concat((k % 4).cast("string"), F.lit(".25x-latest-build")), F.lit(1_000_000)).alias("budget"), scalars.parse_percent(F.concat((k % 100).cast("string"), F.lit("%"))).alias("share"), scalars.compression_level(F.when(k % 3 == 0, "none").when(k % 3 == 1, F.concat(F.lit("zstd-"), (k % 20).cast("string"))).otherwise("lz4")).alias("level"))


def http_ranges(spark, sf_dir):
    """Range headers over files of 1,000 bytes."""
    a, b = F.col("l_partkey") % 1200, F.col("l_suppkey") * 13 % 1100
    header = F.concat(F.lit("bytes="), F.when(F.col("l_linenumber") == 1, "").otherwise(a.cast("string")), F.lit("-"), F.when(F.col("l_linenumber") == 2, "").otherwise(b.cast("string")), F.when(F.col("l_linenumber") == 3, ",7-8").otherwise(""))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.http_range(header, F.lit(1000).cast("long")).alias("r"))
    return x.groupBy("r.state").agg(F.count(F.lit(1)).alias("requests"), F.sum("r.first").alias("firsts"), F.sum("r.last").alias("lasts"))


def payload_kinds(spark, sf_dir):
    """Documents behind the first bytes of several formats, by kind."""
    k = F.col("doc_id")
    magic = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in ("47445043", "504B0304", "4F676753", "89504E47", "FFD8FFE0", "00000018667479706D", "1F8B08", "")]), (k % 8 + 1).cast("int"))
    x = table(spark, sf_dir, "documents").select(F.concat(F.lit("f."), F.when(k % 3 == 0, "txt").when(k % 3 == 1, "bin").otherwise("mp4")).alias("path"), F.concat(magic, F.col("text").cast("binary")).alias("content"))
    return x.groupBy(scalars.payload_kind(F.col("path"), F.col("content")).alias("kind"), scalars.archive_kind(F.col("content")).alias("archive")).agg(F.count(F.lit(1)).alias("files"))


def verify_install(spark, sf_dir):
    """The old build as an install against the new one."""
    h = lambda b: b.select("path", F.sha2("content", 256).alias("hash"))
    return integrity.verify_install(h(builds.old_build(spark, sf_dir)), h(builds.new_build(spark, sf_dir)))


def signature_differences(spark, sf_dir):
    """Distinct (path, hash) rows that one build's signature has and the other's lacks."""
    s = lambda c: c.select("path", "ord", "hash")
    return integrity.signature_differences(s(builds.old_chunks(spark, sf_dir)), s(builds.new_chunks(spark, sf_dir))).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


def certification_worst(spark, sf_dir):
    """Suppliers as phases, lines as checks."""
    k = (F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 400
    r = F.when(F.col("l_suppkey") % 10 == 0, "skipped").when(k == 0, "fail").when(k < 5, "warn").when(k < 20, "skipped").otherwise("pass")
    return integrity.worst(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("phase"), r.alias("result")), "phase")


def entry_counts(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 10 == 0, "dir").when(F.col("p_partkey") % 10 == 1, "symlink").otherwise("file")
    return integrity.entry_counts(table(spark, sf_dir, "part").select(kind.alias("kind"), F.when(kind == "file", F.col("p_size").cast("long")).otherwise(0).alias("size")))


def store_verify(spark, sf_dir):
    """Chunks whose stored text was altered: those whose hash ends in 00."""
    b = builds.old_build(spark, sf_dir)
    n = F.floor((F.length("content") - 1) / 64).cast("int")
    x = b.where("length(content) > 0").select(F.explode(F.sequence(F.lit(0), n)).alias("o"), "content").select(F.substr("content", F.col("o") * 64 + 1, F.lit(64)).alias("data")).distinct().withColumn("hash", F.sha2("data", 256))
    return integrity.corrupt_chunks(x.withColumn("data", F.when(F.endswith("hash", F.lit("00")), F.concat("data", F.lit("!"))).otherwise(F.col("data"))))


def doctor(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    sick = led.where("hash % 97 <> 0").withColumn("off", F.when(F.col("hash") % 50 == 0, F.col("off") - 10).otherwise(F.col("off"))).withColumn("len_stored", F.when(F.col("hash") % 80 == 0, 0).otherwise(F.col("len_stored")))
    return integrity.doctor(sick, _refs(spark, sf_dir), led.select("pack").distinct().where("pack <> 'Brand#11'"))


QUERIES = {f.__name__: f for f in (byte_entropy, weak32_blocks, candidate_blocks, cdc_chunks, cdc_update_estimate, cdc_coverage, block_diff, delta_round_trip, reconstruct_files, merkle_root, tree_hash, bloom_have, stored_forms, zstd_lengths, path_predicates, ignore_rules, glob_filter, natural_sort_versions, human_sizes, parsed_sizes, http_ranges, payload_kinds, verify_install, signature_differences, certification_worst, entry_counts, store_verify, doctor)}

_SIG = """{name} as (select path, i::int as block, (i * {size})::bigint as off, substr(h, i * {size} * 2 + 1, {size} * 2) as b from (select path, hex(encode(content)) as h from {build} {where}), unnest(range(0, (length(h) // 2 + {size} - 1) // {size})) u(i))"""

ORACLE_SQL = {
    "byte_entropy": f"""with {SQL}, h as (select path, hex(encode(content)) as h from old), u as (select path, unnest(regexp_extract_all(h, '..')) as b from h), b as (select path, b, count(*) as n from u group by all),
        t as (select path, sum(n) as t from b group by path), e as (select path, sum(-(n / t::double) * log2(n / t::double)) as e from b join t using (path) group by path) select path, round(coalesce(e, 0.0), 9) as entropy from old left join e using (path)""",
    "weak32_blocks": f"""with {SQL}, {_SIG.format(name='s', size=256, build='old', where='')}, l as (select *, list_transform(regexp_extract_all(b, '..'), lambda v: ('0x' || v)::bigint) as x from s)
        select path, block, off, len(x)::bigint as len, (list_sum(x) % 65536)::bigint + ((list_sum(list_transform(x, lambda v, i: v * (len(x) - i + 1))) % 65536)::bigint << 16) as weak, sha256(unhex(b)) as strong from l""",
    "candidate_blocks": f"""with {SQL}, {_SIG.format(name='o', size=512, build='old', where='')}, {_SIG.format(name='n', size=512, build='new', where='')},
        m as (select n.path, n.off as new_off, o.path as entry, o.off as old_off from n join o on n.b = o.b and length(o.b) = 1024),
        k as (select *, row_number() over (partition by path, new_off order by (path = entry) desc, old_off, entry) as k from m) select path, new_off, entry, old_off from k where k = 1""",
    "cdc_coverage": f"with {SQL} select count(*) as files, count(*) as sound from new where length(content) > 0",
    "delta_round_trip": f"with {SQL} select count(*) as files, count(*) filter (length(content) > 0) as equal from new",
    "reconstruct_files": f"with {SQL} select path, sha256(content) as digest, true as sound from new where length(content) > 0",
    "merkle_root": f"""with recursive {SQL}, t as (select path, list(hash order by ord) as l from nc group by path union all select path, list_transform(range(0, (len(l) + 1) // 2), lambda i: case when 2 * i + 2 <= len(l) then sha256(unhex(l[2 * i + 1] || l[2 * i + 2])) else l[2 * i + 1] end) from t where len(l) > 1)
        select path, l[1] as root from t where len(l) = 1""",
    "tree_hash": f"""with {SQL}, f as (select path, sha256(content) as hash, length(content) as size from new), p as (select substr(sha256(path), 1, 2) as part, sha256(string_agg(path || chr(10) || hash, chr(10) order by path, hash)) as h, count(*) as n, sum(size) as b from f group by 1)
        select sha256(string_agg(h, '' order by part, h)) as tree, sum(n)::bigint as files, sum(b)::bigint as bytes from p""",
    "bloom_have": f"with {SQL}, k as (select distinct hash from oc), n as (select distinct hash from nc) select count(*) as known, count(*) as found, true as few_false from n where hash in (select hash from k)",
    "stored_forms": f"with {SQL} select count(*) as files, count(*) as equal, count(*) filter (strlen(content) < 512) as small_raw from old",
    "path_predicates": f"with {_PATHS_SQL} select id, ext, ext in ('pak', 'pck', 'zip') as pack, path not like '../%' as safe, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') as name from p",
    "ignore_rules": f"with {_PATHS_SQL} select id, path from p where not (path like 'logs/%' or path like 'data/sub/%' or path like '%.txt' or regexp_full_match(path, 'bin/[^/]*7\\.zip') or regexp_full_match(path, '(.*/)?f1[^/]\\.json'))",
    "glob_filter": "select page_id, regexp_full_match(url, 'http[^/]*://[^/]*/en/[^/]*') as by_path, regexp_full_match(url, 'http[^/]*://(.*/)?[^/]*\\.html') as deep, url like 'http%//%.org%' as by_version from pages",
    "natural_sort_versions": "with x as (select source, n_chars // 100 as a, doc_id as b, 'v' || n_chars // 100 || '.' || doc_id as version from documents) select source, version, row_number() over (partition by source order by a, b)::int as place from x",
    "human_sizes": """with x as (select p_partkey, p_partkey * p_partkey * p_size * 97 as n from part) select p_partkey, case when n >= 1073741824 then printf('%.2f GiB', n / 1073741824.0::double) when n >= 1048576 then printf('%.2f MiB', n / 1048576.0::double) when n >= 1024 then printf('%.2f KiB', n / 1024.0::double) else n || ' B' end as size from x""",
    "parsed_sizes": """with x as (select p_partkey, (p_partkey % 900) + case when p_partkey % 2 = 0 then 0.5::double else 0 end as n, p_partkey % 5 as u from part)
        select p_partkey, case u when 0 then floor(n) when 1 then floor(n * 1024) when 2 then floor(n * 1048576) when 3 then floor(n * 1073741824) end::bigint as size, floor((p_partkey % 4 + 0.25::double) * 1000000)::bigint as budget, (p_partkey % 100)::double / 100 as share,
        case p_partkey % 3 when 0 then 0 when 1 then p_partkey % 20 end::int as level from x""",
    "http_ranges": """with x as (select l_linenumber as k, l_partkey % 1200 as a, l_suppkey * 13 % 1100 as b from lineitem),
        r as (select case when k = 3 then 'ignored' when k = 1 then case when b = 0 then 'unsatisfiable' else 'range' end when k = 2 then case when a >= 1000 then 'unsatisfiable' else 'range' end when a >= 1000 or a > least(b, 999) then 'unsatisfiable' else 'range' end as state,
          case when k = 1 then greatest(1000 - b, 0) else a end as f, case when k in (1, 2) then 999 else least(b, 999) end as l from x)
        select state, count(*) as requests, sum(f) filter (state = 'range')::bigint as firsts, sum(l) filter (state = 'range')::bigint as lasts from r group by state""",
    "payload_kinds": """with x as (select doc_id % 8 as m, doc_id % 3 as e from documents), y as (select case m when 0 then 'pck' when 1 then 'zip' when 2 then 'audio' when 3 then 'image' when 4 then 'image' when 5 then 'video' else case e when 0 then 'text' when 1 then 'other' else 'video' end end as kind,
        case m when 1 then 'zip' when 3 then 'png' when 6 then 'gzip' end as archive from x) select kind, archive, count(*) as files from y group by all""",
    "verify_install": f"with {SQL} select path, case when n.content is null then 'extra' when o.content is null then 'missing' when n.content = o.content then 'ok' else 'modified' end as state from old o full join new n using (path)",
    "signature_differences": f"with {SQL} select 'extra' as side, count(*) as rows from (select path, ord, hash from oc except all select path, ord, hash from nc) union all select 'missing', count(*) from (select path, ord, hash from nc except all select path, ord, hash from oc)",
    "certification_worst": """with x as (select l_suppkey as phase, (l_orderkey * 7 + l_suppkey) % 400 as k from lineitem), r as (select phase, case when phase % 10 = 0 then null when k = 0 then 3 when k < 5 then 2 when k < 20 then null else 0 end as r from x)
        select phase, case max(r) when 3 then 'fail' when 2 then 'warn' when 0 then 'pass' else 'skipped' end as result, count(*) as checks from r group by phase""",
    "entry_counts": "with x as (select case p_partkey % 10 when 0 then 'dir' when 1 then 'symlink' else 'file' end as kind, p_size::bigint as s from part) select kind, count(*) as entries, sum(case when kind = 'file' then s else 0 end)::bigint as bytes from x group by kind",
    "store_verify": f"with {SQL} select distinct hash from oc where hash like '%00'",
    "doctor": f"""with {_STORE}, s as (select hash, len_raw, case when hash % 80 = 0 then 0 else len_stored end as len_stored, pack, case when hash % 50 = 0 then off - 10 else off end as off from led where hash % 97 <> 0),
        e as (select *, lag(off + len_stored) over (partition by pack order by off) as e from s),
        c as (select 'references' as check_, count(*) as n from refs where hash not in (select hash from s) union all select 'lengths', count(*) from s where len_stored <= 0 or len_raw < len_stored
          union all select 'overlaps', count(*) from e where off < e union all select 'packs', count(distinct pack) from s where pack not in (select distinct p_brand from part where p_brand <> 'Brand#11'))
        select check_ as "check", n as problems, case when n = 0 then 'pass' else 'fail' end as result from c""",
}
