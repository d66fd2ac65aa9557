"""Registered queries that compare two builds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare
from ..sources import builds
from ..sources.builds import SQL

BOTH = f"with {SQL}, b as (select *, 0 as is_new from oc union all select *, 1 from nc)"


def fixed_chunk_estimate(spark, sf_dir):
    """Files by bytes to download in the same-path fixed-chunk model."""
    return compare.file_estimates(builds.both_chunks(spark, sf_dir)).orderBy(F.desc("download"), "path")


_FILES = """
c as (select path, hash, max(len) as len, count(*) filter (is_new = 0) as n_old, count(*) filter (is_new = 1) as n_new from b group by all),
f as (select path, sum(n_old) as o, sum(n_new)::bigint as n_chunks, count(*) filter (n_old > 0) as d, sum(case when n_old = 0 then n_new else 0 end)::bigint as new_chunks,
  sum(case when n_old = 0 then n_new * len else 0 end)::bigint as download, sum(n_old * len)::bigint as old_size, sum(n_new * len)::bigint as new_size from c group by path),
files as (select path, case when n_chunks = 0 then 'deleted' when o = 0 then 'added' when new_chunks = 0 and d = n_chunks and old_size = new_size then 'unchanged' else 'modified' end as status,
  old_size, new_size, n_chunks, new_chunks, download from f)
"""


def fixed_chunk_totals(spark, sf_dir):
    return compare.build_estimate(builds.both_chunks(spark, sf_dir)).withColumn("reuse", scalars.rounded("reuse", 9))


def global_scope_estimate(spark, sf_dir):
    """The same with chunks looked up in the whole old build."""
    return compare.global_estimate(builds.both_chunks(spark, sf_dir)).select("chunks", "new_chunks", "new_bytes")


def distinct_fetch_bytes(spark, sf_dir):
    """What a client without a cache fetches: each missing chunk once."""
    return compare.global_estimate(builds.both_chunks(spark, sf_dir)).select("fetch_chunks", "fetch_bytes")


def depot_sharing_matrix(spark, sf_dir):
    chunks = builds.fixed_chunks(builds.old_build(spark, sf_dir), builds.CHUNK)
    return compare.sharing_matrix(chunks, least_shared=1024)


def classify_build(spark, sf_dir):
    return compare.classify(builds.both_chunks(spark, sf_dir))


def changes_only_preview(spark, sf_dir):
    """States with their files and bytes; unchanged files aren't listed."""
    c = compare.classify(builds.both_chunks(spark, sf_dir)).where("state <> 'SAME'")
    return c.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("fresh_bytes").alias("fresh_bytes"), F.sum("reused_bytes").alias("reused_bytes"))


def managed_deletions(spark, sf_dir):
    """Old paths that the new build no longer has."""
    return builds.old_build(spark, sf_dir).select("path").join(builds.new_build(spark, sf_dir).select("path"), "path", "left_anti")


def detect_renames(spark, sf_dir):
    return compare.renames(builds.both_chunks(spark, sf_dir))


def dedup_stats(spark, sf_dir):
    """Chunks of documents and pages in one store."""
    pages = builds.table(spark, sf_dir, "pages").select("url", "html")
    return compare.dedup_stats(builds.old_chunks(spark, sf_dir).select("hash", "len").unionByName(builds.fixed_chunks(pages, content="html").select("hash", "len")))


def content_dedup(spark, sf_dir):
    """Each chunk with its first place and its references; only those stored once for several."""
    return compare.first_occurrences(builds.old_chunks(spark, sf_dir), "path", "ord").where("refs > 1").select("hash", "len", "refs", "path", "ord")


def largest_contributor(spark, sf_dir):
    """The file with the largest download; the first of equals by path."""
    f = compare.file_estimates(builds.both_chunks(spark, sf_dir))
    return f.agg(F.min(F.struct((-F.col("download")).alias("d"), "path")).alias("m")).select(F.col("m.path").alias("path"), (-F.col("m.d")).alias("download"))


def depot_delta(spark, sf_dir):
    return compare.depot_delta(builds.both_chunks(spark, sf_dir))


def install_plan(spark, sf_dir):
    """Depots in a language or none, in order; the client holds those with an even number."""
    new, old = builds.new_chunks(spark, sf_dir), builds.old_chunks(spark, sf_dir)
    number = F.substring("depot", 4, 10).cast("int")
    depots = new.select("depot").distinct().select("depot", number.alias("pos"), (number % 2 == 0).alias("had"))
    return compare.install_plan(new.select("depot", "hash", "len"), old.where(number % 2 == 0).select("hash"), depots)


def availability_plan(spark, sf_dir):
    """Where each chunk of the new build comes from; the cache holds chunks of a third of the old files."""
    old = builds.old_chunks(spark, sf_dir)
    return compare.availability(builds.new_chunks(spark, sf_dir).select("path", "ord", "hash", "len"), old.where("cast(path as bigint) % 3 = 0"), old.where("cast(path as bigint) % 2 = 0"))


def rebuild_stats(spark, sf_dir):
    return compare.rebuild_stats(availability_plan(spark, sf_dir))


def manifest_missing_set(spark, sf_dir):
    """Missing chunks with their place in the store, whose packs are the depots of the new build."""
    old = builds.old_chunks(spark, sf_dir)
    new = builds.new_chunks(spark, sf_dir)
    missing = new.join(old.select("hash").distinct(), "hash", "left_anti")
    placed = new.groupBy("hash").agg(F.min(F.struct("depot", "path", "ord", "len")).alias("p")).select("hash", F.col("p.depot").alias("pack"), F.col("p.path").alias("at"), F.col("p.ord").alias("ord"), F.col("p.len").alias("len"))
    return compare.with_location(missing, placed).groupBy("pack").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"), F.count_if(~F.col("located")).alias("lost"))


def chunk_inventory(spark, sf_dir):
    """Languages as versions of a store, in alphabetical order."""
    return compare.inventory(builds.old_chunks(spark, sf_dir).withColumnRenamed("language", "version"))


def hash_set_operations(spark, sf_dir):
    """Union, intersection and differences of the hash sets of both builds."""
    c = compare.by_chunk(builds.both_chunks(spark, sf_dir))
    old, new = F.col("n_old") > 0, F.col("n_new") > 0
    return c.agg(F.count(F.lit(1)).alias("either"), F.count_if(old & new).alias("both"), F.count_if(new & ~old).alias("fresh"), F.count_if(old & ~new).alias("gone"))


def update_preview(spark, sf_dir):
    """Bytes of each way to update, and the cheapest: everything, fixed chunks per path, or chunks fetched once."""
    both = builds.both_chunks(spark, sf_dir)
    f = compare.file_estimates(both).agg(F.sum("new_size").alias("a"), F.sum("download").alias("b"))
    g = compare.global_estimate(both).select("fetch_bytes")
    routes = f.select(F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("full").alias("route"), F.col("a").alias("bytes")), F.struct(F.lit(1).alias("pos"), F.lit("fixed").alias("route"), F.col("b").alias("bytes")))).alias("r")).select("r.*")
    routes = routes.unionByName(g.select(F.lit(2).alias("pos"), F.lit("chunks").alias("route"), F.col("fetch_bytes").alias("bytes")))
    return routes.withColumn("recommended", F.row_number().over(Window.orderBy("bytes", "pos")) == 1).drop("pos")


QUERIES = {f.__name__: f for f in (fixed_chunk_estimate, fixed_chunk_totals, global_scope_estimate, distinct_fetch_bytes, depot_sharing_matrix, classify_build, changes_only_preview, managed_deletions, detect_renames, dedup_stats, content_dedup, largest_contributor, depot_delta, install_plan, availability_plan, rebuild_stats, manifest_missing_set, chunk_inventory, hash_set_operations, update_preview)}

_BY_HASH = "c as (select hash, max(len) as len, count(*) filter (is_new = 0) as n_old, count(*) filter (is_new = 1) as n_new from b group by hash)"
_CLASSIFY = f"""{BOTH},
f as (select is_new, path, sum(len)::bigint as size, sha256(string_agg(hash, '' order by ord)) as content_id from b group by all),
s as (select path, max(size) filter (is_new = 0) as old_size, max(size) filter (is_new = 1) as new_size, max(content_id) filter (is_new = 0) as oi, max(content_id) filter (is_new = 1) as ni from f group by path),
fr as (select path, sum(len) as fresh from nc where hash not in (select hash from oc) group by path),
x as (select path, case when old_size is null then 'NEW' when new_size is null then 'DELETED' when oi = ni then 'SAME' else 'MODIFIED' end as state,
  coalesce(old_size, 0) as old_size, coalesce(new_size, 0) as new_size, coalesce(fresh, 0)::bigint as fresh_bytes, (coalesce(new_size, 0) - coalesce(fresh, 0))::bigint as reused_bytes from s left join fr using (path))
"""
_AVAILABLE = f"""with {SQL}, x as (select path, ord::int as ord, hash, len::bigint as len, hash in (select hash from oc where path::bigint % 3 = 0) as c, hash in (select hash from oc where path::bigint % 2 = 0) as p from nc),
a as (select path, ord, hash, len, case when c and p then 'both' when c then 'cache' when p then 'previous' else 'missing' end as have, case when p then 'previous' when c then 'cache' else 'network' end as source from x)
"""

ORACLE_SQL = {
    "fixed_chunk_estimate": f"{BOTH}, {_FILES} select * from files",
    "fixed_chunk_totals": f"""{BOTH}, {_FILES} select sum(old_size)::bigint as old_bytes, sum(new_size)::bigint as new_bytes, sum(new_chunks)::bigint as new_chunks, sum(download)::bigint as download,
        sum(case when status = 'modified' then old_size else 0 end)::bigint as rebuild_read, sum(case when status in ('modified', 'added') then new_size else 0 end)::bigint as rebuild_write,
        count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'modified') as modified, count(*) filter (status = 'added') as added, count(*) filter (status = 'deleted') as deleted,
        round(greatest(0.0, 1 - sum(download)::double / sum(new_size)::double), 9) as reuse from files""",
    "global_scope_estimate": f"{BOTH}, {_BY_HASH} select sum(n_new)::bigint as chunks, sum(case when n_old = 0 then n_new else 0 end)::bigint as new_chunks, sum(case when n_old = 0 then n_new * len else 0 end)::bigint as new_bytes from c",
    "distinct_fetch_bytes": f"with {SQL}, m as (select distinct hash, len from nc where hash not in (select hash from oc)) select count(*) as fetch_chunks, sum(len)::bigint as fetch_bytes from m",
    "depot_sharing_matrix": f"""with {SQL}, d as (select distinct depot, hash, len from oc), t as (select depot, sum(len) as total from d group by depot),
        p as (select x.depot as a, y.depot as b, sum(x.len)::bigint as shared, count(*) as shared_chunks from d x join d y on x.hash = y.hash and x.depot < y.depot group by all),
        m as (select ta.depot as a, tb.depot as b, ta.total as ta, tb.total as tb, coalesce(shared, 0) as shared, coalesce(shared_chunks, 0) as shared_chunks from t ta join t tb on ta.depot < tb.depot left join p on p.a = ta.depot and p.b = tb.depot)
        select a, b, shared, shared_chunks, (ta - shared)::bigint as unique_a, (tb - shared)::bigint as unique_b, round(shared / (ta + tb - shared)::double, 6) as reuse, shared / (ta + tb - shared)::double > 0.3 and shared > 1024 as suggested from m""",
    "classify_build": f"{_CLASSIFY} select * from x",
    "changes_only_preview": f"{_CLASSIFY} select state, count(*) as files, sum(fresh_bytes)::bigint as fresh_bytes, sum(reused_bytes)::bigint as reused_bytes from x where state <> 'SAME' group by state",
    "managed_deletions": f"with {SQL} select path from old where path not in (select path from new)",
    "detect_renames": f"""{BOTH}, f as (select is_new, path, sum(len)::bigint as size, string_agg(hash, '' order by ord) as id from b group by all),
        s as (select * from f where path in (select path from f group by path having count(*) = 1))
        select n.path as new_path, max(o.path) as old_path, n.size from s n join s o on n.is_new = 1 and o.is_new = 0 and n.size = o.size and n.id = o.id where n.size > 0 group by n.path, n.size""",
    "dedup_stats": f"""with {SQL}, a as (select hash, len from oc union all select sha256(substr(html, i * 64 + 1, 64)), length(substr(html, i * 64 + 1, 64)) from pages, unnest(range(0, (length(html) + 63) // 64)) u(i)),
        c as (select hash, count(*) as refs, max(len) as len from a group by hash)
        select sum(refs)::bigint as logical_chunks, count(*) as unique_chunks, sum(refs * len)::bigint as logical_bytes, sum(len)::bigint as unique_bytes, max(refs) as most_refs, round(1 - sum(len)::double / sum(refs * len)::double, 6) as saved from c""",
    "content_dedup": f"with {SQL}, c as (select hash, max(len)::bigint as len, count(*) as refs, min(struct_pack(path := path, ord := ord)) as k from oc group by hash) select hash, len, refs, k.path as path, k.ord::int as ord from c where refs > 1",
    "largest_contributor": f"{BOTH}, {_FILES} select path, download from files order by download desc, path limit 1",
    "depot_delta": f"""{BOTH}, c as (select depot, hash, max(len) as len, count(*) filter (is_new = 0) as n_old, count(*) filter (is_new = 1) as n_new from b group by all)
        select depot, case when sum(n_old) = 0 then 'new' when sum(n_new) = 0 then 'removed' when count(*) filter ((n_old > 0) <> (n_new > 0)) = 0 then 'unchanged' else 'updated' end as action,
        sum(case when n_old = 0 then len else 0 end)::bigint as update_bytes, sum(case when n_new > 0 then len else 0 end)::bigint as total from c group by depot""",
    "install_plan": f"""with {SQL}, e as (select distinct depot, substr(depot, 4)::int as pos, substr(depot, 4)::int % 2 = 0 as had from new), held as (select distinct hash from oc where substr(depot, 4)::int % 2 = 0),
        w as (select hash, min(pos) as pos, max(len) as len from nc join e using (depot) group by hash), p as (select pos, sum(len) as "fetch" from w where hash not in (select hash from held) group by pos),
        t as (select depot, sum(len) as total from (select distinct depot, hash, len from nc) group by depot),
        x as (select depot, e.pos, had, coalesce(total, 0)::bigint as total, coalesce("fetch", 0)::bigint as "fetch" from e left join t using (depot) left join p on p.pos = e.pos)
        select depot, pos, case when "fetch" = 0 then 'no-op' when had then 'update' else 'install' end as action,
        case when "fetch" = 0 then 'no-op' when had then case when "fetch" * 10 < total then 'plan' else 'chunks' end when "fetch" * 2 < total then 'chunks' else 'bootstrap' end as route, "fetch", total from x""",
    "availability_plan": f"{_AVAILABLE} select * from a",
    "rebuild_stats": f"{_AVAILABLE} select have, source, count(*) as ops, sum(len)::bigint as bytes from a group by all",
    "manifest_missing_set": f"""with {SQL}, m as (select distinct hash from nc where hash not in (select hash from oc)), p as (select hash, min(struct_pack(depot := depot, path := path, ord := ord, len := len)) as p from nc group by hash)
        select p.p.depot as pack, count(*) as chunks, sum(p.p.len)::bigint as bytes, 0::bigint as lost from m join p using (hash) group by 1""",
    "chunk_inventory": f"""with {SQL}, v as (select distinct language as version, hash, len from oc), f as (select version, count(*) as c, sum(len) as l from (select hash, min(version) as version, max(len) as len from v group by hash) group by version)
        select version, count(*) as chunks, sum(len)::bigint as bytes, coalesce(max(c), 0)::bigint as added_chunks, coalesce(max(l), 0)::bigint as added_bytes from v left join f using (version) group by version""",
    "hash_set_operations": f"{BOTH}, {_BY_HASH} select count(*) as either, count(*) filter (n_old > 0 and n_new > 0) as both, count(*) filter (n_new > 0 and n_old = 0) as fresh, count(*) filter (n_old > 0 and n_new = 0) as gone from c",
    "update_preview": f"""{BOTH}, {_FILES}, m as (select distinct hash, len from nc where hash not in (select hash from oc)),
        r as (select 0 as pos, 'full' as route, sum(new_size)::bigint as bytes from files union all select 1, 'fixed', sum(download)::bigint from files union all select 2, 'chunks', sum(len)::bigint from m)
        select route, bytes, row_number() over (order by bytes, pos) = 1 as recommended from r""",
}
