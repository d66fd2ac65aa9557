"""Registered queries over a chunk store and over ordered ranges, with their SQL.

Parts are chunks of a store whose packs are brands; customers are its assets,
and the lines of their latest order the references.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands, ledger
from ..sources import builds
from ..sources.builds import SQL, table


def _ledger(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), (F.col("p_size").cast("long") * 1024).alias("len_raw"), (F.col("p_size").cast("long") * 640).alias("len_stored"), F.col("p_brand").alias("pack"))
    x = ledger.append_offsets(p.withColumn("ord", F.col("hash")).withColumn("len", F.col("len_stored")))
    return x.select("hash", "len_raw", "len_stored", "pack", "off")


def _latest(spark, sf_dir):
    """Each customer's latest order."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return o.select(F.col("o_custkey").alias("asset"), "o.*")


def _lines(spark, sf_dir):
    """Lines of the latest orders: asset, hash, l_linenumber and o_orderpriority."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("hash"), "l_linenumber")
    return lines.join(_latest(spark, sf_dir), "o_orderkey").drop("o_orderkey")


def _refs(spark, sf_dir):
    return _lines(spark, sf_dir).select("asset", "hash").distinct()


def _wanted(spark, sf_dir):
    """Chunks that a client lacks: it has those of over 32 KiB."""
    return _ledger(spark, sf_dir).where("len_raw <= 32768").select("hash", "pack", "off", F.col("len_stored").alias("len"))


_STORE = """led as (select p_partkey as hash, p_size::bigint * 1024 as len_raw, p_size::bigint * 640 as len_stored, p_brand as pack,
  (coalesce(sum(p_size::bigint * 640) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0))::bigint as off from part),
latest as (select o_custkey as asset, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as o, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) as priority from orders group by 1),
lines as (select asset, l_partkey as hash, l_linenumber, priority from lineitem join latest on o = l_orderkey), refs as (select distinct asset, hash from lines),
cnt as (select led.*, coalesce(n, 0) as refcount from led left join (select hash, count(*) as n from refs group by hash) using (hash)),
wanted as (select hash, pack, off, len_stored as len from led where len_raw <= 32768)"""
_FRAG = """frag as (select pack, sum(len_stored)::bigint as disk_bytes, sum(case when refcount > 0 then len_stored else 0 end)::bigint as live_bytes, count(*) filter (refcount > 0) as live_chunks
  from cnt group by pack), fr as (select pack, disk_bytes, live_bytes, live_chunks, round(1 - live_bytes / disk_bytes::double, 6) as dead_ratio, disk_bytes < {small} as small from frag where live_chunks > 0)"""


def refcounts(spark, sf_dir):
    return ledger.refcounts(_ledger(spark, sf_dir), _refs(spark, sf_dir)).select("hash", "refcount")


def store_stats(spark, sf_dir):
    return ledger.store_stats(_ledger(spark, sf_dir), _refs(spark, sf_dir))


SMALL, TARGET, DEAD = 1_300_000, 2_000_000, 0.03


def _collected(spark, sf_dir):
    """The ledger after a collection: chunks without references have left it."""
    return _ledger(spark, sf_dir).join(_refs(spark, sf_dir).select("hash").distinct(), "hash", "left_semi")


def _fragmentation(spark, sf_dir):
    packs = _ledger(spark, sf_dir).groupBy("pack").agg(F.sum("len_stored").alias("disk_bytes"))
    return ledger.fragmentation(_collected(spark, sf_dir), packs, small=SMALL)


def fragmentation(spark, sf_dir):
    """Packs by falling dead ratio, after a collection."""
    return _fragmentation(spark, sf_dir).orderBy(F.desc("dead_ratio"), "pack")


def fragmentation_score(spark, sf_dir):
    return ledger.fragmentation_score(_fragmentation(spark, sf_dir))


def repack_plan(spark, sf_dir):
    return ledger.repack_plan(_fragmentation(spark, sf_dir), target=TARGET, dead_ratio=DEAD)


def repack_run(spark, sf_dir):
    """Where every chunk lies after the plan was carried out."""
    return ledger.repack_run(_collected(spark, sf_dir), repack_plan(spark, sf_dir), target=TARGET // 2)


def publish_batch(spark, sf_dir):
    """References after a batch with all lines of urgent latest orders, and after one that also names a lost chunk and so changes nothing."""
    refs, led = _refs(spark, sf_dir), _ledger(spark, sf_dir)
    urgent = _lines(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select((-F.col("asset") - 1).alias("asset"), "hash").distinct()
    done = ledger.publish_batch(refs, led, urgent)
    broken = urgent.select((F.col("asset") - 10_000_000).alias("asset"), "hash").unionByName(spark.range(1).select(F.lit(-20_000_000).cast("long").alias("asset"), F.lit(-1).cast("long").alias("hash")))
    return ledger.publish_batch(done, led, broken)


def compacted_index(spark, sf_dir):
    """Suppliers as indexes of parts, with a base of first lines and deltas after; returned lines are tombstones."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("index"), F.col("l_partkey").alias("hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("generation"), (F.col("l_linenumber") == 1).alias("is_base"), (F.col("l_returnflag") == "R").alias("tombstone"), F.col("l_quantity").cast("long").alias("bytes"))
    return ledger.compact_index(x, most=500, share_pct=600)


def rebuild_plan(spark, sf_dir):
    """Operations that rebuild the new build's files from the old build, a cache of its files in other languages than English, and the network."""
    old = builds.old_chunks(spark, sf_dir)
    first = old.where("language = 'en'").groupBy("hash").agg(F.min(F.struct("path", "off")).alias("p")).select("hash", F.col("p.path").alias("entry"), F.col("p.off").alias("source_off"))
    cache = old.where("language <> 'en'").select("hash", F.lit(True).alias("cached")).distinct()
    x = builds.new_chunks(spark, sf_dir).join(first, "hash", "left").join(cache, "hash", "left")
    source = F.when(F.col("entry").isNotNull(), "previous").when(F.col("cached"), "cache").otherwise("network")
    return islands.rebuild_ops(x.select(F.col("path").alias("file"), "ord", "hash", "len", source.alias("source"), "entry", "source_off"), most=640)


def republish(spark, sf_dir):
    """References after customers with an urgent order were published again with its first line alone, and those of a low priority removed."""
    refs, lines = _refs(spark, sf_dir), _lines(spark, sf_dir)
    again = lines.where("o_orderpriority = '1-URGENT' and l_linenumber = 1").select("asset", "hash")
    gone = lines.where("o_orderpriority = '5-LOW'").select("asset")
    return ledger.unpublish(ledger.publish(refs, again), gone)


def gc_candidates(spark, sf_dir):
    """Chunks without references whose last shipment was 90 days before 2002; some were never shipped."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("hash")).agg(F.max(F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))).alias("t"))
    counted = ledger.refcounts(_ledger(spark, sf_dir), _refs(spark, sf_dir)).join(last, "hash", "left").withColumn("zero_since", F.col("t"))
    return ledger.gc_candidates(counted, 1009843200, 90 * 86400).select("hash", "len_stored", "zero_since")


def lsm_latest_wins(spark, sf_dir):
    """Lines as segments of an index over parts; a returned line is a tombstone."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("generation"), (F.col("l_returnflag") == "R").alias("tombstone"), F.col("l_suppkey").alias("value"))
    return ledger.latest_wins(d)


def index_compaction(spark, sf_dir):
    """Suppliers as indexes: their first line is the base, the others are deltas."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("index"), (F.col("l_linenumber") == 1).alias("is_base"), F.col("l_quantity").cast("long").alias("bytes"))
    return ledger.needs_compaction(x, most=400)


def reference_check(spark, sf_dir):
    """Assets that refer to chunks of a pack that was lost."""
    led = _ledger(spark, sf_dir).where("pack <> 'Brand#11'")
    return ledger.unknown_references(_refs(spark, sf_dir), led).groupBy("asset").agg(F.count(F.lit(1)).alias("unknown"))


def batch_lookup(spark, sf_dir):
    """Where the chunks that assets refer to lie, after a pack was lost."""
    return ledger.batch_lookup(_refs(spark, sf_dir).select("hash").distinct(), _ledger(spark, sf_dir).where("pack <> 'Brand#11'"))


def asset_bytes(spark, sf_dir):
    return ledger.asset_bytes(_refs(spark, sf_dir), _ledger(spark, sf_dir))


def live_packs(spark, sf_dir):
    packs = table(spark, sf_dir, "part").select(F.concat("p_brand", F.when(F.col("p_size") > 45, "-old").otherwise("")).alias("pack")).distinct()
    return ledger.live_packs(_ledger(spark, sf_dir), _refs(spark, sf_dir), packs)


def ingest_chunks(spark, sf_dir):
    """A store of small chunks after all lines were put into it: known chunks stay as they are."""
    led = _ledger(spark, sf_dir).where("len_raw <= 25600")
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), F.lit(1).cast("long").alias("len_raw"), F.col("l_linenumber").cast("long").alias("len_stored"), F.lit("incoming").alias("pack"), F.col("l_orderkey").alias("off"))
    return ledger.put_chunks(led, new)


def run_encode(spark, sf_dir):
    return islands.contiguous_runs(_wanted(spark, sf_dir))


def range_groups(spark, sf_dir):
    return islands.range_groups(_wanted(spark, sf_dir), gap=20_000, span=400_000, waste_pct=15)


def batch_read_groups(spark, sf_dir):
    return islands.range_groups(_wanted(spark, sf_dir), gap=20_000, span=400_000, waste_pct=None)


def bounded_coalesce(spark, sf_dir):
    return islands.bounded_runs(_wanted(spark, sf_dir), most=40_000)


def pack_rollover(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stream"), F.col("p_partkey").alias("ord"), (F.col("p_size").cast("long") * 640).alias("len"))
    return islands.pack_rollover(x, target=500_000)


def copy_coalesce(spark, sf_dir):
    """Chunks of the new build that the old one has, as copies from their first place, joined where they continue."""
    old, new = builds.old_chunks(spark, sf_dir), builds.new_chunks(spark, sf_dir)
    first = old.groupBy("hash").agg(F.min(F.struct("path", "off")).alias("o")).select("hash", F.col("o.path").alias("entry"), F.col("o.off").alias("old_off"))
    ops = new.join(first, "hash").select(F.col("path").alias("file"), "entry", "old_off", F.col("off").alias("new_off"), "len")
    return islands.coalesce_copies(ops)


def heatmap_windows(spark, sf_dir):
    return islands.heatmap(_windows(spark, sf_dir))


def changed_runs(spark, sf_dir):
    """The five longest runs of changed windows of each file."""
    return islands.largest_runs(islands.changed_runs(_windows(spark, sf_dir)), 5)


def _windows(spark, sf_dir):
    """Windows of 256 characters of the files that both builds have."""
    return islands.changed_windows_of(*[islands.window_hashes(b(spark, sf_dir), 256) for b in (builds.old_build, builds.new_build)])


def tiling_check(spark, sf_dir):
    """Chunks as operations: one in 97 of them is missing."""
    size = builds.new_build(spark, sf_dir).select(F.col("path").alias("file"), F.length("content").alias("size"))
    ops = builds.new_chunks(spark, sf_dir).where("(off div 64) % 97 <> 96").select(F.col("path").alias("file"), "off", "len")
    return islands.tiling(ops.join(size, "file"))


def lru_evict(spark, sf_dir):
    """A cache per event type: users' newest event is their entry."""
    x = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("shard"), F.col("user_id").alias("key")).agg(F.max("ts").alias("used"), F.count(F.lit(1)).alias("len"))
    return islands.evict_lru(x, budget=150)


def budget_select(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 17).cast("double").alias("traffic"), (F.col("p_retailprice") * 3).cast("long").alias("fallback"), (F.col("p_size").cast("long") * 64).alias("patch"))
    return islands.select_under_budget(x, budget=20_000)


def inline_split(spark, sf_dir):
    """Files that exist in the new build alone, in pieces of 500 characters."""
    added = builds.new_build(spark, sf_dir).join(builds.old_build(spark, sf_dir).select("path"), "path", "left_anti")
    return islands.inline_split(added.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("off"), F.length("content").cast("long").alias("len")), 500)


QUERIES = {f.__name__: f for f in (refcounts, store_stats, fragmentation, fragmentation_score, repack_plan, repack_run, publish_batch, compacted_index, rebuild_plan, republish, gc_candidates, lsm_latest_wins, index_compaction, reference_check, batch_lookup, asset_bytes, live_packs, ingest_chunks, run_encode, range_groups, batch_read_groups, bounded_coalesce, pack_rollover, copy_coalesce, heatmap_windows, changed_runs, tiling_check, lru_evict, budget_select, inline_split)}


def _range_sql(rule: str) -> str:
    return f"""with recursive {_STORE}, o as (select *, row_number() over (partition by pack order by off) as rn from wanted),
r as (select pack, rn, off as s, off + len as e, len as u, 0 as g from o where rn = 1
  union all select o.pack, o.rn, case when {rule} then r.s else o.off end, o.off + o.len, case when {rule} then r.u + o.len else o.len end, case when {rule} then r.g else r.g + 1 end from r join o on o.pack = r.pack and o.rn = r.rn + 1)
"""


_PLAN = f"""o as (select pack, live_bytes, row_number() over (order by dead_ratio desc, pack) as rn from fr where small),
r as (select rn, pack, live_bytes, live_bytes as held, 1 as n, 0 as grp from o where rn = 1
  union all select o.rn, o.pack, o.live_bytes, case when r.held + o.live_bytes > {TARGET} and r.n > 1 then o.live_bytes else r.held + o.live_bytes end, case when r.held + o.live_bytes > {TARGET} and r.n > 1 then 1 else r.n + 1 end,
  case when r.held + o.live_bytes > {TARGET} and r.n > 1 then r.grp + 1 else r.grp end from r join o on o.rn = r.rn + 1),
pl as (select pack, 'merge' as action, grp::bigint as grp, live_bytes from r where grp in (select grp from r group by grp having count(*) > 1) union all select pack, 'compact', null, live_bytes from fr where not small and dead_ratio > {DEAD})"""
_GAPS = "o.off >= r.e and o.off - r.e <= 20000 and o.off + o.len - r.s <= 400000"
_GROUPED = "select pack, min(s)::bigint as off, (max(e) - min(s))::bigint as span, max(u)::bigint as useful, count(*) as chunks from r group by pack, g"
_WINDOWS = f"""with {SQL}, stays as (select path from new where path in (select path from old)),
w as (select path, i as ord, 0 as is_new, substr(content, i * 256 + 1, 256) as t from old, unnest(range(0, (length(content) + 255) // 256)) u(i) where path in (select path from stays)
  union all select path, i, 1, substr(content, i * 256 + 1, 256) from new, unnest(range(0, (length(content) + 255) // 256)) u(i) where path in (select path from stays)),
x as (select path, ord, greatest(coalesce(max(length(t)) filter (is_new = 0), 0), coalesce(max(length(t)) filter (is_new = 1), 0)) as len, max(t) filter (is_new = 0) is distinct from max(t) filter (is_new = 1) as changed from w group by all),
c as (select *, ord - row_number() over (partition by path order by ord) as island from x where changed),
rn as (select path, min(ord)::int as start, count(*) as windows, sum(len)::bigint as bytes from c group by path, island)"""

ORACLE_SQL = {
    "refcounts": f"with {_STORE} select hash, refcount from cnt",
    "store_stats": f"""with {_STORE} select count(*) as unique_chunks, sum(len_stored)::bigint as stored_bytes, sum(len_raw)::bigint as raw_bytes, sum(len_raw * refcount)::bigint as logical_bytes,
        count(*) filter (refcount = 0) as zero_ref_chunks, coalesce(sum(len_stored) filter (refcount = 0), 0)::bigint as zero_ref_bytes, count(distinct pack) as packs from cnt""",
    "fragmentation": f"with {_STORE}, {_FRAG.format(small=SMALL)} select * from fr",
    "fragmentation_score": f"with {_STORE}, {_FRAG.format(small=SMALL)} select count(*) as packs, count(*) filter (small) as small_packs, sum(disk_bytes - live_bytes)::bigint as dead_bytes, round(count(*) filter (small) / count(*)::double + sum(disk_bytes - live_bytes) / sum(disk_bytes)::double, 6) as score from fr",
    "repack_plan": f"""with recursive {_STORE}, {_FRAG.format(small=SMALL)}, {_PLAN} select * from pl""",
    "repack_run": f"""with recursive {_STORE}, {_FRAG.format(small=SMALL)}, {_PLAN}, m as (select hash, len_raw, len_stored, coalesce('merge-' || grp, 'compact-' || pack) as stream, row_number() over (partition by coalesce('merge-' || grp, 'compact-' || pack) order by pack, off) as rn from cnt join pl using (pack) where refcount > 0),
        w as (select stream, rn, len_stored as held, 0::bigint as at_, 0 as g from m where rn = 1 union all select m.stream, m.rn, case when w.held < {TARGET // 2} then w.held + m.len_stored else m.len_stored end, case when w.held < {TARGET // 2} then w.held else 0 end, case when w.held < {TARGET // 2} then w.g else w.g + 1 end from w join m on m.stream = w.stream and m.rn = w.rn + 1)
        select hash, len_raw, len_stored, stream || '-' || g as pack, at_ as off from m join w using (stream, rn) union all select hash, len_raw, len_stored, pack, off from cnt where refcount > 0 and pack not in (select pack from pl)""",
    "publish_batch": f"with {_STORE} select asset, hash from refs union select -asset - 1, hash from lines where priority = '1-URGENT'",
    "compacted_index": """with x as (select l_suppkey as index, l_partkey as hash, l_orderkey * 10 + l_linenumber as generation, l_linenumber = 1 as is_base, l_returnflag = 'R' as tombstone, l_quantity::bigint as bytes from lineitem),
        s as (select index, generation, is_base, sum(bytes) as bytes from x group by all), c as (select index from s group by index having count(*) filter (not is_base) > 500 or coalesce(sum(bytes) filter (not is_base), 0) * 100 > coalesce(sum(bytes) filter (is_base), 0) * 600),
        l as (select *, row_number() over (partition by index, hash order by generation desc) as k, max(generation) over (partition by index) as top from x where index in (select index from c))
        select index, hash, generation, is_base, tombstone, bytes from x where index not in (select index from c) union all select index, hash, top, true, false, bytes from l where k = 1 and not tombstone""",
    "rebuild_plan": f"""with {SQL}, f as (select hash, min(struct_pack(p := path, o := off)) as p from oc where language = 'en' group by hash), x as (select nc.path as file, ord, nc.off, nc.len, p.p as entry, p.o as so, case when p is not null then 'previous' when hash in (select hash from oc where language <> 'en') then 'cache' else 'network' end as source from nc left join f using (hash)),
        y as (select *, case when source = 'previous' and lag(source) over w = 'previous' and lag(entry) over w = entry and lag(so) over w + lag(len) over w = so then 0 else 1 end as brk from x window w as (partition by file order by ord)), z as (select *, sum(brk) over (partition by file order by ord) as run from y),
        q as (select *, (row_number() over (partition by file, run order by ord) - 1) // 10 as grp from z) select file, min(source) as source, arg_min(entry, ord) as entry, min(so)::bigint as source_off, min(off)::bigint as out_off, sum(len)::bigint as len, count(*) as parts from q group by file, run, grp""",
    "republish": f"""with {_STORE}, again as (select asset, hash from lines where priority = '1-URGENT' and l_linenumber = 1),
        x as (select asset, hash from refs where asset not in (select asset from again) union select asset, hash from again) select distinct asset, hash from x where asset not in (select asset from lines where priority = '5-LOW')""",
    "gc_candidates": f"""with {_STORE}, l as (select l_partkey as hash, max(epoch(l_shipdate))::bigint as t from lineitem group by 1), x as (select cnt.*, t as zero_since from cnt left join l using (hash))
        select hash, len_stored, zero_since from x where refcount = 0 and 1009843200 - coalesce(zero_since, 0) >= 7776000""",
    "lsm_latest_wins": """with d as (select l_partkey as hash, l_orderkey * 10 + l_linenumber as generation, l_returnflag = 'R' as tombstone, l_suppkey as value, row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber desc) as k from lineitem)
        select hash, generation, value from d where k = 1 and not tombstone""",
    "index_compaction": """with x as (select l_suppkey as index, count(*) filter (l_linenumber <> 1) as deltas, coalesce(sum(l_quantity::bigint) filter (l_linenumber <> 1), 0)::bigint as delta_bytes, coalesce(sum(l_quantity::bigint) filter (l_linenumber = 1), 0)::bigint as base_bytes from lineitem group by 1)
        select *, deltas > 400 or delta_bytes * 100 > base_bytes * 25 as compact from x""",
    "reference_check": f"with {_STORE} select asset, count(*) as unknown from refs where hash not in (select hash from led where pack <> 'Brand#11') group by asset",
    "batch_lookup": f"with {_STORE}, i as (select distinct hash from refs) select i.hash, l.pack, l.off, l.len_stored, case when l.pack is null then 'missing' else 'available' end as status from i left join (select * from led where pack <> 'Brand#11') l using (hash)",
    "asset_bytes": f"with {_STORE}, o as (select hash, count(*) as n from refs group by hash) select asset, count(*) as chunks, sum(len_stored)::bigint as bytes, coalesce(sum(len_stored) filter (n = 1), 0)::bigint as own_bytes from refs join o using (hash) join led using (hash) group by asset",
    "live_packs": f"with {_STORE}, p as (select distinct p_brand || case when p_size > 45 then '-old' else '' end as pack from part) select pack, pack in (select pack from led where hash in (select hash from refs)) as live from p",
    "ingest_chunks": f"""with {_STORE}, n as (select l_partkey as hash, min(struct_pack(a := 1, b := l_linenumber::bigint, c := 'incoming', d := l_orderkey)) as r from lineitem group by 1)
        select * from led where len_raw <= 25600 union all select hash, r.a::bigint, r.b, r.c, r.d from n where hash not in (select hash from led where len_raw <= 25600)""",
    "run_encode": f"with {_STORE}, x as (select *, off - coalesce(sum(len) over (partition by pack order by off rows between unbounded preceding and 1 preceding), 0) as island from wanted) select pack, min(off)::bigint as off, sum(len)::bigint as len, count(*) as chunks from x group by pack, island",
    "range_groups": _range_sql(f"{_GAPS} and (o.off + o.len - r.s - r.u - o.len) * 100 <= (r.u + o.len) * 15") + _GROUPED,
    "batch_read_groups": _range_sql(_GAPS) + _GROUPED,
    "bounded_coalesce": _range_sql("o.off = r.e and r.u + o.len <= 40000") + "select pack, min(s)::bigint as off, max(u)::bigint as len, count(*) as chunks from r group by pack, g",
    "pack_rollover": """with recursive o as (select p_brand as stream, p_partkey as ord, p_size::bigint * 640 as len, row_number() over (partition by p_brand order by p_partkey) as rn from part),
        r as (select stream, rn, ord, len, len as held, 0::bigint as g from o where rn = 1 union all select o.stream, o.rn, o.ord, o.len, case when r.held < 500000 then r.held + o.len else o.len end, case when r.held < 500000 then r.g else r.g + 1 end from r join o on o.stream = r.stream and o.rn = r.rn + 1)
        select stream, g as pack_no, sum(len)::bigint as bytes, count(*) as chunks, min(ord) as first_ord from r group by stream, g""",
    "copy_coalesce": f"""with {SQL}, f as (select hash, min(struct_pack(p := path, o := off)) as o from oc group by hash), ops as (select nc.path as file, o.p as entry, o.o as old_off, nc.off as new_off, nc.len from nc join f using (hash)),
        x as (select *, case when lag(entry) over w = entry and lag(old_off) over w + lag(len) over w = old_off and lag(new_off) over w + lag(len) over w = new_off then 0 else 1 end as brk from ops window w as (partition by file order by new_off)),
        y as (select *, sum(brk) over (partition by file order by new_off) as run from x)
        select file, min(entry) as entry, min(old_off)::bigint as old_off, min(new_off)::bigint as new_off, sum(len)::bigint as len, count(*) as ops from y group by file, run""",
    "heatmap_windows": f"""{_WINDOWS}, h as (select path, count(*) as runs, min(start) as lo, max(start + windows) as hi from rn group by path), a as (select path, count(*) as windows, count(*) filter (changed) as changed from x group by path)
        select path, windows, changed, coalesce(runs, 0) as runs, case when changed > 1 then round((runs - 1) / (changed - 1)::double, 6) else 0.0 end as scatteredness, round(coalesce((hi - lo) / windows::double, 0.0), 6) as span, round(coalesce(changed / runs::double, 0.0), 6) as mean_run from a left join h using (path)""",
    "changed_runs": f"{_WINDOWS}, p as (select *, row_number() over (partition by path order by windows desc, start) as place from rn) select path, start, windows, bytes, place::int as place from p where place <= 5",
    "tiling_check": f"""with {SQL}, s as (select path as file, length(content) as size from new), o as (select path as file, off, len, coalesce(lag(off + len) over (partition by path order by off), 0) as due from nc where (off // 64) % 97 <> 96),
        x as (select file, count(*) as ops, count(*) filter (off > due) as gaps, count(*) filter (off < due) as "overlaps", max(off + len) = max(size) as "ends" from o join s using (file) group by file) select *, gaps = 0 and "overlaps" = 0 and "ends" as tiles from x""",
    "lru_evict": """with x as (select event_type as shard, user_id as key, max(ts) as used, count(*) as len from events group by all)
        select *, sum(len) over (partition by shard) - coalesce(sum(len) over (partition by shard order by used, key rows between unbounded preceding and 1 preceding), 0) > 150 as evicted from x""",
    "budget_select": """with recursive x as (select p_brand as grp, p_partkey as id, (p_retailprice * 3)::bigint as f0, floor(p_retailprice * 3)::bigint as fallback, p_size::bigint * 64 as patch, (p_partkey % 17)::double as traffic from part),
        s as (select *, coalesce(traffic * greatest(fallback - patch, 0) / nullif(patch, 0)::double, 0.0) as score from x), o as (select *, row_number() over (partition by grp order by score desc, id) as rn from s),
        r as (select grp, rn, id, patch, fallback > patch and patch <= 20000 as selected, case when fallback > patch and patch <= 20000 then patch else 0 end as spent from o where rn = 1
          union all select o.grp, o.rn, o.id, o.patch, o.fallback > o.patch and r.spent + o.patch <= 20000, r.spent + case when o.fallback > o.patch and r.spent + o.patch <= 20000 then o.patch else 0 end from r join o on o.grp = r.grp and o.rn = r.rn + 1)
        select grp, id, patch, selected from r""",
    "inline_split": f"with {SQL} select path as file, (i * 500)::bigint as off, least(500, length(content) - i * 500)::bigint as len from new, unnest(range(0, (length(content) + 499) // 500)) u(i) where path not in (select path from old)",
}
