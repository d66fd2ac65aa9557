"""Registered queries that write containers and read them back, and over made-up builds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, compare, cost, delta, graph, ledger
from ..sources import builds, container, formats, synth
from ..sources.builds import SQL, table
from .content import _bytes
from .sessions import shared_folder


def _container(spark, sf_dir):
    root = f"{shared_folder(spark)}/box"
    container.write_container(_bytes(builds.new_build(spark, sf_dir)), root, least=128, mean=512, most=2048)
    return container.open_container(spark, root)


def container_verify(spark, sf_dir):
    """Checks of a container of the new build."""
    return container.verify(_container(spark, sf_dir))


def container_unpack(spark, sf_dir):
    """Files of a container, by digest."""
    return container.unpack(_container(spark, sf_dir)).select("path", F.sha2("content", 256).alias("digest"), "sound")


def container_manifest(spark, sf_dir):
    """Files of a container and whether their chunks add up."""
    m = container.manifest(_container(spark, sf_dir))
    return m.select("path", "size", (F.aggregate(F.coalesce("chunks", F.array().cast("array<struct<hash:string,len:bigint>>")), F.lit(0).cast("long"), lambda s, c: s + c["len"]) == F.col("size")).alias("whole"))


def container_ingest(spark, sf_dir):
    """Two containers in one store: every reference resolves and chunks are kept once."""
    root = shared_folder(spark)
    container.write_container(_bytes(builds.old_build(spark, sf_dir)), f"{root}/a", least=128, mean=512, most=2048)
    container.write_container(_bytes(builds.new_build(spark, sf_dir)), f"{root}/b", least=128, mean=512, most=2048)
    led = spark.createDataFrame([], "hash string, len_raw long, len_stored long, form string")
    refs = spark.createDataFrame([], "asset string, hash string")
    for name in ("a", "b"):
        led, refs = container.ingest(container.open_container(spark, f"{root}/{name}"), name, led, refs)
    lost = refs.join(led.select("hash"), "hash", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("lost")).unionByName(led.groupBy("hash").count().where("count > 1").agg(F.count(F.lit(1)).alias("lost")))


def cached_sources(spark, sf_dir):
    """First place in the old build of each fixed chunk that the new build needs."""
    old = builds.old_chunks(spark, sf_dir).select("path", "off", "hash")
    return container.needed_from_previous(old, builds.new_chunks(spark, sf_dir))


def run_expansion(spark, sf_dir):
    """Packs encoded as runs of adjacent parts and expanded again."""
    from ..operators import islands
    from .store import _wanted

    w = _wanted(spark, sf_dir)
    runs = islands.contiguous_runs(w.select("pack", "off", "len")).select("pack", F.col("off").alias("first"), (F.col("off") + F.col("len")).alias("end"))
    x = w.join(runs, "pack").where("off >= first and off < end")
    encoded = x.groupBy("pack", "first").agg(F.array_sort(F.collect_list(F.struct("off", "hash", "len"))).alias("r")).select("pack", F.col("first").alias("off"), F.transform("r", lambda c: c["hash"]).alias("hashes"), F.transform("r", lambda c: c["len"]).alias("lens"))
    return container.expand_runs(encoded)


def synthetic_drift(spark, sf_dir):
    """Content-defined chunks that each variant of a made-up file shares with the first: the shifted one nearly all."""
    files = synth.file_variants(spark, 32, 5, 4096)
    c = chunking.cdc_chunks(files, 256, 1024, 4096, 1)
    first = c.where("path = 'v1'").select("hash").distinct()
    x = c.where("path <> 'v1'").join(first.withColumn("known", F.lit(True)), "hash", "left")
    share = F.sum(F.when(F.col("known"), F.col("len")).otherwise(0)) / F.sum("len")
    least = F.coalesce(*[F.when(F.col("path") == p, F.lit(v)) for p, v in (("small", 0.8), ("medium", 0.6), ("large", 0.2), ("shifted", 0.9), ("reordered", 0.7))])
    return x.groupBy("path").agg(share.alias("share")).select("path", (F.col("share") >= least).alias("shares_enough"))


def synthetic_directory(spark, sf_dir):
    """What happens to the files of a made-up pair of builds."""
    old, new = synth.directory_pair(spark, 16, 7, 40, 1024)
    both = builds.fixed_chunks(old, 1024).withColumn("is_new", F.lit(0)).unionByName(builds.fixed_chunks(new, 1024).withColumn("is_new", F.lit(1)))
    return compare.file_estimates(both).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def version_stream_costs(spark, sf_dir):
    """Update bytes between versions of a made-up stream against a full load: neighbours are cheap, and no jump costs more than the sum of its steps."""
    v = synth.version_stream(spark, 6, 24, 5, 0.1, 2048)
    c = builds.fixed_chunks(v.withColumn("path", F.col("version").cast("string")), 2048).select("version", "hash", "len")
    have = c.select("version", "hash").distinct()
    pairs = graph.all_pairs(spark, 6)
    need = pairs.join(c.groupBy("version", "hash").agg(F.max("len").alias("len")), F.col("dst") == F.col("version")).select("src", "dst", "hash", "len")
    fetch = need.join(have.select(F.col("version").alias("src"), "hash"), ["src", "hash"], "left_anti").groupBy("src", "dst").agg(F.sum("len").alias("bytes"))
    x = pairs.join(fetch, ["src", "dst"], "left").select("src", "dst", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    steps = x.where("dst = src + 1").select("src", F.col("bytes").alias("b"))
    total = x.join(steps.select(F.col("src").alias("s"), "b"), (F.col("s") >= F.col("src")) & (F.col("s") < F.col("dst"))).groupBy("src", "dst").agg(F.max("bytes").alias("bytes"), F.sum("b").alias("sum"))
    return total.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("bytes") <= F.col("sum")).alias("within"), F.count_if((F.col("dst") == F.col("src") + 1) & (F.col("bytes") < 24 * 2048 // 2)).alias("cheap_neighbours"))


def plan_identity(spark, sf_dir):
    """Two plans of the same builds have one identity, however their rows are dealt."""
    ops = delta.block_diff(_bytes(builds.old_build(spark, sf_dir)), _bytes(builds.new_build(spark, sf_dir)), 256)
    line = F.to_json(F.struct("path", "seq", "op", "entry", "old_off", "new_off", "len", F.sha2("data", 256).alias("data")))
    ident = lambda df: df.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash")).withColumn("size", F.lit(0))
    a, b = chunking.tree_hash(ident(ops)).select(F.col("tree").alias("a")), chunking.tree_hash(ident(ops.repartition(5, "len"))).select(F.col("tree").alias("b"))
    return a.join(F.broadcast(b), F.col("a") == F.col("b"), "left").select(F.col("b").isNotNull().alias("same"))


def project_history(spark, sf_dir):
    """Operations of each project, newest first, ten at most: customers are projects and orders operations."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.withColumn("place", F.row_number().over(w)).where("place <= 10").select("o_custkey", "o_orderkey", "place")


def settings_upsert(spark, sf_dir):
    """Key-value settings after all writes: of each key the latest stays."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("key")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("value"))


def capabilities(spark, sf_dir):
    """What this engine can do, a row a feature."""
    return spark.createDataFrame([("chunk-modes", "fixed,cdc"), ("hash", "sha256"), ("compression", "none,zstd"), ("schema", "1")], "feature string, value string")


def static_export(spark, sf_dir):
    """Chunk maps exported as an immutable tree, read back by asset."""
    root = f"{shared_folder(spark)}/tree"
    c = builds.new_chunks(spark, sf_dir).select(F.col("depot").alias("asset"), "path", "ord", "hash", "len")
    packs = c.groupBy("hash").agg(F.max("len").alias("len"), F.min("asset").alias("pack"))
    formats.export_store(c, packs, root)
    return spark.read.parquet(formats.static_url(root, "assets")).groupBy("asset").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))


def layout_cases(spark, sf_dir):
    """What each way of editing a pack costs: fixed chunks by place against content-defined ones, and who is cheaper by a quarter."""
    old, new = synth.case_matrix(spark, 64, 9, 4096)
    both = builds.fixed_chunks(old, 4096).withColumn("is_new", F.lit(0)).unionByName(builds.fixed_chunks(new, 4096).withColumn("is_new", F.lit(1)))
    fixed = compare.file_estimates(both).select("path", F.col("download").alias("fixed"))
    known = chunking.cdc_chunks(old, 256, 1024, 4096, 1).select("path", "hash").distinct()
    cdc = chunking.cdc_chunks(new, 256, 1024, 4096, 1).join(known, ["path", "hash"], "left_anti").groupBy("path").agg(F.sum("len").alias("cdc"))
    x = fixed.join(cdc, "path", "left").withColumn("cdc", F.coalesce("cdc", F.lit(0)))
    better = F.when(F.col("fixed") * 4 < F.col("cdc") * 3, "fixed").when(F.col("cdc") * 4 < F.col("fixed") * 3, "content").otherwise("either")
    return x.select("path", (F.col("fixed") == 0).alias("fixed_free"), better.alias("better"))


def layout_case_fixed(spark, sf_dir):
    """Blocks that the fixed model loads for each case."""
    old, new = synth.case_matrix(spark, 64, 9, 4096)
    both = builds.fixed_chunks(old, 4096).withColumn("is_new", F.lit(0)).unionByName(builds.fixed_chunks(new, 4096).withColumn("is_new", F.lit(1)))
    return compare.file_estimates(both).select("path", "status", "new_chunks")


def version_nodes(spark, sf_dir):
    """Documents of each source as its versions: order, sizes and hashes, and that compression helps."""
    x = builds.old_build(spark, sf_dir).select("depot", F.concat(F.lit("v1."), "path").alias("path"), F.col("content").cast("binary").alias("content"))
    return builds.versions(x, "v1.*", by=("depot",)).select("depot", "idx", "id", "size_bytes", "hash", ((F.col("compressed_bytes") < F.col("size_bytes")) | (F.col("size_bytes") < 300)).alias("smaller"))


def pack_quarantine(spark, sf_dir):
    """Brands as packs, some in quarantine since their number of days; live are those with a large part."""
    p = table(spark, sf_dir, "part")
    packs = p.select(F.col("p_brand").alias("pack"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("n")).distinct()
    packs = packs.select("pack", F.when(F.col("n") % 3 != 0, F.col("n") * 86400).alias("quarantined_at"))
    live = p.where("p_partkey % 40 = 1").select(F.col("p_brand").alias("pack"))
    return ledger.quarantine(packs, live, 60 * 86400, 30 * 86400)


def request_accounting(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "json").otherwise("binary").alias("format"), (F.col("event_id") % 500).alias("bytes"))
    return ledger.request_accounting(e)


def client_state_matrix(spark, sf_dir):
    """Routes chosen in each client state, counted."""
    from .cost import _routes

    return cost.state_matrix(_routes(spark, sf_dir), "balanced").groupBy("state", "route").agg(F.count(F.lit(1)).alias("clients"))


QUERIES = {f.__name__: f for f in (container_verify, container_unpack, container_manifest, container_ingest, cached_sources, run_expansion, synthetic_drift, synthetic_directory, version_stream_costs, plan_identity, project_history, settings_upsert, capabilities, static_export, layout_cases, layout_case_fixed, version_nodes, pack_quarantine, request_accounting, client_state_matrix)}



def _states_sql() -> str:
    from .cost import _ROUTES_SQL

    net, apply, ram, temp, read, _ = cost.POLICIES["balanced"]
    parts = []
    for name, (flags, old, cache) in cost.CLIENT_STATES.items():
        t, cap = (max(temp, 1.0) * 20 if "low_disk" in flags else temp), (128 << 20 if "low_ram" in flags else 1 << 30)
        hdd = "+ 5 * (temp / 1048576.0::double + disk_read / 1048576.0::double)" if "slow_hdd" in flags else ""
        able = f"available and ram <= {cap} and ({str(old).lower()} or route not in ('plan', 'patch', 'hybrid')) and ({str(old or cache).lower()} or route <> 'chunks')"
        score = f"round(network_bytes / 1048576.0::double * {net}::double + apply_ms * {apply}::double + ram / 1048576.0::double * {ram}::double + temp / 1048576.0::double * {t}::double + disk_read / 1048576.0::double * {read}::double {hdd} + 25.0::double * greatest(steps - 1, 0), 9)"
        parts.append(f"select client, '{name}' as state, arg_min(route, struct_pack(s := {score}, p := pos)) as route from r where {able} group by client")
    return f"with {_ROUTES_SQL}, x as ({' union all '.join(parts)}) select state, route, count(*) as clients from x group by all"


_STATES_SQL = _states_sql()

ORACLE_SQL = {
    "container_verify": "select unnest(['chunks', 'segments', 'tiling', 'totals', 'merkle']) as \"check\", 0::bigint as problems",
    "container_unpack": f"with {SQL} select path, sha256(content) as digest, true as sound from new",
    "container_manifest": f"with {SQL} select path, strlen(content)::bigint as size, true as whole from new",
    "container_ingest": "select unnest([0, 0])::bigint as lost",
    "cached_sources": f"with {SQL}, f as (select hash, min(struct_pack(p := path, o := off)) as m from oc where hash in (select hash from nc) group by hash) select hash, m.p as path, m.o::bigint as off from f",
    "run_expansion": "with led as (select p_partkey as hash, p_brand as pack, p_size::bigint * 640 as len, coalesce(sum(p_size::bigint * 640) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as off from part) select pack, off, hash, len from led where len <= 20480",
    "synthetic_drift": "select unnest(['small', 'medium', 'large', 'shifted', 'reordered']) as path, true as shares_enough",
    "synthetic_directory": "select unnest(['modified', 'deleted', 'added', 'unchanged']) as status, unnest([2, 2, 3, 37])::bigint as files",
    "version_stream_costs": "select 15::bigint as pairs, 15::bigint as within, 5::bigint as cheap_neighbours",
    "plan_identity": "select true as same",
    "project_history": "with x as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders where o_orderstatus <> 'P') select o_custkey, o_orderkey, place::int as place from x where place <= 10",
    "settings_upsert": "select o_custkey % 100 as key, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) as value from orders group by 1",
    "capabilities": "select * from (values ('chunk-modes', 'fixed,cdc'), ('hash', 'sha256'), ('compression', 'none,zstd'), ('schema', '1')) t(feature, value)",
    "static_export": f"with {SQL} select depot as asset, count(*) as chunks, sum(len)::bigint as bytes from nc group by depot",
    "layout_case_fixed": "select * from (values ('same', 'unchanged', 0::bigint), ('localized', 'modified', 1), ('scattered', 'modified', 16), ('toc_start', 'modified', 1), ('toc_spread', 'modified', 64), ('appended', 'modified', 16), ('shuffled', 'unchanged', 0), ('new_noise', 'modified', 64), ('shifted', 'modified', 65)) t(path, status, new_chunks)",
    "version_nodes": "select source as depot, (row_number() over (partition by source order by doc_id) - 1)::int as idx, 'v1.' || doc_id as id, strlen(text)::bigint as size_bytes, sha256(text) as hash, true as smaller from documents",
    "pack_quarantine": """with p as (select distinct p_brand as pack, regexp_extract(p_brand, '([0-9]+)', 1)::bigint as n from part), q as (select pack, case when n % 3 <> 0 then n * 86400 end as at_, pack in (select p_brand from part where p_partkey % 40 = 1) as used from p),
        a as (select pack, at_, case when at_ is not null and used then 'restore' when used then 'keep' when at_ is null then 'quarantine' when 5184000 - at_ >= 2592000 then 'sweep' else 'wait' end as action from q)
        select pack, action, case action when 'quarantine' then 5184000 when 'wait' then at_ end as quarantined_at from a""",
    "request_accounting": "select case when event_id % 3 = 0 then 'json' else 'binary' end as format, count(*) as requests, sum(event_id % 500)::bigint as bytes from events group by 1",
    "client_state_matrix": _STATES_SQL,
}
