"""Registered queries over files, documents and small forms that are written and read again, with their SQL.

Benchmark items are small files here, in a folder by their length.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import chunking, cost, integrity
from ..sources import builds, container, formats
from ..sources.builds import SQL, table
from .content import _bytes
from .sessions import _SEGS, _manifests, shared_folder


def _items(spark, sf_dir):
    folder = F.when(F.length("text") > 200, "long/").otherwise("short/")
    return table(spark, sf_dir, "benchmark").select(F.concat(folder, F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), "item_id")


def _written(spark, sf_dir):
    from ..api import write_files

    root = f"{shared_folder(spark)}/files"
    write_files(_items(spark, sf_dir), root).collect()
    return root


def file_listing(spark, sf_dir):
    """Files of a folder with their sizes."""
    return builds.list_files(spark, _written(spark, sf_dir)).select("path", "size")


def file_ranges(spark, sf_dir):
    """Bytes 150 to 180 of the long files, read with a filter on paths; null where a file is shorter."""
    files = builds.binary_files(spark, _written(spark, sf_dir), F.startswith("path", F.lit("long/")))
    return builds.read_range(files, F.lit(150), F.lit(30)).select("path", "size", F.hex("bytes").alias("bytes"))


def metrics_document(spark, sf_dir):
    """Suppliers' balances as one metrics document, read again."""
    root = f"{shared_folder(spark)}/metrics"
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_acctbal").cast("string"))))
    table(spark, sf_dir, "supplier").agg(F.to_json(F.struct(entries.alias("metrics"))).alias("value")).coalesce(1).write.text(root)
    return formats.metrics(spark, root)


def graph_document(spark, sf_dir):
    """Nations as versions of a graph document with edges to the next one and a policy of every edge, read again."""
    root = f"{shared_folder(spark)}/graph"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a fixed table of 25 rows
    names = [r["n_name"] for r in sorted(n, key=lambda r: r["n_nationkey"])]
    doc = {"versions": [{"id": v, "size_bytes": 100 * len(v), "compressed_bytes": 10 * len(v)} for v in names], "edges": [{"src": i, "dst": i + 1, "bytes": len(names[i + 1]), "verified": True} for i in range(len(names) - 1)], "policies": [{"name": "all", "edges": list(range(len(names) - 1))}]}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(root)
    versions, _, policies = formats.graph(spark, root)
    return policies.join(versions.select(F.col("idx").alias("dst"), "id", "size_bytes"), "dst").select("policy", "src", "dst", "id", "size_bytes")


def engine_packs(spark, sf_dir):
    """Items of equal folder as one engine pack, whose directory is read again."""
    pack = F.pandas_udf(lambda s: s.map(lambda rows: formats.make_pack({r["path"]: bytes(r["content"]) for r in rows})), "binary")
    x = _items(spark, sf_dir).withColumn("pack", F.element_at(F.split("path", "/"), 1))
    packs = x.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("rows")).select(F.col("pack").alias("path"), pack("rows").alias("content"))
    return formats.pack_entries(packs).select("pack", "entry", "size")


def counter_page(spark, sf_dir):
    """Events by type as a page of counters."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value")).withColumn("help", F.concat(F.lit("events of type "), "name"))
    return spark.createDataFrame([(formats.prometheus(e),)], "page string")


def region_report(spark, sf_dir):
    """Regions as a Markdown report."""
    return spark.createDataFrame([(formats.report(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions"),)], "report string")


def rolling_windows(spark, sf_dir):
    """The weak checksum of every window of 16 bytes of each item."""
    roll = F.pandas_udf(lambda s: s.map(lambda b: scalars.rolling_weak32(bytes(b), 16).tolist()), "array<long>")
    return _items(spark, sf_dir).select("item_id", F.posexplode(roll("content")).alias("pos", "weak"))


def sample_windows(spark, sf_dir):
    """At most four windows of 200 bytes of each document, evenly spread."""
    d = builds.old_build(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("size"))
    return chunking.sample_windows(d, 4, 200)


def content_hashes(spark, sf_dir):
    """The identity of each new file's bytes, and of each document that shares it."""
    return builds.new_build(spark, sf_dir).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count(F.lit(1)).alias("files"))


def varints(spark, sf_dir):
    """Order keys as variable-length numbers, read again."""
    code = F.pandas_udf(lambda s: s.map(lambda n: scalars.varint(int(n))), "binary")
    read = F.pandas_udf(lambda s: s.map(lambda b: scalars.read_varint(bytes(b))[0]), "long")
    x = table(spark, sf_dir, "orders").select("o_orderkey", code(F.col("o_orderkey") * 997).alias("b"))
    return x.select("o_orderkey", F.length("b").alias("bytes"), read("b").alias("value"))


def noise_bytes(spark, sf_dir):
    """The first bytes of the noise that each region's key seeds."""
    noise = F.pandas_udf(lambda s: s.map(lambda k: scalars.lcg_bytes(8, int(k)).hex()), "string")
    return table(spark, sf_dir, "region").select("r_regionkey", noise("r_regionkey").alias("noise"))


def blob_shapes(spark, sf_dir):
    """Documents by archive magic, size and whether they compress; the ratio is that of their length in words."""
    ratio = F.when(F.col("n_chars") > 5000, 0.99).otherwise(0.4)
    content = F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("1F8B08")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    x = table(spark, sf_dir, "documents").select(scalars.blob_shape(scalars.archive_kind(content), F.col("n_chars") * 20, ratio).alias("shape"))
    return x.groupBy("shape").agg(F.count(F.lit(1)).alias("files"))


def rebuild_scores(spark, sf_dir):
    """Suppliers' lines as ways to rebuild, by the weights of their costs."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("network"), F.sum(F.col("l_linenumber").cast("long")).alias("read"), F.count(F.lit(1)).alias("seeks"), F.count_if(F.col("l_returnflag") == "R").alias("verify"))
    return x.select("l_suppkey", cost.rebuild_score(F.col("network"), F.col("read"), F.col("seeks"), F.col("verify")).alias("score"))


def container_listing(spark, sf_dir):
    """Files of a container with what it knows of them, and how many bytes its segments tell."""
    root = f"{shared_folder(spark)}/box"
    container.write_container(_bytes(builds.new_build(spark, sf_dir)), root, least=512, mean=2048, most=8192)
    box = container.open_container(spark, root)
    told = box["segments"].groupBy("path").agg(F.sum("len").alias("told"))
    return box["files"].join(told, "path", "left").select("path", "size", "executable", "digest", F.coalesce("told", F.lit(0)).alias("told"))


def container_chunks(spark, sf_dir):
    """Chunks of a container by hash, decoded: as many bytes as the files that they make up need."""
    root = f"{shared_folder(spark)}/box"
    container.write_container(_bytes(builds.new_build(spark, sf_dir)), root, least=512, mean=2048, most=8192)
    box = container.open_container(spark, root)
    raw = container.raw_chunks(box, box["segments"]).select("hash", F.octet_length("data").cast("long").alias("n"), (F.sha2("data", 256) == F.col("hash")).alias("sound"))
    return box["segments"].join(raw, "hash").agg(F.sum("n").alias("bytes"), F.every("sound").alias("sound"))


def cache_verify(spark, sf_dir):
    """Cached chunks of the new build whose bytes changed: those that began with a capital A."""
    c = builds.fixed_chunks(builds.new_build(spark, sf_dir), data=True).select("hash", "data").distinct()
    return integrity.corrupt_chunks(c.withColumn("data", F.when(F.startswith("data", F.lit("A")), F.concat(F.lit("B"), F.substr("data", F.lit(2), F.lit(64)))).otherwise(F.col("data"))))


def manifest_hashes(spark, sf_dir):
    """Distinct hashes of each order's manifest in order of first use."""
    return formats.manifest_hashes(_manifests(spark, sf_dir))


QUERIES = {f.__name__: f for f in (file_listing, file_ranges, metrics_document, graph_document, engine_packs, counter_page, region_report, rolling_windows, sample_windows, content_hashes, varints, noise_bytes, blob_shapes, rebuild_scores, container_listing, container_chunks, cache_verify, manifest_hashes)}

_FILES = "i as (select case when length(text) > 200 then 'long/' else 'short/' end || item_id || '.txt' as path, text, item_id from benchmark)"

ORACLE_SQL = {
    "file_listing": f"with {_FILES} select path, strlen(text)::bigint as size from i",
    "file_ranges": f"with {_FILES} select path, strlen(text)::bigint as size, case when strlen(text) >= 180 then substr(hex(encode(text)), 301, 60) end as bytes from i where path like 'long/%'",
    "metrics_document": "select 's' || s_suppkey as name, s_acctbal as value from supplier",
    "graph_document": "select 'all' as policy, n_nationkey::int - 1 as src, n_nationkey::int as dst, n_name as id, 100 * length(n_name)::bigint as size_bytes from nation where n_nationkey > 0",
    "engine_packs": f"with {_FILES} select split_part(path, '/', 1) as pack, path as entry, strlen(text)::bigint as size from i",
    "counter_page": """with e as (select event_type as n, count(*) as c from events group by 1) select string_agg('# HELP chunkloom_' || n || ' events of type ' || n || chr(10) || '# TYPE chunkloom_' || n || ' counter' || chr(10) || 'chunkloom_' || n || ' ' || c || chr(10), '' order by n) as page from e""",
    "region_report": "select '# Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' order by r_regionkey) as report from region",
    "rolling_windows": """with x as (select item_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda v: ('0x' || v)::bigint) as b from benchmark), w as (select item_id, p::int as pos, b[p + 1 : p + 16] as v from x, unnest(range(0, greatest(len(b) - 15, 0))) u(p))
        select item_id, pos, (list_sum(v) % 65536)::bigint + ((list_sum(list_transform(v, lambda a, k: a * (17 - k))) % 65536)::bigint << 16) as weak from w""",
    "sample_windows": """with d as (select doc_id::varchar as path, strlen(text)::bigint as size from documents) select path, 0::bigint as off, size as len from d where size <= 800
        union all select path, (size - 200) // 3 * i, 200 from d, range(0, 4) r(i) where size > 800""",
    "content_hashes": f"with {SQL} select sha256(content) as hash, count(*) as files from new group by 1",
    "varints": "with x as (select o_orderkey, o_orderkey * 997 as v from orders) select o_orderkey, case when v < 128 then 1 when v < 16384 then 2 when v < 2097152 then 3 when v < 268435456 then 4 else 5 end as bytes, v as value from x",
    "noise_bytes": """with recursive s as (select r_regionkey, r_regionkey::bigint as s, 0 as i, '' as noise from region union all select r_regionkey, (s * 1664525 + 1013904223) % 4294967296, i + 1, noise || lower(printf('%02x', ((s * 1664525 + 1013904223) % 4294967296) >> 24)) from s where i < 8)
        select r_regionkey, noise from s where i = 8""",
    "blob_shapes": "with x as (select case when lang = 'fr' then 'archive' when n_chars * 20 >= 65536 and n_chars > 5000 then 'high-entropy' else 'plain' end as shape from documents) select shape, count(*) as files from x group by 1",
    "rebuild_scores": "select l_suppkey, 100 * sum(l_quantity::bigint)::bigint + sum(l_linenumber)::bigint + 4096 * count(*) + 512 * count(*) filter (l_returnflag = 'R') as score from lineitem group by 1",
    "container_listing": f"with {SQL} select path, strlen(content)::bigint as size, false as executable, sha256(content) as digest, strlen(content)::bigint as told from new",
    "container_chunks": f"with {SQL} select sum(strlen(content))::bigint as bytes, true as sound from new",
    "cache_verify": f"with {SQL} select distinct hash from nc join new using (path) where substr(content, nc.off + 1, 1) = 'A'",
    "manifest_hashes": f"with {_SEGS}, f as (select asset, hash, min(struct_pack(p := pts, t := track, s := segment, o := ord)) as k from s group by all) select asset, hash, (row_number() over (partition by asset order by k))::int as place from f",
}
