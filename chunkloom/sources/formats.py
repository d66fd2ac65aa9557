"""Readers of documents that describe builds, metrics, graphs and media, and writers of results.

Structured formats are JSON with explicit schemas or Parquet; binary content is
decoded in Arrow batches. Nothing is inferred from data.
"""

from __future__ import annotations

import json
import struct
import tomllib
import uuid
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "asset string, version int, tracks array<struct<id:int,kind:string,name:string,timescale:int,init:array<string>>>, segments array<struct<id:int,track:int,pts:bigint,duration:bigint,chunks:array<string>>>, chunks array<struct<hash:string,len:bigint>>, meta map<string,string>"
GRAPH = "versions array<struct<id:string,size_bytes:bigint,compressed_bytes:bigint>>, edges array<struct<src:int,dst:int,bytes:bigint,verified:boolean>>, policies array<struct<name:string,edges:array<int>>>"
TRANSFER = "event string, oid string, size bigint, path string, operation string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents, one JSON object a line; missing fields are null."""
    return spark.read.schema(MANIFEST).json(path)


def manifest_segments(found: DataFrame) -> DataFrame:
    """A row per chunk of each segment: tracks' first chunks have segment -1, and offsets run within a track by pts and id."""
    init = found.select("asset", F.explode("tracks").alias("t")).select("asset", F.col("t.id").alias("track"), F.lit(-1).alias("segment"), F.lit(-1).cast("long").alias("pts"), F.posexplode("t.init").alias("ord", "hash"))
    body = found.select("asset", F.explode("segments").alias("s")).select("asset", F.col("s.track").alias("track"), F.col("s.id").alias("segment"), F.col("s.pts").alias("pts"), F.posexplode("s.chunks").alias("ord", "hash"))
    sizes = found.select("asset", F.explode("chunks").alias("c")).select("asset", "c.hash", "c.len")
    x = init.unionByName(body).join(sizes, ["asset", "hash"], "left")
    w = Window.partitionBy("asset", "track").orderBy("pts", "segment", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("off", F.coalesce(F.sum("len").over(w), F.lit(0)))


def manifest_hashes(found: DataFrame) -> DataFrame:
    """Distinct hashes of an asset's tracks and segments, in order of first use."""
    x = manifest_segments(found)
    first = x.groupBy("asset", "hash").agg(F.min(F.struct("pts", "track", "segment", "ord")).alias("k"))
    return first.select("asset", "hash", F.row_number().over(Window.partitionBy("asset").orderBy("k")).alias("place"))


def summaries(found: DataFrame) -> DataFrame:
    """Tracks, segments and unique chunks of each asset."""
    return found.select("asset", F.size("tracks").alias("tracks"), F.size("segments").alias("segments"), F.size(F.array_distinct(F.transform("chunks", lambda c: c["hash"]))).alias("unique_chunks"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of every number under ``metrics``, or at the top where there is no such key; a JSON document a file."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.metrics"), F.col("value"))
    pairs = raw.select(F.explode(F.from_json(inner, "map<string,string>")).alias("name", "text"))
    return pairs.select("name", F.expr("try_cast(text as double)").alias("value")).where("value is not null")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, edges and policy edges of a graph document."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    versions = g.select(F.posexplode("versions").alias("idx", "v")).select("idx", "v.*")
    edges = g.select(F.posexplode("edges").alias("edge", "e")).select("edge", "e.*")
    policies = g.select(F.explode("policies").alias("p")).select(F.col("p.name").alias("policy"), F.explode("p.edges").alias("edge"))
    return versions, edges, policies.join(edges.select("edge", "src", "dst"), "edge").select("policy", "src", "dst")


def traffic_model(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a TOML traffic model."""
    rules = tomllib.loads(text)["traffic"].get("rule", [])
    return spark.createDataFrame([(r["kind"], r.get("min_skip"), r.get("max_skip"), r.get("min_age"), float(r["probability"])) for r in rules], "kind string, min_skip int, max_skip int, min_age int, probability double")


def patch_policy(text: str) -> dict:
    """A TOML patch policy with its defaults."""
    return {"enabled": True, "max_pairs_per_release": 3, "max_total_patch_storage_ratio": 0.25, "pairs": ["previous", "latest-stable", "top-installed"], "expire_after_days": 90} | tomllib.loads(text).get("patch_policy", {})


def playlist(lines: DataFrame) -> DataFrame:
    """(file, line, value) of media playlists -> file, pos, uri, duration. A duration belongs to the next line that is no tag."""
    w = Window.partitionBy("file").orderBy("line")
    tag = F.nullif(F.regexp_extract("value", r"^#EXTINF:([0-9.]+)", 1), F.lit("")).cast("double")
    x = lines.withColumn("tag", tag).withColumn("duration", F.last("tag", ignorenulls=True).over(w)).where("trim(value) <> '' and not startswith(value, '#')")
    return x.select("file", (F.row_number().over(w) - 1).alias("pos"), F.trim("value").alias("uri"), "duration")


def pack_directory(data: bytes) -> list[tuple[str, int, int]]:
    """(path, offset, size) of a pack: magic GDPC, version and engine numbers, flags, file base, then entries with padded names."""
    if data[:4] != b"GDPC":
        raise ValueError("not a pack")
    version = struct.unpack_from("<I", data, 4)[0]
    at, base = (96, struct.unpack_from("<Q", data, 24)[0]) if version >= 2 else (84, 0)
    count, out = struct.unpack_from("<I", data, at)[0], []
    at += 4
    for _ in range(count):
        n = struct.unpack_from("<I", data, at)[0]
        name = data[at + 4 : at + 4 + n].rstrip(b"\0").decode()
        off, size = struct.unpack_from("<QQ", data, at + 4 + n)
        at += 4 + n + 32 + (4 if version >= 2 else 0)
        if off + base + size > len(data):
            raise ValueError("entry beyond the pack")
        out.append((name, off + base, size))
    return out


def make_pack(files: dict[str, bytes]) -> bytes:
    """A pack of version 2 for tests and samples."""
    names = {n: n.encode() + b"\0" * (-len(n.encode()) % 4) for n in files}
    head = b"GDPC" + struct.pack("<IIII", 2, 4, 0, 0) + struct.pack("<IQ", 0, 0) + b"\0" * 64
    table = sum(4 + len(v) + 36 for v in names.values())
    at, entries, body = len(head) + 4 + table, b"", b""
    for n, data in files.items():
        entries += struct.pack("<I", len(names[n])) + names[n] + struct.pack("<QQ", at + len(body), len(data)) + b"\0" * 20
        body += data
    return head + struct.pack("<I", len(files)) + entries + body


def pack_entries(packs: DataFrame) -> DataFrame:
    """(path, content) -> pack, entry, off, size; what is no pack has no entries."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.path, batch.content, strict=True):
                if bytes(data[:4]) == b"GDPC":
                    rows += [(path, *e) for e in pack_directory(bytes(data))]
            yield pd.DataFrame(rows, columns=["pack", "entry", "off", "size"])

    return packs.select("path", "content").mapInPandas(run, "pack string, entry string, off long, size long")


def transfer_events(lines: DataFrame) -> DataFrame:
    """Large-file transfer events, a JSON object a line; lines that aren't are dropped. Works on streams too."""
    return lines.select(F.from_json("value", TRANSFER).alias("e")).select("e.*").where("event is not null")


def envelope(request: Column, operations: tuple[str, ...]) -> Column:
    """A JSON reply to a JSON request: its id, and success or a stable error code."""
    r = F.from_json(request, "id string, schema string, op string")
    code = F.when(r.isNull() | r["op"].isNull(), "INVALID_REQUEST").when(~F.coalesce(r["schema"], F.lit("1.0")).startswith("1."), "UNSUPPORTED_SCHEMA").when(~r["op"].isin(*operations), "UNKNOWN_OPERATION")
    return F.to_json(F.struct(r["id"].alias("id"), code.isNull().alias("ok"), code.alias("error")))


# writers


def save_snapshot(df: DataFrame, root: str) -> str:
    """Writes a new version beside the old ones and points CURRENT at it; readers never see half of it."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    fs, path = _fs(spark, root)
    before = current_snapshot(spark, root)
    for pointer, value in (("PREVIOUS", before), ("CURRENT", name)):
        if value:
            out = fs.create(path(f"{root}/.{pointer}.tmp"), True)
            out.writeBytes(value)
            out.close()
            fs.delete(path(f"{root}/{pointer}"), False)
            fs.rename(path(f"{root}/.{pointer}.tmp"), path(f"{root}/{pointer}"))
    return name


def current_snapshot(spark: SparkSession, root: str, pointer: str = "CURRENT") -> str | None:
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/{pointer}")):
        return None
    return spark.read.text(f"{root}/{pointer}").first()[0]


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current version, or the one before it if that can't be read."""
    for pointer in ("CURRENT", "PREVIOUS"):
        name = current_snapshot(spark, root, pointer)
        fs, path = _fs(spark, root)
        if name and fs.exists(path(f"{root}/{name}/_SUCCESS")):
            return spark.read.parquet(f"{root}/{name}")
    raise FileNotFoundError(f"no snapshot under {root}")


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def export_store(chunks: DataFrame, packs: DataFrame, root: str) -> None:
    """Chunk maps by asset and pack entries by pack, as immutable folders."""
    chunks.write.partitionBy("asset").parquet(f"{root}/assets")
    packs.write.partitionBy("pack").parquet(f"{root}/packs")


def report(df: DataFrame, title: str, kind: str = "markdown", rows: int = 1000) -> str:
    """A small result as Markdown, CSV or JSON text; larger ones are for files."""
    data = df.limit(rows + 1).collect()
    if len(data) > rows:
        raise ValueError(f"over {rows} rows; write them with df.write")
    if kind == "json":
        return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in data]}, default=str, indent=1)
    if kind == "csv":
        return pd.DataFrame([tuple(r) for r in data], columns=df.columns).to_csv(index=False)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in data)]) + "\n"


def static_url(base: str, *parts: str) -> str:
    """A path below a static tree, which may be a folder or any address that Spark reads."""
    safe = [p for part in parts for p in PurePosixPath(part).parts]
    if any(p in ("..", "/") for p in safe):
        raise ValueError("path leaves the tree")
    return "/".join([base.rstrip("/"), *safe])


def prometheus(counters: DataFrame, prefix: str = "chunkloom") -> str:
    """(name, help, value) as a page of counters; a name a row, a bounded set."""
    lines = []
    for r in counters.orderBy("name").collect():
        name = f"{prefix}_{r['name']}"
        lines += [f"# HELP {name} {r['help']}", f"# TYPE {name} counter", f"{name} {r['value']}"]
    return "\n".join(lines) + "\n"


def bundle(files: dict[str, bytes]) -> bytes:
    """A reproducible archive (tar, zstd) of small files with a list of their hashes: equal files give equal bytes."""
    import hashlib
    import io
    import tarfile

    import zstandard

    listing = "".join(f"{hashlib.sha256(v).hexdigest()}  {k}\n" for k, v in sorted(files.items()))
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in sorted((files | {"SHA256SUMS": listing.encode()}).items()):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 0, 0o644
            tar.addfile(info, io.BytesIO(data))
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())
