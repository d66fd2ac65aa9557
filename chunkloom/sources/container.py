"""Containers: the files of a build as deduplicated chunks, in Parquet tables under one folder.

``files`` (path, size, executable, symlink, digest), ``segments`` (path, ord,
off, len, hash), ``chunks`` (hash, len_raw, len_stored, form, data) dealt to
packs of bounded bytes, and ``integrity`` (one row of totals and the Merkle
root over the chunk table). Tables are written before ``integrity``, whose
presence makes a container complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.batches import small_batches
from ..operators import chunking

TABLES = ("files", "segments", "chunks", "integrity")


class BadContainer(ValueError):
    """The folder isn't a sound container."""


def chunked(files: DataFrame, least: int = 16 << 10, mean: int = 64 << 10, most: int = 256 << 10, norm: int = 1) -> DataFrame:
    """(path, content) -> path, ord, off, len, hash, data."""
    return chunking.cdc_chunks(files, least, mean, most, norm, data=True)


def stored_chunks(pieces: DataFrame, level: int = 3, pack_bytes: int = 128 << 20, lens: DataFrame | None = None) -> DataFrame:
    """Each different chunk once, in the form that it is stored in, with its pack.

    ``lens`` (hash, len) are the pieces' where they have been written already: else they are cut twice.

    Packs are ranges of the hash, as many as the raw bytes ask for, so adding
    chunks to one never needs the others.
    """
    once = pieces.groupBy("hash").agg(F.first("data").alias("data"), F.max("len").alias("len_raw"))
    raw = (pieces if lens is None else lens).groupBy("hash").agg(F.max("len").alias("len")).agg(F.sum("len")).first()[0] or 0
    packs = max(1, -(-raw // pack_bytes))
    x = once.withColumn("s", scalars.stored(F.col("data"), level))
    pack = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * packs / (1 << 32)).cast("int")
    return x.select("hash", "len_raw", F.length("s.bytes").cast("long").alias("len_stored"), F.col("s.form").alias("form"), F.col("s.bytes").alias("data"), pack.alias("pack"))


def merkle(chunks: DataFrame) -> DataFrame:
    """One row: the root over the sorted hashes, from the roots of 256 ranges of them."""
    ranges = chunking.merkle_roots(chunks.select(F.substring("hash", 1, 2).alias("path"), F.col("hash").alias("ord"), "hash"))
    return chunking.merkle_roots(ranges.select(F.lit("all").alias("path"), F.col("path").alias("ord"), F.col("root").alias("hash"))).select("root")


def write_container(files: DataFrame, root: str, **profile: int) -> None:
    """(path, content and optionally executable, symlink) -> a container under ``root``."""
    for name, kind in (("executable", "boolean"), ("symlink", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    pieces = chunked(files, **profile)
    files.select("path", F.length("content").cast("long").alias("size"), F.coalesce("executable", F.lit(False)).alias("executable"), "symlink", F.sha2("content", 256).alias("digest")).write.parquet(f"{root}/files")
    pieces.drop("data").write.parquet(f"{root}/segments")
    spark = files.sparkSession
    stored_chunks(pieces, lens=spark.read.parquet(f"{root}/segments")).write.partitionBy("pack").parquet(f"{root}/chunks")
    c = spark.read.parquet(f"{root}/chunks")
    totals = c.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("len_raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("len_stored"), F.lit(0)).alias("stored")).withColumn("version", F.lit(1))
    root_row = merkle(c).first()
    totals.withColumn("merkle", F.lit(root_row["root"] if root_row else chunking.merkle_of([]).hex())).write.parquet(f"{root}/integrity")


def open_container(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a complete container."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/integrity/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise BadContainer(f"no container under {root}")
    small_batches(spark)
    found = {t: spark.read.parquet(f"{root}/{t}") for t in TABLES}
    if found["integrity"].first()["version"] != 1:
        raise BadContainer("unknown version")
    return found


def raw_chunks(box: dict[str, DataFrame], hashes: DataFrame | None = None) -> DataFrame:
    """(hash, data) decoded, of all chunks or of those asked for."""
    c = box["chunks"] if hashes is None else box["chunks"].join(hashes.select("hash").distinct(), "hash", "left_semi")
    return c.select("hash", scalars.loaded(F.col("form"), F.col("data")).alias("data"))


def unpack(box: dict[str, DataFrame], keep: Column | None = None) -> DataFrame:
    """(path, content, sound): files put together and compared with their digests."""
    from ..operators.delta import reconstruct

    files = box["files"] if keep is None else box["files"].where(keep)
    segments = box["segments"].join(files.select("path"), "path", "left_semi")
    built = reconstruct(segments.select("path", "ord", "hash"), raw_chunks(box, segments))
    x = files.join(built, "path", "left")
    content = F.coalesce("content", F.lit("").cast("binary"))
    return x.select("path", content.alias("content"), (F.coalesce("sound", F.col("size") == 0) & (F.sha2(content, 256) == F.col("digest"))).alias("sound"))


def verify(box: dict[str, DataFrame]) -> DataFrame:
    """(check, problems): chunks against their hashes, segments against chunks, tiling, totals and root."""
    from ..operators import integrity, islands

    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(name).alias("check"), "problems")
    bad = integrity.corrupt_chunks(raw_chunks(box))
    lost = box["segments"].join(box["chunks"].select("hash"), "hash", "left_anti")
    tiles = islands.tiling(box["segments"].join(box["files"].select("path", "size"), "path").select(F.col("path").alias("file"), "off", "len", "size")).where("not tiles")
    now = box["chunks"].agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("len_raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("len_stored"), F.lit(0)).alias("stored"))
    totals = now.exceptAll(box["integrity"].select("chunks", "raw", "stored"))
    root = merkle(box["chunks"]).join(box["integrity"].select(F.col("merkle").alias("root")), "root", "left_anti")
    return one(bad, "chunks").unionByName(one(lost, "segments")).unionByName(one(tiles, "tiling")).unionByName(one(totals, "totals")).unionByName(one(root, "merkle"))


def summary(box: dict[str, DataFrame]) -> DataFrame:
    """One row: files, logical and unique bytes and chunks, stored bytes."""
    s = box["segments"].agg(F.count(F.lit(1)).alias("logical_chunks"), F.sum("len").alias("logical_bytes"))
    return s.join(F.broadcast(box["integrity"].select("chunks", "raw", "stored"))).join(F.broadcast(box["files"].agg(F.count(F.lit(1)).alias("files"))))


def manifest(box: dict[str, DataFrame]) -> DataFrame:
    """(path, size, chunks as an ordered array of hash, len)."""
    s = box["segments"].groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash", "len"))), lambda x: F.struct(x["hash"].alias("hash"), x["len"].alias("len"))).alias("chunks"))
    return box["files"].select("path", "size").join(s, "path", "left")


def ingest(box: dict[str, DataFrame], asset: str, ledger: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A store's ledger (hash, len_raw, len_stored, form) and references (asset, hash) with a container in it."""
    from ..operators import ledger as store

    grown = store.put_chunks(ledger, box["chunks"].select(*ledger.columns))
    return grown, store.publish(refs, box["segments"].select(F.lit(asset).alias("asset"), "hash").distinct())


def needed_from_previous(previous: DataFrame, needed: DataFrame) -> DataFrame:
    """(path, off, hash) of an installed build: the first place of each chunk that is needed."""
    x = previous.join(needed.select("hash").distinct(), "hash", "left_semi")
    return x.groupBy("hash").agg(F.min(F.struct("path", "off")).alias("p")).select("hash", "p.path", "p.off")


def expand_runs(runs: DataFrame) -> DataFrame:
    """(pack, off, hashes, lens): contiguous runs as a row per chunk with its offset."""
    x = runs.select("pack", "off", F.posexplode(F.arrays_zip("hashes", "lens")).alias("i", "c"), "lens")
    before = F.aggregate(F.slice("lens", 1, F.col("i")), F.lit(0).cast("long"), lambda s, n: s + n)
    return x.select("pack", (F.col("off") + before).alias("off"), F.col("c.hashes").alias("hash"), F.col("c.lens").alias("len"))
