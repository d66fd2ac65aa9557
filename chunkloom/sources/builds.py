"""Builds (path, content) of versioned files, and their chunk tables.

``documents`` stands for the old build: path = doc_id, content = text, depot =
source, language = lang. The new build derives from it: ids divisible by 11
are gone, those by 13 move to another path, those by 7 get eight characters in
front, and those by 5 an edit in the middle. Offsets and lengths are in
characters for strings and in bytes for binary content.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches

CHUNK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core up to which a table is dealt anew.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, which may be one row group, over all cores; others stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL else df


def many_parts(df: DataFrame, part: int) -> DataFrame:
    """A table of narrow rows, of each of which a plan makes many, dealt to parts of about ``part`` bytes: however long the table, a task has as many."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part)))


def old_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("source").alias("depot"), F.col("lang").alias("language"))


def new_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").where("doc_id % 11 <> 0"))
    half = F.floor(F.length("text") / 2).cast("int")
    content = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(">>shift:"), "text"))
        .when(F.col("doc_id") % 5 == 0, F.concat(F.substr("text", F.lit(1), half), F.lit("#edit#"), F.substr("text", half + 7)))
        .otherwise(F.col("text"))
    )
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), content.alias("content"), F.col("source").alias("depot"), F.col("lang").alias("language"))


def fixed_chunks(build: DataFrame, size: int = CHUNK, content: str = "content", data: bool = False) -> DataFrame:
    """A row per ``size`` units of content: ord, off, len, hash beside the build's other columns, and the chunk itself if asked for.

    The last chunk is short; empty content has none. Nothing is shuffled. Bytes
    are cut by position; a string, in which a position takes a scan from its
    start, is cut in one pass.
    """
    others = [c for c in build.columns if c != content]
    if build.schema[content].dataType.typeName() == "string":
        pieces = F.regexp_extract_all(F.col(content), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        cut = build.select(*others, F.posexplode(pieces).alias("ord", "body"))
    else:
        n = F.length(content)
        at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
        cut = build.select("*", at.alias("ord")).withColumn("body", F.substr(F.col(content), F.col("ord") * size + 1, F.lit(size)))
    return cut.select(*others, "ord", (F.col("ord") * F.lit(size)).cast("long").alias("off"), F.length("body").cast("long").alias("len"), F.sha2("body", 256).alias("hash"), *([F.col("body").alias("data")] if data else []))


def old_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    return fixed_chunks(old_build(spark, sf_dir), size)


def new_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    return fixed_chunks(new_build(spark, sf_dir), size)


def both_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """Chunks of both builds with ``is_new``: one shuffle can then compare them."""
    old, new = old_chunks(spark, sf_dir, size), new_chunks(spark, sf_dir, size)
    return old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))


def binary_files(spark: SparkSession, root: str, keep: Column | None = None, content: bool = True) -> DataFrame:
    """Files under ``root``: path (relative), size, modified, and content unless only listed.

    ``keep`` filters relative paths before any content is read. Spark's file
    sources leave out empty files, which ``list_files`` has.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.regexp_replace(base, "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/")) + "/", "")
    out = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.where(keep) if keep is not None else out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The listing alone, with empty files: path, size and modification time in ms. Metadata pass through the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, rows = fs.makeQualified(path).toUri().getPath().rstrip("/"), fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toUri().getPath()[len(base) + 1 :], f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(sorted(rows), "path string, size long, modified_ms long")


def read_range(files: DataFrame, offset: Column, length: Column) -> DataFrame:
    """``files`` with the bytes [offset, offset + length), null where they exceed the file."""
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.col("size"))
    return files.withColumn("bytes", F.when(inside, F.substr("content", (offset + 1).cast("int"), length.cast("int"))))


def versions(files: DataFrame, glob: str = "*", level: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of artifacts -> nodes of a version graph in natural order of their names: idx, id, sizes and hash.

    Columns in ``by`` keep graphs apart; without them, versions of one artifact are numbered together.
    """
    from pyspark.sql import Window

    from ..functions import scalars

    x = files.where(F.col("path").rlike(scalars.version_glob(glob))).select(*by, F.col("path").alias("id"), F.length("content").cast("long").alias("size_bytes"), scalars.compressed_length(F.col("content"), level).alias("compressed_bytes"), F.sha2("content", 256).alias("hash"))
    order = Window.partitionBy(*by).orderBy(scalars.natural_key(F.col("id")), "id")  # a row per version, content left behind
    return x.select(*by, (F.row_number().over(order) - 1).alias("idx"), "id", "size_bytes", "compressed_bytes", "hash")


#: DuckDB counterpart of the builds and their chunks.
SQL = f"""
old as (select doc_id::varchar as path, text as content, source as depot, lang as language from documents),
new as (select case when doc_id % 13 = 0 then 'moved/' || doc_id else doc_id::varchar end as path,
  case when doc_id % 7 = 0 then '>>shift:' || text when doc_id % 5 = 0 then substr(text, 1, length(text) // 2) || '#edit#' || substr(text, length(text) // 2 + 7) else text end as content,
  source as depot, lang as language from documents where doc_id % 11 <> 0),
oc as (select path, depot, language, i as ord, i * {CHUNK} as off, length(substr(content, i * {CHUNK} + 1, {CHUNK})) as len, sha256(substr(content, i * {CHUNK} + 1, {CHUNK})) as hash
  from old, unnest(range(0, (length(content) + {CHUNK - 1}) // {CHUNK})) u(i)),
nc as (select path, depot, language, i as ord, i * {CHUNK} as off, length(substr(content, i * {CHUNK} + 1, {CHUNK})) as len, sha256(substr(content, i * {CHUNK} + 1, {CHUNK})) as hash
  from new, unnest(range(0, (length(content) + {CHUNK - 1}) // {CHUNK})) u(i))
"""
