"""What updating from one build to another costs file by file, and what in the files' layout makes it dear.

Builds are (path, content binary). Two chunk models are held against each
other: fixed-size chunks reused within a path, as simple updaters do, and
content-defined chunks reused from anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.batches import small_batches
from ..sources.builds import fixed_chunks
from . import chunking, compare

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
#: Window sizes of heat, chunk sizes of both models (least, mean, most and normalisation for the second), and manifest bytes a chunk.
FINE, COARSE, FIXED, CDC, PER_CHUNK = 64 * KIB, MIB, MIB, (16 * KIB, 64 * KIB, 256 * KIB, 1), 36

_HEAT = "windows long, changed long, runs long, scatteredness double, span double, density double, mean_run double"


def heat_of(old: bytes, new: bytes, size: int) -> tuple:
    """Windows of ``size`` at equal places: how many, how many differ, in how many runs, how scattered, over what share of the file, how densely, and a run's mean length.

    Bytes that only one of the files has differ.
    """
    n, both = max(len(old), len(new)), min(len(old), len(new))
    total = -(-n // size)
    if old == new:
        return total, 0, 0, 0.0, 0.0, 0.0, 0.0
    differs = np.ones(n, np.int64)
    differs[:both] = np.frombuffer(old, np.uint8, both) != np.frombuffer(new, np.uint8, both)
    per = np.add.reduceat(differs, np.arange(0, n, size))
    at = np.flatnonzero(per)
    runs = 1 + int((np.diff(at) > 1).sum())
    bytes_ = len(at) * size - (size * total - n if at[-1] == total - 1 else 0)
    return total, len(at), runs, (runs - 1) / (len(at) - 1) if len(at) > 1 else 0.0, float(at[-1] - at[0] + 1) / total, float(per.sum()) / bytes_, len(at) / runs


def heat(old: DataFrame, new: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """path and a struct of ``heat_of`` for each named window size, of every file that either build has; a file meets its old self in one task."""
    both = old.select("path", F.col("content").alias("was")).join(new.select("path", F.col("content").alias("is")), "path", "full")
    kind = pa.struct([(n, pa.int64() if t == "long" else pa.float64()) for n, t in (c.split() for c in _HEAT.split(", "))])
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            found = [pa.array([dict(zip(names, heat_of(a or b"", b or b"", size), strict=True)) for a, b in pairs], kind) for size in sizes.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["path", *sizes])

    small_batches(both)
    return both.mapInArrow(run, ", ".join(["path string", *(f"{n} struct<{_HEAT.replace(' ', ':').replace(',:', ',')}>" for n in sizes)]))


def fastcdc(build: DataFrame) -> DataFrame:
    return chunking.cdc_chunks(build, *CDC)


def delimited_chunks(build: DataFrame, pattern: str = "(?s)[^.]*\\.|[^.]+") -> DataFrame:
    """(path, content string) -> chunks that end where the text says so: by default behind a full stop."""
    pieces = build.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("body"))
    return pieces.select("path", F.octet_length("body").cast("long").alias("len"), F.sha2("body", 256).alias("hash"))


def signals(old: DataFrame, new: DataFrame, fixed: int = FIXED, fine: int = FINE, coarse: int = COARSE, cdc: Callable[[DataFrame], DataFrame] = fastcdc, texts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per file of the new build: status, sizes, reuse and download under both models, entropy, and heat in fine and coarse windows.

    ``texts`` are the builds as ``cdc`` takes them, if not as they are.
    """
    both = fixed_chunks(old, fixed).withColumn("is_new", F.lit(0)).unionByName(fixed_chunks(new, fixed).withColumn("is_new", F.lit(1)))
    files = compare.file_estimates(both).where("status <> 'deleted'").withColumn("fixed_reuse", 1 - F.col("new_chunks") / F.greatest("n_chunks", F.lit(1)))
    before, after = texts or (old, new)
    known = cdc(before).select(*[c.alias(n) for n, c in compare.short("hash").items()]).distinct().withColumn("known", F.lit(True))
    fresh = F.col("known").isNull()
    of = cdc(after).select("path", "len", *[c.alias(n) for n, c in compare.short("hash").items()]).join(known, ["h1", "h2"], "left").groupBy("path").agg((1 - F.count_if(fresh) / F.count(F.lit(1))).alias("cdc_reuse"), F.sum(F.when(fresh, F.col("len") + PER_CHUNK).otherwise(0)).alias("cdc_download"))
    bits = new.select("path", scalars.entropy(F.col("content")).alias("entropy"))
    x = files.join(of, "path", "left").join(bits, "path", "left").join(heat(old, new, {"fine": fine, "coarse": coarse}), "path", "left")
    return x.select("path", "status", scalars.is_pack(F.col("path")).alias("is_pack"), "old_size", "new_size", "fixed_reuse", F.coalesce("cdc_reuse", F.lit(1.0)).alias("cdc_reuse"), F.col("download").alias("fixed_download"), F.coalesce("cdc_download", F.lit(0)).alias("cdc_download"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "fine", "coarse")


def rollup(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row of a whole analysis: sizes, files by status, and what both models load and reuse; an empty build reuses all."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = files.agg(F.sum("new_size").alias("new_size"), of("unchanged"), of("modified"), of("added"), F.sum("fixed_download").alias("fixed_download"), F.sum("cdc_download").alias("cdc_download"))
    total = total.fillna(0).join(deleted.agg(F.count(F.lit(1)).alias("deleted")))  # a row each
    reuse = lambda c: F.when(F.col("new_size") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(c) / F.col("new_size")))
    return total.withColumns({"fixed_reuse": reuse("fixed_download"), "cdc_reuse": reuse("cdc_download")})


@dataclass(frozen=True)
class Thresholds:
    """From where on each pattern is reported."""

    advisory: int = GIB
    warning: int = 2 * GIB
    critical: int = 8 * GIB
    interesting: int = 16 * MIB
    scattered: float = 0.5
    scattered_windows: int = 16
    shuffle_gap: float = 0.25
    toc_runs: int = 24
    toc_mean_run: float = 2.0
    toc_density: float = 0.15
    toc_span: float = 0.5
    entropy: float = 7.5
    metadata_windows: int = 2
    metadata_files: int = 5
    growth: int = 16 * MIB


_FINDING = ("path", "kind", "severity", "wasted")


def detector_findings(files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Per file the patterns that make its updates dear (severity 3 critical, 2 warning, 1 info) with the bytes they waste.

    Churn of a table of contents is the more specific diagnosis, and hides the scattered one.
    """
    c = F.col
    wasted = F.greatest(c("fixed_download") - c("cdc_download"), F.lit(0))
    looked_at = (c("status") == "modified") & (c("new_size") >= t.interesting)
    toc = looked_at & (c("fine.runs") >= t.toc_runs) & (c("fine.mean_run") <= t.toc_mean_run) & (c("fine.density") < t.toc_density) & (c("fine.span") >= t.toc_span)
    size = F.when(c("new_size") > t.critical, 3).when(c("new_size") > t.warning, 2).when(c("new_size") > t.advisory, 1)
    found = lambda ok, kind, severity, bytes_: F.when(ok, F.struct(F.lit(kind).alias("kind"), severity.cast("int").alias("severity"), bytes_.cast("long").alias("wasted")))
    tests = F.array(
        found(c("is_pack") & size.isNotNull(), "oversized_pack", size, F.lit(0)),
        found(toc, "toc_churn", F.lit(3), wasted),
        found(looked_at & ~toc & c("is_pack") & (c("coarse.changed") >= t.scattered_windows) & (c("coarse.scatteredness") >= t.scattered), "scattered_pack_churn", F.when(c("new_size") > t.advisory, 3).otherwise(2), wasted),
        found(looked_at & (c("cdc_reuse") - c("fixed_reuse") > t.shuffle_gap), "asset_shuffling", F.lit(3), wasted),
        found(looked_at & (c("entropy") >= t.entropy) & (c("fixed_reuse") < 0.20) & (c("cdc_reuse") < 0.25), "compressed_blob", F.lit(2), c("fixed_download")),
    )
    return files.select("path", F.explode(F.array_compact(tests)).alias("f")).select("path", "f.kind", "f.severity", "f.wasted")


def build_findings(files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Findings over a whole build: many files of equal size with tiny edits, and packs that grew where new files would do."""
    tiny = (F.col("status") == "modified") & (F.col("new_size") == F.col("old_size")) & F.col("fine.changed").between(1, t.metadata_windows)
    one = files.where(tiny).agg(F.count(F.lit(1)).alias("n"), F.sum("fixed_download").alias("b")).where(F.col("n") >= t.metadata_files)
    added = files.agg(F.coalesce(F.sum(F.when(F.col("status") == "added", F.col("new_size"))), F.lit(0)).alias("added"))
    grown = files.where(F.col("is_pack") & (F.col("status") == "modified")).withColumn("by", F.col("new_size") - F.col("old_size")).where(F.col("by") >= t.growth)
    two = grown.join(added, F.col("added") < F.floor(F.col("by") / 4))  # against one row
    wasted = F.greatest(F.col("fixed_download") - F.col("by"), F.lit(0)).cast("long")
    return one.select(F.lit(None).cast("string").alias("path"), F.lit("metadata_churn").alias("kind"), F.lit(2).alias("severity"), F.col("b").cast("long").alias("wasted")).unionByName(two.select("path", F.lit("new_content_in_old_pack").alias("kind"), F.lit(2).alias("severity"), wasted.alias("wasted")))


def engine_of(path: Column) -> Column:
    """The engine that a file's extension belongs to."""
    ext = scalars.extension(path)
    return F.when(ext.isin("pak", "ucas", "utoc"), "unreal").when(ext.isin("bundle", "assets", "ress"), "unity").when(ext == "pck", "godot")


def engine_hint(files: DataFrame, forced: str | None = None, least: int = 16 * MIB) -> DataFrame:
    """One row: the engine of the first file, by path, that is large, reuses little and belongs to one; else the one that the caller names; none if neither."""
    bad = files.where((F.col("status") != "unchanged") & (F.col("fixed_reuse") < 0.6) & (F.col("new_size") > least)).select("path", engine_of(F.col("path")).alias("engine")).where("engine is not null")
    first = bad.agg(F.min_by("engine", "path").alias("engine"), F.min("path").alias("path"))
    return first.select(F.coalesce("engine", F.lit(forced if forced in ("unreal", "unity", "godot") else None).cast("string")).alias("engine"), "path").where("engine is not null")


#: What to do about each finding.
ADVICE = [
    ("oversized_pack", "split the pack by content that ships together"), ("toc_churn", "keep the table of contents in one place, with relative offsets"), ("scattered_pack_churn", "group what changes together"),
    ("asset_shuffling", "keep order and alignment from build to build"), ("compressed_blob", "compress each asset by itself"), ("metadata_churn", "leave out build times and build ids"), ("new_content_in_old_pack", "ship new content in new files"),
]


def layout_plan(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Advice for each finding, with its file's download now and after it: what the fixed and the content-defined model load.

    A finding without a file in the analysis stands for its wasted bytes now and none after.
    """
    of = files.select("path", "fixed_download", "cdc_download")
    advice = F.coalesce(*[F.when(F.col("kind") == k, F.lit(a)) for k, a in ADVICE])
    return findings.join(of, "path", "left").select("path", "kind", "severity", advice.alias("advice"), F.coalesce("fixed_download", "wasted").alias("now"), F.coalesce("cdc_download", F.lit(0)).alias("after"))


def profile_sweep(old: DataFrame, new: DataFrame, profiles: list[tuple], level: int | None = None, unit: int = KIB) -> DataFrame:
    """Each profile (name, mode, least, mean, most in ``unit`` bytes, normalisation) measured on the builds.

    Returns profile, chunks, unique_chunks, bytes (of different chunks), new_chunks and new_bytes
    (different ones that the old build lacks), compressed with zstd where ``level`` is given.
    """
    out = None
    for name, mode, least, mean, most, norm in profiles:
        chunk = (lambda b, data=False: fixed_chunks(b, mean * unit, data=data)) if mode == "fixed" else (lambda b, data=False: chunking.cdc_chunks(b, least * unit, mean * unit, most * unit, norm, data))  # noqa: E731, B023
        known = chunk(old).select("hash").distinct().withColumn("known", F.lit(True))
        size, chunks = F.col("len"), chunk(new, level is not None)
        if level is not None:
            chunks = chunks.withColumn("len", scalars.compressed_length(F.col("data"), level)).drop("data")
        each = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len")).join(known, "hash", "left")
        fresh = F.col("known").isNull()
        x = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(fresh).alias("new_chunks"), F.coalesce(F.sum(F.when(fresh, size)), F.lit(0)).alias("new_bytes"))
        x = x.select(F.lit(name).alias("profile"), "*")
        out = x if out is None else out.unionByName(x)
    return out
