"""Operations on folders of files, as a caller asks for them.

Folders may lie in any store that Spark reads. Results are DataFrames; plans
and containers are folders of Parquet.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import analysis, chunking, compare, cost, delta, integrity
from .sources import builds, container

MIB = 1 << 20
FIXED, CDC = MIB, (16 << 10, 64 << 10, 256 << 10, 1)


class EngineError(Exception):
    """An error with a stable code, and whether trying again may help."""

    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(f"{code}: {message}")
        self.code, self.retryable = code, retryable


def _files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    keep = ~scalars.ignored(F.col("path"), ignore) if ignore else None
    return builds.binary_files(spark, root, keep).select("path", "content")


def _both(old: DataFrame, new: DataFrame, size: int) -> DataFrame:
    return builds.fixed_chunks(old, size).withColumn("is_new", F.lit(0)).unionByName(builds.fixed_chunks(new, size).withColumn("is_new", F.lit(1)))


def analyze(spark: SparkSession, old_root: str, new_root: str, ignore: list[str] | None = None, engine: str = "auto", thresholds: analysis.Thresholds = analysis.Thresholds(), fixed: int = FIXED, fine: int = 64 << 10, coarse: int = MIB, cdc: tuple[int, int, int, int] = CDC) -> dict[str, DataFrame]:
    """Per file: status, downloads under fixed and content-defined chunks, heat of changes and entropy; with totals, findings and advice."""
    old, new = _files(spark, old_root, ignore), _files(spark, new_root, ignore)
    files = analysis.signals(old, new, fixed, fine, coarse, lambda b: chunking.cdc_chunks(b, *cdc))
    findings = analysis.detector_findings(files, thresholds).unionByName(analysis.build_findings(files, thresholds))
    deleted = old.select("path").join(new.select("path"), "path", "left_anti")
    return {
        "files": files, "totals": compare.build_estimate(_both(old, new, fixed)), "rollup": analysis.rollup(files, deleted), "findings": findings.orderBy(F.desc("severity"), F.desc("wasted"), "path"),
        "advice": analysis.layout_plan(findings, files), "engine": analysis.engine_hint(files, engine),
    }


def preview_update(spark: SparkSession, old_root: str, new_root: str, fixed: int = FIXED, cdc: tuple[int, int, int, int] = CDC, block: int = 64 << 10) -> DataFrame:
    """Routes with their bytes, and the smallest: everything, fixed chunks by path, content-defined chunks once, and a block plan."""
    from pyspark.sql import Window

    old, new = _files(spark, old_root), _files(spark, new_root)
    one = lambda df, pos, route: df.select(F.lit(pos).alias("pos"), F.lit(route).alias("route"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    e = compare.build_estimate(_both(old, new, fixed))
    known = chunking.cdc_chunks(old, *cdc).select("hash").distinct()
    chunks = chunking.cdc_chunks(new, *cdc).groupBy("hash").agg(F.max("len").alias("len")).join(known, "hash", "left_anti").agg(F.sum("len").alias("bytes"))
    plan = delta.block_diff(old, new, block).where("op = 'inline'").agg(F.sum("len").alias("bytes"))
    routes = one(e.select(F.col("new_bytes").alias("bytes")), 0, "full").unionByName(one(e.select(F.col("download").alias("bytes")), 1, "fixed")).unionByName(one(chunks, 2, "chunks")).unionByName(one(plan, 3, "plan"))
    return routes.withColumn("recommended", F.row_number().over(Window.orderBy("bytes", "pos")) == 1).drop("pos")


def pack_directory(spark: SparkSession, root: str, out: str, ignore: list[str] | None = None, **profile: int) -> dict[str, DataFrame]:
    """A folder as a container."""
    container.write_container(_files(spark, root, ignore), out, **profile)
    return container.open_container(spark, out)


def create_plan(spark: SparkSession, old_root: str, new_root: str, out: str, block: int = 64 << 10) -> DataFrame:
    """Writes operations, expected files and deletions under ``out``, and sums the plan up by file."""
    old, new = _files(spark, old_root), _files(spark, new_root)
    delta.block_diff(old, new, block).write.parquet(f"{out}/ops")
    new.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash")).write.parquet(f"{out}/expected")
    old.select("path").join(new.select("path"), "path", "left_anti").write.parquet(f"{out}/deleted")
    return delta.plan_summary(spark.read.parquet(f"{out}/ops"))


def apply_plan(spark: SparkSession, old_root: str, plan_root: str, out: str) -> DataFrame:
    """Rebuilds the new files under ``out``; nothing is written unless every rebuilt file has its expected hash."""
    expected = spark.read.parquet(f"{plan_root}/expected")
    built = delta.apply_plan(_files(spark, old_root), spark.read.parquet(f"{plan_root}/ops"))
    built = built.unionByName(expected.where("size = 0").select("path", F.lit("").cast("binary").alias("content")))
    state = integrity.verify_install(built.select("path", F.sha2("content", 256).alias("hash")), expected)
    if not state.where("state <> 'ok'").isEmpty():
        raise EngineError("PLAN_MISMATCH", "the old build is not the one that the plan was made for")
    return write_files(built, out)


def write_files(files: DataFrame, out: str) -> DataFrame:
    """Writes (path, content) below ``out``, each to a temporary name first; executors write, so ``out`` is a shared place.

    A file that is there with the same content is left alone, so a run that was
    stopped goes on where it was.
    """
    if not files.where(~scalars.path_is_safe(F.col("path"))).isEmpty():
        raise EngineError("UNSAFE_PATH", "a path leaves the folder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out) if "://" in out else (fs.LocalFileSystem(), out)
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                target = f"{base}/{path}"
                there = store.get_file_info(target)
                if there.is_file and there.size == len(content):
                    with store.open_input_stream(target) as f:
                        if f.read() == bytes(content):
                            continue
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{target}.part") as f:
                    f.write(bytes(content))
                store.move(f"{target}.part", target)
            yield pd.DataFrame({"path": batch.path, "size": [len(c) for c in batch.content]})

    written = files.select("path", "content").mapInPandas(run, "path string, size long")
    return files.sparkSession.createDataFrame([tuple(r) for r in written.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).collect()], "files long, bytes long")


def verify_install(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """States of the files under ``root`` against (path, hash)."""
    have = _files(spark, root).select("path", F.sha2("content", 256).alias("hash"))
    empty = builds.list_files(spark, root).where("size = 0").select("path", F.sha2(F.lit("").cast("binary"), 256).alias("hash"))
    return integrity.verify_install(have.unionByName(empty), expected.select("path", "hash"))


def fetch_static(spark: SparkSession, box_root: str, out: str, keep: Column | None = None) -> DataFrame:
    """Writes the files of a container that ``keep`` leaves, each verified."""
    files = container.unpack(container.open_container(spark, box_root), keep)
    if not files.where("not sound").isEmpty():
        raise EngineError("CORRUPT_CHUNK", "a file can't be rebuilt from its chunks", retryable=True)
    return write_files(files, out)


def estimate_savings(full_bytes: int, update_bytes: int, downloads: int, price_per_gib: float) -> dict[str, float]:
    """Monthly costs and savings of smaller updates."""
    price = lambda n: n / 1073741824 * downloads * price_per_gib
    full, update = price(full_bytes), price(update_bytes)
    return {"full_cost": full, "update_cost": update, "saved": full - update, "saved_pct": (full - update) / full * 100 if full else 0.0}


def benchmark(spark: SparkSession, old_root: str, new_root: str) -> list[tuple[str, float]]:
    """Seconds of each operation on a pair of folders."""
    out = []
    for name, run in (("analyze", lambda: analyze(spark, old_root, new_root)["files"]), ("preview", lambda: preview_update(spark, old_root, new_root))):
        began = time.monotonic()
        run().write.format("noop").mode("overwrite").save()
        out.append((name, time.monotonic() - began))
    return out


def certify(spark: SparkSession, box_root: str, current: DataFrame | None = None, baseline: DataFrame | None = None, threshold: float = 0.05) -> DataFrame:
    """(phase, result, checks): integrity of a container, that it unpacks, and metrics against a baseline if there is one."""
    box = container.open_container(spark, box_root)
    ok = lambda good: F.when(good, "pass").otherwise("fail")
    checks = container.verify(box).select(F.lit("integrity").alias("phase"), ok(F.col("problems") == 0).alias("result"))
    checks = checks.unionByName(container.unpack(box).agg(F.count_if(~F.col("sound")).alias("n")).select(F.lit("unpack").alias("phase"), ok(F.col("n") == 0).alias("result")))
    if current is not None and baseline is not None:
        r = cost.regressions(current, baseline, threshold).select(F.lit("regressions").alias("phase"), F.when(F.col("result").isin("pass", "fail"), F.col("result")).otherwise("skipped").alias("result"))
        checks = checks.unionByName(r)
    return integrity.worst(checks, "phase")


def previous_chunks(spark: SparkSession, path: str, **profile: int) -> DataFrame:
    """(hash) of what a client has installed: of a container if the folder is one, else of its files or of the file."""
    try:
        return container.open_container(spark, path)["chunks"].select("hash").distinct()
    except container.BadContainer:
        return chunking.cdc_chunks(_files(spark, path), **({"least": CDC[0], "mean": CDC[1], "most": CDC[2]} | profile)).select("hash").distinct()


def old_signature(spark: SparkSession, path: str, block: int = 64 << 10) -> DataFrame:
    """The block signature of an old build: as it was stored under ``path``, or of the files there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        found = spark.read.parquet(path)
        if {"path", "block", "off", "len", "weak", "strong"} <= set(found.columns):
            return found
    return chunking.signature(_files(spark, path), block)


class Job:
    """An operation that runs beside its caller: start, poll, cancel.

    Its Spark jobs form a group, so cancelling ends them; events tell what phase it is in.
    """

    def __init__(self, spark: SparkSession, operation: Callable[[Callable[[str], None]], object]):
        self.group, self.events, self._spark, self._result, self._error = uuid.uuid4().hex, [("started", time.time())], spark, None, None
        self._cancelled = threading.Event()

        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, "job", interruptOnCancel=True)
            try:
                self._result = operation(self.phase)
                self.events.append(("completed", time.time()))
            except Exception as e:
                self._error = EngineError("CANCELLED", "the caller cancelled it") if self._cancelled.is_set() else e
                self.events.append(("cancelled" if self._cancelled.is_set() else "failed", time.time()))

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def phase(self, name: str) -> None:
        """Called by the operation between its phases; a cancelled one ends here."""
        if self._cancelled.is_set():
            raise EngineError("CANCELLED", "the caller cancelled it")
        self.events.append((name, time.time()))

    def poll(self) -> str:
        return "running" if self._thread.is_alive() else self.events[-1][0]

    def cancel(self) -> None:
        self._cancelled.set()
        self._spark.sparkContext.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None) -> object:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise EngineError("TIMEOUT", "it still runs", retryable=True)
        if self._error:
            raise self._error
        return self._result
