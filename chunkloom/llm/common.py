"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows and bytes that one Arrow batch holds at most: whole texts travel in it.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="chunkloom-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _dropped(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and nothing can reach the folder
        drop_folder(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder; its columns compress better than a checkpoint's rows.

    The folder goes with the returned frame, so keep that until all that reads it has run.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/chunkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    weakref.finalize(out, _dropped, spark, path).atexit = False
    return out


def whole_text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small for the session; never raises a smaller setting.

    Plans run after they are returned, so the setting has to outlast the call.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a size with a unit is the caller's own
            spark.conf.set(key, str(most))


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lit_array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more.

    The cleaner acts on the driver's garbage collections, which a driver with
    little to do may not reach for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Kept:
    """The columns of ``df`` under names that can't clash with an operator's own.

    Columns that start with ``prefix`` are renamed while the operator works.
    ``columns`` gives them their names back, without those in ``own``: where an
    operator adds a column of that name, its own replaces it.
    """

    def __init__(self, df: DataFrame, prefix: str, own: tuple[str, ...] = ()):
        names = {c: f"kept {i} {c}" if c.lower().startswith(prefix) else c for i, c in enumerate(df.columns)}
        self.df = df.withColumnsRenamed({c: n for c, n in names.items() if c != n})
        taken = {o.lower() for o in own}
        self.columns = [F.col(f"`{n}`").alias(c) for c, n in names.items() if c.lower() not in taken]
