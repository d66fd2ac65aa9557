"""How many bytes of rows a Python worker is handed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes that one Arrow batch holds at most: whole files travel in it, and what is made of them stays beside them.
BYTES = 4 << 20


def small_batches(at: DataFrame | SparkSession) -> None:
    """Keeps Arrow batches small for the session; never raises a smaller setting.

    By default one holds 10,000 rows, which fill up as a table's partitions
    grow. Plans run after they are returned, so the setting has to outlast the
    call.
    """
    spark = at.sparkSession if isinstance(at, DataFrame) else at
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BYTES:  # a size with a unit is the caller's own
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
