"""Streams: session planning with state per session, and a ledger kept by published and removed references."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PLANNED = "session long, seq long, hash string, kind string"


def plan_sessions(requests: DataFrame) -> DataFrame:
    """A stream of (session, seq, hash): the first request of a chunk carries it inline, later ones refer to it.

    The chunks a session knows are its state. Rows of a batch are planned in
    order of ``seq``.
    """

    def plan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        kinds = []
        for h in rows["hash"]:
            kinds.append("ref" if h in known else "inline")
            known.add(h)
        state.update((sorted(known),))
        yield rows.assign(kind=kinds)[["session", "seq", "hash", "kind"]]

    return requests.groupBy("session").applyInPandasWithState(plan, PLANNED, "known array<string>", "append", GroupStateTimeout.NoTimeout)


def keep_ledger(changes: DataFrame, root: str, checkpoint: str):
    """A stream of (batch_no, asset, hash, op) with op publish or remove -> snapshots of references under ``root``.

    A batch is applied once: its number is stored with the snapshot, and one
    seen before is skipped. Removals of an asset come before its publishing.
    """
    from ..sources.formats import current_snapshot, load_snapshot, save_snapshot

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if current_snapshot(spark, root):
            refs = load_snapshot(spark, root)
            if refs.agg(F.max("applied")).first()[0] is not None and refs.agg(F.max("applied")).first()[0] >= number:
                return
        else:
            refs = spark.createDataFrame([], "asset long, hash string, applied long")
        touched = batch.select("asset").distinct()
        added = batch.where("op = 'publish'").select("asset", "hash").distinct()
        kept = refs.where("hash is not null").join(touched, "asset", "left_anti").select("asset", "hash").unionByName(added)
        mark = spark.createDataFrame([(None, None)], "asset long, hash string")
        save_snapshot(kept.unionByName(mark).withColumn("applied", F.lit(number).cast("long")), root)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Events and values per type and window, with late events dropped by a watermark on streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def concurrency_replay(requests: DataFrame, low: int = 2, high: int = 64, cooldown: int = 1) -> DataFrame:
    """(grp, second, pressure): the limit of parallel requests after each second with traffic.

    It grows by one after a second without pressure. Pressure halves it, unless
    it was halved under ``cooldown`` seconds before; where it stays at ``low``,
    no cooldown begins. The fold runs per group over its seconds, a row each.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        limit, cut, out = 8, None, []
        for r in rows.sort_values("second").itertuples(index=False):
            if not r.pressure:
                limit = min(high, limit + 1)
            elif (cut is None or r.second - cut >= cooldown) and max(low, limit // 2) < limit:
                limit, cut = max(low, limit // 2), r.second
            out.append((r.grp, r.second, limit))
        return pd.DataFrame(out, columns=["grp", "second", "limit"])

    per = requests.groupBy("grp", "second").agg(F.max("pressure").alias("pressure"))
    return per.groupBy("grp").applyInPandas(fold, "grp string, second long, limit long")


def run_to_table(spark: SparkSession, stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows, which executors write below ``root``; the driver holds none."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{root}/rows")
    else:  # all rows so far, each time
        w = w.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/rows"))
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def transfer_summary(events: DataFrame) -> DataFrame:
    """(session, seq, event, size): uploads and downloads between an init and its terminate, by session."""
    w = Window.partitionBy("session").orderBy("seq")
    open_ = F.sum((F.col("event") == "init").cast("int")).over(w) - F.coalesce(F.sum((F.col("event") == "terminate").cast("int")).over(w), F.lit(0))
    x = events.withColumn("open", open_ > 0)
    return x.groupBy("session").agg(*[F.count_if((F.col("event") == k) & F.col("open")).alias(f"{k}s") for k in ("upload", "download")], F.sum(F.when(F.col("open") & F.col("event").isin("upload", "download"), F.col("size")).otherwise(0)).alias("bytes"), F.count_if(~F.col("open") & F.col("event").isin("upload", "download")).alias("out_of_session"))
