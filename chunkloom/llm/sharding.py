"""Sharding by a two-pass external shuffle.

Pass one scatters records: the document id alone picks the shard by a jump
consistent hash, so a shard more takes rows only into itself (the law is
``key``), and a seeded hash of the whole record picks one of the shard's
buckets, whose number follows from the shard's bytes so that a bucket fits in
memory. Pass two loads one bucket at a time, brings it into a canonical order,
shuffles it by Fisher-Yates from a generator seeded with shard and bucket, and
writes it behind the buckets before it. A lost executor redoes its buckets
with the same outcome.

Identical records would all hash to one bucket. Those that occur over
``heavy`` times are folded into one row and a count before the shuffle and
unfolded with their copy number in the hash, so they spread as other rows do.
``heavy`` rises with the rows so that at most ``MANY`` hashes of such records
exist; this bounds what is broadcast, and texts then move once.

Defined results: a null text has no bytes (a record of 8); null ids share one
shard; repeated rows get slots of their own; an empty table gives an empty
result; extra columns go along (of any type that hashes, so not maps), and ones
named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, cut

#: Bytes of records that a bucket should hold.
BUCKET_BYTES = 8 << 20
#: Most hashes of heavy records that are broadcast (8 bytes each).
MANY = 1 << 20
#: Bytes that count for a record besides its text.
RECORD_BYTES = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of unsigned 64-bit keys."""
    key = keys.astype(np.uint64).copy()
    found, at = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            found[live] = at[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            at[live] = ((found[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            live = live[at[live] < shards]
    return found


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def _whole_bytes(docs: DataFrame) -> Column:
    """What a record takes in a bucket: its strings and bytes, and eight for every column."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in docs.schema if f.dataType.typeName() in ("string", "binary")]
    return sum(wide, F.lit(8 * len(docs.columns)).cast("long"))


def _shuffled(seed: int, columns: list[str]):
    def one(group: pa.Table) -> pa.Table:
        shard, bucket, start = (group.column(c)[0].as_py() for c in ("shard_id", "shard_bucket", "shard_start"))
        group = group.take(pa.compute.sort_indices(group, [("shard_hash", "ascending"), ("shard_copy", "ascending")]))
        order = np.arange(len(group))
        np.random.Generator(np.random.PCG64([seed, shard, bucket])).shuffle(order)
        out = group.take(pa.array(order)).select(columns)
        return out.append_column("shard", pa.array(np.full(len(out), shard, np.int32))).append_column("slot", pa.array(np.arange(start, start + len(out), dtype=np.int64)))

    return one


def shard(docs: DataFrame, shards: int = 24, seed: int = 29, bucket_bytes: int = BUCKET_BYTES, heavy: int = 1000) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot, in shuffled order inside each shard."""
    kept = Kept(docs.drop("shard", "slot"), "shard")
    docs = kept.df
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    content = F.xxhash64(F.lit(seed), *columns)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard_id", shard_of(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id"), shards))

    sizes = {r["shard_id"]: (r["b"], r["n"]) for r in dealt(docs).groupBy("shard_id").agg(F.sum(_whole_bytes(docs)).alias("b"), F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    heavy = max(heavy, sum(n for _, n in sizes.values()) // MANY)
    many = cut(docs.select(content.alias("shard_h")).groupBy("shard_h").count().where(F.col("count") > heavy).select("shard_h"))
    once = docs.withColumn("shard_hash", content)
    again = None
    if not many.isEmpty():
        many = F.broadcast(many)  # at most rows / heavy <= MANY hashes
        folded = once.join(many, F.col("shard_hash") == F.col("shard_h"), "left_semi").groupBy(*columns, "shard_hash").agg(F.count(F.lit(1)).alias("shard_n"))
        again = folded.select(*columns, "shard_hash", F.explode(F.sequence(F.lit(1).cast("long"), "shard_n")).alias("shard_copy"))
        once = once.join(many, F.col("shard_hash") == F.col("shard_h"), "left_anti")
    once = once.withColumn("shard_copy", F.lit(0).cast("long"))
    per_shard = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(s, (0, 0))[0] // bucket_bytes))) for s in range(shards)]), F.col("shard_id") + 1)

    def bucketed(rows: DataFrame) -> DataFrame:
        return dealt(rows).withColumn("shard_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "shard_hash", "shard_copy"), per_shard).cast("int"))

    both = bucketed(once if again is None else once.unionByName(again))
    counts = both.groupBy("shard_id", "shard_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard_id").orderBy("shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard_id", "shard_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    schema = docs.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    out = both.join(starts, ["shard_id", "shard_bucket"]).groupBy("shard_id", "shard_bucket").applyInArrow(_shuffled(seed, names), schema)
    return out.select(*kept.columns, "shard", "slot")
