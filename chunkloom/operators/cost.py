"""Cost models: routes, rebuild I/O, chunk profiles, savings, and what a build's layout does to updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars

MIB = 1 << 20

#: Weights (net, apply, ram, temp, read, build) of the update policies.
POLICIES = {
    "network_min": (100.0, 0.01, 0.01, 0.001, 0.001, 0.0), "cpu_min": (1.0, 10.0, 0.01, 0.001, 0.001, 0.0), "ram_min": (1.0, 0.01, 100.0, 0.001, 0.001, 0.0), "disk_io_min": (1.0, 0.01, 0.01, 10.0, 10.0, 0.0),
    "balanced": (10.0, 0.05, 0.05, 0.01, 0.01, 0.0), "hdd_friendly": (2.0, 0.05, 0.1, 20.0, 20.0, 0.0), "developer_fast": (1.0, 0.05, 0.01, 0.01, 0.01, 10.0),
}
#: Client profiles (net, apply, temp weights, RAM cap in bytes or None).
CLIENTS = {"default": (1.0, 100.0, 0.01, None), "low-memory": (1.0, 100.0, 0.01, 128 * MIB), "slow-network": (4.0, 50.0, 0.01, None), "low-disk": (1.0, 100.0, 1.0, None)}
#: Devices (read and write MB/s, seek ms).
DEVICES = [("hdd", 120.0, 100.0, 8.0), ("sata_ssd", 500.0, 450.0, 0.1), ("nvme", 3500.0, 2500.0, 0.02)]
#: Chunk profiles (name, mode, min, avg, max in KiB, normalisation).
PROFILES = [
    ("fixed-256k", "fixed", 256, 256, 256, 0), ("fixed-512k", "fixed", 512, 512, 512, 0), ("fixed-1m", "fixed", 1024, 1024, 1024, 0),
    ("fastcdc-16k", "cdc", 4, 16, 64, 3), ("fastcdc-32k", "cdc", 8, 32, 128, 3), ("fastcdc-64k", "cdc", 16, 64, 256, 1), ("fastcdc-128k", "cdc", 32, 128, 512, 1), ("fastcdc-256k", "cdc", 64, 256, 1024, 1),
    ("fastcdc-64k-n3", "cdc", 16, 64, 256, 3), ("fastcdc-128k-n3", "cdc", 32, 128, 512, 3),
]
#: Profile score weights (cold, update, storage, manifest, requests).
PROFILE_WEIGHTS = {"live": (0.20, 0.40, 0.15, 0.10, 0.10), "cold": (0.45, 0.15, 0.15, 0.10, 0.10)}
MANIFEST_BYTES, WIRE_BYTES, REQUESTS = 36, 42, 3


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, mode string, min_kib int, avg_kib int, max_kib int, norm int")


def auto_profile(size: Column) -> Column:
    """By total size: 16k below 128 MiB, 64k below 512 MiB, else 128k."""
    return F.when(size < 128 * MIB, "fastcdc-16k").when(size < 512 * MIB, "fastcdc-64k").otherwise("fastcdc-128k")


def score_routes(routes: DataFrame, policy: str, slow_hdd: bool = False, low_disk: bool = False, low_ram: bool = False) -> DataFrame:
    """(client, route, pos, available, network_bytes, apply_ms, ram, temp, disk_read, steps, build_ms) with score and choice.

    A route that isn't available, or needs more memory than the client has, is
    infinitely dear. Among routes within a fiftieth of the fewest network bytes
    a plan is preferred when the policy is the network's.
    """
    net, apply, ram, temp, read, build = POLICIES[policy]
    temp = max(temp, 1.0) * 20 if low_disk else temp
    budget = 128 * MIB if low_ram else 1 << 30
    mib = lambda c: F.col(c) / float(MIB)
    cost = mib("network_bytes") * net + F.col("apply_ms") * apply + mib("ram") * ram + mib("temp") * temp + mib("disk_read") * read + F.col("build_ms") * build
    if slow_hdd:
        cost = cost + 5 * (mib("temp") + mib("disk_read"))
    cost = cost + 25.0 * F.greatest(F.col("steps") - 1, F.lit(0))
    open_ = F.col("available") & (F.col("ram") <= budget)
    x = routes.withColumn("score", F.when(open_, scalars.rounded(cost, 9)).otherwise(F.lit(float("inf"))))
    w = Window.partitionBy("client").orderBy("score", "pos")
    return x.withColumn("chosen", (F.row_number().over(w) == 1) & (F.col("score") < float("inf")))


def near_tie(routes: DataFrame, preferred: str = "plan") -> DataFrame:
    """Per client the route to take: the preferred one if it is within a fiftieth of the fewest bytes, else the smallest."""
    least = F.min(F.when(F.col("available"), F.col("network_bytes"))).over(Window.partitionBy("client"))
    x = routes.where("available").withColumn("limit", least + F.floor(least / 50)).where("network_bytes <= limit")
    w = Window.partitionBy("client").orderBy((F.col("route") != preferred).cast("int"), "network_bytes", "pos")
    return x.withColumn("k", F.row_number().over(w)).where("k = 1").select("client", "route", "network_bytes")


def client_plan(routes: DataFrame, profile: str) -> DataFrame:
    """Like ``score_routes`` in raw bytes with three weights and a memory gate; equal trees need nothing."""
    net, apply, temp, cap = CLIENTS[profile]
    cost = F.col("network_bytes") * net + F.col("apply_ms") * apply + F.col("temp") * temp
    open_ = F.col("available") & (F.lit(True) if cap is None else F.col("ram") <= cap)
    x = routes.withColumn("score", F.when(open_, scalars.rounded(cost, 6)).otherwise(F.lit(float("inf"))))
    best = x.groupBy("client").agg(F.min(F.struct("score", "pos", "route")).alias("b"), F.max("same").alias("same"))
    return best.select("client", F.when(F.col("same"), "no-op").when(F.col("b.score") == float("inf"), "none").otherwise(F.col("b.route")).alias("route"), F.when(F.col("same"), 0.0).otherwise(F.col("b.score")).alias("score"))


def io_estimate(routes: DataFrame, devices: DataFrame) -> DataFrame:
    """(route, read, write, download, seeks, new_size) on each device: seconds, and whether disk work exceeds the build."""
    mib = lambda c: F.col(c) / float(MIB)
    x = routes.join(F.broadcast(devices))  # devices are a handful
    seconds = mib("read") / F.col("read_mbs") + (mib("write") + mib("download")) / F.col("write_mbs") + F.col("seeks") * F.col("seek_ms") / 1000
    return x.select("route", "device", scalars.rounded(seconds, 9).alias("seconds"), (F.col("read") + F.col("write") > F.greatest("new_size", F.lit(1))).alias("dominates"))


def profile_estimates(chunks: DataFrame, ratio: float) -> DataFrame:
    """(profile, chunks, bytes, new_chunks, new_bytes) -> storage, first download and update bytes at a compression ratio."""
    r = lambda c: F.col(c) * F.lit(ratio)
    over = MANIFEST_BYTES + WIRE_BYTES
    return chunks.select("profile", "chunks", r("bytes").alias("storage"), (r("bytes") + F.col("chunks") * over).alias("cold"), (r("new_bytes") + F.col("chunks") * over).alias("update"), (F.col("chunks") * MANIFEST_BYTES).alias("manifest"), scalars.rounded(1 - F.col("new_bytes") / F.col("bytes"), 9).alias("reuse"))


def score_profiles(estimates: DataFrame, mode: str = "live") -> DataFrame:
    """Profiles with their score; the lowest is best, the first by name among equals. Encode time isn't counted."""
    c, u, s, m, q = PROFILE_WEIGHTS[mode]
    x = estimates.withColumn("score", scalars.rounded(F.col("cold") * c + F.col("update") * u + F.col("storage") * s + F.col("manifest") * m + 64000.0 * REQUESTS * q, 6))
    return x.withColumn("best", F.row_number().over(Window.orderBy("score", "profile")) == 1)


def savings(updates: DataFrame, price_per_gib: float, downloads: int) -> DataFrame:
    """(item, full_bytes, update_bytes) -> monthly cost of either, what is saved and the percentage."""
    cost = lambda c: F.col(c) / 1073741824.0 * downloads * price_per_gib
    x = updates.withColumns({"full_cost": cost("full_bytes"), "update_cost": cost("update_bytes")})
    pct = F.when(F.col("full_cost") > 0, (F.col("full_cost") - F.col("update_cost")) / F.col("full_cost") * 100).otherwise(0.0)
    return x.select("item", scalars.rounded("full_cost", 9).alias("full_cost"), scalars.rounded("update_cost", 9).alias("update_cost"), scalars.rounded(F.col("full_cost") - F.col("update_cost"), 9).alias("saved"), scalars.rounded(pct, 6).alias("saved_pct"))


def best_strategy(candidates: DataFrame) -> DataFrame:
    """(file, strategy, bytes): the smallest per file; among equals plan, then xdelta, then the full data, then bsdiff."""
    rank = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(k)) for k, s in enumerate(("copy-old", "plan-ops", "xdelta3", "full-data", "bsdiff"))], F.lit(9))
    return candidates.where("bytes is not null").groupBy("file").agg(F.min(F.struct("bytes", rank.alias("rank"), "strategy")).alias("m")).select("file", F.col("m.strategy").alias("strategy"), F.col("m.bytes").alias("bytes"))


def regressions(current: DataFrame, baseline: DataFrame, threshold: float, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """(name, value) of two runs: a metric passes if it rose by at most ``threshold`` or stayed under the noise floor.

    New metrics and baselines of zero or less are skipped; so are exceptions.
    """
    n = F.col("name")
    floor = F.when(F.endswith(n, F.lit("_ms")), 250.0).when(F.contains(n, F.lit("ram")), 32.0 * MIB).otherwise(0.0)
    x = current.join(baseline.select("name", F.col("value").alias("base")), "name")
    change = (F.col("value") - F.col("base")) / F.col("base")
    result = F.when(F.col("base") <= 0, "skipped").when(n.isin(*exceptions) if exceptions else F.lit(False), "excepted").when((change <= threshold) | (F.col("value") - F.col("base") <= floor), "pass").otherwise("fail")
    return x.select("name", scalars.rounded("value", 6).alias("value"), scalars.rounded("base", 6).alias("base"), F.when(F.col("base") > 0, scalars.rounded(change, 9)).alias("change"), result.alias("result"))


def rebuild_score(network: Column, read: Column, seeks: Column, verify: Column) -> Column:
    return 100 * network + read + 4096 * seeks + 512 * verify


#: Client states as keyword arguments of ``score_routes``, and whether an old build and a cache are there.
CLIENT_STATES = {
    "new": ({}, False, False), "previous": ({}, True, False), "warm": ({}, True, True), "cache-only": ({}, False, True),
    "slow-hdd": ({"slow_hdd": True}, True, False), "low-disk": ({"low_disk": True}, True, False), "low-ram": ({"low_ram": True}, True, False),
}


def state_matrix(routes: DataFrame, policy: str) -> DataFrame:
    """The chosen route of each client in each state; routes that need what a state lacks aren't available."""
    out = None
    for name, (flags, old, cache) in CLIENT_STATES.items():
        needs_old, needs_cache = F.col("route").isin("plan", "patch", "hybrid"), F.col("route") == "chunks"
        able = F.col("available") & (F.lit(old) | ~needs_old) & (F.lit(old or cache) | ~needs_cache)
        x = score_routes(routes.withColumn("available", able), policy, **flags).where("chosen").select("client", F.lit(name).alias("state"), "route")
        out = x if out is None else out.unionByName(x)
    return out
