"""Checks: stored content against its hashes, installs against signatures, and how results of checks combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results from best to worst; skipped ones don't count.
RANK = {"pass": 0, "skipped": 1, "warn": 2, "fail": 3}


def corrupt_chunks(chunks: DataFrame) -> DataFrame:
    """(hash, data): chunks whose content doesn't have their hash, or can't be read."""
    return chunks.where(~F.sha2("data", 256).eqNullSafe(F.col("hash"))).select("hash")


def signature_differences(have: DataFrame, want: DataFrame) -> DataFrame:
    """Rows of one signature that the other lacks, with their side; copies count."""
    return have.exceptAll(want).withColumn("side", F.lit("extra")).unionByName(want.exceptAll(have).withColumn("side", F.lit("missing")))


def verify_install(installed: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, hash) of an install against what is expected: ok, modified, missing or extra for each path."""
    x = installed.select("path", F.col("hash").alias("have")).join(expected.select("path", F.col("hash").alias("want")), "path", "full_outer")
    state = F.when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("want"), "ok").otherwise("modified")
    return x.select("path", state.alias("state"))


def worst(checks: DataFrame, by: str) -> DataFrame:
    """(phase, result): the worst result of each phase, skipped only if all were."""
    rank = F.coalesce(*[F.when(F.col("result") == r, F.lit(k)) for r, k in RANK.items()])
    x = checks.withColumn("r", rank).groupBy(by).agg(F.max(F.when(F.col("result") != "skipped", F.col("r"))).alias("m"), F.count(F.lit(1)).alias("checks"))
    name = F.when(F.col("m").isNull(), "skipped").otherwise(F.element_at(F.array(*[F.lit(r) for r in RANK]), F.col("m") + 1))
    return x.select(by, name.alias("result"), "checks")


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def doctor(ledger: DataFrame, refs: DataFrame, packs: DataFrame) -> DataFrame:
    """Checks of a store: references resolve, lengths are sound, chunks don't overlap in a pack, packs exist."""
    from pyspark.sql import Window

    lost = refs.join(ledger.select("hash"), "hash", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("references").alias("check"), "n")
    length = ledger.where("len_stored <= 0 or len_raw < len_stored").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lengths").alias("check"), "n")
    end = F.lag(F.col("off") + F.col("len_stored")).over(Window.partitionBy("pack").orderBy("off"))
    over = ledger.withColumn("end", end).where("off < end").agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlaps").alias("check"), "n")
    gone = ledger.select("pack").distinct().join(packs.select("pack"), "pack", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("packs").alias("check"), "n")
    return lost.unionByName(length).unionByName(over).unionByName(gone).select("check", F.col("n").alias("problems"), F.when(F.col("n") == 0, "pass").otherwise("fail").alias("result"))


def corruption_matrix(box: dict[str, DataFrame], verify) -> DataFrame:
    """(damage, found, rejected): a container's tables damaged in each way, and the checks of ``verify`` that notice.

    Chunks are hit where their hash begins with 0, segments where they are a file's first.
    """
    hit = F.startswith("hash", F.lit("0"))
    first = F.col("ord") == 0
    damages = {
        "none": {},
        "chunk bytes": {"chunks": box["chunks"].withColumn("data", F.when(hit, F.concat(F.substr("data", F.lit(1), F.length("data") - 1), F.unhex(F.lit("A5")))).otherwise(F.col("data")))},
        "chunk cut": {"chunks": box["chunks"].withColumn("data", F.when(hit, F.substr("data", F.lit(1), F.floor(F.length("data") / 2).cast("int"))).otherwise(F.col("data")))},
        "chunk lost": {"chunks": box["chunks"].where(~hit)},
        "segment lost": {"segments": box["segments"].where(~first)},
        "segment moved": {"segments": box["segments"].withColumn("off", F.when(first, F.col("off") + 1).otherwise(F.col("off")))},
        "file grown": {"files": box["files"].withColumn("size", F.col("size") + 1)},
        "totals": {"integrity": box["integrity"].withColumn("stored", F.col("stored") + 1)},
        "root": {"integrity": box["integrity"].withColumn("merkle", F.reverse("merkle"))},
    }
    out = None
    for name, changed in damages.items():
        x = verify(box | changed).where("problems > 0").agg(F.sort_array(F.collect_list("check")).alias("c"))  # a row a check
        x = x.select(F.lit(name).alias("damage"), F.array_join("c", ",").alias("found"), (F.size("c") > 0).alias("rejected"))
        out = x if out is None else out.unionByName(x)
    return out
