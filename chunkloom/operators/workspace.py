"""Catalogs of apps: depots, branches and builds, and joins along versions and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible_depots(depots: DataFrame, platform: str, language: str, owned: list[str]) -> DataFrame:
    """Depots for a platform and language or for any, that are owned or not optional."""
    return depots.where((F.col("platform").isNull() | (F.col("platform") == platform)) & (F.col("language").isNull() | (F.col("language") == language)) & (~F.col("optional") | F.col("depot").isin(*owned)))


def next_build_id(builds: DataFrame, base: int = 1000) -> DataFrame:
    """Per app the next build number: one more than the largest number its ids end in."""
    n = F.nullif(F.regexp_extract("build", r"(\d+)$", 1), F.lit("")).cast("long")
    return builds.groupBy("app").agg((F.coalesce(F.max(n), F.lit(base)) + 1).alias("next"))


def branch_history(promotions: DataFrame) -> DataFrame:
    """(branch, seq, build): builds in order of promotion, the current one, and how often it was current before."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "build")))
    x = promotions.groupBy("branch").agg(F.transform(ordered, lambda p: p["build"]).alias("h"))
    return x.select("branch", F.element_at("h", -1).alias("current"), F.size("h").alias("promotions"), (F.size(F.filter("h", lambda b: b == F.element_at("h", -1))) - 1).alias("before"))


def rollback(promotions: DataFrame, targets: DataFrame) -> DataFrame:
    """(branch, build) to return to -> whether each is in its branch's history and so may become current."""
    known = promotions.select("branch", "build").distinct().withColumn("known", F.lit(True))
    return targets.join(known, ["branch", "build"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def content_as_of(releases: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, version, value) and (key, version) -> the value of the latest release at or before each asked version.

    Both are merged into one order per key, so nothing is paired off.
    """
    both = releases.select("key", "version", "value", F.lit(0).alias("side")).unionByName(asked.select("key", "version", F.lit(None).cast(releases.schema["value"].dataType).alias("value"), F.lit(1).alias("side")))
    w = Window.partitionBy("key").orderBy("version", "side")
    found = both.withColumn("value", F.last("value", ignorenulls=True).over(w))
    return found.where("side = 1").select("key", "version", "value")


def overlapping(windows: DataFrame, resources: DataFrame, cell: int) -> DataFrame:
    """(grp, w_start, w_end) and (grp, r_start, r_end, name): pairs of ranges that overlap.

    Ranges are filed under the cells they touch and joined by cell; a pair is
    kept in the first cell both touch, so it comes once. Ends are exclusive.
    """

    def filed(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) < F.col(b)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))))

    x = filed(windows, "w_start", "w_end").join(filed(resources, "r_start", "r_end"), ["grp", "cell"])
    first = F.floor(F.greatest("w_start", "r_start") / cell)
    return x.where((F.col("w_start") < F.col("r_end")) & (F.col("r_start") < F.col("w_end")) & (F.col("cell") == first)).drop("cell")


def nth_segment(segments: DataFrame) -> DataFrame:
    """(track, id, pts): the position of each segment in its track by pts."""
    return segments.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("pts", "id")) - 1)


def session_batches(requests: DataFrame, per_batch: int) -> DataFrame:
    """(session, seq, hash): the first request of a chunk carries it, later ones refer to it; batches of ``per_batch`` new chunks."""
    w = Window.partitionBy("session", "hash").orderBy("seq")
    x = requests.withColumn("kind", F.when(F.row_number().over(w) == 1, "inline").otherwise("ref"))
    before = F.sum(F.when(F.col("kind") == "inline", 1).otherwise(0)).over(Window.partitionBy("session").orderBy("seq"))
    return x.withColumn("batch", F.floor((F.greatest(before, F.lit(1)) - 1) / per_batch))


def session_route(sessions: DataFrame) -> DataFrame:
    """(session, known, total, bootstrap_bytes, estimate): how a session is served.

    References suffice where nothing is to be sent; the bootstrap is advised to
    clients that know under a twentieth if it is at most 0.98 of the estimate.
    """
    route = F.when(F.col("estimate") == 0, "references").when((F.col("known") / F.col("total") < 0.05) & (F.col("bootstrap_bytes") <= 0.98 * F.col("estimate")), "bootstrap").otherwise("chunks")
    return sessions.withColumn("route", route)
