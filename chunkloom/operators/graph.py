"""Version graphs: which patches to keep, and what a traffic of updates costs with them.

Versions are numbered 0 to n - 1. Pair generators and traffic rules are joins
over ranges; the cheapest path is a min-plus relaxation, one grouped join per
round, which ends after as many rounds as the longest cheapest path has steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars

#: Rules (kind, min_skip, max_skip, min_age, probability) of the built-in traffic models.
MODELS = {
    "adjacent-heavy": [("adjacent", None, None, None, 0.80), ("skip_range", 2, 4, None, 0.15), ("old_to_latest", None, None, 6, 0.04), ("reinstall_latest", None, None, None, 0.01)],
    "skip-heavy": [("adjacent", None, None, None, 0.40), ("skip_range", 2, 8, None, 0.40), ("old_to_latest", None, None, 6, 0.15), ("reinstall_latest", None, None, None, 0.05)],
    "live-service-weekly": [("adjacent", None, None, None, 0.65), ("skip_range", 2, 3, None, 0.25), ("old_to_latest", None, None, 6, 0.08), ("reinstall_latest", None, None, None, 0.02)],
    "major-release": [("adjacent", None, None, None, 0.30), ("skip_range", 2, 5, None, 0.20), ("old_to_latest", None, None, 4, 0.45), ("reinstall_latest", None, None, None, 0.05)],
    "random": [("skip_range", 1, 1 << 30, None, 1.0)],
}
RULE = "kind string, min_skip int, max_skip int, min_age int, probability double"
#: Bytes that a client applies in a millisecond.
APPLY_RATE = 500 * 1024 * 1024 // 1000


def adjacent(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def all_pairs(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.when(F.col("id") < n - 1, F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long")))).alias("dst"))


def ladder(spark: SparkSession, n: int, dense: bool = False) -> DataFrame:
    """Steps of powers of two, from multiples of the step or from everywhere."""
    steps = spark.range(max(1, n.bit_length())).select(F.pow(F.lit(2.0), F.col("id")).cast("long").alias("d")).where(F.col("d") < n)
    starts = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long") - F.col("d"), F.lit(1).cast("long") if dense else F.col("d"))
    return steps.select(F.explode(starts).alias("src"), "d").select("src", (F.col("src") + F.col("d")).alias("dst")).distinct()


def base_hub(spark: SparkSession, n: int, base: int, both_ways: bool = False) -> DataFrame:
    out = spark.range(n).where(F.col("id") != base).select(F.lit(base).cast("long").alias("src"), F.col("id").alias("dst"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both_ways else out


def hot_latest(spark: SparkSession, n: int, k: int) -> DataFrame:
    """Adjacent pairs, and the ``k`` versions before the latest straight to it."""
    jumps = spark.range(2, max(2, min(k, n - 1) + 1)).select((F.lit(n - 1) - F.col("id")).alias("src"), F.lit(n - 1).cast("long").alias("dst"))
    return adjacent(spark, n).unionByName(jumps).distinct()


def traffic(spark: SparkSession, rules: DataFrame | str, n: int) -> DataFrame:
    """Weighted updates (src, dst, probability, rule); a rule spreads evenly over its pairs, and rules without pairs drop out."""
    if isinstance(rules, str):
        rules = spark.createDataFrame(MODELS[rules], RULE)
    latest = n - 1
    pairs = all_pairs(spark, n).unionByName(spark.range(latest, n).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    d = F.col("dst") - F.col("src")
    lo = F.greatest(F.coalesce("min_skip", F.lit(1)), F.lit(1))
    fits = (
        ((F.col("kind") == "adjacent") & (d == 1))
        | ((F.col("kind") == "skip_range") & (d >= lo) & (d <= F.greatest(F.coalesce("max_skip", F.lit(1 << 30)), lo)))
        | ((F.col("kind") == "old_to_latest") & (F.col("dst") == latest) & (d >= F.greatest(F.coalesce("min_age", F.lit(1)), F.lit(1))))
        | ((F.col("kind") == "reinstall_latest") & (d == 0))
    )
    # rules are a handful, so the inequality join broadcasts them
    hit = pairs.join(F.broadcast(rules.withColumn("pos", F.monotonically_increasing_id())), fits)
    each = hit.withColumn("p", F.col("probability") / F.count(F.lit(1)).over(Window.partitionBy("pos")))
    merged = each.groupBy("src", "dst").agg(F.sum("p").alias("p"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"])), "+").alias("rule"))
    return merged.select("src", "dst", (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(0)))).alias("probability"), "rule")


def cheapest_paths(edges: DataFrame, sources: DataFrame, by: tuple[str, ...] = (), rounds: int = 64) -> DataFrame:
    """(src, dst, bytes) and (src) -> (src, dst, bytes, steps) of the cheapest path, fewest steps among equals.

    An edge without bytes costs 1. Columns in ``by``, which edges and sources
    share, keep graphs apart that are searched together. Each round lengthens
    paths by one step and keeps the best of each pair; lineage is cut where the
    session has a shared folder for it.
    """
    w = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"), F.coalesce("bytes", F.lit(1)).cast("long").alias("w")).groupBy(*by, "u", "v").agg(F.min("w").alias("w"))
    best = sources.select(*by, F.col("src").cast("long").alias("src")).distinct().select(*by, "src", F.col("src").alias("u"), F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("steps"))
    mark = None
    for _ in range(rounds):
        longer = best.join(w, [*by, "u"]).select(*by, "src", F.col("v").alias("u"), (F.col("bytes") + F.col("w")).alias("bytes"), (F.col("steps") + 1).alias("steps"))
        best = best.unionByName(longer).groupBy(*by, "src", "u").agg(F.min(F.struct("bytes", "steps")).alias("m")).select(*by, "src", "u", "m.bytes", "m.steps")
        best = _settled(best)
        now = best.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("steps")).first()
        if now == mark:
            return best.withColumnRenamed("u", "dst")
        mark = now
    raise RuntimeError("paths did not settle")


def _settled(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def explain_path(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """The hops of the cheapest path, in order: an edge lies on it if it closes the best cost of its ends."""
    spark = edges.sparkSession
    out = cheapest_paths(edges, spark.range(src, src + 1).select(F.col("id").alias("src")))
    back = cheapest_paths(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "bytes"), spark.range(dst, dst + 1).select(F.col("id").alias("src")))
    total = out.where(F.col("dst") == dst).select(F.col("bytes").alias("tb"), F.col("steps").alias("ts"))
    a = out.select(F.col("dst").alias("u"), F.col("bytes").alias("ab"), F.col("steps").alias("as_"))
    b = back.select(F.col("dst").alias("v"), F.col("bytes").alias("bb"), F.col("steps").alias("bs"))
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.coalesce("bytes", F.lit(1)).alias("w"))
    on = e.join(a, "u").join(b, "v").join(F.broadcast(total), (F.col("ab") + F.col("w") + F.col("bb") == F.col("tb")) & (F.col("as_") + 1 + F.col("bs") == F.col("ts")))
    w = Window.partitionBy("as_").orderBy("u", "v")
    return on.withColumn("k", F.row_number().over(w)).where("k = 1").select((F.col("as_") + 1).alias("hop"), F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("bytes"))


def simulate(queries: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each update's bytes and steps: its path, the whole build on reinstall, or the whole build uncovered.

    queries: (policy, src, dst, probability); paths: (policy, src, dst, bytes, steps); nodes: (id, full).
    """
    x = queries.join(paths.where("src <> dst"), ["policy", "src", "dst"], "left").join(nodes, F.col("dst") == F.col("id"))
    again, found = F.col("src") == F.col("dst"), F.col("bytes").isNotNull()
    return x.select("policy", "src", "dst", "probability", F.when(found & ~again, F.col("bytes")).otherwise(F.col("full")).alias("bytes"), F.when(found & ~again, F.col("steps")).otherwise(0).alias("steps"), (again | found).alias("covered"))


def weighted_percentile(values: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The first value whose running weight reaches ``q`` of the total."""
    per = values.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    acc = F.sum("w").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(*by))
    return per.withColumn("reached", acc >= F.lit(q) * total - 1e-12).where("reached").groupBy(*by).agg(F.min(value).alias("percentile"))


def policy_summary(outcomes: DataFrame, users: int) -> DataFrame:
    """Per policy: mean and percentiles of bytes, steps, apply time, bytes served and coverage; means are cut to whole numbers."""
    p, mean = F.col("probability"), lambda c: F.sum(F.col("probability") * c) / F.sum("probability")
    base = outcomes.groupBy("policy").agg(
        F.floor(scalars.rounded(mean(F.col("bytes")), 6)).alias("avg_bytes"), F.max("bytes").alias("worst_bytes"), scalars.rounded(mean(F.col("steps")), 9).alias("avg_steps"), F.max("steps").alias("max_steps"),
        F.floor(scalars.rounded(F.lit(users) * mean(F.col("bytes")), 3)).alias("served_bytes"), scalars.rounded(F.sum(F.when(F.col("covered"), p).otherwise(0.0)), 9).alias("coverage"),
    )
    for name, q in (("median_bytes", 0.5), ("p95_bytes", 0.95), ("p99_bytes", 0.99)):
        base = base.join(weighted_percentile(outcomes, ["policy"], "bytes", "probability", q).withColumnRenamed("percentile", name), "policy")
    return base


def edge_pool(policies: DataFrame) -> DataFrame:
    """(policy, src, dst): each edge once, with the policies that use it."""
    return policies.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("policy")), ",").alias("policies"))


def base_choice(outcomes: DataFrame) -> DataFrame:
    """(base, probability, bytes): the base with the lowest mean bytes, the first of equals."""
    m = outcomes.groupBy("base").agg(scalars.rounded(F.sum(F.col("probability") * F.col("bytes")) / F.sum("probability"), 6).alias("mean"))
    return m.agg(F.min(F.struct("mean", "base")).alias("m")).select("m.base", "m.mean")


def hot_pairs(queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest updates that skip a version."""
    return queries.where("dst - src > 1").orderBy(F.desc(scalars.rounded("probability", 12)), "src", "dst").limit(k)


def planned_pairs(versions: DataFrame, shares: DataFrame, pinned: DataFrame, most: int = 3) -> DataFrame:
    """Patch pairs to the latest version by rule: pinned, previous, latest stable, then most installed; ``most`` at most, each once.

    versions: (id, idx); shares: (id, share); pinned: (src, dst).
    """
    latest = versions.agg(F.max_by("id", "idx").alias("dst"), F.max("idx").alias("top"))
    old = versions.join(F.broadcast(latest), F.col("idx") < F.col("top"))
    stable = ~F.lower("id").rlike("beta|alpha|rc|-")
    previous = old.where(F.col("idx") == F.col("top") - 1).select(F.lit(1).alias("prio"), F.lit(0.0).alias("r"), F.col("id").alias("src"), "dst", F.lit("previous").alias("rule"))
    calm = old.where(stable).groupBy("dst").agg(F.max_by("id", "idx").alias("src")).select(F.lit(2).alias("prio"), F.lit(0.0).alias("r"), "src", "dst", F.lit("latest-stable").alias("rule"))
    top = old.join(shares, "id", "left").where(F.coalesce("share", F.lit(0.0)) > 0).select(F.lit(3).alias("prio"), (-F.col("share")).alias("r"), F.col("id").alias("src"), "dst", F.lit("top-installed").alias("rule"))
    pins = pinned.select(F.lit(0).alias("prio"), F.lit(0.0).alias("r"), "src", "dst", F.lit("pinned").alias("rule"))
    each = pins.unionByName(previous).unionByName(calm).unionByName(top).groupBy("src", "dst").agg(F.min(F.struct("prio", "r", "rule")).alias("m"))
    order = Window.orderBy("m.prio", "m.r", "src", "dst")  # one row per version at most
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("place", "src", "dst", F.col("m.rule").alias("rule"))


def latest_major(versions: DataFrame) -> DataFrame:
    """(line, idx, id): the last version whose leading number exceeds its predecessor's, else the first."""
    major = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    w = Window.partitionBy("line").orderBy("idx")
    x = versions.withColumn("rises", F.coalesce(major > F.lag(major).over(w), F.lit(False)))
    return x.groupBy("line").agg(F.coalesce(F.max(F.when(F.col("rises"), F.col("idx"))), F.min("idx")).alias("idx"))


def apply_ms(size: Column) -> Column:
    return F.floor(size / APPLY_RATE)
