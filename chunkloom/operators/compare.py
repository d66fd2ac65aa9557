"""Comparing two builds by their chunks: what is new, shared, moved or gone.

Every operator groups the union of both builds' chunks instead of joining
them: counts combine before the shuffle, so a chunk that occurs very often
costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def is_new():
    return F.col("is_new") == 1


def short(hash_: Column | str, *more: Column | str) -> dict[str, Column]:
    """128 bits as two numbers, ``h1`` and ``h2``, to compare hashes by: a quarter of a written one, and of fixed size."""
    return {"h1": F.xxhash64(hash_, *more), "h2": F.xxhash64(F.lit(1), hash_, *more)}


def by_chunk(both: DataFrame, *keys: str) -> DataFrame:
    """Counts of each chunk (``h1`` and ``h2``, with ``keys``) in either build."""
    return both.select(*keys, "len", "is_new", *[c.alias(n) for n, c in short("hash").items()]).groupBy(*keys, "h1", "h2").agg(F.max("len").alias("len"), F.count_if(~is_new()).alias("n_old"), F.count_if(is_new()).alias("n_new"))


def file_estimates(both: DataFrame) -> DataFrame:
    """Per file of either build: status, sizes, and chunks and bytes to download in the same-path model.

    A file is unchanged if its new chunks all occur in the old file of that
    path, the old file has as many different chunks as the new file has
    chunks, and sizes agree. Repeated unmatched chunks count each time.
    """
    c = by_chunk(both, "path")
    f = c.groupBy("path").agg(
        F.sum("n_old").alias("o"), F.sum("n_new").alias("n_chunks"), F.count_if(F.col("n_old") > 0).alias("d"),
        F.sum(F.when(F.col("n_old") == 0, F.col("n_new")).otherwise(0)).alias("new_chunks"),
        F.sum(F.when(F.col("n_old") == 0, F.col("n_new") * F.col("len")).otherwise(0)).alias("download"),
        F.sum(F.col("n_old") * F.col("len")).alias("old_size"), F.sum(F.col("n_new") * F.col("len")).alias("new_size"),
    )
    same = (F.col("new_chunks") == 0) & (F.col("d") == F.col("n_chunks")) & (F.col("old_size") == F.col("new_size"))
    status = F.when(F.col("n_chunks") == 0, "deleted").when(F.col("o") == 0, "added").when(same, "unchanged").otherwise("modified")
    return f.select("path", status.alias("status"), "old_size", "new_size", "n_chunks", "new_chunks", "download")


def build_estimate(both: DataFrame) -> DataFrame:
    """One row over all files: totals, downloads, rebuild I/O and files by status.

    A modified file is read and written as a whole, an added one is written.
    """
    f = file_estimates(both)
    of = lambda s: F.count_if(F.col("status") == s)
    changed = F.col("status").isin("modified", "added")
    return f.agg(
        F.sum("old_size").alias("old_bytes"), F.sum("new_size").alias("new_bytes"), F.sum("new_chunks").alias("new_chunks"), F.sum("download").alias("download"),
        F.sum(F.when(F.col("status") == "modified", F.col("old_size")).otherwise(0)).alias("rebuild_read"), F.sum(F.when(changed, F.col("new_size")).otherwise(0)).alias("rebuild_write"),
        of("unchanged").alias("unchanged"), of("modified").alias("modified"), of("added").alias("added"), of("deleted").alias("deleted"),
        F.greatest(F.lit(0.0), 1 - F.sum("download") / F.sum("new_size")).alias("reuse"),
    )


def global_estimate(both: DataFrame) -> DataFrame:
    """Chunks and bytes of the new build that occur nowhere in the old one, counted each time and once."""
    c = by_chunk(both)
    fresh = (F.col("n_old") == 0) & (F.col("n_new") > 0)
    return c.agg(
        F.sum("n_new").alias("chunks"), F.sum(F.when(fresh, F.col("n_new")).otherwise(0)).alias("new_chunks"), F.sum(F.when(fresh, F.col("n_new") * F.col("len")).otherwise(0)).alias("new_bytes"),
        F.count_if(fresh).alias("fetch_chunks"), F.sum(F.when(fresh, F.col("len")).otherwise(0)).alias("fetch_bytes"),
    )


def sharing_matrix(chunks: DataFrame, least_reuse: float = 0.3, least_shared: int = 1 << 20) -> DataFrame:
    """For each pair of depots: distinct bytes shared and unique to either, and the share of all their bytes that both hold.

    Shared bytes come from the depots that hold a chunk, so a chunk costs as
    many rows as it has pairs of depots. Every pair of depots is listed; their
    number is that of an app's depots, squared.
    """
    held = chunks.groupBy("hash").agg(F.max("len").alias("len"), F.sort_array(F.collect_set("depot")).alias("ds"))
    sizes = held.select("len", F.explode("ds").alias("depot")).groupBy("depot").agg(F.sum("len").alias("total"))
    met = held.where(F.size("ds") > 1).select("len", "ds", F.posexplode("ds").alias("i", "a")).select("len", "a", F.explode(F.slice("ds", F.col("i") + 2, F.size("ds"))).alias("b"))
    shared = met.groupBy("a", "b").agg(F.sum("len").alias("shared"), F.count(F.lit(1)).alias("shared_chunks"))
    a, b = sizes.select(F.col("depot").alias("a"), F.col("total").alias("ta")), sizes.select(F.col("depot").alias("b"), F.col("total").alias("tb"))
    x = a.join(b, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").fillna(0, ["shared", "shared_chunks"])
    reuse = F.coalesce(F.col("shared") / F.nullif(F.col("ta") + F.col("tb") - F.col("shared"), F.lit(0)), F.lit(0.0))
    return x.select("a", "b", "shared", "shared_chunks", (F.col("ta") - F.col("shared")).alias("unique_a"), (F.col("tb") - F.col("shared")).alias("unique_b"), scalars.rounded(reuse, 6).alias("reuse"), ((reuse > least_reuse) & (F.col("shared") > least_shared)).alias("suggested"))


def fingerprints(chunks: DataFrame) -> DataFrame:
    """Per (build, path): size and a digest of its chunk hashes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "hash")))
    return chunks.groupBy("is_new", "path").agg(F.sum("len").alias("size"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("content_id"))


def classify(both: DataFrame) -> DataFrame:
    """NEW, MODIFIED, DELETED or SAME for each path, with the bytes that no chunk of the old build covers."""
    # the sums of halves of what hashes and places make tell what the whole is made of; a file costs a row a build
    halves = {f"{n}{k}": v for n, c in short("hash", "ord").items() for k, v in (("a", F.shiftright(c, 32)), ("b", c.bitwiseAND(0xFFFFFFFF)))}
    at = both.select("path", "len", "is_new", *[c.alias(n) for n, c in halves.items()])
    side = lambda k, c: F.sum(F.when(F.col("is_new") == k, F.col(c)))
    f = at.groupBy("path").agg(*[side(k, c).alias(f"{n}_{m}") for k, n in ((0, "old"), (1, "new")) for c, m in (("len", "size"), *zip(halves, halves, strict=True))])
    same = F.col("old_size") == F.col("new_size")
    for h in halves:
        same = same & (F.col(f"old_{h}") == F.col(f"new_{h}"))
    state = F.when(F.col("old_size").isNull(), "NEW").when(F.col("new_size").isNull(), "DELETED").when(same, "SAME").otherwise("MODIFIED")
    # only chunks that the old file of the path lacks are looked up elsewhere, each once a path
    per = by_chunk(both, "path")
    unknown = per.groupBy("h1", "h2").agg(F.sum("n_old").alias("anywhere")).where("anywhere = 0").select("h1", "h2")
    fresh = per.where("n_old = 0").join(unknown, ["h1", "h2"], "left_semi").groupBy("path").agg(F.sum(F.col("len") * F.col("n_new")).alias("fresh"))
    x = f.select("path", state.alias("state"), F.coalesce("old_size", F.lit(0)).alias("old_size"), F.coalesce("new_size", F.lit(0)).alias("new_size")).join(fresh, "path", "left")
    return x.select("path", "state", "old_size", "new_size", F.coalesce("fresh", F.lit(0)).alias("fresh_bytes"), (F.col("new_size") - F.coalesce("fresh", F.lit(0))).alias("reused_bytes"))


def renames(both: DataFrame) -> DataFrame:
    """New paths whose content a deleted path had; of several deleted ones the last. Empty files are never renames."""
    f = fingerprints(both)
    state = f.groupBy("path").agg(F.count_if(is_new()).alias("in_new"), F.count_if(~is_new()).alias("in_old"))
    f = f.join(state, "path").where("size > 0 and in_new + in_old = 1")
    gone = f.where("is_new = 0").groupBy("size", "content_id").agg(F.max("path").alias("old_path"))
    return f.where("is_new = 1").join(gone, ["size", "content_id"]).select(F.col("path").alias("new_path"), "old_path", "size")


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """Logical and unique chunks and bytes, and the share that deduplication saves."""
    c = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"), F.max("len").alias("len"))
    return c.agg(
        F.sum("refs").alias("logical_chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("refs") * F.col("len")).alias("logical_bytes"), F.sum("len").alias("unique_bytes"),
        F.max("refs").alias("most_refs"), scalars.rounded(1 - F.sum("len") / F.sum(F.col("refs") * F.col("len")), 6).alias("saved"),
    )


def first_occurrences(chunks: DataFrame, *order: str) -> DataFrame:
    """Each chunk where it first occurs by ``order``, with its references."""
    keys = F.struct(*order)
    return chunks.groupBy("hash").agg(F.min(keys).alias("k"), F.count(F.lit(1)).alias("refs"), F.max("len").alias("len")).select("hash", "len", "refs", *[F.col(f"k.{o}").alias(o) for o in order])


def depot_delta(both: DataFrame) -> DataFrame:
    """Per depot: updated, new, removed or unchanged, with distinct bytes that the old depot lacks."""
    c = by_chunk(both, "depot")
    d = c.groupBy("depot").agg(F.sum("n_old").alias("o"), F.sum("n_new").alias("n"), F.sum(F.when(F.col("n_old") == 0, F.col("len")).otherwise(0)).alias("update_bytes"), F.count_if((F.col("n_old") > 0) != (F.col("n_new") > 0)).alias("differ"), F.sum(F.when(F.col("n_new") > 0, F.col("len")).otherwise(0)).alias("total"))
    action = F.when(F.col("o") == 0, "new").when(F.col("n") == 0, "removed").when(F.col("differ") == 0, "unchanged").otherwise("updated")
    return d.select("depot", action.alias("action"), "update_bytes", "total")


def install_plan(new: DataFrame, held: DataFrame, eligible: DataFrame) -> DataFrame:
    """Depots in order, each priced against what is held and the depots before it.

    new: (depot, hash, len); held: (hash); eligible: (depot, pos, had). A chunk
    is paid by the first depot that brings it.
    """
    want = new.join(eligible, "depot").groupBy("hash").agg(F.min("pos").alias("pos"), F.max("len").alias("len"))
    pay = want.join(held.select("hash").distinct(), "hash", "left_anti").groupBy("pos").agg(F.sum("len").alias("fetch"))
    totals = new.groupBy("depot", "hash").agg(F.max("len").alias("len")).groupBy("depot").agg(F.sum("len").alias("total"))
    x = eligible.join(totals, "depot", "left").join(pay, "pos", "left").select("depot", "pos", "had", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("fetch", F.lit(0)).alias("fetch"))
    action = F.when(F.col("fetch") == 0, "no-op").when(F.col("had"), "update").otherwise("install")
    route = (
        F.when(F.col("fetch") == 0, "no-op")
        .when(F.col("had"), F.when(F.col("fetch") * 10 < F.col("total"), "plan").otherwise("chunks"))
        .otherwise(F.when(F.col("fetch") * 2 < F.col("total"), "chunks").otherwise("bootstrap"))
    )
    return x.select("depot", "pos", action.alias("action"), route.alias("route"), "fetch", "total")


def availability(needed: DataFrame, cache: DataFrame, previous: DataFrame) -> DataFrame:
    """Where each needed chunk can come from; a chunk in both places is read from the previous build."""
    where = needed.join(cache.select("hash", F.lit(1).alias("c")).distinct(), "hash", "left").join(previous.select("hash", F.lit(1).alias("p")).distinct(), "hash", "left")
    have = F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), "both").when(F.col("c").isNotNull(), "cache").when(F.col("p").isNotNull(), "previous").otherwise("missing")
    source = F.when(F.col("p").isNotNull(), "previous").when(F.col("c").isNotNull(), "cache").otherwise("network")
    return where.select(*needed.columns, have.alias("have"), source.alias("source"))


def rebuild_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("have", "source").agg(F.count(F.lit(1)).alias("ops"), F.sum("len").alias("bytes"))


def with_location(wanted: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Wanted hashes with the pack and offset that hold them; located is false where none does."""
    return wanted.select("hash").distinct().join(chunk_map, "hash", "left").withColumn("located", F.col("pack").isNotNull())


def inventory(chunks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per version: distinct chunks and bytes, and those first seen in it (what a store grows by)."""
    per = chunks.groupBy("version", "hash").agg(F.max("len").alias("len"))
    first = per.groupBy("hash").agg(F.min("version").alias("version"), F.max("len").alias("len")).groupBy("version").agg(F.count(F.lit(1)).alias("added_chunks"), F.sum("len").alias("added_bytes"))
    return per.groupBy("version").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes")).join(first, "version", "left").select("version", "chunks", "bytes", F.coalesce("added_chunks", F.lit(0)).alias("added_chunks"), F.coalesce("added_bytes", F.lit(0)).alias("added_bytes"))
