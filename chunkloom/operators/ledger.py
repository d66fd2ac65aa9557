"""A chunk store as tables: ledger (hash, len_raw, len_stored, pack, off), references (asset, hash), packs.

Reference counts are recomputed from the distinct references, so publishing,
replacing and removing assets are set operations that may be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

SMALL_PACK, DEAD_RATIO, PACK_TARGET = 8 << 20, 0.30, 128 << 20


def refcounts(ledger: DataFrame, refs: DataFrame) -> DataFrame:
    """The ledger with the number of assets that use each chunk."""
    n = refs.select("asset", "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("refcount"))
    return ledger.join(n, "hash", "left").withColumn("refcount", F.coalesce("refcount", F.lit(0)))


def publish(refs: DataFrame, asset_refs: DataFrame) -> DataFrame:
    """References after (re)publishing assets: theirs are replaced, others stay."""
    kept = refs.join(asset_refs.select("asset").distinct(), "asset", "left_anti")
    return kept.unionByName(asset_refs.select(*refs.columns)).distinct()


def unpublish(refs: DataFrame, assets: DataFrame) -> DataFrame:
    return refs.join(assets.select("asset").distinct(), "asset", "left_anti")


def put_chunks(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ledger with chunks it lacked; of equal new ones the first by all columns stays."""
    fresh = chunks.groupBy("hash").agg(F.min(F.struct(*[c for c in ledger.columns if c != "hash"])).alias("r")).select("hash", "r.*")
    return ledger.unionByName(fresh.join(ledger.select("hash"), "hash", "left_anti").select(*ledger.columns))


def store_stats(ledger: DataFrame, refs: DataFrame) -> DataFrame:
    counted = refcounts(ledger, refs)
    dead = F.col("refcount") == 0
    return counted.agg(
        F.count(F.lit(1)).alias("unique_chunks"), F.sum("len_stored").alias("stored_bytes"), F.sum("len_raw").alias("raw_bytes"), F.sum(F.col("len_raw") * F.col("refcount")).alias("logical_bytes"),
        F.count_if(dead).alias("zero_ref_chunks"), F.sum(F.when(dead, F.col("len_stored")).otherwise(0)).alias("zero_ref_bytes"), F.countDistinct("pack").alias("packs"),
    )


def fragmentation(ledger: DataFrame, packs: DataFrame, small: int = SMALL_PACK) -> DataFrame:
    """Per pack that the ledger names: bytes on disk, bytes and chunks that the ledger has in it, dead ratio, and whether it is small.

    packs: (pack, disk_bytes). Chunks that left the ledger stay in their pack's file until it is rewritten.
    """
    live = ledger.groupBy("pack").agg(F.sum("len_stored").alias("live_bytes"), F.count(F.lit(1)).alias("live_chunks"))
    x = live.join(packs, "pack", "left").withColumn("disk_bytes", F.coalesce("disk_bytes", F.lit(0)))
    dead = F.when(F.col("disk_bytes") == 0, 0.0).otherwise(1 - F.least("live_bytes", "disk_bytes") / F.col("disk_bytes"))
    return x.select("pack", "disk_bytes", "live_bytes", "live_chunks", scalars.rounded(dead, 6).alias("dead_ratio"), (F.col("disk_bytes") < small).alias("small"))


def fragmentation_score(frag: DataFrame) -> DataFrame:
    """One row: the share of small packs plus the share of dead bytes."""
    dead = F.greatest(F.sum("disk_bytes") - F.sum("live_bytes"), F.lit(0))
    return frag.agg(F.count(F.lit(1)).alias("packs"), F.count_if("small").alias("small_packs"), dead.alias("dead_bytes"), scalars.rounded(F.count_if("small") / F.count(F.lit(1)) + F.coalesce(dead / F.nullif(F.sum("disk_bytes"), F.lit(0)), F.lit(0.0)), 6).alias("score"))


def repack_plan(frag: DataFrame, target: int = PACK_TARGET, dead_ratio: float = DEAD_RATIO) -> DataFrame:
    """Packs to rewrite: small ones merged in groups near ``target``, large ones with many dead bytes compacted.

    Packs come by falling dead ratio. A group closes when the next pack would
    exceed the target and it holds two at least; a last group of one is left
    alone. Each decision depends on those before, so the fold takes all small
    packs in order: a row of numbers for a pack of many megabytes.
    """
    import pandas as pd

    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dead_ratio", "pack"], ascending=[False, True], kind="stable")
        number, held, size, out = 0, 0, 0, []
        for r in rows.itertuples(index=False):
            if held + r.live_bytes > target and size > 1:
                number, held, size = number + 1, 0, 0
            held, size = held + r.live_bytes, size + 1
            out.append(number)
        rows = rows.assign(grp=out)
        return rows[rows.groupby("grp").grp.transform("size") > 1][["pack", "grp", "live_bytes"]]

    merged = frag.where("small").select("pack", "live_bytes", "dead_ratio", F.lit(1).alias("all")).groupBy("all").applyInPandas(groups, "pack string, grp long, live_bytes long")
    compact = frag.where(~F.col("small") & (F.col("dead_ratio") > dead_ratio)).select("pack", F.lit(None).cast("long").alias("grp"), "live_bytes")
    return merged.select("pack", F.lit("merge").alias("action"), "grp", "live_bytes").unionByName(compact.select("pack", F.lit("compact").alias("action"), "grp", "live_bytes"))


def repack_run(ledger: DataFrame, plan: DataFrame, target: int = PACK_TARGET) -> DataFrame:
    """The ledger after a plan: chunks of each group lie in new packs in their old order, all others where they were.

    A new pack closes once it has reached ``target``. The old packs hold nothing then, and can go to quarantine.
    """
    from .islands import pack_numbers

    groups = plan.select("pack", F.coalesce(F.concat(F.lit("merge-"), F.col("grp").cast("string")), F.concat(F.lit("compact-"), "pack")).alias("stream"))
    moved = ledger.join(groups, "pack").withColumn("len", F.col("len_stored"))
    order = Window.partitionBy("stream").orderBy("pack", "off")
    dealt = pack_numbers(moved.withColumn("ord", F.row_number().over(order).cast("long")), target)
    dealt = dealt.withColumn("pack", F.concat("stream", F.lit("-"), F.col("grp").cast("string")))
    placed = append_offsets(dealt.drop("off")).select(*ledger.columns)
    return ledger.join(groups, "pack", "left_anti").select(*ledger.columns).unionByName(placed)


def publish_batch(refs: DataFrame, ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """References after a whole batch (asset, hash) is published, or as they were if any chunk of it is unknown to the ledger."""
    lost = unknown_references(batch, ledger).agg(F.count(F.lit(1)).alias("lost"))
    ok = batch.join(lost, F.col("lost") == 0).drop("lost")  # against one row
    return publish(refs, ok)


def compact_index(deltas: DataFrame, most: int = 8, share_pct: int = 25) -> DataFrame:
    """(index, hash, generation, is_base, tombstone, bytes): indexes that have too much in deltas become one base of their live rows; others stay."""
    due = needs_compaction(deltas.groupBy("index", "generation", "is_base").agg(F.sum("bytes").alias("bytes")), most, share_pct).where("compact").select("index")
    live = deltas.join(due, "index", "left_semi").groupBy("index", "hash").agg(F.max_by(F.struct("generation", "tombstone", "bytes"), "generation").alias("r")).where("not r.tombstone")
    based = live.select("index", "hash", F.col("r.generation").alias("generation"), F.lit(True).alias("is_base"), F.lit(False).alias("tombstone"), F.col("r.bytes").alias("bytes"))
    top = deltas.join(due, "index", "left_semi").groupBy("index").agg(F.max("generation").alias("top"))
    based = based.join(top, "index").withColumn("generation", F.col("top")).select(*deltas.columns)
    return deltas.join(due, "index", "left_anti").select(*deltas.columns).unionByName(based)


def gc_candidates(counted: DataFrame, now: int, grace: int) -> DataFrame:
    """Unreferenced chunks whose grace is over; one never published has no time and is over at once."""
    return counted.where((F.col("refcount") == 0) & (F.lit(now) - F.coalesce("zero_since", F.lit(0)) >= grace))


def latest_wins(deltas: DataFrame, key: str = "hash", order: str = "generation") -> DataFrame:
    """The live rows of stacked segments: of each key the newest, unless it is a tombstone."""
    rest = [c for c in deltas.columns if c != key]
    return deltas.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").where("not tombstone").drop("tombstone")


def needs_compaction(segments: DataFrame, most: int = 8, share_pct: int = 25) -> DataFrame:
    """(index, is_base, bytes) -> whether an index has too many deltas or too many bytes in them."""
    x = segments.groupBy("index").agg(F.count_if(~F.col("is_base")).alias("deltas"), F.sum(F.when(F.col("is_base"), 0).otherwise(F.col("bytes"))).alias("delta_bytes"), F.sum(F.when(F.col("is_base"), F.col("bytes")).otherwise(0)).alias("base_bytes"))
    return x.withColumn("compact", (F.col("deltas") > most) | (F.col("delta_bytes") * 100 > F.col("base_bytes") * share_pct))


def unknown_references(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """References to chunks that the ledger doesn't have; none in a sound store."""
    return refs.join(ledger.select("hash"), "hash", "left_anti")


def batch_lookup(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each asked id with its status and, where available, its place."""
    return ids.join(ledger.select("hash", "pack", "off", "len_stored"), "hash", "left").withColumn("status", F.when(F.col("pack").isNull(), "missing").otherwise("available"))


def asset_bytes(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Stored bytes that each asset refers to, and those it alone keeps alive."""
    per = refs.select("asset", "hash").distinct()
    owned = per.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    x = per.join(owned, "hash").join(ledger.select("hash", "len_stored"), "hash")
    return x.groupBy("asset").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len_stored").alias("bytes"), F.sum(F.when(F.col("n") == 1, F.col("len_stored")).otherwise(0)).alias("own_bytes"))


def live_packs(ledger: DataFrame, refs: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs on disk: live if a referenced chunk lies in them, else orphan."""
    used = ledger.join(refs.select("hash").distinct(), "hash", "left_semi").select("pack").distinct().withColumn("live", F.lit(True))
    return packs.join(used, "pack", "left").withColumn("live", F.coalesce("live", F.lit(False)))


def append_offsets(chunks: DataFrame) -> DataFrame:
    """(pack, ord, len) with the offset at which each chunk is appended."""
    w = Window.partitionBy("pack").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("off", F.coalesce(F.sum("len").over(w), F.lit(0)))


def quarantine(packs: DataFrame, live: DataFrame, now: int, period: int) -> DataFrame:
    """(pack, quarantined_at) and (pack) with references -> what becomes of each pack.

    A dead pack goes to quarantine, stays for ``period`` seconds and is then
    swept; one that is referenced again comes back.
    """
    x = packs.join(live.select("pack").distinct().withColumn("used", F.lit(True)), "pack", "left")
    held, used = F.col("quarantined_at").isNotNull(), F.col("used").isNotNull()
    action = F.when(held & used, "restore").when(used, "keep").when(~held, "quarantine").when(F.lit(now) - F.col("quarantined_at") >= period, "sweep").otherwise("wait")
    return x.select("pack", action.alias("action"), F.when(action == "quarantine", F.lit(now).cast("long")).when(action == "wait", F.col("quarantined_at")).alias("quarantined_at"))


def request_accounting(requests: DataFrame) -> DataFrame:
    """(format, bytes): requests and bytes of each format."""
    return requests.groupBy("format").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))
