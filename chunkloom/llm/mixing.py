"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of
the source. Documents are ranked within their source by size class and hash;
the running sum of expected copies plus one random offset of the source is cut
at whole numbers, and a document is emitted once per whole number crossed.
Sorting by size first makes the words taken, and not just the copies, come
near the target.

A running sum over a hot source is never made in one task: documents fall into
(source, size class, hash byte) cells, the sum over cells is taken from their
counts, and only the rank inside a cell needs its rows together. Sums are in
fixed point, so they are exact and equal on every run.

Defined results: a null text has size 0; null is a source of its own, the last;
a source without words has target 0; repeated rows are documents of their own;
an empty table gives an empty result; extra columns go along, and one with the
name of an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Kept, cut

#: Size classes in each doubling of the size.
CLASSES = 8
#: Fractional bits of the running sum of copies.
BITS = 26
#: Columns that ``mix`` adds.
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """A whole number that grows with the logarithm of ``size``, in integer arithmetic."""
    bits = F.length(F.bin(size))
    return F.when(size <= 0, F.lit(-1)).otherwise(bits * CLASSES + (F.call_function("shiftright", size * 2 * CLASSES, bits) - CLASSES)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(skey, source, source_size) -> the same with ``target``.

    Weights repeat over the sources in order of code points, null last. All
    sources that can't reach their share stop at ``most`` times their size; the
    water level of the others is found from one running sum over the sources in
    order of the level at which each is full. This takes one task, over one row
    per source and none per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    x = x.withColumn("level", F.col("left") / F.col("open"))
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    return x.select("skey", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 17) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (0 to ``most``)."""
    kept = Kept(docs, "mix_", OWN)
    docs = kept.df
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    x = docs.withColumns({"mix_size": words(F.col("text")), "mix_key": key, "mix_hash": digest, "mix_tie": F.xxhash64("text")})
    x = x.withColumn("mix_cell", F.concat(F.lpad((size_class(F.col("mix_size")) + 1).cast("string"), 4, "0"), F.substring("mix_hash", 1, 2)))

    # at most CLASSES * 64 * 256 cells a source, each a row; read twice, so computed once
    cells = cut(x.groupBy("mix_key", "mix_cell").agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("words")))
    named = F.when(F.col("skey") != "", F.substr("skey", F.lit(2))).alias("source")
    sizes = cells.groupBy(F.col("mix_key").alias("skey")).agg(F.sum("words").alias("source_size")).select("skey", named, "source_size")
    targets = source_targets(sizes, weights, share, most)
    before = Window.partitionBy("mix_key").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "skey")), 1, 6), 16, 10).cast("long") * F.lit(1 << (BITS - 24))
    targets = targets.select(F.col("skey").alias("mix_skey"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.coalesce(F.round(F.col("target") / F.nullif("source_size", F.lit(0)) * F.lit(float(1 << BITS))), F.lit(0.0)).cast("long").alias("mix_step"), offset.alias("mix_offset"))
    cells = cells.select(F.col("mix_key").alias("mix_ckey"), F.col("mix_cell").alias("mix_ccell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before")).join(targets, F.col("mix_ckey") == F.col("mix_skey"))

    rank = F.row_number().over(Window.partitionBy("mix_key", "mix_cell").orderBy("mix_hash", "mix_size", "mix_tie"))
    x = x.withColumn("mix_rank", rank).join(cells, (F.col("mix_key") == F.col("mix_ckey")) & (F.col("mix_cell") == F.col("mix_ccell")))
    reached = (F.col("mix_before") + F.col("mix_rank")) * F.col("mix_step") + F.col("mix_offset")
    copies = F.shiftright(reached, BITS) - F.shiftright(reached - F.col("mix_step"), BITS)
    return x.select(*kept.columns, "mix_size", "mix_source_size", "mix_target", copies.cast("int").alias("mix_copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: a row per copy, with the columns that ``mix`` was given."""
    kept = [F.col(f"`{c}`") for c in mixed.columns if c not in OWN]
    return mixed.where("mix_copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), "mix_copies")).alias("mix_copies")).drop("mix_copies")
