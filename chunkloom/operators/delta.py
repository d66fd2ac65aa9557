"""Block deltas: what of a new file can be copied from old blocks, and rebuilding it from that."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.scalars import Bloom
from .chunking import block_anchors, window_anchors, window_prints

OP = "path string, seq int, op string, entry string, old_off long, new_off long, len long, data binary"


def candidate_pick(matches: DataFrame) -> DataFrame:
    """Of several old blocks with a new block's hash, the one to copy from.

    (path, new_off, entry, old_off, continues): an old file of the same path
    comes first, then a block that continues the copy before, then the lowest
    offset, then the first entry.
    """
    w = Window.partitionBy("path", "new_off").orderBy((F.col("entry") == F.col("path")).cast("int").desc(), F.col("continues").cast("int").desc(), "old_off", "entry")
    return matches.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _first_places(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of full old blocks: the places of each content in each file, and its first place in the build (lowest offset, then first entry).

    A content that is everywhere costs a row a file, and no two of its copies are ever paired.
    """
    own = blocks.groupBy("strong", "path").agg(F.array_sort(F.collect_list("off")).alias("offs"), *[F.first(c).alias(c) for c in ("print", "gram", "at")])
    anywhere = own.groupBy("strong").agg(F.min(F.struct(F.col("offs")[0].alias("off"), F.col("path").alias("entry"))).alias("any"), *[F.first(c).alias(c) for c in ("print", "gram", "at")])
    return own.select("strong", "path", "offs"), anywhere


def two_stage_match(old: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """Aligned blocks of new files that an old block equals, and the one to copy: of the same path if there is one, else anywhere; short tails never match."""
    own, anywhere = _first_places(block_anchors(old, size))
    x = block_anchors(new, size).select("path", F.col("off").alias("new_off"), "strong").join(own, ["strong", "path"], "left").join(anywhere, "strong")
    same = F.col("offs").isNotNull()
    return x.select("path", "new_off", F.when(same, F.col("path")).otherwise(F.col("any.entry")).alias("entry"), F.when(same, F.col("offs")[0]).otherwise(F.col("any.off")).alias("old_off"))


def _greedy(path: str, data: bytes, size: int, candidates: list[dict], places: dict[str, list[int]]) -> list[tuple]:
    """Left to right: copy where a window is an old block, else move on to the next candidate.

    Among the blocks of the same path the one that continues the copy before
    comes first, then the lowest offset; else the first place in the build is taken.
    """
    ops, pending, strong, at = [], 0, None, -1
    for c in sorted(candidates, key=lambda c: c["new_off"]):
        if c["new_off"] < pending:
            continue
        if c["new_off"] != at:
            at, strong = c["new_off"], hashlib.sha256(data[c["new_off"] : c["new_off"] + size]).digest()
        if c["strong"] != strong:
            continue
        last = ops[-1] if ops and ops[-1][0] == "copy" and pending == at else None
        own = places.get(strong)
        if own:
            i = bisect_left(own, last[2] + last[4]) if last and last[1] == path else len(own)
            entry, off = path, own[i] if i < len(own) and own[i] == last[2] + last[4] else own[0]
        else:
            entry, off = c["entry"], c["old_off"]
        if pending < at:
            ops.append(("inline", None, None, pending, at - pending, data[pending:at]))
        if last and last[1] == entry and last[2] + last[4] == off:
            ops[-1] = ("copy", entry, last[2], last[3], last[4] + size, None)
        else:
            ops.append(("copy", entry, off, at, size, None))
        pending = at + size
    if pending < len(data):
        ops.append(("inline", None, None, pending, len(data) - pending, data[pending:]))
    return ops


def equal_windows(new: DataFrame, anywhere: DataFrame, size: int) -> DataFrame:
    """Windows of new files with the fingerprint of an old block, a row each, and that block's first place."""
    seats = anywhere.groupBy("gram").agg(F.collect_set("at").alias("ats"))  # no more than a block has bytes
    offs = F.transform(F.filter("ats", lambda a: a.between(F.col("low"), F.col("high"))), lambda a: F.col("pos") - a)
    tried = window_anchors(new, size).join(seats, "gram").select("path", offs.alias("offs")).where("size(offs) > 0").groupBy("path").agg(F.flatten(F.collect_list("offs")).alias("offs"))
    prints = window_prints(new.select("path", "content").join(tried, "path"), size)
    return prints.join(anywhere, "print").select("path", "new_off", "strong", F.col("any.entry").alias("entry"), F.col("any.off").alias("old_off"))


def block_diff(old: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """(path, content binary) of both builds -> operations that make each new file from old blocks of any file.

    Every window of ``size`` bytes of a new file has an anchor, its smallest
    gram by hash, and so has every old block; a window that equals a block has
    the same anchor at the same place. So anchors, two a block on average, are
    joined to the places that they have in old blocks, not to the blocks: many
    blocks share a common gram, but a window has one anchor at one place and is
    suggested once. Fingerprints of these windows are joined to those of the
    blocks, and what that finds meets the file, where hashes decide. Nothing
    larger than a file is in one task.
    """
    own, anywhere = _first_places(block_anchors(old, size))
    met = equal_windows(new, anywhere, size)
    places = own.join(met.select("path", "strong").distinct(), ["path", "strong"], "left_semi").groupBy("path").agg(F.collect_list(F.struct("strong", "offs")).alias("places"))
    found = met.groupBy("path").agg(F.collect_list(F.struct("new_off", "strong", "entry", "old_off")).alias("candidates"))
    files = new.select("path", "content").join(found, "path", "left").join(places, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for path, content, candidates, own_places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ops = _greedy(path, content or b"", size, candidates or [], {p["strong"]: p["offs"] for p in own_places or []})
                rows += [(path, k, *op) for k, op in enumerate(ops)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], [c.split()[0] for c in OP.split(", ")])

    small_batches(new)
    return files.select("path", "content", "candidates", "places").mapInArrow(run, OP)


#: Keys that one part of a filter is meant for.
PART_KEYS = 100_000


def _dealt(hashes: DataFrame, parts: int) -> DataFrame:
    return hashes.select("hash", F.pmod(F.xxhash64("hash"), F.lit(parts)).alias("part"))


def bloom_filters(keys: DataFrame, parts: int) -> DataFrame:
    """Different keys (hash hex) -> part, size and bits of a filter that is dealt by hash: executors make it and keep it, and a task has one part of it."""

    def build(key: tuple, keys: pa.Table) -> pa.Table:
        f = Bloom(keys.num_rows)
        f.add_all([bytes.fromhex(h) for h in keys.column("hash").to_pylist()])
        return pa.table({"part": [key[0].as_py()], "size": [keys.num_rows], "bits": [f.bits.tobytes()]})

    return _dealt(keys, parts).groupBy("part").applyInArrow(build, "part long, size long, bits binary")


def filtered(hashes: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """``hashes`` (hash hex) with ``maybe``: whether the filter of so many parts takes one for known. Each part of them meets its part of the filter."""

    def probe(key: tuple, hashes: pa.Table, filters: pa.Table) -> pa.Table:
        found = hashes.column("hash").to_pylist()
        maybe = [False] * len(found)
        if found and filters.num_rows:
            f = Bloom(filters.column("size")[0].as_py(), np.frombuffer(filters.column("bits")[0].as_py(), np.uint8))
            maybe = f.contains_all([bytes.fromhex(h) for h in found]).tolist()
        return pa.table({"hash": pa.array(found, pa.string()), "maybe": pa.array(maybe, pa.bool_())})

    return _dealt(hashes, parts).groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(probe, "hash string, maybe boolean")


def plan_summary(ops: DataFrame) -> DataFrame:
    """Per file: operations and bytes by kind, and whether copies cover it whole."""
    copy, inline = F.col("op") == "copy", F.col("op") == "inline"
    return ops.groupBy("path").agg(F.count_if(copy).alias("copies"), F.count_if(inline).alias("inlines"), F.sum(F.when(copy, F.col("len")).otherwise(0)).alias("reused"), F.sum(F.when(inline, F.col("len")).otherwise(0)).alias("inline"), (F.count_if(inline) == 0).alias("unchanged"))


def apply_plan(old: DataFrame, ops: DataFrame) -> DataFrame:
    """(path, content) rebuilt from operations and the old build: pieces are fetched by entry, then joined in order."""
    copied = ops.where("op = 'copy'").join(old.select(F.col("path").alias("entry"), F.col("content")), "entry").select("path", "seq", F.substr("content", (F.col("old_off") + 1).cast("int"), F.col("len").cast("int")).alias("piece"))
    pieces = copied.unionByName(ops.where("op = 'inline'").select("path", "seq", F.col("data").alias("piece")))
    joined = F.pandas_udf(lambda s: s.map(lambda ps: b"".join(bytes(p) for p in ps)), "binary")
    ordered = pieces.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]).alias("ps"))
    return ordered.select("path", joined("ps").alias("content"))


def reconstruct(chunk_map: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, ord, hash) and (hash, data) -> path, content, and whether every chunk was there with its hash."""
    x = chunk_map.join(chunks, "hash", "left").withColumn("sound", F.sha2("data", 256) == F.col("hash"))
    ordered = x.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "data"))), lambda r: r["data"]).alias("ps"), F.every(F.coalesce("sound", F.lit(False))).alias("sound"))
    joined = F.pandas_udf(lambda s: s.map(lambda ps: b"".join(bytes(p) for p in ps if p is not None)), "binary")
    return ordered.select("path", joined("ps").alias("content"), "sound")
