"""What happens between a store and its clients: retries, errors, caches of what isn't there, byte budgets, wire batches and routes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import compare
from .islands import _folded

#: Attempts, first and longest wait in ms, and status codes worth another attempt.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, TRANSIENT = 5, 250, 8000, (429, 500, 502, 503, 504)

#: Error codes in order, the ones worth trying again unchanged, and those that another source can make good.
ERROR_CODES = (
    "MANIFEST-CORRUPT", "UNSUPPORTED-MANIFEST-VERSION", "CONTAINER-CORRUPT", "BOOTSTRAP-HASH-MISMATCH", "CHUNK-HASH-MISMATCH", "PACK-CORRUPT", "CACHE-CORRUPT-RECOVERABLE", "OUTPUT-HASH-MISMATCH", "SIGNATURE-INVALID", "NETWORK",
    "RESUME-INVALID", "DISK-FULL", "UNSUPPORTED-FEATURE", "SIGNATURE-CORRUPT", "SIGNATURE-MISMATCH", "PREVIOUS-ARTIFACT-MISSING", "PREVIOUS-ARTIFACT-MISMATCH", "HYBRID-PLAN-INVALID", "HYBRID-SOURCE-FAILED", "CONTAINER-APPLY-FAILED",
    "CONTAINER-ROLLBACK-FAILED", "DELTA-BENCH-UNAVAILABLE", "BUTLER-NOT-FOUND", "BUTLER-DIFF-FAILED", "BUTLER-APPLY-FAILED", "BUTLER-VERIFY-FAILED", "PLAN-CORRUPT", "PLAN-INVALID", "APPLY-HASH-MISMATCH", "JOURNAL-CORRUPT",
    "JOURNAL-RESUME-FAILED", "PATH-TRAVERSAL", "UNSUPPORTED-SYMLINK", "PAIRWISE-TOOL-MISSING", "PATCH-CORRUPT", "PATCH-INVALID", "MEMORY-BUDGET-EXCEEDED", "BUTLER-REDIFF-FAILED",
)
RETRYABLE, RECOVERABLE = ("NETWORK",), ("NETWORK", "CACHE-CORRUPT-RECOVERABLE", "PREVIOUS-ARTIFACT-MISSING", "PREVIOUS-ARTIFACT-MISMATCH")
#: What stands before a code in a message.
MARK = "E-"


def retry(status: Column, attempt: Column, nanos: Column) -> Column:
    """What follows a failed attempt (from 1 on): outcome (retry, give-up, fail) and the wait in ms.

    Waits double up to the longest, and lie within a quarter of that either way
    by the clock's nanoseconds. No status stands for a broken connection.
    """
    base = F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(LONGEST_WAIT))).cast("long")
    wait = base - F.floor(base / 4) + nanos % F.greatest(F.floor(base / 2), F.lit(1))
    transient = status.isNull() | status.isin(*TRANSIENT)
    outcome = F.when(~transient, "fail").when(attempt < ATTEMPTS, "retry").otherwise("give-up")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "retry", wait).cast("long").alias("wait_ms"))


def error_code(message: Column) -> Column:
    """The code that a message holds: the longest that stands at its first mark, or null."""
    longest = "|".join(sorted(ERROR_CODES, key=lambda c: (-len(c), c)))
    tail = F.regexp_extract(message, f"(?s)^.*?{MARK}(.*)$", 1)
    return F.nullif(F.regexp_extract(tail, f"^({longest})", 1), F.lit(""))


def error_flags(code: Column) -> Column:
    return F.struct(code.isin(*RETRYABLE).alias("retryable"), code.isin(*RECOVERABLE).alias("recoverable"))


#: Labels and what they stand for.
SCOPES, ENGINES = {"per-file": "per-file", "global": "global"}, {"unreal": "unreal", "unity": "unity", "godot": "godot", "custom": "custom", "generic": "custom"}
PLATFORMS = {"windows": "windows", "win": "windows", "linux": "linux", "macos": "macos", "mac": "macos", "osx": "macos"}
STATE_FLAGS = {
    "warm-cache": ("warm_cache", True), "cold-cache": ("warm_cache", False), "has-previous-install": ("has_previous_install", True), "previous-install": ("has_previous_install", True), "cold-install": ("has_previous_install", False),
    "fresh-install": ("has_previous_install", False), "no-previous-install": ("has_previous_install", False), "low-ram": ("low_ram", True), "low-disk": ("low_disk", True), "limited-disk": ("low_disk", True), "slow-hdd": ("slow_hdd", True), "fast-nvme": ("slow_hdd", False),
}
STATE = ("warm_cache", "has_previous_install", "low_ram", "low_disk", "slow_hdd")


def label(text: Column, known: dict[str, str], default: str | None = None, fold: bool = True) -> Column:
    """What a label stands for, in any case where ``fold``; an unknown one gives the default."""
    key = F.lower(text) if fold else text
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in known.items()], F.lit(default).cast("string"))


def client_state(text: Column) -> Column:
    """Flags separated by commas as a struct of booleans and the first unknown flag; later flags win."""
    flags = F.filter(F.transform(F.split(text, ","), lambda f: F.trim(f)), lambda f: f != "")

    def on(name: str) -> Column:
        about = [k for k, (n, _) in STATE_FLAGS.items() if n == name]
        last = F.try_element_at(F.filter(flags, lambda f: f.isin(*about)), F.lit(-1))
        return F.coalesce(last.isin(*[k for k in about if STATE_FLAGS[k][1]]), F.lit(False)).alias(name)

    unknown = F.try_element_at(F.filter(flags, lambda f: ~f.isin(*STATE_FLAGS)), F.lit(1))
    return F.struct(*map(on, STATE), unknown.alias("unknown"))


def asset_name_ok(name: Column) -> Column:
    """Asset names aren't empty and hold no separator and no dot."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\.]"), F.lit(False))


def id_ok(name: Column) -> Column:
    """Ids of apps, depots and branches hold letters, digits, - and _."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))


def negative_cache(misses: DataFrame, ttl: float) -> DataFrame:
    """(key, at): lookups of what isn't there, with ``asked``: whether it was asked for, or known from a miss under ``ttl`` before that was."""
    x = _folded(misses, "key", ["at"], lambda r: r.at + ttl, lambda until, r: until if r.at < until else None)
    first = F.row_number().over(Window.partitionBy("key", "grp").orderBy("at"))
    return x.withColumn("asked", first == 1).drop("grp")


def inflight_waves(groups: DataFrame, budget: int) -> DataFrame:
    """(stream, ord, len): the wave in which each group of ranges is loaded, so that no wave exceeds ``budget``; a larger group has a wave of its own."""
    size = lambda r: min(r.len, budget)
    return _folded(groups, "stream", ["ord"], size, lambda s, r: s + size(r) if s + size(r) <= budget else None).withColumnRenamed("grp", "wave")


def counters(requests: DataFrame) -> DataFrame:
    """(name, at, bytes): requests and bytes of each counter up to and with each time; they never fall."""
    per = requests.groupBy("name", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    w = Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("name", "at", F.sum("n").over(w).alias("requests"), F.sum("b").over(w).alias("bytes"))


#: Fixed values of wire batches: first bytes, version, and the largest chunk.
MAGIC, VERSION, LARGEST = b"CVSP", 2, 256 << 20
ITEM = "part string, id long, pos int, hash string, kind string, len_raw long, payload binary"


class BadBatch(ValueError):
    """The bytes aren't a batch."""


def encode_batch(items: list[dict]) -> bytes:
    """Items (part init or segment, id, pos, hash, kind inline or ref, payload) as one batch; payloads are compressed where that helps."""
    import zstandard

    out = [MAGIC, bytes([VERSION])]
    for part, head in (("init", "<II"), ("segment", "<QI")):
        own: dict[int, list[dict]] = {}
        for i in sorted((i for i in items if i["part"] == part), key=lambda i: (i["id"], i["pos"])):
            own.setdefault(i["id"], []).append(i)
        out.append(struct.pack("<I", len(own)))
        for key, rows in own.items():
            out.append(struct.pack(head, key, len(rows)))
            for i in rows:
                out.append(bytes([i["kind"] == "inline"]) + bytes.fromhex(i["hash"]))
                if i["kind"] == "inline":
                    raw = bytes(i["payload"])
                    packed = zstandard.ZstdCompressor(level=3).compress(raw)
                    short = len(packed) < len(raw)
                    out += [struct.pack("<BII", int(short), len(raw), len(packed) if short else len(raw)), packed if short else raw]
    return b"".join(out)


def decode_batch(data: bytes, largest: int = LARGEST) -> Iterator[tuple]:
    """One item after the other, as rows of ``ITEM``; sizes are checked before anything is read."""
    import zstandard

    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise BadBatch("the batch ends early")
        at += n
        return data[at - n : at]

    if take(4) != MAGIC or take(1)[0] != VERSION:
        raise BadBatch("first bytes or version")
    for part, head in (("init", "<II"), ("segment", "<QI")):
        for _ in range(struct.unpack("<I", take(4))[0]):
            key, n = struct.unpack(head, take(struct.calcsize(head)))
            for pos in range(n):
                tag, digest = take(1)[0], take(32).hex()
                if tag == 0:
                    yield part, key, pos, digest, "ref", None, None
                elif tag == 1:
                    form, raw, stored = struct.unpack("<BII", take(9))
                    if form > 1 or max(raw, stored) > largest:
                        raise BadBatch("form or size of a chunk")
                    payload = take(stored)
                    if form:
                        try:
                            payload = zstandard.ZstdDecompressor().decompress(payload, max_output_size=raw)
                        except zstandard.ZstdError as e:
                            raise BadBatch("compressed chunk") from e
                    if len(payload) != raw:
                        raise BadBatch("length of a chunk")
                    yield part, key, pos, digest, "inline", raw, payload
                else:
                    raise BadBatch("kind of an item")
    if at != len(data):
        raise BadBatch("bytes behind the batch")


def encode_batches(items: DataFrame) -> DataFrame:
    """(session, part, id, pos, hash, kind, payload) -> session, batch: what one reply holds meets in one task."""
    each = items.groupBy("session").agg(F.collect_list(F.struct("part", "id", "pos", "hash", "kind", "payload")).alias("items"))
    pack = F.pandas_udf(lambda s: s.map(lambda rows: encode_batch([dict(r) for r in rows])), "binary")
    return each.select("session", pack("items").alias("batch"))


def decode_batches(batches: DataFrame) -> DataFrame:
    """(session, batch) -> session and the items; a bad batch ends in one row whose kind says why."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for session, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    for item in decode_batch(data or b""):
                        rows.append((session, *item))
                except BadBatch as e:
                    rows.append((session, None, None, None, None, f"bad: {e}", None, None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], ["session", *(c.split()[0] for c in ITEM.split(", "))])

    return batches.select("session", "batch").mapInArrow(run, f"session long, {ITEM}")


#: Memory in MiB of each route.
ROUTE_MIB = {"full": 16, "bootstrap": 32, "chunks": 64, "hybrid": 64, "plan": 40}


def collect_routes(both: DataFrame, state: dict[str, bool], apply_rate: int, bootstrap_bytes: int | None = None, plan_bytes: int | None = None) -> DataFrame:
    """The ways to update one client, as ``cost.score_routes`` takes them.

    both: chunks of the old and the new build. Routes that need an old install,
    a warm cache, or a file that isn't there are listed as not available.
    """
    e = compare.by_chunk(both).agg(F.sum(F.col("n_old") * F.col("len")).alias("old"), F.sum(F.col("n_new") * F.col("len")).alias("new"), F.sum(F.when((F.col("n_old") == 0) & (F.col("n_new") > 0), F.col("len")).otherwise(0)).alias("fresh"))
    old, new, fresh, zero = F.col("old"), F.col("new"), F.col("fresh"), F.lit(0).cast("long")
    has, warm = state.get("has_previous_install", False), state.get("warm_cache", False)
    apply = F.floor(new / apply_rate)
    # route, whether it is open, network bytes, time to apply, bytes on disk beside the build, bytes read
    routes = [
        ("full", True, new, zero, zero, zero), ("bootstrap", bootstrap_bytes is not None, F.lit(bootstrap_bytes or 0).cast("long"), apply, new, zero), ("chunks", has and warm, fresh, apply, new, zero),
        ("hybrid", has, fresh, apply, new, old), ("plan", has and plan_bytes is not None, F.lit(plan_bytes or 0).cast("long"), apply, F.floor(new / 4), old),
    ]
    each = [
        F.struct(F.lit(r).alias("route"), F.lit(k).alias("pos"), F.lit(ok).alias("available"), F.when(F.lit(ok), net).alias("network_bytes"), F.when(F.lit(ok), ms).otherwise(0).alias("apply_ms"), F.lit(ROUTE_MIB[r] << 20).cast("long").alias("ram"), F.when(F.lit(ok), temp).otherwise(0).alias("temp"), F.when(F.lit(ok), read).otherwise(0).alias("disk_read"), F.lit(1).alias("steps"), F.lit(0).alias("build_ms"))
        for k, (r, ok, net, ms, temp, read) in enumerate(routes)
    ]
    return e.select(F.explode(F.array(*each)).alias("r")).select(F.lit(0).alias("client"), "r.*")


def publish_preview(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (part, name, value): bytes of each open route, findings by kind, and the smallest route as the recommendation."""
    open_ = routes.where("available")
    best = open_.agg(F.min(F.struct("network_bytes", "pos", "route")).alias("b"))
    return (
        open_.select(F.lit("route").alias("part"), F.col("route").alias("name"), F.col("network_bytes").alias("value"))
        .unionByName(findings.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("finding").alias("part"), "name", "value"))
        .unionByName(best.select(F.lit("recommended").alias("part"), F.col("b.route").alias("name"), F.col("b.network_bytes").alias("value")))
    )


def push_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(oid, size) of both sides -> what a push does with each local object; one the remote has by id and size is skipped."""
    there = remote.groupBy("oid").agg(F.max("size").alias("there"))
    x = local.groupBy("oid").agg(F.max("size").alias("size")).join(there, "oid", "left")
    return x.select("oid", "size", F.when(F.col("there").eqNullSafe(F.col("size")), "skip").when(F.col("there").isNull(), "put").otherwise("replace").alias("action"))
