"""Document fingerprints by randomised edit embedding.

A random walk shared by all documents reads a text: at step j it puts out the
character under the pointer and moves on, or stays, as a random bit of (j,
character) says. Texts within a small edit distance fall into step with each
other, so their outputs differ in few places (Chakraborty, Goldenberg and
Koucky, 2016). A text is walked once from its start, for twice as many steps
as it has characters, so an edit is paid for where it stands and texts are in
step again behind it, however long they are. How soon is a matter of chance
with a long tail, so each text is walked ``WALKS`` times with different bits.
Walks of many texts go side by side; each needs no more than its pointer
beside the text. The random bits repeat after ``PERIOD`` steps.

A fingerprint holds ``SLOTS`` sampled symbols of the outputs, taken from the walks in turn. Each slot takes
the step with the smallest random number among the steps that a text has, so
texts of different lengths mostly sample the same steps. Likeness is the share
of slots that agree. For search, slots are banded: texts that agree on all
slots of a band are candidates, and likeness verifies them. Bands that hold
padding alone make no candidates: all short texts would share them.

Defined results: a null or empty text has the fingerprint of padding alone;
equal texts have equal fingerprints; ids are ordered descending with nulls
last and ties by text; a single row is its own next; repeated rows follow each
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text_batches

PERIOD = 1 << 14
WALKS = 2
SLOTS = 64
BAND = 4
SEED = 20160619
#: Characters of texts that are embedded together with their edited texts.
CHUNK = 12 << 20


@cache
def walk_bits() -> np.ndarray:
    """A bit for each walk, step and symbol; padding (0) never moves."""
    bits = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (WALKS, PERIOD, 256), dtype=np.uint8)
    bits[..., 0] = 0
    return bits


@cache
def slot_steps() -> list[np.ndarray]:
    """For each slot the steps at which its random numbers reach a new minimum, far beyond any text."""
    rng, out = np.random.Generator(np.random.PCG64(SEED + 1)), []
    for _ in range(SLOTS):
        at, least, steps = 0, rng.random(), [0]
        while at < 1 << 44:
            at += max(1, ceil(log(1.0 - rng.random()) / log1p(-least)))
            least *= rng.random()
            steps.append(at)
        out.append(np.array(steps))
    return out


def symbols(text: str) -> np.ndarray:
    """A symbol of 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), "<u4")
    return np.maximum((points * np.uint32(2654435761)) >> np.uint32(24), 1).astype(np.uint8)


def embed(texts: list[str]) -> np.ndarray:
    """The sampled symbols of each text, one row of SLOTS each."""
    if not texts:
        return np.zeros((0, SLOTS), np.uint8)
    coded = [symbols(t) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    # for each text the step of every slot; texts that are walked longest come first
    at = np.stack([s[np.searchsorted(s, np.maximum(1, 2 * size), "left") - 1] for s in slot_steps()], axis=1)
    last = at.max(axis=1)
    order = np.argsort(-last, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size[order] + 1)])
    flat = np.zeros(begin[-1], np.uint8)  # each text with a symbol of padding behind it
    for b, k in zip(begin.tolist(), order.tolist(), strict=False):
        flat[b : b + len(coded[k])] = coded[k]
    del coded
    live = np.searchsorted(-last[order], -np.arange(int(last.max()) + 1), "right").tolist()  # texts that go on to a step
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for w, bits in enumerate(walk_bits()):
        pointer, asked = begin[:-1].copy(), at[order, w::WALKS]
        by_step = np.argsort(asked, axis=None, kind="stable")
        steps, first = np.unique(asked.ravel()[by_step], return_index=True)
        wanted = dict(zip(steps.tolist(), np.split(by_step, first[1:]), strict=True))
        read = np.zeros(asked.size, np.uint8)
        for j, n in enumerate(live):
            seen = flat.take(pointer[:n])
            if j in wanted:
                read[wanted[j]] = seen[wanted[j] // asked.shape[1]]
            pointer[:n] += bits[j % PERIOD].take(seen)
        out[order, w::WALKS] = read.reshape(asked.shape)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _bands(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).reshape(len(a), -1, BAND)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) dealt by ranges of descending id, each range with the head of the next behind it.

    Returns ring_part, ring_tail (0, or 1 for the head of the next range),
    ring_key, doc_id and text, sorted within partitions. One boundary and one
    head per partition come to the driver; texts move once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ring_key"))
    cuts = x.agg(F.percentile_approx("ring_key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(np.array(cuts, np.int64), keys.to_numpy(np.int64), "left")).astype(np.int32))

    x = x.withColumn("ring_part", part("ring_key"))
    heads = {r["ring_part"]: r["k"] for r in x.groupBy("ring_part").agg(F.max("ring_key").alias("k")).collect()}  # one per partition
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    tails = x.where(F.col("ring_key").isin(list(heads.values()))).withColumn("ring_part", F.element_at(F.create_map(*[F.lit(v) for pair in before.items() for v in pair]), F.col("ring_part"))) if filled else x.limit(0)
    both = x.withColumn("ring_tail", F.lit(0)).unionByName(tails.withColumn("ring_tail", F.lit(1)))
    return both.repartitionById(parts, F.col("ring_part")).sortWithinPartitions("ring_part", "ring_tail", F.desc("ring_key"), "text").select("ring_part", "ring_tail", "ring_key", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (hex), near_edited, near_next, and whether a band makes the edited text and
    the next document candidates.
    """
    whole_text_batches(docs.sparkSession)

    def finished(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], following]
        third = [len(t) // 3 for t in texts]
        edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, nexts, third, strict=True)]
        found = embed([*texts, following, *edited])
        m = len(texts)
        own, nxt, new = found[:m], found[1 : m + 1], found[m + 1 :]
        shared = lambda a, b: (_bands(a) == _bands(b)).all(axis=2).any(axis=1)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode(errors="surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([a.tobytes().hex() for a in own], pa.string()), pa.array([a.tobytes().hex() for a in new], pa.string()),
            pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, nxt), pa.float64()), pa.array(shared(own, new)), pa.array(shared(own, nxt)),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_candidate", "next_candidate"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, part, closed = [], 0, None, False
        for batch in batches:
            for p, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if p != part:
                    part, closed = p, False
                if closed:
                    continue  # more heads that tie with the first
                if tail:
                    yield finished(rows, text)
                    rows, held, closed = [], 0, True
                    continue
                if held > CHUNK:
                    yield finished(rows, text)
                    rows, held = [], 0
                rows.append((doc_id, text))
                held += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_candidate boolean, next_candidate boolean"
    return with_next(docs).mapInArrow(run, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and edit_fp (binary, SLOTS bytes) of every row."""
    whole_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = embed([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a in found], pa.binary())], ["doc_id", "edit_fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, edit_fp binary")


def search(queries: DataFrame, docs: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, fingerprints of the queries) against all documents: pairs of distinct fingerprints.

    Copies share a fingerprint, so bands are joined between distinct ones. Returns
    query_fp, doc_fp and likeness of at least ``least``; ``fingerprints`` gives membership.
    """

    def banded(x: DataFrame, name: str) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(b).alias("band"), F.substring("edit_fp", b * BAND + 1, BAND).alias("part")) for b in range(SLOTS // BAND)])
        each = x.select("edit_fp").distinct().select(F.col("edit_fp").alias(name), F.explode(bands).alias("b")).select(name, "b.band", "b.part")
        return each.where(F.col("part") != F.lit(bytes(BAND)))

    met = banded(queries, "query_fp").join(banded(docs, "doc_fp"), ["band", "part"]).select("query_fp", "doc_fp").distinct()
    same = sum((F.substring("query_fp", i + 1, 1) == F.substring("doc_fp", i + 1, 1)).cast("int") for i in range(SLOTS))
    return met.withColumn("likeness", same / F.lit(float(SLOTS))).where(F.col("likeness") >= least)
