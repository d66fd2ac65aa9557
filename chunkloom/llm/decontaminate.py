"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts are lower-cased, ASCII punctuation becomes blank, and shingles are runs
of five words (all words of a shorter item). A window's SimHash is the
majority of the bits of its shingles, read from running sums. Every window of
a document gets one, for each of a few sizes: those of items of up to eight
words, and from there on sizes that grow by a third.

An item stands in the index with windows of its own. A document's window of
similarity 0.8 or more lacks a ninth of the item's shingles at most. Where
that is under four shingles, the words that differ lie at the item's ends, and
the windows of the largest size that fits without them, at the start, in the
middle and at the end of the item, find the rest. Where it is more, e words
inside may differ, so e + 1 windows beside each other are added, of which one
at least has no such word. Fingerprints of 64 bits are cut into three blocks:
within ``RADIUS`` bits, two fingerprints differ by at most ``FLIPS`` bits in
one of them, so a table per block of all values with as many flips finds every
index window within the radius. Nothing else makes candidates.

A candidate says where the item would start. The windows of the item's own
size thereabouts are verified by the exact weighted similarity of their
shingles: the sum of the smaller weights over the sum of the larger, a
shingle's weight being how often it occurs.

Items come to the driver and to the tasks in slices of at most ``SLICE_BYTES``
and ``SLICE_ITEMS``. A benchmark of one slice is applied as part of the plan;
of more, slice by slice, with each slice's links written to the shared folder,
so one slice is held at a time. Documents don't move.

Defined results: null and empty texts and items without words never match; a
document shorter than an item is one window; repeated rows and repeated items
are reported each; ties of similarity go to the first window; an empty table
gives an empty result; extra columns are ignored. Texts are fingerprinted in
stretches of ``STRETCH`` words, so very long ones take no more memory than
their words' hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text_batches

SHINGLE = 5
LEAST = 0.8
#: Bits of each block, and how many of them may differ; so fingerprints are found within RADIUS bits.
BLOCKS, FLIPS = (22, 21, 21), 2
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
SLICE_BYTES, SLICE_ITEMS = 1 << 20, 2048
#: Words that are fingerprinted together.
STRETCH = 1 << 15

_BLANKED = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _blanked(text: str | None) -> bytes:
    return (text or "").lower().encode(errors="replace").translate(_BLANKED)


def _words(blanked: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    a = np.frombuffer(blanked, np.uint8)
    inside = a != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(a))
    place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(a)))
    return starts, _mixed(np.add.reduceat(np.where(inside, a, 0) * _POWERS[place & 255], starts))


def word_hashes(text: str) -> np.ndarray:
    return _words(_blanked(text))[1]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + words[k : k + n]
    return _mixed(h)


def window_prints(h: np.ndarray, span: int) -> np.ndarray:
    """The SimHash of every ``span`` (at most 255) shingles in a row."""
    bits = np.zeros((len(h) + 1, 64), np.uint8)
    bits[1:] = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return _prints(np.cumsum(bits, axis=0, dtype=np.uint8), span)


def _prints(sums: np.ndarray, span: int) -> np.ndarray:
    # sums are kept modulo 256, and so is their difference, which is at most span
    return np.packbits(sums[span:] - sums[:-span] > span // 2, axis=1, bitorder="little").view("<u8").ravel()


@cache
def sizes() -> list[int]:
    """Words of windows, so many that their shingles' bits can be counted in a byte."""
    out = list(range(1, 9))
    while out[-1] * 4 // 3 - SHINGLE < 255:
        out.append(out[-1] * 4 // 3)
    return out


def index_windows(n: int) -> list[tuple[int, int]]:
    """(size, first word) of the windows that stand for an item of n words."""
    fits = lambda words: max(g for g in sizes() if g <= words)
    if n <= sizes()[7]:
        return [(n, 0)]
    missing = int((n - SHINGLE + 1) * (1 - LEAST) / (1 + LEAST) + 1e-9)
    inside = missing // (SHINGLE - 1)
    whole = fits(n - min(missing, SHINGLE - 2))
    out = {(whole, k * (n - whole) // 2) for k in range(3)}
    if inside:
        part = fits(n // (inside + 1))
        out |= {(part, k * (n - part) // inside) for k in range(inside + 1)}
    return sorted(out)


@cache
def _flips(width: int) -> np.ndarray:
    return np.array([sum(1 << b for b in at) for k in range(FLIPS + 1) for at in combinations(range(width), k)], np.uint32)


def _blocks(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in BLOCKS:
        out.append(((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32))
        at += width
    return out


class Table:
    """The index windows of one size: fingerprints, what they belong to, and each block's values with their flips."""

    def __init__(self, prints: np.ndarray, item: np.ndarray, first: np.ndarray):
        self.prints, self.item, self.first, self.blocks = prints, item, first, []
        for width, own in zip(BLOCKS, _blocks(prints), strict=True):
            values = (own[:, None] ^ _flips(width)).ravel()
            order = np.argsort(values, kind="stable")
            known = np.zeros(1 << width, bool)
            known[values] = True
            self.blocks.append((known, values[order], (order // len(_flips(width))).astype(np.int32)))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, index window) of all within the radius."""
        own = _blocks(prints)
        maybe = np.zeros(len(prints), bool)
        for (known, _, _), b in zip(self.blocks, own, strict=True):
            maybe |= known.take(b)
        at = np.flatnonzero(maybe)
        places, found = [], []
        for (_, values, window), b in zip(self.blocks, own, strict=True):
            lo, hi = (np.searchsorted(values, b[at], side) for side in ("left", "right"))
            n = hi - lo
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            places.append(np.repeat(at, n)), found.append(window[np.repeat(lo, n) + inner])
        place, window = np.concatenate(places), np.concatenate(found)
        near = np.bitwise_count(prints[place] ^ self.prints[window]) <= RADIUS
        return place[near], window[near]


class Items:
    """A slice of items, with the tables of their windows; a task builds them once from the items' words."""

    def __init__(self, rows: list[tuple[int, str]]):
        own = [(i, w) for i, t in rows if len(w := word_hashes(t))]
        self.ids, self.words = [i for i, _ in own], [w for _, w in own]
        self._tables = None

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "words": self.words, "_tables": None}

    def tables(self) -> dict[tuple[int, int], Table]:
        """By shingle size and words of a window."""
        if self._tables is None:
            self.size = [min(SHINGLE, len(w)) for w in self.words]
            self.shingles = [shingles(w, s) for w, s in zip(self.words, self.size, strict=True)]
            self.bags = [np.unique(h, return_counts=True) for h in self.shingles]
            found = defaultdict(list)
            for i, (h, s) in enumerate(zip(self.shingles, self.size, strict=True)):
                for g, first in index_windows(len(self.words[i])):
                    span = g - s + 1
                    found[s, g].append((window_prints(h[first : first + span], span)[0], i, first))
            self._tables = {key: Table(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for key, rows in sorted(found.items())}
        return self._tables

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, first word of the item in the text) of texts that lie in ``words`` one after the other."""
        out: set[tuple[int, int, int]] = set()
        longest = max((g for _, g in self.tables()), default=0)
        for base in range(0, len(words), STRETCH):
            piece = words[base : base + STRETCH + longest - 1]
            for s in sorted({s for s, _ in self.tables()}):
                h = shingles(piece, s)
                bits = np.zeros((len(h) + 1, 64), np.uint8)
                bits[1:] = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.cumsum(bits, axis=0, dtype=np.uint8)
                for (size, g), table in self.tables().items():
                    if size != s or len(piece) < g:
                        continue
                    place, window = table.find(_prints(sums[: STRETCH + g - s + 1], g - s + 1))
                    place = place + base
                    text = np.searchsorted(bounds, place, "right") - 1
                    inside = place + g <= bounds[text + 1]
                    out.update(zip(text[inside].tolist(), table.item[window[inside]].tolist(), (place - bounds[text] - table.first[window])[inside].tolist(), strict=True))
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, float, int]]:
        """(text, item_id, first word, words, similarity, distance) of each item that a window of a text matches, by its best window."""
        if not self.ids:
            return []
        found, group, held = [], [], 0
        for k, text in enumerate(texts):
            group.append((k, _blanked(text)))
            held += len(group[-1][1])
            if held > 8 * STRETCH or k == len(texts) - 1:
                found += self._matches(group)
                group, held = [], 0
        return found

    def _matches(self, group: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, int, float, int]]:
        starts, words = _words(b" ".join(b for _, b in group))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for _, b in group]))
        by = defaultdict(list)
        for text, item, first in self.candidates(words, bounds):
            by[text, item].append(first)
        for (text, item), first in sorted(by.items()):
            best = self._best(item, words[bounds[text] : bounds[text + 1]], np.array(sorted(first)))
            if best:
                yield group[text][0], self.ids[item], *best

    def _best(self, i: int, words: np.ndarray, first: np.ndarray):
        """The best window of the item's size among those that begin within half its size of a candidate."""
        size, (bag, weights) = self.size[i], self.bags[i]
        total = len(self.shingles[i])
        span = min(total, len(words) - size + 1)  # shingles in a window
        last = len(words) - size + 1 - span
        reach = len(self.words[i]) // 2
        lo, hi = np.clip(first - reach, 0, last), np.clip(first + reach, 0, last)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        base = int(starts[0])
        h = shingles(words[base : int(starts[-1]) + span + size - 1], size)
        known = bag[np.minimum(np.searchsorted(bag, h), len(bag) - 1)] == h
        hits = np.concatenate([[0], np.cumsum(known)])
        # a window's similarity is at most its hits over the item's shingles
        starts = starts[hits[starts - base + span] - hits[starts - base] >= LEAST * total - 1e-9]
        best = None
        for w in starts.tolist():
            v, c = np.unique(h[w - base : w - base + span], return_counts=True)
            at = np.minimum(np.searchsorted(bag, v), len(bag) - 1)
            both = int(np.minimum(c, weights[at])[bag[at] == v].sum())
            similarity = both / (span + total - both)
            if similarity >= LEAST and (best is None or similarity > best[1]):
                best = (w, similarity)
        if best is None:
            return None
        w, similarity = best
        distance = _simhash(h[w - base : w - base + span]) ^ _simhash(self.shingles[i])
        return w, span + size - 1, similarity, distance.bit_count()


def _simhash(h: np.ndarray) -> int:
    counts = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def slices(items: DataFrame, slice_bytes: int = SLICE_BYTES) -> tuple[int, Iterator[Items]]:
    """How many slices the items' sizes ask for, and the slices, each read when its turn comes."""
    x = items.select("item_id", "text")
    total, count = x.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count(F.lit(1))).first()
    n = max(1, -(-(total or 0) // slice_bytes), -(-count // SLICE_ITEMS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Items([(r["item_id"], r["text"]) for r in x.where(part == k).orderBy("item_id", "text").collect()]) for k in range(n))


_LINKS = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"


def links(docs: DataFrame, items: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row per document and item it holds: doc_id, item_id, start_word, n_words, similarity, distance."""
    whole_text_batches(docs.sparkSession)
    n, parts = slices(items, slice_bytes)
    out = None
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], part: Items = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], *m) for k, *m in part.matches(batch.column(1).to_pylist())]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _LINKS.split(", ")])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _LINKS)
        found = found if n == 1 else cut(found)
        out = found if out is None else out.union(found)
    return out


def contaminated(text: Column, part: Items) -> Column:
    """Whether a text holds any of the items of a slice."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        held = {k for k, *_ in part.matches(texts.tolist())}
        return pd.Series([k in held for k in range(len(texts))], dtype=bool)

    return holds(text)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; of several slices, each is applied to what the one before has left."""
    whole_text_batches(docs.sparkSession)
    n, parts = slices(items)
    for part in parts:
        docs = docs.where(~contaminated(F.col("text"), part))
        docs = docs if n == 1 else cut(docs)
    return docs
