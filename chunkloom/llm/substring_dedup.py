"""Exact removal of repeated substrings through a column-wise multi-document transform.

Every byte that a string of ``length`` bytes covers is removed if that string
also starts anywhere else. Passages of ``words`` words that also stand
elsewhere are reported beside them, by the same steps with words in place of
bytes. The sorted order of such strings over the whole corpus is built column
by column: each round inserts one symbol per text, updates the order of the
texts by what they have read (the Burrows-Wheeler order of the collection) and
the common lengths of neighbours. A transform of whole documents would take as
many rounds as the longest has symbols, and each round would reread all that
came before; so texts are first cut and aligned:

1. Every window of ``length`` symbols picks its smallest k-gram by hash as its
   anchor. Equal windows pick equal anchors at equal offsets, so only texts
   around equal anchors can repeat, and aligned at the anchor they repeat
   column by column. Neighbouring windows share an anchor; the windows of one
   anchor form an item of under 2 * ``length`` symbols, and every window is in
   exactly one item. Items are written once to the shared folder.
2. Items are counted by anchor and a 128-bit hash of their content. An item
   that occurs twice is repeated as a whole. Of anchors with several different
   items, the texts of those items are fetched.
3. The windows of a fetched item fall into ``CLASSES`` classes by the anchor's
   offset. Windows of a class have most of their symbols in common places, so
   an item is dealt on by class and those symbols: one anchor's items spread
   over as many groups as they have different surroundings.
4. A task reads its groups in sorted order and runs the transform over batches
   of them: with aligned columns a round needs the order and common lengths of
   the round before alone, so work is linear in the items' symbols. Neighbours
   whose common length reaches ``length`` end a repeated window.
5. Groups of over ``heavy`` items (a passage with ever different surroundings)
   don't meet in one task: each of their windows is a row, counted by a
   128-bit hash. Both ways find the same windows.

A word is a maximal run of anything but the six ASCII blanks, taken as it is;
words are compared by a 64-bit hash, with any blanks between them.

Defined results: null and short texts lose nothing; strings never cross
documents; overlaps count; copies of a text lose all of it if they reach
``length`` bytes; repeated rows are documents of their own, and so are rows
that share an id; a null id is kept; an empty table gives an empty result;
extra columns are ignored. Very long texts are cut into pieces of a megabyte
of windows, so memory beyond the text itself is bounded by its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, stored, text_bytes, whole_text_batches

#: Symbols of an anchor: bytes, and words.
GRAM, WORD_GRAM = 32, 8
#: Windows of a text that are looked at together.
PIECE = 1 << 20
#: Bytes of items that go through the transform together.
BATCH_BYTES = 12 << 20
#: Classes of windows by the offset of their anchor.
CLASSES = 4
#: Items of a group beyond which its windows are counted one by one.
HEAVY = 4096

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 4096
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(a)], out=total[1:])
    return total


def _gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    total = _sums(a)
    return _mixed((total[gram:] - total[:-gram]) * _powers()[1][: len(a) - gram + 1])


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word."""
    starts, ends, hashes = [], [], []
    base = 0
    while base < len(text):
        stop = min(base + PIECE, len(text))
        if stop < len(text):  # pieces end behind a blank
            at = np.flatnonzero(_BLANK[np.frombuffer(text, np.uint8, stop - base, base)])
            if len(at):
                stop = base + int(at[-1]) + 1
        a = np.frombuffer(text, np.uint8, stop - base, base)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~_BLANK[a]
        edges = np.flatnonzero(np.diff(inside))
        s, e = edges[::2], edges[1::2]
        if len(a) == PIECE and stop < len(text) and not _BLANK[a[-1]]:  # one word of over a piece
            while stop < len(text) and not _BLANK[text[stop]]:
                stop += 1
            s, e = np.array([0]), np.array([stop - base])
            h = np.array([xxhash.xxh3_64_intdigest(text[base:stop])], np.uint64)
        else:
            total = _sums(a)
            h = _mixed((total[e] - total[s]) * _powers()[1][s])
        starts.append(base + s), ends.append(base + e), hashes.append(h)
        base = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _anchored(h: np.ndarray, windows: int, span: int) -> tuple[np.ndarray, ...]:
    """Of windows of ``span`` grams: the anchor's hash, first window, number of windows, and the anchor's offset from the first."""
    # hash first, then place: the smallest, and the leftmost of equals
    v = np.full(-(-len(h) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    v[: len(h)] = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    blocks = v.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.diff(first, append=windows), at[first] - first


def _digests(parts: list, seeds: list[int]) -> np.ndarray:
    """A 128-bit hash of each part, as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, s) for p, s in zip(parts, seeds, strict=True)]), np.int64).reshape(-1, 2)


def byte_items(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each piece of a text: gram (even), content hash (two columns), first byte, bytes, and the anchor's offset in bytes."""
    gram = min(GRAM, length)
    for base in range(0, len(text) - length + 1, PIECE):
        h = _gram_hashes(np.frombuffer(text, np.uint8)[base : base + PIECE + length - 1], gram)
        g, first, wins, off = _anchored(h, len(h) - length + gram, length - gram + 1)
        lo, size = base + first, wins + length - 1
        content = _digests([text[a : a + n] for a, n in zip(lo.tolist(), size.tolist(), strict=True)], off.tolist())
        yield (g & ~np.uint64(1)).view(np.int64), content, lo, size, off


def word_items(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same of words, with odd grams and the anchor's offset in words."""
    gram = min(WORD_GRAM, length)
    starts, ends, hashes = words_of(text)
    for base in range(0, len(starts) - length + 1, PIECE):
        w = hashes[base : base + PIECE + length - 1]
        h = np.zeros(len(w) - gram + 1, np.uint64)
        for k in range(gram):
            h = h * np.uint64(_BASE) + w[k : k + len(h)]
        g, first, wins, off = _anchored(_mixed(h), len(w) - length + 1, length - gram + 1)
        last = first + wins + length - 2
        raw = w.tobytes()
        content = _digests([raw[8 * a : 8 * b + 8] for a, b in zip(first.tolist(), last.tolist(), strict=True)], off.tolist())
        lo = starts[base + first]
        yield (g | np.uint64(1)).view(np.int64), content, lo, ends[base + last] - lo, off


_ITEM = "gram long, c1 long, c2 long, did long, tid long, lo int, size int, off int"


def items(docs: DataFrame, length: int, words: int | None) -> DataFrame:
    """A row per item of each document: gram, content (c1, c2), did, tid (the document), lo and size (its bytes), off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 5 + (pa.int32(),) * 3
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for did, tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for found in (byte_items(text, length), word_items(text, words) if words else ()):
                    for gram, content, lo, size, off in found:
                        for o, x in zip(out, (gram, content[:, 0], content[:, 1], np.full(len(lo), did), np.full(len(lo), tid), lo, size, off), strict=True):
                            o.append(x)
            joined = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(joined, kinds, strict=True)], [c.split()[0] for c in _ITEM.split(", ")])

    least = min(length, 2 * words - 1) if words else length
    return docs.where(F.octet_length("body") >= least).select("did", "tid", "body").mapInArrow(run, _ITEM)


def repeated_windows(group: np.ndarray, texts: list, off: np.ndarray, length: int) -> list[np.ndarray]:
    """For each aligned item the starts of its windows that another item of its group has at the same columns.

    group: a number per item, ascending; texts: bytes, or arrays of symbols from
    0 on. Columns are read left to right. The order of the items by (group, what
    was read, backwards) is kept with the common length of each with the one
    before it; a round sorts stably by the next symbol, and the common length of
    new neighbours is one more than the smallest between them.
    """
    texts = [np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t for t in texts]
    m, size = len(texts), np.array([len(t) for t in texts], np.int64)
    shift = int(off.max())
    begin = shift - off
    end = begin + size
    columns = int(end.max())
    cells = np.zeros((m, columns), texts[0].dtype)
    for i, t in enumerate(texts):
        cells[i, begin[i] : end[i]] = t
    cells = np.ascontiguousarray(cells.T)
    radix = int(cells.max()) + 2
    hits = np.zeros((columns, m), bool)
    order, common = np.arange(m), np.zeros(m, np.int32)
    for c in range(columns):
        # items that have ended, or can't reach the length any more, leave
        stay = end[order] > c
        if c % 8 == 0:
            best = np.maximum(common, np.append(common[1:], 0))
            stay &= best + end[order] - c >= length
        if not stay.all():
            at = np.flatnonzero(stay)
            if len(at) < 2:
                break
            common = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            order = order[at]
        symbol = cells[c][order].astype(np.int64) + 1
        symbol[begin[order] > c] = 0
        of = group[order]
        key = of * radix + symbol
        step = np.flatnonzero(key[1:] < key[:-1])
        if len(step):
            mixed = np.isin(of, of[step])
            at = np.flatnonzero(mixed)
            perm = np.arange(len(order))
            perm[at] = at[np.argsort(key[at], kind="stable")]
            before = np.concatenate([[-1], perm[:-1]])
            far = np.flatnonzero((perm != before + 1) & (key[before] == key[perm]))
            least = common[perm]
            if len(far):
                pairs = np.empty(2 * len(far), np.int64)
                pairs[::2], pairs[1::2] = before[far] + 1, perm[far] + 1
                least[far] = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
            order, key, symbol = order[perm], key[perm], symbol[perm]
        else:
            least = common
        same = np.concatenate([[False], key[1:] == key[:-1]]) & (symbol > 0)
        common = np.where(same, least + 1, 0).astype(np.int32)
        if c >= length - 1:
            at = np.flatnonzero(common >= length)
            if len(at):
                hits[c - length + 1, order[at]] = True
                hits[c - length + 1, order[at - 1]] = True
    hits = np.ascontiguousarray(hits.T)
    return [np.flatnonzero(h) - b for h, b in zip(hits, begin.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut_at = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut_at + 1])], starts[np.concatenate([cut_at, [len(starts) - 1]])]


def _worded(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of the words of each body; bodies begin and end with a word."""
    joined = b" ".join(bodies)
    starts, ends, hashes = words_of(joined)
    at = np.cumsum([0] + [len(b) + 1 for b in bodies])
    first = np.searchsorted(starts, at)
    for k in range(len(bodies)):
        a, b = first[k], first[k + 1]
        yield starts[a:b] - at[k], ends[a:b] - at[k], hashes[a:b]


_PART = "key long, did long, tid long, lo int, off int, occ long, body binary"


def _parts(length: int, words: int | None, bodies: bool):
    """(gram, did, tid, lo, off, occ, body) of items to a row for each of their classes of windows; key alone without ``bodies``."""

    def classes(units: int, size: int, gram: int, off: int) -> Iterator[tuple[int, int, int, int, int]]:
        offsets = units - gram + 1
        step = -(-offsets // CLASSES)
        for j in range(CLASSES):
            a, b = j * step, min((j + 1) * step, offsets) - 1
            lo, hi = max(0, off - b), min(size - units, off - a)
            if a <= b and lo <= hi:  # first and last symbol of the part, and of what its windows share
                yield j, lo, hi + units, off - a, off - b + units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
            out: list[tuple] = []
            for gram, did, tid, lo, off, occ, body in rows:
                if not gram & 1:
                    for j, a, b, x, y in classes(length, len(body), min(GRAM, length), off):
                        key = xxhash.xxh3_64_intdigest(body[x:y], j) & ~1
                        out.append((key, did, tid, lo + a, off - a, occ, body[a:b]) if bodies else (key,))
            worded = [r for r in rows if r[0] & 1]
            for (_, did, tid, lo, off, occ, body), (starts, ends, hashes) in zip(worded, _worded([r[6] for r in worded]), strict=True):
                raw, starts, ends = hashes.tobytes(), starts.tolist(), ends.tolist()
                for j, a, b, x, y in classes(words, len(starts), min(WORD_GRAM, words), off):
                    key = xxhash.xxh3_64_intdigest(raw[8 * x : 8 * y], j) | 1
                    out.append((key, did, tid, lo + starts[a], off - a, occ, body[starts[a] : ends[b - 1]]) if bodies else (key,))
            columns = list(zip(*out, strict=True)) or [()] * (7 if bodies else 1)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            keys = pa.array(np.array(columns[0], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=False)]], [c.split()[0] for c in _PART.split(", ")][: len(columns)])

    return run


_FOUND = "word boolean, did long, tid long, start long, stop long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.bool_(),) + (pa.int64(),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "did", "tid", "start", "stop"])


def _transformed(length: int, words: int | None):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for word in (0, 1):
            own = [r for r in rows if r[0] & 1 == word]
            if not own:
                continue
            _, group = np.unique(np.array([r[0] for r in own], np.int64), return_inverse=True)
            off = np.array([r[4] for r in own], np.int64)
            if word:
                places = list(_worded([r[6] for r in own]))
                _, symbols = np.unique(np.concatenate([p[2] for p in places]), return_inverse=True)
                texts = np.split(symbols.astype(np.int32), np.cumsum([len(p[2]) for p in places])[:-1])
            else:
                texts = [r[6] for r in own]
            for k, starts in enumerate(repeated_windows(group, texts, off, words if word else length)):
                if not len(starts) or own[k][5] > 1:  # items that occur twice are repeated anyway
                    continue
                _, did, tid, lo = own[k][:4]
                a, b = _runs(starts)
                if word:
                    a, b = places[k][0][a], places[k][1][b + words - 1]
                else:
                    b = b + length
                out += [(bool(word), did, tid, lo + x, lo + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return _spans(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last, alone = [], 0, (None,), True
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if r[:4] == last:
                    continue  # a document that occurs twice with its id
                if r[0] != last[0]:
                    if alone and rows:  # the group before has this one alone
                        held -= len(rows.pop()[6])
                    if held >= BATCH_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                    alone = True
                else:
                    alone = False
                rows.append(r)
                held += len(r[6])
                last = r[:4]
        if alone and rows:
            rows.pop()
        if rows:
            yield flush(rows)

    return run


def _windowed(length: int, words: int | None):
    """Parts to a row per window: its 128-bit hash, document, bytes and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, did, tid, lo, _, occ, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if key & 1:
                    starts, ends, hashes = words_of(body)
                    raw, n = hashes.tobytes(), len(starts) - words + 1
                    parts, first, stop = [raw[8 * i : 8 * (i + words)] for i in range(n)], starts[:n], ends[words - 1 :]
                else:
                    n = len(body) - length + 1
                    parts, first = [body[i : i + length] for i in range(n)], np.arange(n)
                    stop = first + length
                halves = _digests(parts, [key & 1] * n)
                fixed = [pa.array(np.full(n, x)) for x in (did, tid, occ)]
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.full(n, bool(key & 1))), *fixed[:2], pa.array(lo + first.astype(np.int64)), pa.array(lo + stop.astype(np.int64)), fixed[2]], ["w1", "w2", "word", "did", "tid", "start", "stop", "occ"])

    return run


def repeated_spans(docs: DataFrame, length: int, words: int | None, heavy: int = HEAVY) -> DataFrame:
    """(did, tid, body) -> word, did, tid, start, stop: bytes of repeated strings, or of repeated passages where ``word``."""
    content = ["gram", "c1", "c2"]
    every = stored(items(docs, length, words))
    counted = every.groupBy(*content).agg(F.count(F.lit(1)).alias("occ"))
    kinds = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.max("occ").alias("most")).where("kinds > 1 or most > 1").select("gram", "kinds")
    known = cut(counted.join(kinds, "gram").where("kinds > 1 or occ > 1"))
    release(docs.sparkSession)
    found = stored(every.join(known, content))
    del every, counted, kinds, known
    release(docs.sparkSession)

    # of a document's items any one stands for all with its content
    one = found.where("kinds > 1").groupBy(*content).agg(F.first("occ").alias("occ"), F.min(F.struct("did", "tid", "lo", "size", "off")).alias("at"))
    one = one.select("gram", "at.*", "occ")
    body = F.substring("body", F.col("lo") + 1, F.col("size")).alias("body")
    fetched = stored(one.join(docs, ["did", "tid"]).select("gram", "did", "tid", "lo", "off", "occ", body))
    del one
    release(docs.sparkSession)
    crowded = cut(fetched.mapInArrow(_parts(length, words, False), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy))
    parts = fetched.mapInArrow(_parts(length, words, True), _PART)
    none_crowded = crowded.isEmpty()
    aligned = parts if none_crowded else parts.join(crowded, "key", "left_anti")
    partial = aligned.repartition("key").sortWithinPartitions("key", "did", "tid", "lo").mapInArrow(_transformed(length, words), _FOUND)
    if not none_crowded:
        window = "w1 long, w2 long, word boolean, did long, tid long, start long, stop long, occ long"
        single = parts.join(crowded, "key", "left_semi").dropDuplicates(["key", "did", "tid", "lo"]).mapInArrow(_windowed(length, words), window)
        twice = single.groupBy("w1", "w2").agg(F.sum("occ").alias("n")).where("n > 1").select("w1", "w2")
        partial = partial.union(single.where("occ = 1").join(twice, ["w1", "w2"]).select("word", "did", "tid", "start", "stop"))
    whole = found.where("occ > 1").select((F.col("gram") % 2 != 0).alias("word"), "did", "tid", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("size")).cast("long").alias("stop"))
    both = cut(partial.unionByName(whole))  # it outlives this call, so its rows can't lie in a stored folder
    del found, fetched, parts, aligned, partial, whole
    release(docs.sparkSession)
    return both


def _merged(runs: list[dict], word: bool) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in runs:
        if r["word"] == word:
            if out and r["start"] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], r["stop"]))
            else:
                out.append((r["start"], r["stop"]))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """What is left of every document: doc_id, n_bytes, spans, passages and kept (binary).

    spans: the removed byte ranges, ends exclusive. passages: the byte ranges
    that runs of ``words`` words cover which also stand elsewhere, joined where
    they overlap; empty if ``words`` is None. They are reported, not removed.
    """
    whole_text_batches(docs.sparkSession)
    # a document is known by its id and the hash of its text
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("tid"), text_bytes(F.col("text")).alias("body"))
    found = repeated_spans(keyed.drop("doc_id"), length, words, heavy).groupBy("did", "tid").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "word"))).alias("runs"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, passages, kept, sizes = [], [], [], []
            for body, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = _merged(runs or [], False)
                ends = [0, *(b for _, b in gone)]
                kept.append(b"".join(body[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(body)], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in gone])
                passages.append([{"start": a, "end": b} for a, b in _merged(runs or [], True)])
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(passages, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "passages", "kept"])

    ranges = "array<struct<start:bigint,end:bigint>>"
    return keyed.join(found, ["did", "tid"], "left").select("doc_id", "body", "runs").mapInArrow(run, f"doc_id long, n_bytes long, spans {ranges}, passages {ranges}, kept binary")
