"""Near-duplicates by SimHash, linked through deletion variants of two halves.

A 64-bit fingerprint is cut into two halves. Two fingerprints within two bits
differ by at most one bit in one half, so their values of that half are equal
or share a variant with one position wiped out. Variants are made of distinct
half values, not of documents: a variant then has at most two owners, and the
equality join yields neighbouring values without any large bucket. Documents
meet only through values that neighbour, and are verified on all 64 bits.

Where a value has over ``most`` fingerprints, its members aren't paired.
Wiping two positions of the other half (or one, between two neighbouring
values) makes linked fingerprints equal, and such a group holds four at most;
linking each to the smallest of them loses no connection.

Whole near copies (the pipeline's stage) are linked so too, after an exact
check; those that differ in more bits are then found by sketches.

Defined results: a null or empty text, or one of white space alone, has
fingerprint zero and is linked like any other; repeated rows are rows of
their own; component ids ignore null doc_ids and are null only where a whole
component has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, cut, release, whole_text_batches
from .components import components
from .decontaminate import shingles, word_hashes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of all words if there are fewer."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set where over half the hashes have it."""
    if not len(hashes):
        return 0
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(planes[:, k], minlength=256) @ BITS_OF for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash (of the text as it is) and fp (signed 64 bits) of every row."""
    whole_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.array([simhash(shingle_hashes(t or b"", words)) for t in texts.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(fps: DataFrame, most: int = 256) -> DataFrame:
    """Distinct ``fp`` -> (a, b): links that connect all fingerprints within two bits of each other."""
    low = F.lit(0xFFFFFFFF)
    halves = F.array(*[F.struct(F.lit(s).alias("seg"), h.alias("half"), o.alias("other")) for s, h, o in ((0, F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)), (1, F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)))])
    members = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.seg", "h.half", "h.other")
    values = members.groupBy("seg", "half").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*[F.lit(0xFFFFFFFF ^ (1 << i)) for i in range(32)])
    # a small table that grows 32-fold: dealt anew by number, so that its partitions aren't coalesced before
    spread = values.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "half", "seg")
    variants = spread.select("half", "n", "seg", F.posexplode(masks).alias("i", "mask")).select("half", "n", (F.col("seg") * 32 + F.col("i")).cast("int").alias("at"), F.col("half").bitwiseAND(F.col("mask")).alias("variant"))
    near = variants.groupBy("at", "variant").agg(F.min("half").alias("v"), F.max("half").alias("w"), F.max("n").alias("n")).where("v <> w")
    pairs = near.select(F.floor(F.col("at") / 32).cast("int").alias("seg"), "v", "w", "n").union(values.where("n > 1").select("seg", F.col("half").alias("v"), F.col("half").alias("w"), "n"))
    pairs = cut(pairs)

    few = pairs.where(F.col("n") <= most)
    left = few.join(members.select("seg", F.col("half").alias("v"), F.col("fp").alias("a")), ["seg", "v"])
    met = left.join(members.select("seg", F.col("half").alias("w"), F.col("fp").alias("b")), ["seg", "w"])
    close = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).where((F.col("v") < F.col("w")) | (F.col("a") < F.col("b"))).select("a", "b")

    full = 0xFFFFFFFF
    one = F.array(*[F.lit(full ^ (1 << i)) for i in range(32)])
    two = F.array(*[F.lit(full ^ (1 << i) ^ (1 << j)) for i in range(32) for j in range(i)])
    many = pairs.where(F.col("n") > most).select("seg", "v", "w", F.explode(F.array_distinct(F.array("v", "w"))).alias("half"))
    wiped = many.join(members, ["seg", "half"]).select("seg", "v", "w", "fp", "other", F.explode(F.when(F.col("v") == F.col("w"), two).otherwise(one)).alias("mask"))
    group = Window.partitionBy("seg", "v", "w", "mask", "rest")
    stars = wiped.withColumn("rest", F.col("other").bitwiseAND(F.col("mask"))).select(F.min("fp").over(group).alias("a"), F.col("fp").alias("b")).where("a <> b")
    return close.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 256) -> DataFrame:
    """doc_id, text_hash, fp and component_id (smallest doc_id of the linked group) of every row."""
    every = cut(fingerprints(docs, words))
    fps = cut(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), most))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return every.join(ids, "fp").select("doc_id", "text_hash", "fp", "component_id")


# Near copies of whole texts: fingerprints within two bits are linked first, after an exact check. Most near copies differ in
# more bits; what the fingerprints don't join is found by sketches of the sets of shingles.

#: Words of the shingles that a fingerprint counts.
PRINT = 3
#: Bands of a sketch, and the smallest hashes that make up a band. Texts of similarity s share a band with a
#: probability of 1 - (1 - s^BAND)^BANDS: 0.99993 at 0.8, whatever was edited, cut or appended.
BANDS, BAND = 24, 5
#: Standard deviations by which a sketch may fall below the least similarity before a pair is given up.
SLACK = 5
#: Rounds in which the texts of a band meet one of them, before those that are left meet by their rarest shingles.
LEAD = 1
#: Shingles whose hashes are held at a time.
PIECE = 4096
_RNG = np.random.Generator(np.random.PCG64(20020519))
_SALT, _ODD = (_RNG.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) for _ in range(2))
_ODD = _ODD * np.uint64(2) + np.uint64(1)


def gram_set(text: str, words: int) -> np.ndarray:
    """The different shingles of ``words`` words in order; of all words of a shorter text."""
    w = word_hashes(text)
    return np.unique(shingles(w, min(words, len(w)))) if len(w) else np.zeros(0, np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The smallest of each of BANDS * BAND hashes of the shingles; every shingle counts alike."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), PIECE):
        h = (grams[k : k + PIECE, None] ^ _SALT) * _ODD
        np.minimum(least, h.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), fp (its fingerprint, as ``fingerprints`` has it), n (different shingles), low (a byte of each smallest hash) and bands of every row; a null text is an empty one."""
    whole_text_batches(docs.sparkSession)
    place = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, n, low, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                prints.append(simhash(shingle_hashes(text.encode(), PRINT)))
                grams = gram_set(text, words)
                least = sketch(grams)
                key = place.copy()
                for x in least.reshape(BANDS, BAND).T:
                    key = (key ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(31)
                n.append(len(grams))
                low.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                bands.append(key.view(np.int64) if len(grams) else key[:0].view(np.int64))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, pa.array(n, pa.int64()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "fp", "n", "low", "bands"])

    x = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, "doc_id long, th long, fp long, n long, low binary, bands array<long>")


def shared_bands(texts: DataFrame) -> DataFrame:
    """(th, bands) -> (key, th, rank) for every band that two texts have; the text that meets most others ranks first."""
    members = cut(texts.select("th", F.explode("bands").alias("key")))
    met = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key")
    rank = met.groupBy("th").agg(F.struct(F.sum("m").alias("m"), F.xxhash64("th").alias("h"), F.col("th")).alias("rank"))
    return cut(met.select("key", "th").join(rank, "th").select("key", "th", "rank"))


def gram_sets(docs: DataFrame, texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """th and grams (the different shingles in order, as bytes) of the texts in ``asked`` (th)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gram_set(t or "", words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["th", "grams"])

    named = asked.join(texts.select("th", "least"), "th").select("th", F.coalesce("least", F.lit(0)).alias("ki"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("ki"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]
    grams = docs.select(*key, "text").join(named, ["th", "ki"], "left_semi").select("th", "text").mapInArrow(sets, "th long, grams binary")
    return grams.groupBy("th").agg(F.first("grams").alias("grams"))


def rare_pairs(docs: DataFrame, texts: DataFrame, asked: DataFrame, words: int, least: float) -> DataFrame:
    """(th, root) -> (th, b): pairs of texts with different roots, among them all whose similarity is at least ``least``.

    Such a text has at least that share of its shingles in common with the
    other one. So of the rest of them and one more, taken from the rarest on,
    the two share one (prefix filtering, Chaudhuri et al., 2006), and the first
    one they share leaves enough behind it in both (Xiao et al., 2008). Shingles
    of one text alone count without being joined.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for th, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.frombuffer(grams, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), th)), pa.array(np.full(len(g), len(g))), pa.array(g)], ["th", "n", "gram"])

    every = cut(gram_sets(docs, texts, asked.select("th"), words).mapInArrow(exploded, "th long, n long, gram long"))
    common = every.join(every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "gram")
    mine = Window.partitionBy("th")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("c", "gram"))
    rare = common.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1)
    rare = cut(rare.select("gram", "th", "n", F.expr("n - place").alias("after")).join(asked, "th"))
    other = rare.select("gram", F.col("th").alias("b"), F.col("n").alias("nb"), F.col("after").alias("afterb"), F.col("root").alias("other"))
    both = 1 + F.least("after", "afterb")  # that two texts have in common at most, if this shingle is their first
    return rare.join(other, "gram").where("th < b and root <> other").where(both * (1 + least) >= least * (F.col("n") + F.col("nb")) - 1e-6).select("th", "b").distinct()


def print_links(docs: DataFrame, texts: DataFrame, words: int, least: float, most: int = 256) -> DataFrame:
    """(a, b): links of ``links`` between the fingerprints of texts, as far as ``verified`` confirms them.

    The text of the smallest hash stands for all texts of its fingerprint, and
    the others meet it. Pairs that meet only through texts that fail the check
    are left to the sketches.
    """
    fps = cut(texts.groupBy("fp").agg(F.min("th").alias("first")))
    same = texts.select("fp", "th").join(fps, "fp").where("th <> first").select(F.col("first").alias("a"), F.col("th").alias("b"))
    f = lambda n: fps.select(F.col("fp").alias(n), F.col("first").alias(f"first{n}"))
    far = links(fps.select("fp"), most).join(f("a"), "a").join(f("b"), "b")
    far = far.select(F.least("firsta", "firstb").alias("a"), F.greatest("firsta", "firstb").alias("b"))
    return verified(docs, texts, same.union(far).distinct(), words, least)


def unjoined(bands: DataFrame, links_: DataFrame) -> DataFrame:
    """(key, th, rank, root) of the bands whose texts ``links_`` don't all join; root is the same for joined texts."""
    joined = components(links_).withColumnRenamed("root", "joined")
    named = cut(bands.join(joined, F.col("th") == F.col("node"), "left").select("key", "th", "rank", F.coalesce("joined", "th").alias("root")))
    return cut(named.join(named.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("key"), "key", "left_semi"))


def band_links(docs: DataFrame, texts: DataFrame, links_: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): ``links_``, and links that connect whatever else pairs of similar texts that share a band connect.

    In a round each text meets the first text of each of its bands, unless
    links join the two already. The first text has then met all of its band and
    leaves it, and bands whose texts are all joined are done. After ``LEAD``
    rounds, the texts that are left meet by ``rare_pairs``, which misses no
    link. So a pair that shares a band stays unseen only where it would link
    texts of one group, and a group that its first texts join costs a row a text
    and not a pair of its texts.
    """
    shared = unjoined(shared_bands(texts), links_)
    for k in range(LEAD + 1):
        release(docs.sparkSession)
        if shared.isEmpty():
            break
        if k < LEAD:
            first = shared.groupBy("key").agg(F.max(F.struct("rank", "root")).alias("r")).select("key", F.col("r.rank.th").alias("b"), F.col("r.root").alias("other"))
            pairs = shared.join(first, "key").where("root <> other")
        else:
            pairs = rare_pairs(docs, texts, shared.select("th", "root").distinct(), words, least)
        found = verified(docs, texts, pairs.select(F.least("th", "b").alias("a"), F.greatest("th", "b").alias("b")).distinct(), words, least)
        links_ = cut(links_.union(found))
        if k < LEAD:
            shared = unjoined(shared.join(first.select("key", F.col("b").alias("th")), ["key", "th"], "left_anti"), links_)
    return links_


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of texts whose sets of shingles have a Jaccard similarity of at least ``least``."""
    enough = least - SLACK * (least * (1 - least) / (BANDS * BAND)) ** 0.5

    @F.pandas_udf("boolean")
    def promising(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BANDS * BAND) for s in (a, b))
        return pd.Series((x == y).mean(axis=1) >= enough)

    f = lambda n: texts.select(F.col("th").alias(n), F.col("n").alias(f"n{n}"), F.col("low").alias(f"low{n}"))
    sized = pairs.join(f("a"), "a").join(f("b"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    pairs = cut(sized.where(promising("lowa", "lowb")).select("a", "b"))
    release(docs.sparkSession)

    grams = cut(gram_sets(docs, texts, pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), words))
    release(docs.sparkSession)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    g = lambda n: grams.select(F.col("th").alias(n), F.col("grams").alias(f"g{n}"))
    return cut(pairs.join(g("a"), "a").join(g("b"), "b").where(alike("ga", "gb")).select("a", "b"))


def text_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id and th, and of each different text its th, least doc_id and group (a text hash).

    Candidates are texts whose fingerprints are within two bits, and then texts
    that share a band of their sketches. A candidate pair is a link if its sets
    of shingles of ``words`` words (of all words of a shorter text) have a
    Jaccard similarity of at least ``least``; here words are in lower case
    without ASCII punctuation. Texts without such words have no band: they are
    only grouped with each other, by their fingerprints.
    """
    every = cut(sketches(docs, words))
    texts = cut(every.groupBy("th").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "low", "bands")]))
    release(docs.sparkSession)
    near = print_links(docs, texts, words, least)
    roots = components(band_links(docs, texts.where("n > 0"), near, words, least))
    named = texts.join(roots, F.col("th") == F.col("node"), "left").select("th", "least", F.coalesce("root", "th").alias("group"))
    return every.select("doc_id", "th"), named


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, th and group (a text hash) of every row: texts of a group are linked by near copies."""
    every, named = text_groups(docs, words, least)
    return every.join(named.drop("least"), "th")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: its smallest (doc_id, text hash).

    The choice is among different texts with their least ids, so copies aren't joined.
    """
    _, named = text_groups(docs, words, least)
    first = named.groupBy("group").agg(F.min(F.struct("least", "th")).alias("r")).select(F.col("r.least").alias("doc_id"), "r.th")
    # rows that agree in both are one document; ids are null-safe through a key of two parts
    first = first.select(F.col("doc_id").isNull().alias("near_null"), F.coalesce("doc_id", F.lit(0)).alias("near_id"), F.col("th").alias("near_hash"))
    kept, key = Kept(docs, "near_"), ["near_null", "near_id", "near_hash"]
    x = kept.df.select("*", F.col("doc_id").isNull().alias("near_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("near_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("near_hash"))
    x = x.join(first, key, "left_semi").withColumn("near_row", F.row_number().over(Window.partitionBy(*key).orderBy("near_hash")))
    return x.where("near_row = 1").select(*kept.columns)
