"""Cases at the edge of each operator: very long texts, ties, repeated rows, empty tables, null ids."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from chunkloom.llm import catalog, chat_format, decontaminate, edit_fingerprint, language_id, mixing, secret_scan, sharding, simhash_dedup, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 300_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def test_very_long_texts(spark):
    df = documents(spark, [(1, LONG, "s"), (2, "short text here", "s"), (3, LONG + "end", "s")])
    turns = spark.createDataFrame([(1, 0, "user", LONG)], "conv_id long, turn int, role string, text string")
    chat = chat_format.format_chats(turns.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts")))
    assert chat.select(F.length(chat_format.read_back(F.col("formatted"))[0]["text"])).first()[0] == len(LONG)
    assert {r["doc_id"]: r["mix_size"] for r in mixing.mix(df).collect()} == {1: 300_000, 2: 3, 3: 300_001}
    assert sorted(len(r["text"]) for r in sharding.shard(df, 2, bucket_bytes=1000).collect()) == sorted(map(len, (LONG, "short text here", LONG + "end")))
    pages = spark.createDataFrame([(1, "http://a.com/" + "p" * 1_000_000)], "page_id long, url string")
    assert url_filter.judge(pages, pages.limit(0).select("url", F.lit(1).alias("bad")), catalog.URL_RULES).first()["url_rule"] == "com/"
    groups = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(df).collect()}
    assert groups[1] == groups[3] == 1 and groups[2] == 2
    kept = {r["doc_id"]: (r["n_bytes"], len(r["kept"]), len(r["passages"])) for r in substring_dedup.remove_repeats(df, 400, 51).collect()}
    assert kept == {1: (len(LONG), 0, 1), 2: (15, 15, 0), 3: (len(LONG) + 3, 3, 1)}
    model = language_id.train(df)
    assert [r["lang_pred"] for r in language_id.identify(df, model).collect()] == ["en"] * 3
    item = spark.createDataFrame([(9, "the item of the benchmark that a long text holds somewhere in its middle part")], "item_id long, text string")
    held = documents(spark, [(4, LONG + item.first()["text"] + " " + LONG, "s")])
    assert [(r["doc_id"], r["start_word"], r["similarity"]) for r in decontaminate.links(held, item).collect()] == [(4, 300_000, 1.0)]


def test_ties_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/")], "page_id long, url string")
    none = pages.limit(0).select("url", F.lit(1).alias("bad"))
    out = url_filter.judge(pages, none, [("allow", "a.com", "/"), ("block", "a.com", "/")])
    assert sorted((r["page_id"], r["url_verdict"], r["url_rule"]) for r in out.collect()) == [(1, "allow", "a.com/"), (1, "allow", "a.com/"), (2, "allow", None)]
    assert url_filter.judge(pages.limit(0), none, catalog.URL_RULES).count() == 0
    same = documents(spark, [(1, "token = abcdefgh12", "s")] * 3)
    assert [len(r["spans"]) for r in secret_scan.scan(same).collect()] == [1, 1, 1] and secret_scan.scan(same.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "aaa bbb", "x", "s", None), (2, "aaa bbb", "y", "s", None)] * 30, DOCS)
    model = language_id.train(both)
    assert {r["lang_pred"] for r in language_id.identify(both, model).collect()} <= {"x", "y"} and len({(r["lang_pred"], r["lang_score"]) for r in language_id.identify(both, model).collect()}) == 1
    item = "one two three four five six seven eight nine ten"
    doc = documents(spark, [(7, f"{item} and {item}", "s")] * 2)
    found = decontaminate.links(doc, spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in found] == [(7, 1, 0)] * 4
    assert decontaminate.links(doc.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
    assert decontaminate.links(doc, spark.createDataFrame([], "item_id long, text string")).count() == 0
    ring = edit_fingerprint.edited_fingerprints(documents(spark, [(5, "b" * 90, "s"), (5, "a" * 90, "s"), (5, "a" * 90, "s"), (4, "c" * 90, "s")])).collect()
    assert sorted(r["near_next"] == 1.0 for r in ring) == [False, False, False, True] and len(ring) == 4
    mixed = mixing.mix(documents(spark, [(1, "same words", "a")] * 40 + [(2, "same words", "b")] * 40)).groupBy("source").agg(F.sum("mix_copies").alias("n"), F.max("mix_copies").alias("m"))
    assert all(r["m"] <= 3 and r["n"] > 0 for r in mixed.collect())


def test_slots_follow_buckets_and_their_shuffles(spark):
    rng = random.Random(1)
    df = documents(spark, [(rng.randrange(500), f"text {i} " * rng.randint(1, 30), "s") for i in range(300)])
    seed, shards, size = 29, 5, 4000
    key, record = F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id"), F.xxhash64(F.lit(seed), *df.columns)
    rows = df.select("doc_id", "text", key.alias("key"), record.alias("record")).collect()
    bucket_hash = {(r["h"]): r["b"] for r in spark.createDataFrame([(r["record"],) for r in rows], "h long").select("h", F.xxhash64(F.lit(seed + 1), "h", F.lit(0).cast("long")).alias("b")).collect()}

    def jump(k):
        k, b, j = k % (1 << 64), -1, 0
        while j < shards:
            b, k = j, (k * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((k >> 33) + 1)))
        return b

    by_shard = defaultdict(list)
    for r in rows:
        by_shard[jump(r["key"])].append(r)
    want = {}
    for s, own in by_shard.items():
        total = sum(len(r["text"].encode()) + len("en") + len("s") + 8 * len(df.columns) for r in own)
        n, buckets, slot = max(1, -(-total // size)), defaultdict(list), 0
        for r in own:
            buckets[bucket_hash[r["record"]] % n].append(r)
        for b in sorted(buckets):
            group = sorted(buckets[b], key=lambda r: r["record"])
            order = np.arange(len(group))
            np.random.Generator(np.random.PCG64([seed, s, b])).shuffle(order)
            for k in order:
                want[s, slot] = (group[k]["doc_id"], group[k]["text"])
                slot += 1
    got = {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in sharding.shard(df, shards, seed, bucket_bytes=size).collect()}
    assert got == want and max(b for _, b in got) > 20


def test_model_and_prediction_by_hand():
    rng = np.random.default_rng(3)
    texts = [("the cat sat on the mat " + "".join(rng.choice(list("abc "), 9)), 0) for _ in range(12)] + [("der hund lief schnell " + "".join(rng.choice(list("xyz "), 9)), 1) for _ in range(12)]
    idf, rows = np.ones(language_id.FEATURES), []
    for t, k in texts:
        c = language_id.counts(t)
        at = np.flatnonzero(c)
        rows.append((at, language_id.weighted(at, c[at], idf), k))
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.02
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    for _ in range(3):
        for at, x, label in rows:
            cells = [*zip(at.tolist(), x.tolist(), strict=True), (language_id.FEATURES, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in cells for k in (0, 1)}
            s = [sum(v * w[i, k] for i, v in cells) for k in (0, 1)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            for i, v in cells:
                for k in (0, 1):
                    g = (p[k] - (k == label)) * v
                    sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    got = language_id.ftrl(rows, 2)
    used = sorted({i for i, _ in z})
    assert np.allclose(got[used], [[weight(i, 0), weight(i, 1)] for i in used], atol=1e-9)
    model = language_id.Model(["en", "de"], idf, got, np.ones(language_id.FEATURES, bool), 0.5)
    c = language_id.counts("the cat ran")
    at = np.flatnonzero(c)
    x = language_id.weighted(at, c[at], idf)
    s = [sum(v * weight(i, k) for i, v in zip(at.tolist(), x.tolist(), strict=True)) + weight(language_id.FEATURES, k) for k in (0, 1)]
    assert model.predict("the cat ran")[0] == "en" and abs(model.predict("the cat ran")[1] - 1 / (1 + np.exp((s[1] - s[0]) / 0.5))) < 1e-9
    grams = language_id.counts("日本")
    assert grams.sum() == 4 + 3 + 2 and language_id.counts("日").sum() == 3 + 2 + 1
    long = "ab cd " * 300_000
    assert language_id.counts(long).sum() == 3 * (len(long) + 2) - 3
