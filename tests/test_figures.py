"""Figures on the edge of two roundings, and steps whose memory or bytes must not grow with the input."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import scalars
from chunkloom.operators import chunking, compare, cost, delta, islands
from chunkloom.sources import builds, container, exchange


def test_sizes_round_halves_to_even(spark):
    want = {320 * 320 * 32 * 97: "303.12 MiB", 1024 + 128: "1.12 KiB", 1024 + 384: "1.38 KiB", (1 << 20) - 1: "1024.00 KiB", 86016**2 * 40 * 97: "26735.62 GiB", 1023: "1023 B", 1 << 30: "1.00 GiB"}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r["n"]: r["s"] for r in df.select("n", scalars.human_bytes(F.col("n")).alias("s")).collect()} == want


def test_rounding_is_that_of_doubles(spark):
    # the shortest decimal forms end in a 5 that arithmetic on doubles loses, or has, in the tenth place
    want = {1073.2318359375: 1073.231835937, 513.7697265625: 513.769726562, -0.5: -0.5, 2.5e-10: 0.0, -7.5e-10: -1e-09, 4.9999999999999994e-10: 0.0, 1e200: 1e200, float("inf"): float("inf")}
    df = spark.createDataFrame([(v,) for v in want], "v double")
    got = {r["v"]: r["r"] for r in df.select("v", scalars.rounded("v", 9).alias("r")).collect()}
    assert got == want


def test_scores_of_routes_are_those_of_sql(spark):
    import duckdb

    rows = [(c, route, pos, True, c * 40_000 + 1_000_000 * (pos + 1), c % 900, 16 << 20, 0, 0, 1, 0) for c in range(1, 5001) for pos, route in enumerate(("full", "plan"))]
    df = spark.createDataFrame(rows, "client long, route string, pos int, available boolean, network_bytes long, apply_ms long, ram long, temp long, disk_read long, steps int, build_ms int")
    got = {(r["client"], r["pos"]): r["score"] for r in cost.score_routes(df, "balanced").collect()}
    sql = duckdb.execute("select c, p, round((c * 40000 + 1000000 * (p + 1)) / 1048576.0::double * 10.0::double + (c % 900) * 0.05::double + 16777216 / 1048576.0::double * 0.05::double + 0 * 0.01::double + 0 * 0.01::double + 25.0::double * 0, 9) from range(1, 5001) r(c), range(0, 2) s(p)").fetchall()
    assert got == {(c, p): v for c, p, v in sql}


def test_times_count_to_the_nearest_second(spark, tmp_path):
    from datetime import datetime

    from chunkloom import catalog

    from .oracle import duck_rows, spark_rows

    rows = [(datetime(2024, 1, 1, 5, 59, 59, 700_000), "a", 200.0), (datetime(2024, 1, 1, 5, 59, 59, 500_000), "b", 1.0), (datetime(2024, 1, 1, 5, 0, 0, 499_999), "b", 200.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert spark_rows(catalog.QUERIES["concurrency_replay"](spark, str(tmp_path))) == duck_rows(c, catalog.ORACLE_SQL["concurrency_replay"])


def test_blocks_with_a_common_phrase_are_suggested_once(spark):
    rng = random.Random(5)
    # the phrase is the anchor of all windows that hold it
    phrase = min((rng.randbytes(32) for _ in range(20_000)), key=lambda p: int(chunking._gram_hashes(p, 32)[0]))
    rows = lambda n: [(f"f{i:03d}", bytearray(rng.randbytes(16 + rng.randrange(2)) + phrase + rng.randbytes(80))) for i in range(n)]
    olds, news = rows(60), rows(60)
    news[7] = ("x", bytearray(b"ab") + olds[9][1][:64] + bytearray(b"cd"))
    old, new = (spark.createDataFrame(r, "path string, content binary") for r in (olds, news))
    _, anywhere = delta._first_places(chunking.block_anchors(old, 64))
    assert [(r["path"], r["new_off"], r["entry"], r["old_off"]) for r in delta.equal_windows(new, anywhere, 64).collect()] == [("x", 2, "f009", 0)]
    got = {(r["path"], r["op"], r["new_off"], r["len"]) for r in delta.block_diff(old, new, 64).where("path = 'x'").collect()}
    assert got == {("x", "inline", 0, 2), ("x", "copy", 2, 64), ("x", "inline", 66, 2)}


def test_fingerprints_are_those_of_windows():
    data = random.Random(1).randbytes(1000)
    for size in (4, 8, 33, 256, 1000):
        got = chunking._fingerprints(data, size)
        assert [int(v) for v in got[:: max(1, len(got) // 9)]] == [int(chunking._fingerprints(data[at : at + size], size)[0]) for at in range(0, len(got), max(1, len(got) // 9))]


def test_workers_take_few_bytes_at_once(spark):
    files = spark.range(3000, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 4000).cast("binary").alias("content"))
    chunking.signature(files, 256)

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert files.mapInArrow(bytes_of, "n long").agg(F.max("n")).first()[0] < 5 << 20


def test_streams_leave_no_rows_with_the_driver(spark):
    from chunkloom import catalog

    for name in ("streaming_sessions", "streaming_windows"):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.count() and df.inputFiles()  # a sink in memory has no files


def test_a_filter_in_parts_is_the_filter(spark):
    rng = random.Random(2)
    keys, others = [rng.randbytes(32) for _ in range(900)], [rng.randbytes(32) for _ in range(2000)]
    f, g = scalars.Bloom(len(keys)), scalars.Bloom(len(keys))
    for k in keys:
        f.add(k)
    g.add_all(keys)
    assert f.bits.tobytes() == g.bits.tobytes() and g.contains_all(keys + others).tolist() == [k in f for k in keys + others]
    known, asked = (spark.createDataFrame([(k.hex(),) for k in ks], "hash string") for ks in (keys, keys + others))
    filters = delta.bloom_filters(known, 7)
    assert filters.count() == 7 and filters.agg(F.max(F.length("bits"))).first()[0] < len(f.bits) // 4
    maybe = {r["hash"]: r["maybe"] for r in delta.filtered(asked, filters, 7).collect()}
    assert len(maybe) == 2900 and all(maybe[k.hex()] for k in keys) and sum(maybe[o.hex()] for o in others) < 60
    assert not any(r["maybe"] for r in delta.filtered(asked, delta.bloom_filters(known.limit(0), 1), 1).collect())


def test_manifests_in_batches_are_those_one_by_one(spark):
    rng = random.Random(3)
    rows = [(f"a{k % 7}", k % 3, rng.choice([-1, 0, 5, 200]), k, rng.choice([0, 127, 128, 1 << 20, (1 << 62) + k]), f"h{rng.randrange(9)}") for k in range(400)]
    rows += [("long", 0, k, 0, k, f"{rng.random()}") for k in range(4000)]
    df = spark.createDataFrame(rows, "asset string, track long, segment long, ord long, off long, hash string")
    found = {r["asset"]: bytes(r["manifest"]) for r in exchange.encode_manifests(df).collect()}
    order = ("track", "off", "segment", "ord", "hash")
    of = lambda a: [dict(zip(order, v, strict=True)) for v in sorted((t, o, s, n, h) for asset, t, s, n, o, h in rows if asset == a)]
    assert found == {a: exchange.encode_manifest(of(a)) for a in {r[0] for r in rows}} and found["long"][4] == 1
    again = spark.createDataFrame([*found.items(), ("json", b'[{"track": 1, "segment": -1, "ord": 0, "off": 2, "hash": "x"}]'), ("none", exchange.encode_manifest([]))], "asset string, manifest binary")
    assert sorted(map(tuple, exchange.decode_manifests(again).collect())) == sorted([*rows, ("json", 1, -1, 0, 2, "x")])


def test_damaged_manifests_are_refused_in_batches(spark):
    good = exchange.encode_manifest([{"track": 0, "segment": 0, "ord": 0, "off": 300, "hash": "h"}])
    for bad in (good[:-1], good + b"\0", good[:-1] + b"\7", good[:-3] + b"\xac\x82\x00\x00", b"CLM2"):
        df = spark.createDataFrame([("a", good), ("b", bad)], "asset string, manifest binary").coalesce(1)
        with pytest.raises(Exception, match="BadManifest"):
            exchange.decode_manifests(df).collect()


def test_packs_of_metadata_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    manifests = spark.createDataFrame([(f"a{k}", b"m%d" % k) for k in range(20)], "asset string, manifest binary").mapInArrow(one, "asset string, manifest binary")
    exchange.export_meta_packs(manifests, f"{tmp_path}/meta", 3)
    assert made.value == 20 and exchange.resolve(spark, f"{tmp_path}/meta", manifests).where("source = 'packed'").count() == 20


def test_states_count_copies_and_places(spark):
    rows = [("a", 0, 4, "x", 0), ("a", 0, 4, "x", 0), ("a", 0, 4, "y", 1), ("a", 0, 4, "y", 1), ("b", 0, 4, "x", 0), ("b", 1, 4, "y", 0), ("b", 0, 4, "y", 1), ("b", 1, 4, "x", 1), ("c", 0, 4, "x", 0), ("c", 0, 4, "x", 1), ("d", 0, 4, "q", 1), ("e", 0, 4, "x", 0)]
    both = spark.createDataFrame(rows, "path string, ord int, len long, hash string, is_new int")
    got = {r["path"]: (r["state"], r["fresh_bytes"]) for r in compare.classify(both).collect()}
    assert got == {"a": ("MODIFIED", 0), "b": ("MODIFIED", 0), "c": ("SAME", 0), "d": ("NEW", 4), "e": ("DELETED", 0)}


def shuffled(df):
    """The names and kinds of the columns that each exchange of a plan carries."""
    found = []
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.inputPlan())
            continue
        if p.nodeName() == "Exchange":
            found.append(p.output().mkString(",") + " " + p.schema().simpleString())
        c = p.children()
        todo += [c.apply(i) for i in range(c.size())]
    return found


def test_chunks_are_compared_by_short_hashes(spark):
    both = builds.both_chunks(spark, "/root/testdata/sf0.001")
    for df in (compare.file_estimates(both), compare.classify(both), islands.changed_windows(both.select("path", "ord", "len", "hash", "is_new"))):
        kinds = shuffled(df)
        assert kinds and not any("hash:" in k or "content_id" in k or "_hash" in k for k in kinds)
        assert "SortAggregate" not in df._jdf.queryExecution().toString()


def test_narrow_rows_are_dealt_however_many(spark, tmp_path):
    spark.range(1_000_000).select(F.col("id").alias("c_custkey"), F.rand(1).alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    from chunkloom.plans.cost import _routes

    assert _routes(spark, str(tmp_path)).rdd.getNumPartitions() >= 6


def test_signals_are_made_once_for_a_plan(spark):
    from chunkloom import catalog

    for name in ("layout_plan", "build_findings"):
        assert "MapInArrow" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_windows_of_files_are_those_of_rows(spark):
    rows = [("a", "x" * 10, "x" * 9), ("b", "abcdefgh", "abcdefgh1234"), ("c", "", "abc"), ("d", None, "abcde"), ("e", "only old", None)]
    old = spark.createDataFrame([(p, o) for p, o, _ in rows], "path string, content string")
    new = spark.createDataFrame([(p, n) for p, _, n in rows if p != "e"], "path string, content string")
    both = builds.fixed_chunks(old, 4).withColumn("is_new", F.lit(0)).unionByName(builds.fixed_chunks(new, 4).withColumn("is_new", F.lit(1)))
    of = lambda df: sorted(tuple(r[c] for c in ("path", "ord", "len", "changed", "was", "is")) for r in df.collect())
    got = islands.changed_windows_of(islands.window_hashes(old, 4), islands.window_hashes(new, 4))
    assert of(got) == of(islands.changed_windows(both.where("path <> 'e'")))
    assert "Aggregate" not in got._jdf.queryExecution().toString()


def test_containers_cut_files_no_more_than_they_must(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            cut.add(b.num_rows)
            yield b

    rng = random.Random(4)
    files = spark.createDataFrame([(f"f{k}", bytearray(rng.randbytes(3000) + b"a" * 3000)) for k in range(8)], "path string, content binary")
    watched = files.mapInArrow(one, "path string, content binary")
    container.write_container(watched, f"{tmp_path}/box", least=128, mean=512, most=2048)
    assert cut.value == 3 * 8  # for the files, their segments and their chunks
    box = container.open_container(spark, f"{tmp_path}/box")
    assert container.verify(box).where("problems > 0").count() == 0
    assert container.unpack(box).where("sound").count() == 8


def test_one_compressor_is_kept():
    assert scalars._packer(3) is scalars._packer(3)
    data = bytes(range(256)) * 20
    form, kept = scalars.store_form(data)
    assert form != "raw" and scalars.load_form(form, kept) == data
