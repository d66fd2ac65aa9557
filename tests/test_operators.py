"""Operators on made-up inputs: properties, edge cases and round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import scalars
from chunkloom.operators import chunking, compare, cost, delta, graph, integrity, islands, ledger, workspace
from chunkloom.sources import builds, formats


def chunks(spark, rows):
    return spark.createDataFrame(rows, "path string, ord int, len long, hash string, is_new int").withColumn("off", F.lit(0))


def states(df):
    return {r["path"]: r["status"] for r in compare.file_estimates(df).collect()}


def test_status_of_permuted_and_repeated_chunks(spark):
    old = [("a", 0, 4, "x", 0), ("a", 1, 4, "y", 0), ("b", 0, 4, "x", 0), ("b", 1, 4, "x", 0), ("c", 0, 4, "z", 0)]
    new = [("a", 0, 4, "y", 1), ("a", 1, 4, "x", 1), ("b", 0, 4, "x", 1), ("b", 1, 4, "x", 1), ("d", 0, 4, "z", 1)]
    # a permutation of different chunks is unchanged; a file that repeats a chunk is modified with nothing to load
    assert states(chunks(spark, old + new)) == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}


def test_fixed_chunks_of_bytes_and_empty(spark):
    df = spark.createDataFrame([("e", b""), ("s", b"abc"), ("t", bytes(range(10))), ("n", None)], "path string, content binary")
    got = [(r["path"], r["off"], r["len"]) for r in builds.fixed_chunks(df, 4).orderBy("path", "off").collect()]
    assert got == [("s", 0, 3), ("t", 0, 4), ("t", 4, 4), ("t", 8, 2)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([(64, 128, 512), (64, 256, 1024)]))
def test_cut_points_tile_within_bounds(data, sizes):
    ends = chunking.cut_points(data, *sizes, norm=1)
    lengths = np.diff([0, *ends])
    assert (not data and not ends) or ends[-1] == len(data)
    assert (lengths <= sizes[2]).all() and (lengths[:-1] > sizes[0]).all() if len(lengths) else True


def test_cut_points_resist_shifts():
    data = scalars.xorshift_bytes(200_000, 5)
    a, b = chunking.cut_points(data, 256, 1024, 4096), chunking.cut_points(b"12345678" + data, 256, 1024, 4096)
    assert len({e + 8 for e in a} & set(b)) > 0.95 * len(a) and 700 < len(data) / len(a) < 2500


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 50))
def test_rolling_checksum(data, size):
    got = scalars.rolling_weak32(data, size)
    assert got.tolist() == [scalars.weak32_of(data[i : i + size]) for i in range(len(data) - size + 1)]


def test_checksum_values():
    assert [scalars.weak32_of(b) for b in (b"", b"a", b"abc")] == [0, 97 | 97 << 16, 0x024A0126]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_stored_forms_round_trip(data):
    assert scalars.ungroup_bytes(scalars.group_bytes(data)) == data
    assert scalars.load_form(*scalars.store_form(data)) == data
    assert scalars.store_form(data[:511])[0] == "raw"


def test_byte_planes_help_tables_of_numbers():
    data = np.random.default_rng(0).normal(1.0, 0.01, 4000).astype("<f4").tobytes()
    assert scalars.store_form(data)[0] == "planes+zstd" and scalars.store_form(scalars.xorshift_bytes(4096, 1))[0] == "raw"


@given(st.integers(0, (1 << 64) - 1))
def test_varint_round_trip(n):
    data = scalars.varint(n)
    assert scalars.read_varint(data) == (n, len(data))


@pytest.mark.parametrize("bad", [b"", b"\x80", b"\x80\x00", b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x02"])
def test_varint_rejects(bad):
    with pytest.raises(ValueError):
        scalars.read_varint(bad)


def test_bloom_has_no_false_negatives():
    rng = random.Random(1)
    keys, others = [rng.randbytes(32) for _ in range(500)], [rng.randbytes(32) for _ in range(2000)]
    f = scalars.Bloom(len(keys))
    for k in keys:
        f.add(k)
    assert all(k in f for k in keys) and sum(o in f for o in others) < 60


def test_sampled_entropy():
    noise = scalars.xorshift_bytes(300_000, 3)
    assert scalars.entropy_of(b"") == 0 and scalars.entropy_of(b"aaaa") == 0 and scalars.entropy_of(bytes(range(256))) == 8
    assert scalars.sampled_entropy_of(noise, 4, 1000) == pytest.approx(7.8, abs=0.15) and scalars.sampled_entropy_of(b"ab" * 10, 4, 1000) == 1.0


def test_merkle_roots():
    h = [bytes([i]) * 32 for i in range(5)]
    two = lambda a, b: chunking.hashlib.sha256(a + b).digest()
    assert chunking.merkle_of(h[:1]) == h[0] and chunking.merkle_of(h[:2]) == two(h[0], h[1])
    assert chunking.merkle_of(h) == two(two(two(h[0], h[1]), two(h[2], h[3])), h[4])


@pytest.mark.parametrize("seed", range(3))
def test_block_diff_rebuilds(spark, seed):
    rng = random.Random(seed)
    base = {f"f{i}": rng.randbytes(rng.randint(0, 3000)) for i in range(6)}
    new = {"f0": base["f0"], "f1": b"123" + base["f1"], "f2": base["f2"][:500] + b"X" + base["f2"][500:], "f3": base["f3"][::-1], "f9": rng.randbytes(700), "moved": base["f4"], "f5": base["f5"][64:] + base["f4"] + bytes(300)}
    base["f2"] += bytes(400)
    base["f5"] += bytes(200)
    df = lambda d: spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], "path string, content binary")
    ops = delta.block_diff(df(base), df(new), 64)
    got = {r["path"]: bytes(r["content"]) for r in delta.apply_plan(df(base), ops).collect()}
    assert got == {k: v for k, v in new.items() if v}
    s = {r["path"]: r for r in delta.plan_summary(ops).collect()}
    if len(base["f1"]) > 500:
        assert s["f1"]["reused"] > 0.8 * len(base["f1"])
    got = {k: [] for k in new if new[k]}
    for r in ops.orderBy("path", "seq").collect():
        got[r["path"]].append((r["op"], r["entry"], r["old_off"], r["new_off"], r["len"]))
    assert got == {k: brute_diff(base, k, v, 64) for k, v in new.items() if v}


def brute_diff(old, path, data, size):
    """Greedy from left to right, all old blocks looked at in order of preference: same path going on, same path, lowest offset, first entry."""
    blocks = [(p, o, b[o : o + size]) for p, b in sorted(old.items()) for o in range(0, len(b) - size + 1, size)]
    ops, at, pending = [], 0, 0
    while at + size <= len(data):
        hits = [(p, o) for p, o, b in blocks if b == data[at : at + size]]
        if not hits:
            at += 1
            continue
        last = ops[-1] if ops and ops[-1][0] == "copy" and pending == at else None
        entry, off = min(hits, key=lambda h: (h[0] != path, not (last and h[0] == path == last[1] and h[1] == last[2] + last[4]), h[1], h[0]))
        if pending < at:
            ops.append(("inline", None, None, pending, at - pending))
        if last and (last[1], last[2] + last[4]) == (entry, off):
            ops[-1] = ("copy", entry, last[2], last[3], last[4] + size)
        else:
            ops.append(("copy", entry, off, at, size))
        at = pending = at + size
    return ops + ([("inline", None, None, pending, len(data) - pending)] if pending < len(data) else [])


def test_candidate_score(spark):
    rows = [("p", 0, "p", 9000, 1, False), ("p", 0, "q", 0, 2, False), ("p", 64, "q", 0, 1, True), ("p", 64, "q", 900_000, 5, False), ("p", 128, "q", 600_000, 3, False), ("p", 128, "q", 700_000, 4, False)]
    df = spark.createDataFrame(rows, "path string, new_off long, entry string, old_off long, block int, continues boolean")
    assert {r["new_off"]: (r["entry"], r["old_off"]) for r in delta.candidate_pick(df).collect()} == {0: ("p", 9000), 64: ("q", 0), 128: ("q", 600_000)}


def test_range_groups_caps(spark):
    rows = [("p", 0, 100), ("p", 110, 100), ("p", 205, 50), ("p", 300, 10), ("q", 0, 5)]
    df = spark.createDataFrame(rows, "pack string, off long, len long")
    got = sorted((r["pack"], r["off"], r["span"], r["chunks"]) for r in islands.range_groups(df, gap=50, span=400, waste_pct=15).collect())
    assert got == [("p", 0, 210, 2), ("p", 205, 50, 1), ("p", 300, 10, 1), ("q", 0, 5, 1)]
    assert len(islands.range_groups(df, gap=50, span=205, waste_pct=None).collect()) == 4


def test_heatmap_of_one_change(spark):
    df = spark.createDataFrame([("a", i, 10, i == 2) for i in range(5)] + [("b", i, 10, i % 2 == 0) for i in range(5)], "path string, ord int, len long, changed boolean")
    got = {r["path"]: (r["changed"], r["runs"], r["scatteredness"], r["span"], r["mean_run"]) for r in islands.heatmap(df).collect()}
    assert got == {"a": (1, 1, 0.0, 0.2, 1.0), "b": (3, 3, 1.0, 1.0, 1.0)}


def test_publish_replaces_and_counts(spark):
    refs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "asset string, hash string")
    again = spark.createDataFrame([("a", "z"), ("a", "z")], "asset string, hash string")
    now = ledger.publish(refs, again)
    assert sorted(map(tuple, now.collect())) == [("a", "z"), ("b", "x")]
    assert sorted(map(tuple, ledger.publish(now, again).collect())) == [("a", "z"), ("b", "x")]
    assert ledger.unpublish(now, again).count() == 1


def test_latest_wins_and_tombstones(spark):
    df = spark.createDataFrame([("x", 1, False, 10), ("x", 3, True, 0), ("y", 2, True, 0), ("y", 4, False, 7)], "hash string, generation int, tombstone boolean, value int")
    assert [tuple(r) for r in ledger.latest_wins(df).collect()] == [("y", 4, 7)]


def test_paths_with_cycles_and_gaps(spark):
    edges = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (1, 2, 5), (0, 2, 10), (2, 3, None)], "src long, dst long, bytes long")
    got = {(r["src"], r["dst"]): (r["bytes"], r["steps"]) for r in graph.cheapest_paths(edges, spark.range(5).select(F.col("id").alias("src"))).collect()}
    assert got[0, 2] == (10, 1) and got[0, 3] == (11, 2) and (3, 0) not in got and got[4, 4] == (0, 0)


@pytest.mark.parametrize("name", sorted(graph.MODELS))
def test_traffic_sums_to_one(spark, name):
    t = graph.traffic(spark, name, 10)
    assert t.agg(F.sum("probability")).first()[0] == pytest.approx(1.0) and t.where("src > dst").count() == 0


def test_uncovered_updates_load_everything(spark):
    q = spark.createDataFrame([("p", 0, 1, 0.5), ("p", 0, 2, 0.25), ("p", 2, 2, 0.25)], "policy string, src long, dst long, probability double")
    paths = spark.createDataFrame([("p", 0, 1, 7, 1)], "policy string, src long, dst long, bytes long, steps int")
    nodes = spark.range(3).select("id", F.lit(100).cast("long").alias("full"))
    got = {(r["src"], r["dst"]): (r["bytes"], r["steps"], r["covered"]) for r in graph.simulate(q, paths, nodes).collect()}
    assert got == {(0, 1): (7, 1, True), (0, 2): (100, 0, False), (2, 2): (100, 0, True)}


def test_regressions(spark):
    m = lambda d: spark.createDataFrame(list(d.items()), "name string, value double")
    got = {r["name"]: r["result"] for r in cost.regressions(m({"a": 110.0, "b": 104.0, "c_ms": 300.0, "d": 1.0, "new": 1.0, "e": 200.0}), m({"a": 100.0, "b": 100.0, "c_ms": 100.0, "d": 0.0, "e": 100.0}), 0.05, ("e",)).collect()}
    assert got == {"a": "fail", "b": "pass", "c_ms": "pass", "d": "skipped", "e": "excepted"}


def test_worst_ignores_skipped(spark):
    df = spark.createDataFrame([("a", "pass"), ("a", "skipped"), ("b", "skipped"), ("c", "warn"), ("c", "fail")], "phase string, result string")
    assert {r["phase"]: r["result"] for r in integrity.worst(df, "phase").collect()} == {"a": "pass", "b": "skipped", "c": "fail"}


def test_overlaps_come_once(spark):
    w = spark.createDataFrame([("g", 0, 100), ("g", 90, 400), ("g", 5, 5)], "grp string, w_start long, w_end long")
    r = spark.createDataFrame([("g", 50, 300, "a"), ("g", 399, 500, "b"), ("h", 0, 9, "c")], "grp string, r_start long, r_end long, name string")
    got = sorted((x["w_start"], x["name"]) for x in workspace.overlapping(w, r, 64).collect())
    assert got == [(0, "a"), (90, "a"), (90, "b")]


def test_globs(spark):
    df = spark.createDataFrame([("a/b.txt",), ("a/c/b.txt",), ("b.txt",), ("logs/x/y",), ("src/logs/z",), ("logs",)], "p string")
    match = lambda rx: [r["p"] for r in df.where(F.col("p").rlike(rx)).collect()]
    assert match(scalars.path_glob("a/*.txt")) == ["a/b.txt"] and match(scalars.path_glob("**/b.txt")) == ["a/b.txt", "a/c/b.txt", "b.txt"]
    assert match(scalars.version_glob("a*.txt")) == ["a/b.txt", "a/c/b.txt"]
    kept = lambda rules: [r["p"] for r in df.where(~scalars.ignored(F.col("p"), rules)).collect()]
    assert kept(["logs/"]) == ["a/b.txt", "a/c/b.txt", "b.txt", "logs"] and kept(["logs"]) == ["a/b.txt", "a/c/b.txt", "b.txt"] and kept(["a/*.txt"]) == ["a/c/b.txt", "b.txt", "logs/x/y", "src/logs/z", "logs"]


# sources and writers


def test_files_and_ranges(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.bin").write_bytes(b"0123456789")
    (tmp_path / "d" / "b.bin").write_bytes(b"")
    files = builds.binary_files(spark, str(tmp_path))
    assert sorted((r["path"], r["size"]) for r in files.collect()) == [("a.bin", 10)]
    assert [tuple(r) for r in builds.list_files(spark, str(tmp_path)).select("path", "size").orderBy("path").collect()] == [("a.bin", 10), ("d/b.bin", 0)]
    got = {r["path"]: r["bytes"] for r in builds.read_range(files, F.lit(2), F.lit(3)).collect()}
    assert bytes(got["a.bin"]) == b"234"
    assert builds.read_range(files, F.lit(8), F.lit(3)).first()["bytes"] is None
    assert builds.binary_files(spark, str(tmp_path), F.col("path").startswith("d/"), content=False).count() == 0


def test_packs_are_listed(spark):
    pack = formats.make_pack({"res://a.txt": b"hello", "res://dir/b": b"x" * 100, "é": b""})
    df = spark.createDataFrame([("p.pck", bytearray(pack)), ("no.bin", bytearray(b"none"))], "path string, content binary")
    got = {r["entry"]: pack[r["off"] : r["off"] + r["size"]] for r in formats.pack_entries(df).collect()}
    assert got == {"res://a.txt": b"hello", "res://dir/b": b"x" * 100, "é": b""}
    with pytest.raises(ValueError):
        formats.pack_directory(pack[:-1])


def test_documents_of_metrics_graphs_and_configs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema": "1", "metrics": {"a_ms": 5, "b": 1.5, "c": "text"}}')
    assert sorted(map(tuple, formats.metrics(spark, str(tmp_path / "m.json")).collect())) == [("a_ms", 5.0), ("b", 1.5)]
    (tmp_path / "g.json").write_text('{"versions": [{"id": "v1", "size_bytes": 5}, {"id": "v2"}],\n "edges": [{"src": 0, "dst": 1, "bytes": 3, "verified": true}], "policies": [{"name": "p", "edges": [0]}]}')
    v, e, p = formats.graph(spark, str(tmp_path / "g.json"))
    assert v.count() == 2 and e.first()["bytes"] == 3 and [tuple(r) for r in p.collect()] == [("p", 0, 1)]
    model = formats.traffic_model(spark, '[traffic]\nname = "x"\n[[traffic.rule]]\nkind = "adjacent"\nprobability = 1.0\n')
    assert graph.traffic(spark, model, 3).count() == 2
    assert formats.patch_policy("[patch_policy]\nexpire_after_days = 7")["expire_after_days"] == 7


def test_snapshots_fall_back(spark, tmp_path):
    import shutil

    root = f"{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        formats.load_snapshot(spark, root)
    formats.save_snapshot(spark.range(1), root)
    newer = formats.save_snapshot(spark.range(2), root)
    assert formats.load_snapshot(spark, root).count() == 2
    shutil.rmtree(f"{root}/{newer}")
    assert formats.load_snapshot(spark, root).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([(1, "a|b")], "n int, t string")
    assert "| 1 | a\\|b |" in formats.report(df, "T") and formats.report(df, "T", "csv").splitlines()[0] == "n,t" and '"n": 1' in formats.report(df, "T", "json")
    assert formats.static_url("s3://x/", "a/b", "c") == "s3://x/a/b/c"
    with pytest.raises(ValueError):
        formats.static_url("x", "../y")


def test_corruption_is_found(spark):
    df = spark.createDataFrame([("ab", bytearray(b"x"))], "hash string, data binary")
    sound = df.withColumn("hash", F.sha2("data", 256))
    assert integrity.corrupt_chunks(df).count() == 1 and integrity.corrupt_chunks(sound).count() == 0
    got = delta.reconstruct(spark.createDataFrame([("p", 0, "ab"), ("p", 1, "gone")], "path string, ord int, hash string"), df).first()
    assert not got["sound"]
