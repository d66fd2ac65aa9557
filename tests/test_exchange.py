"""Wire batches, manifests, indexes, patches, labels, jobs and build analysis against small cases by hand."""

import threading

import pytest
from pyspark.sql import functions as F

from chunkloom import api
from chunkloom.operators import analysis, compare, delivery, islands, ledger
from chunkloom.sources import container, exchange

HASH = "ab" * 32


def test_batches_reject_damage():
    items = [{"part": "segment", "id": 7, "pos": 0, "hash": HASH, "kind": "inline", "payload": b"x" * 500}, {"part": "segment", "id": 7, "pos": 1, "hash": HASH, "kind": "ref", "payload": None}, {"part": "init", "id": 1, "pos": 0, "hash": "00" * 32, "kind": "inline", "payload": b""}]
    data = delivery.encode_batch(items)
    assert len(data) < 300 and list(delivery.decode_batch(data)) == [("init", 1, 0, "00" * 32, "inline", 0, b""), ("segment", 7, 0, HASH, "inline", 500, b"x" * 500), ("segment", 7, 1, HASH, "ref", None, None)]
    assert list(delivery.decode_batch(delivery.encode_batch([]))) == []
    for bad in (data[:-1], data + b"0", b"NOPE" + data[4:], b"", data.replace(b"\x01" + b"\x00" * 32, b"\x02" + b"\x00" * 32)):
        with pytest.raises(delivery.BadBatch):
            list(delivery.decode_batch(bad))
    with pytest.raises(delivery.BadBatch):
        list(delivery.decode_batch(data, largest=499))


def test_manifests_of_both_forms():
    rows = [{"track": 1, "segment": s, "ord": o, "off": 100 * s + o, "hash": f"{(s + o) % 3}" * 64} for s in range(-1, 3) for o in range(2)]
    data = exchange.encode_manifest([r | {"off": max(0, r["off"])} for r in rows])
    assert exchange.read_manifest(data) == [r | {"off": max(0, r["off"])} for r in rows]
    big = exchange.encode_manifest([{"track": 0, "segment": i, "ord": 0, "off": i, "hash": f"{i:064x}"} for i in range(3000)])
    assert big[4] == 1 and len(exchange.read_manifest(big)) == 3000
    assert exchange.read_manifest(b'[{"track": 1}]') == [{"track": 1}]
    for bad in (b"", data[:-1], data + b"0", b"XXXX" + data[4:], big[:-9]):
        with pytest.raises(exchange.BadManifest):
            exchange.read_manifest(bad)


def test_retry_and_codes(spark):
    df = spark.createDataFrame([(503, 1, 0), (503, 4, 999), (503, 5, 0), (404, 1, 0), (None, 2, 249)], "status int, attempt int, nanos long")
    assert [tuple(r["r"]) for r in df.select(delivery.retry(F.col("status"), F.col("attempt"), F.col("nanos")).alias("r")).collect()] == [("retry", 188), ("retry", 1500 + 999), ("give-up", None), ("fail", None), ("retry", 375 + 249)]
    text = spark.createDataFrame([("a: E-CACHE-CORRUPT-RECOVERABLE: b",), ("E-NETWORK (attempt 3)",), ("no code",), ("E-NOPE then E-NETWORK",), (None,)], "m string")
    assert [r[0] for r in text.select(delivery.error_code(F.col("m"))).collect()] == ["CACHE-CORRUPT-RECOVERABLE", "NETWORK", None, None, None]
    assert len(set(delivery.ERROR_CODES)) == 38


def test_client_state_flags(spark):
    df = spark.createDataFrame([("warm-cache, cold-cache,warm-cache",), (" ,slow-hdd,fast-nvme",), ("what,low-ram",), ("",)], "s string")
    got = [tuple(r["s"]) for r in df.select(delivery.client_state(F.col("s")).alias("s")).collect()]
    assert got == [(True, False, False, False, False, None), (False, False, False, False, False, None), (False, False, True, False, False, "what"), (False, False, False, False, False, None)]


def test_heat_of_windows():
    assert analysis.heat_of(b"", b"", 4) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert analysis.heat_of(b"a" * 10, b"a" * 10, 4) == (3, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert analysis.heat_of(b"aaaaaaaaaa", b"abaaaaaaab", 4) == (3, 2, 2, 1.0, 1.0, 2 / 6, 1.0)
    assert analysis.heat_of(b"aaaa", b"aaaabbbb" + b"b", 4) == (3, 2, 1, 0.0, 2 / 3, 1.0, 2.0)


def test_sharing_of_all_pairs(spark):
    rows = [("windows", "h1", 100), ("windows", "h2", 200), ("windows", "h3", 50), ("linux", "h1", 100), ("linux", "h2", 200), ("linux", "h4", 30), ("mac", "h9", 7)]
    got = {(r["a"], r["b"]): (r["shared"], r["unique_a"], r["unique_b"], r["reuse"]) for r in compare.sharing_matrix(spark.createDataFrame(rows, "depot string, hash string, len long")).collect()}
    assert got == {("linux", "windows"): (300, 30, 50, round(300 / 380, 6)), ("linux", "mac"): (0, 330, 7, 0.0), ("mac", "windows"): (0, 7, 350, 0.0)}


def test_fragmentation_against_files(spark):
    led = spark.createDataFrame([("x", 10, "p", 0), ("y", 30, "p", 10), ("z", 5, "q", 0)], "hash string, len_stored long, pack string, off long")
    packs = spark.createDataFrame([("p", 100), ("orphan", 9)], "pack string, disk_bytes long")
    got = {r["pack"]: (r["disk_bytes"], r["live_bytes"], r["dead_ratio"], r["small"]) for r in ledger.fragmentation(led, packs, small=50).collect()}
    assert got == {"p": (100, 40, 0.6, False), "q": (0, 5, 0.0, True)}


def test_rebuild_reads_on(spark):
    rows = [("f", 0, "a", 10, "previous", "o", 0), ("f", 1, "b", 10, "previous", "o", 10), ("f", 2, "c", 10, "previous", "o", 20), ("f", 3, "d", 10, "previous", "o", 90), ("f", 4, "e", 10, "network", None, None), ("f", 5, "e", 10, "network", None, None)]
    df = spark.createDataFrame(rows, "file string, ord int, hash string, len long, source string, entry string, source_off long")
    got = sorted((r["out_off"], r["source"], r["source_off"], r["len"], r["parts"]) for r in islands.rebuild_ops(df, most=20).collect())
    assert got == [(0, "previous", 0, 20, 2), (20, "previous", 20, 10, 1), (30, "previous", 90, 10, 1), (40, "network", None, 10, 1), (50, "network", None, 10, 1)]


def test_previous_builds_and_signatures(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_bytes(bytes(range(256)) * 40)
    files = f"{tmp_path}/files"
    api.pack_directory(spark, files, f"{tmp_path}/box", least=256, mean=1024, most=4096)
    profile = {"least": 256, "mean": 1024, "most": 4096}
    assert {r[0] for r in api.previous_chunks(spark, files, **profile).collect()} == {r[0] for r in api.previous_chunks(spark, f"{tmp_path}/box").collect()}
    api.old_signature(spark, files, 512).write.parquet(f"{tmp_path}/sig")
    assert api.old_signature(spark, f"{tmp_path}/sig").count() == 20
    with pytest.raises(container.BadContainer):
        container.open_container(spark, files)


def test_jobs_end_and_are_cancelled(spark):
    job = api.Job(spark, lambda phase: (phase("count"), spark.range(100).count())[1])
    assert job.result(60) == 100 and [e for e, _ in job.events] == ["started", "count", "completed"] and job.poll() == "completed"
    go = threading.Event()

    def slow(phase):
        go.wait(60)
        phase("never")

    job = api.Job(spark, slow)
    assert job.poll() == "running"
    job.cancel()
    go.set()
    with pytest.raises(api.EngineError, match="CANCELLED"):
        job.result(60)
    assert job.poll() == "cancelled"
    failed = api.Job(spark, lambda phase: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(60)
