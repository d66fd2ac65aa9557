"""Operations on folders, the SQL surface, containers, made-up builds and streams that stop and go on."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from chunkloom import api
from chunkloom.functions import register
from chunkloom.sources import container, formats, synth
from chunkloom.streaming import sessions


@pytest.fixture
def pair(tmp_path):
    rng = random.Random(2)
    old = {"a.bin": rng.randbytes(30_000), "d/b.txt": b"text " * 3000, "d/gone.bin": rng.randbytes(900), "same.pak": rng.randbytes(5000)}
    new = {"a.bin": old["a.bin"][:9000] + b"edit" + old["a.bin"][9000:], "d/b.txt": old["d/b.txt"], "same.pak": old["same.pak"], "d/new.bin": rng.randbytes(700), "empty": b""}
    for name, files in (("old", old), ("new", new)):
        for path, data in files.items():
            p = tmp_path / name / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(data)
    return str(tmp_path / "old"), str(tmp_path / "new"), new


def test_analyze_and_preview(spark, pair):
    old, new, _ = pair
    out = api.analyze(spark, old, new, fixed=1024, fine=1024, coarse=4096, cdc=(256, 1024, 4096, 1))
    files = {r["path"]: r for r in out["files"].collect()}
    assert {p: r["status"] for p, r in files.items()} == {"a.bin": "modified", "d/b.txt": "modified", "same.pak": "unchanged", "d/new.bin": "added"}
    total = out["rollup"].first()
    assert (total["deleted"], total["added"]) == (1, 1) and total["cdc_reuse"] > total["fixed_reuse"]
    assert files["a.bin"]["fine"]["changed"] == files["a.bin"]["fine"]["windows"] - 9000 // 1024 and out["engine"].isEmpty()
    assert files["a.bin"]["cdc_reuse"] > 0.7 > 0.4 > files["a.bin"]["fixed_reuse"] and files["same.pak"]["is_pack"]
    routes = {r["route"]: r for r in api.preview_update(spark, old, new, 1024, (256, 1024, 4096, 1), 256).collect()}
    assert routes["full"]["bytes"] > routes["fixed"]["bytes"] > max(routes["chunks"]["bytes"], routes["plan"]["bytes"]) > 0
    assert [r for r in routes.values() if r["recommended"]] == [min(routes.values(), key=lambda r: r["bytes"])]
    assert api.analyze(spark, old, new, ignore=["d/"], fixed=1024)["files"].count() == 2
    assert api.analyze(spark, old, new, engine="unity")["engine"].first()["engine"] == "unity"


def test_plan_is_applied_or_refused(spark, pair, tmp_path):
    old, new, files = pair
    summary = {r["path"]: r for r in api.create_plan(spark, old, new, f"{tmp_path}/plan", 256).collect()}
    assert summary["same.pak"]["inline"] < 256 and summary["a.bin"]["reused"] > 25_000
    done = api.apply_plan(spark, old, f"{tmp_path}/plan", f"{tmp_path}/out").first()
    assert done["bytes"] == sum(map(len, files.values()))
    states = api.verify_install(spark, f"{tmp_path}/out", spark.read.parquet(f"{tmp_path}/plan/expected")).collect()
    assert {r["state"] for r in states} == {"ok"} and len(states) == len(files) - 1 or len(states) == len(files)
    (tmp_path / "out" / "a.bin").write_bytes(b"bad")
    assert api.verify_install(spark, f"{tmp_path}/out", spark.read.parquet(f"{tmp_path}/plan/expected")).where("state = 'modified'").count() == 1
    with pytest.raises(api.EngineError, match="PLAN_MISMATCH"):
        api.apply_plan(spark, new, f"{tmp_path}/plan", f"{tmp_path}/no")
    assert not (tmp_path / "no").exists()


def test_container_round_trip_and_damage(spark, pair, tmp_path):
    _, new, files = pair
    box = api.pack_directory(spark, new, f"{tmp_path}/box", least=256, mean=1024, most=4096)
    assert {r["check"]: r["problems"] for r in container.verify(box).collect()} == dict.fromkeys(("chunks", "segments", "tiling", "totals", "merkle"), 0)
    assert container.summary(box).first()["stored"] < sum(map(len, files.values()))
    api.fetch_static(spark, f"{tmp_path}/box", f"{tmp_path}/got", F.col("path") != "same.pak")
    assert (tmp_path / "got" / "a.bin").read_bytes() == files["a.bin"] and not (tmp_path / "got" / "same.pak").exists()
    damaged = box | {"chunks": box["chunks"].where("pack < 0").unionByName(box["chunks"].orderBy("hash").limit(3))}
    found = {r["check"]: r["problems"] for r in container.verify(damaged).collect()}
    assert found["segments"] > 0 and found["totals"] == 1 and found["merkle"] == 1
    assert container.unpack(damaged).where("not sound").count() > 0
    shutil.rmtree(tmp_path / "box" / "integrity")
    with pytest.raises(container.BadContainer):
        container.open_container(spark, f"{tmp_path}/box")


def test_unsafe_paths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("../x", bytearray(b"1"))], "path string, content binary")
    with pytest.raises(api.EngineError, match="UNSAFE_PATH"):
        api.write_files(df, f"{tmp_path}/out")


def test_savings():
    assert api.estimate_savings(2 << 30, 1 << 30, 100, 0.5) == {"full_cost": 100.0, "update_cost": 50.0, "saved": 50.0, "saved_pct": 50.0}
    assert api.estimate_savings(0, 0, 1, 1.0)["saved_pct"] == 0.0


def test_sql_surface(spark):
    register.register(spark)
    register.views(spark, "/root/testdata/sf0.001")
    n, total = spark.sql("select count(*), sum(c.len) from old_build b, lateral cdc_chunks(cast(b.content as binary), 64, 256, 1024, 1) c").first()
    assert total == spark.sql("select sum(octet_length(content)) from old_build").first()[0] and n > 100
    assert spark.sql("select weak32(cast('abc' as binary)), byte_entropy(cast('ab' as binary)), merkle_root(array(sha2('', 256)))").first()[:2] == (0x024A0126, 1.0)
    assert [tuple(r) for r in spark.sql("select * from expand_run(10, array(3, 4))").collect()] == [(0, 10, 3), (1, 13, 4)]
    assert spark.sql("select count(*) from new_chunks left anti join old_chunks using (path, hash)").first()[0] > 0


def test_made_up_builds_repeat(spark):
    a = {r["path"]: bytes(r["content"]) for r in synth.file_variants(spark, 16, 3, 512).collect()}
    b = {r["path"]: bytes(r["content"]) for r in synth.file_variants(spark, 16, 3, 512).collect()}
    assert a == b and a["shifted"][4096:] == a["v1"] and sorted(a["reordered"]) == sorted(a["v1"]) and a["reordered"] != a["v1"]
    v = {r["version"]: bytes(r["content"]) for r in synth.version_stream(spark, 4, 10, 1, 0.2, 256).collect()}
    assert len(v) == 4 and v[0] != v[3]


def test_streams_keep_state_over_restarts(spark, tmp_path):
    schema = "session long, seq long, hash string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = sessions.plan_sessions(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    put([(1, 1, "x"), (1, 2, "x"), (2, 1, "x")], 1)
    run()
    put([(1, 3, "x"), (1, 4, "y"), (2, 2, "z")], 2)
    run()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [(1, 1, "x", "inline"), (1, 2, "x", "ref"), (1, 3, "x", "ref"), (1, 4, "y", "inline"), (2, 1, "x", "inline"), (2, 2, "z", "inline")]


def test_ledger_applies_a_batch_once(spark, tmp_path):
    schema = "asset long, hash string, op string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        sessions.keep_ledger(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/led", f"{tmp_path}/ck").awaitTermination()
        return sorted((r["asset"], r["hash"]) for r in formats.load_snapshot(spark, f"{tmp_path}/led").where("hash is not null").collect())

    put([(1, "x", "publish"), (1, "y", "publish"), (2, "x", "publish")], 1)
    assert run() == [(1, "x"), (1, "y"), (2, "x")]
    put([(1, "z", "publish"), (2, None, "remove")], 2)
    assert run() == [(1, "z")]
    assert run() == [(1, "z")]


def test_certify_and_resume(spark, pair, tmp_path):
    _, new, files = pair
    api.pack_directory(spark, new, f"{tmp_path}/box", least=256, mean=1024, most=4096)
    m = lambda v: spark.createDataFrame([("size", v)], "name string, value double")
    got = {r["phase"]: r["result"] for r in api.certify(spark, f"{tmp_path}/box", m(120.0), m(100.0)).collect()}
    assert got == {"integrity": "pass", "unpack": "pass", "regressions": "fail"}
    api.fetch_static(spark, f"{tmp_path}/box", f"{tmp_path}/out")
    kept = (tmp_path / "out" / "same.pak").stat().st_mtime_ns
    (tmp_path / "out" / "a.bin").write_bytes(b"torn")
    api.fetch_static(spark, f"{tmp_path}/box", f"{tmp_path}/out")
    assert (tmp_path / "out" / "same.pak").stat().st_mtime_ns == kept and (tmp_path / "out" / "a.bin").read_bytes() == files["a.bin"]


def test_pages_and_bundles(spark):
    df = spark.createDataFrame([("b", "bees", 2), ("a", "ants", 1)], "name string, help string, value long")
    assert formats.prometheus(df).splitlines()[2] == "chunkloom_a 1"
    assert formats.bundle({"x": b"1", "y": b"2"}) == formats.bundle({"y": b"2", "x": b"1"}) != formats.bundle({"x": b"1"})


@pytest.mark.parametrize("case", synth.CASES)
def test_cases_are_edits(case):
    old, new = synth.case_pair(case, 16, 9, 512)
    assert (old == new) == (case == "same") and len(old) == 16 * 512
