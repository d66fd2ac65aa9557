"""The pipeline against its stages done by hand."""

import corpus_pipeline
from pyspark.sql import functions as F

from chunkloom.llm import decontaminate, language_id, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.identify(spark, docs, SF)
    assert kept.columns == docs.columns
    known = {r["doc_id"] for r in kept.collect()}
    assert known == {i for i, t in rows.items() if language_id.has_letter(t)}
    one = corpus_pipeline.deduplicate(spark, kept, SF)
    left = sorted(r["doc_id"] for r in one.collect())
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.near_copies(kept).collect()}
    first = {}
    for i in sorted(known):
        first.setdefault(group[i], i)
    assert left == sorted(first.values()) and len({rows[i] for i in known}) >= len(left) == len({rows[i] for i in left})
    clean = corpus_pipeline.decontaminated(spark, one, SF)
    held = {r["doc_id"] for r in decontaminate.links(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert held and {r["doc_id"] for r in clean.collect()} == set(left) - held
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in got)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= set(left) - held and out.groupBy("doc_id").count().where("count > 3").isEmpty()


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = ["Это русский текст о погоде и о том, что было вчера", "日本語のテキストです。天気がいいです", "ここに文字がある", "1234 5678", ""]
    made = spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify(spark, docs.unionByName(made), SF).collect()}
    assert not kept & {10_000 + i for i in range(len(strange))} and len(kept) > 0.99 * docs.count()


def test_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
