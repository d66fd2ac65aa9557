"""The SQL surface: views of builds and chunks, scalar functions and table functions for ``spark.sql``."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import builds, formats
from . import scalars


class CdcChunks:
    """cdc_chunks(content, min, avg, max, norm): a row per content-defined chunk."""

    def eval(self, content: bytes, least: int, mean: int, most: int, norm: int):
        at = 0
        for k, end in enumerate(chunking.cut_points(content or b"", least, mean, most, norm)):
            yield k, at, end - at, hashlib.sha256(content[at:end]).hexdigest()
            at = end


class BlockSignature:
    """block_signature(content, size): a row per block with weak and strong hash."""

    def eval(self, content: bytes, size: int):
        for k, at in enumerate(range(0, len(content or b""), size)):
            block = content[at : at + size]
            yield k, at, len(block), scalars.weak32_of(block), hashlib.sha256(block).hexdigest()


class PackDirectory:
    """pack_directory(content): a row per entry of a pack; none for other content."""

    def eval(self, content: bytes):
        if (content or b"")[:4] == b"GDPC":
            yield from formats.pack_directory(content)


class ExpandRun:
    """expand_run(offset, lens): the offset of each chunk of a contiguous run."""

    def eval(self, offset: int, lens: list[int]):
        for k, n in enumerate(lens or []):
            yield k, offset, n
            offset += n


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, cls, kind in (
        ("cdc_chunks", CdcChunks, "ord int, off long, len long, hash string"), ("block_signature", BlockSignature, "block int, off long, len long, weak long, strong string"),
        ("pack_directory", PackDirectory, "entry string, off long, size long"), ("expand_run", ExpandRun, "ord int, off long, len long"),
    ):
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    one = lambda f: lambda s: s.map(lambda b: None if b is None else f(bytes(b)))
    spark.udf.register("weak32", F.pandas_udf(lambda s: one(scalars.weak32_of)(s).astype("Int64"), "long"))
    spark.udf.register("byte_entropy", F.pandas_udf(one(scalars.entropy_of), "double"))
    spark.udf.register("group_bytes", F.pandas_udf(one(scalars.group_bytes), "binary"))
    spark.udf.register("ungroup_bytes", F.pandas_udf(one(scalars.ungroup_bytes), "binary"))
    spark.udf.register("store_form", F.pandas_udf(lambda s: pd.DataFrame([scalars.store_form(bytes(b or b"")) for b in s], columns=["form", "bytes"]), "form string, bytes binary"))
    spark.udf.register("zstd_length", F.pandas_udf(one(lambda b: len(scalars.store_form(b)[1])), "long"))
    spark.udf.register("merkle_root", F.pandas_udf(lambda s: s.map(lambda hs: chunking.merkle_of([bytes.fromhex(h) for h in hs]).hex()), "string"))


def views(spark: SparkSession, sf_dir: str) -> None:
    """old_build, new_build, old_chunks and new_chunks over the test tables."""
    builds.old_build(spark, sf_dir).createOrReplaceTempView("old_build")
    builds.new_build(spark, sf_dir).createOrReplaceTempView("new_build")
    builds.old_chunks(spark, sf_dir).createOrReplaceTempView("old_chunks")
    builds.new_chunks(spark, sf_dir).createOrReplaceTempView("new_chunks")
