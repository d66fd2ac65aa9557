"""Made-up builds from seeds: drifting files, a directory pair and version streams.

Blocks of 64 KiB alternate between compressible text and noise. A block's
bytes follow from (seed, version drift, block) alone, so every variant can be
made in parallel and again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64 << 10
#: Share of blocks that each variant of a file changes.
DRIFT = {"small": 0.03, "medium": 0.15, "large": 0.50}


def block_bytes(seed: int, block: int, edition: int = 0, size: int = BLOCK) -> bytes:
    rng = np.random.Generator(np.random.PCG64([seed, block, edition]))
    if block % 2:
        return rng.bytes(size)
    words = np.array([b"level ", b"asset ", b"0.0 1.0 ", b"mesh ", b"name=", b"\n"], object)
    return b"".join(words[rng.integers(0, len(words), size // 4)])[:size].ljust(size, b" ")


def changed(seed: int, block: int, share: float) -> bool:
    return bool(np.random.Generator(np.random.PCG64([seed, block, 99])).random() < share)


def variant(seed: int, blocks: int, name: str, size: int = BLOCK) -> bytes:
    """``v1``, one of DRIFT, ``shifted`` by 4 KiB, or ``reordered`` by swapping pairs of groups of eight blocks."""
    order = list(range(blocks))
    if name == "reordered":
        groups = [order[i : i + 8] for i in range(0, blocks, 8)]
        for i in range(0, len(groups) - 1, 2):
            groups[i], groups[i + 1] = groups[i + 1], groups[i]
        order = [b for g in groups for b in g]
    share = DRIFT.get(name, 0.0)
    body = b"".join(block_bytes(seed, b, int(share > 0 and changed(seed, b, share)), size) for b in order)
    return block_bytes(seed, 1 << 20, 0, 4096) + body if name == "shifted" else body


def _made(spark: SparkSession, rows: list[tuple[str, str, int, int]], size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch.path, "content": [variant(s, n, v, size) for v, s, n in zip(batch.variant, batch.seed, batch.blocks, strict=True)]})

    df = spark.createDataFrame(rows, "path string, variant string, seed long, blocks int")
    return df.repartition(max(1, min(len(rows), 64))).mapInPandas(run, "path string, content binary")


def file_variants(spark: SparkSession, blocks: int, seed: int, size: int = BLOCK) -> DataFrame:
    """(path, content) of one file and its five variants."""
    return _made(spark, [(n, n, seed, blocks) for n in ("v1", *DRIFT, "shifted", "reordered")], size)


def directory_pair(spark: SparkSession, blocks: int, seed: int, assets: int = 40, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two builds: a pack with few edits, assets of which one goes, one moves, one changes and two are new."""
    old = [("game.pck", "v1", seed, blocks)] + [(f"assets/{i:03}.bin", "v1", seed + 1 + i, 1 + i % 3) for i in range(assets)]
    new = [("game.pck", "small", seed, blocks)]
    for i in range(assets + 2):
        if i != 7 % assets:
            new.append(("assets/moved.bin" if i == 13 % assets else f"assets/{i:03}.bin", "large" if i == 21 % assets else "v1", seed + 1 + i, 1 + i % 3))
    return _made(spark, old, size), _made(spark, new, size)


def version_stream(spark: SparkSession, versions: int, blocks: int, seed: int, drift: float = 0.03, size: int = BLOCK) -> DataFrame:
    """(version, content): each version redraws a share of the blocks of the one before."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.version:
                last = [sum(changed(seed + k, b, drift) for k in range(1, v + 1)) for b in range(blocks)]
                out.append(b"".join(block_bytes(seed, b, n, size) for b, n in enumerate(last)))
            yield pd.DataFrame({"version": batch.version, "content": out})

    return spark.range(versions).select(F.col("id").cast("int").alias("version")).repartition(max(1, min(versions, 64))).mapInPandas(run, "version int, content binary")


#: Pairs of packs, each with a way in which edits land in a file.
CASES = ("same", "localized", "scattered", "shifted", "shuffled", "toc_start", "toc_spread", "appended", "new_noise")


def case_pair(case: str, blocks: int, seed: int, size: int = 4096) -> tuple[bytes, bytes]:
    """Old and new bytes of a pack of ``blocks`` assets."""
    assets = [block_bytes(seed, b, 0, size) for b in range(blocks)]
    new, rng = list(assets), np.random.Generator(np.random.PCG64([seed, 7]))
    if case == "localized":
        new[blocks // 2] = block_bytes(seed, blocks // 2, 1, size)
    elif case == "scattered":
        for b in range(0, blocks, 4):
            new[b] = block_bytes(seed, b, 1, size)
    elif case == "shifted":
        new.insert(0, block_bytes(seed, 1 << 21, 0, 100))
    elif case == "shuffled":
        new = [assets[i] for i in rng.permutation(blocks)]
    elif case == "toc_start":
        new[0] = block_bytes(seed, 0, 1, size)
    elif case == "toc_spread":
        new = [bytes([65 + i % 26]) * 8 + a[8:] for i, a in enumerate(assets)]
    elif case == "appended":
        new += [block_bytes(seed, blocks + i, 0, size) for i in range(blocks // 4)]
    elif case == "new_noise":
        new = [block_bytes(seed, 2 * b + 1, 5, size) for b in range(blocks)]
    return b"".join(assets), b"".join(new)


def case_matrix(spark: SparkSession, blocks: int = 64, seed: int = 9, size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the old and the new pack of every case."""

    def made(side: int):
        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"path": batch.path, "content": [case_pair(c, blocks, seed, size)[side] for c in batch.path]})

        return spark.createDataFrame([(c,) for c in CASES], "path string").repartition(len(CASES)).mapInPandas(run, "path string, content binary")

    return made(0), made(1)
