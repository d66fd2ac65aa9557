"""Scalar functions: column expressions where Spark has the pieces, Arrow batches with numpy where bytes must be walked."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of pack files.
PACK_EXTENSIONS = ("pak", "ucas", "utoc", "pck", "bundle", "assets", "ress", "archive", "big", "dat", "blob", "pack", "zip")
#: Leading bytes (hex) of archives, with their names.
ARCHIVE_MAGIC = [("504b0304", "zip"), ("504b0506", "zip"), ("1f8b", "gzip"), ("28b52ffd", "zstd"), ("fd377a585a00", "xz"), ("425a68", "bzip2"), ("377abcaf271c", "7z"), ("52617221", "rar"), ("04224d18", "lz4"), ("89504e47", "png")]
#: Leading bytes (hex) of payload kinds.
PAYLOAD_MAGIC = [("47445043", "pck"), ("504b0304", "zip"), ("504b0506", "zip"), ("4f676753", "audio"), ("89504e47", "image"), ("ffd8ff", "image"), ("556e6974794653", "bundle")]
#: Payload kinds by extension, where no magic decides.
PAYLOAD_EXTENSIONS = {"zip": "zip", "mp4": "video", "m4s": "video", "png": "image", "jpg": "image", "ogg": "audio", "mp3": "audio", "pck": "pck", "pak": "pak", "ucas": "ucas", "bundle": "bundle", "tar": "tar", "json": "text", "xml": "text", "txt": "text", "csv": "text"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_pack(path: Column) -> Column:
    return extension(path).isin(*PACK_EXTENSIONS)


def is_stable(version: Column) -> Column:
    return ~F.lower(version).rlike("beta|alpha|rc|-")


def path_is_safe(path: Column) -> Column:
    """Relative, without empty, ``..``, backslash or drive parts."""
    bad = path.rlike(r"^/|\\|^[A-Za-z]:|^$") | F.array_contains(F.split(path, "/"), "..") | F.array_contains(F.split(path, "/"), "")
    return ~bad


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]+$")


def safe_name(path: Column) -> Column:
    """A file name for a path: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]", "_")


def path_glob(pattern: str) -> str:
    """The regex of a path glob: ``*`` and ``?`` stay within a segment, ``**`` crosses them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"(?s)^{out}$"


def version_glob(pattern: str) -> str:
    """The regex of a version glob: ``*`` and ``?`` match anything."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore rules drop a file: by any segment, by the whole path if the rule has a slash, and with a trailing slash by its directories."""
    tests = [F.lit(False)]
    for rule in patterns:
        p = rule.strip().rstrip("/")
        if not p or p.startswith("#"):
            continue
        body, dirs = path_glob(p)[5:-1], rule.strip().endswith("/")
        if "/" in p:
            tests.append(path.rlike(f"(?s)^{body}" + ("/" if dirs else "$")))
        else:
            tests.append(path.rlike(f"(?s)(?:^|/){body}" + ("/" if dirs else "(?:/|$)")))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def natural_key(label: Column) -> Column:
    """The numbers of a version label, for sorting."""
    return F.transform(F.regexp_extract_all(label, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def rounded(x: Column | str, digits: int) -> Column:
    """A double to decimal places by arithmetic on doubles, halves away from zero, as DuckDB rounds.

    Spark's own goes by the shortest decimal form, whose last place differs where a half is
    near; without places both agree.
    """
    unit = 10.0**digits
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * unit, 0) / unit


def _two_places(n: Column, size: int) -> Column:
    """``n / size`` with two decimals as C prints them: by the exact quotient, halves to even. Java's format rounds them up."""
    n = n.cast("double").cast("long")  # the double that a division would take
    whole, rest = F.floor(n / size), n % size * 100
    cents = F.floor(rest / size)
    twice = 2 * (rest - cents * size)
    cents = cents + ((twice > size) | ((twice == size) & (cents % 2 == 1))).cast("long")
    return F.concat((whole + (cents == 100).cast("long")).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def human_bytes(n: Column) -> Column:
    two = lambda unit, size: F.concat(_two_places(n, size), F.lit(unit))
    return F.when(n >= 1 << 30, two(" GiB", 1 << 30)).when(n >= 1 << 20, two(" MiB", 1 << 20)).when(n >= 1 << 10, two(" KiB", 1 << 10)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def human_seconds(s: Column) -> Column:
    return F.when(s >= 3600, F.format_string("%.1f h", s / 3600)).when(s >= 60, F.format_string("%.1f min", s / 60)).otherwise(F.format_string("%.1f s", s))


def parse_size(text: Column) -> Column:
    """Bytes of ``32MiB``, ``1.5GB``, ``7k`` or ``12``; null where it can't be read."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*$", 2))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1)
    return F.when(number != "", F.floor(F.nullif(number, F.lit("")).cast("double") * factor))


def parse_budget(text: Column, latest: Column) -> Column:
    """A size, or a multiple of the latest build such as ``0.5x-latest-build``."""
    factor = F.nullif(F.regexp_extract(text, r"^([0-9.]+)x-latest-build$", 1), F.lit(""))
    return F.coalesce(F.floor(factor.cast("double") * latest), parse_size(text))


def parse_percent(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9.]+)\s*%$", 1), F.lit("")).cast("double") / 100


def compression_level(label: Column) -> Column:
    """0 for ``none``, N for ``zstd-N``, else null."""
    return F.when(label == "none", 0).otherwise(F.nullif(F.regexp_extract(label, r"^zstd-([0-9]+)$", 1), F.lit("")).cast("int"))


def http_range(header: Column, size: Column) -> Column:
    """(state, first, last) of a range header: ``range``, ``unsatisfiable``, or ``ignored`` where it isn't one range."""
    first = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).cast("long")
    last = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).cast("long")
    valid = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    lo = F.when(first.isNull(), F.greatest(size - last, F.lit(0))).otherwise(first)
    hi = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    bad = (lo >= size) | (lo > hi) | (first.isNull() & (last == 0))
    state = F.when(header.isNull() | ~valid, "ignored").when(bad, "unsatisfiable").otherwise("range")
    return F.struct(state.alias("state"), F.when(state == "range", lo).alias("first"), F.when(state == "range", hi).alias("last"))


def _by_magic(content: Column, table: list[tuple[str, str]]) -> Column:
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    return F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(n)) for m, n in table])


def archive_kind(content: Column) -> Column:
    """Name of the archive format that the first bytes of binary content tell, or null."""
    return _by_magic(content, ARCHIVE_MAGIC)


def payload_kind(path: Column, content: Column) -> Column:
    """Magic first, then a tar header at 257, then the extension."""
    box = F.when(F.hex(F.substring(content, 5, 4)) == "66747970", "video")
    tar = F.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")
    by_name = F.coalesce(*[F.when(extension(path) == e, F.lit(k)) for e, k in PAYLOAD_EXTENSIONS.items()])
    return F.coalesce(_by_magic(content, PAYLOAD_MAGIC), box, tar, by_name, F.lit("other"))


def blob_shape(archive: Column, size: Column, ratio: Column) -> Column:
    return F.when(archive.isNotNull(), "archive").when((size >= 64 << 10) & (ratio > 0.97), "high-entropy").otherwise("plain")


# bytes, in Arrow batches


def weak32_of(data: bytes) -> int:
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    return int(x.sum() % 65536 + (((len(x) - np.arange(len(x))) * x).sum() % 65536 << 16))


def _weak32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else weak32_of(bytes(b))).astype("Int64")


def weak32(content: Column) -> Column:
    """The rolling checksum of binary content: sums of bytes, and of bytes by distance from the end, each mod 65536."""
    return F.pandas_udf(_weak32, "long")(content)


def rolling_weak32(data: bytes, size: int) -> np.ndarray:
    """The checksum of every window of ``size`` bytes, from prefix sums."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(x)])
    placed = np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
    a = total[size:] - total[:n]
    b = (np.arange(n) + size) * a - (placed[size:] - placed[:n])
    return a % 65536 + (b % 65536 << 16)


def entropy_of(data: bytes) -> float:
    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def entropy(content: Column) -> Column:
    """Bits per byte of binary content."""
    return F.pandas_udf(lambda s: s.map(lambda b: 0.0 if b is None else entropy_of(bytes(b))), "double")(content)


def sampled_entropy_of(data: bytes, samples: int = 16, window: int = 64 << 10) -> float:
    """The mean over evenly spread windows; of all bytes where those windows would cover them."""
    if len(data) <= samples * window:
        return entropy_of(data)
    step = (len(data) - window) // (samples - 1)
    return float(np.mean([entropy_of(data[i * step : i * step + window]) for i in range(samples)]))


def group_bytes(data: bytes, planes: int = 4) -> bytes:
    """Bytes by their index mod ``planes``, plane after plane."""
    return b"".join(data[k::planes] for k in range(planes))


def ungroup_bytes(data: bytes, planes: int = 4) -> bytes:
    out, at = np.empty(len(data), np.uint8), 0
    for k in range(planes):
        n = len(range(k, len(data), planes))
        out[k::planes] = np.frombuffer(data[at : at + n], np.uint8)
        at += n
    return out.tobytes()


@cache
def _packer(level: int):
    """A compressor of this process; making one for each chunk costs more than a small chunk."""
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@cache
def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor()


def store_form(data: bytes, level: int = 3) -> tuple[str, bytes]:
    """How a chunk is stored: raw below 512 bytes or where compression saves under a sixteenth; byte planes where they beat plain compression that disappoints."""
    n = len(data)
    if n < 512:
        return "raw", data
    pack = _packer(level).compress
    plain, form = pack(data), "zstd"
    if len(plain) > 3 * (n // 4) or len(plain) >= n - n // 16:
        grouped = pack(group_bytes(data))
        if len(grouped) < len(plain):
            plain, form = grouped, "planes+zstd"
    return (form, plain) if len(plain) < n - n // 16 else ("raw", data)


def load_form(form: str, stored: bytes) -> bytes:
    if form == "raw":
        return stored
    data = _unpacker().decompress(stored)
    return ungroup_bytes(data) if form == "planes+zstd" else data


def stored(content: Column, level: int = 3) -> Column:
    """(form, bytes) of each chunk."""
    run = F.pandas_udf(lambda s: pd.DataFrame([store_form(bytes(b or b""), level) for b in s], columns=["form", "bytes"]), "form string, bytes binary")
    return run(content)


def loaded(form: Column, data: Column) -> Column:
    """The bytes of a stored chunk, or null where they can't be decoded."""

    def load(forms: pd.Series, stored: pd.Series) -> pd.Series:
        import zstandard

        out = []
        for f, b in zip(forms, stored, strict=True):
            try:
                out.append(load_form(f, bytes(b)))
            except (zstandard.ZstdError, ValueError, IndexError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(load, "binary")(form, data)


def compressed_length(content: Column, level: int = 3) -> Column:
    """Bytes after compression at a level, or of the content itself at level 0."""

    def lengths(s: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=max(level, 1)).compress
        return s.map(lambda b: len(b) if not level else len(pack(bytes(b)))).astype("int64")

    return F.pandas_udf(lengths, "long")(content)


def varint(n: int) -> bytes:
    """LEB128 of an unsigned 64-bit number."""
    if not 0 <= n < 1 << 64:
        raise ValueError("out of range")
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, next position); longer forms than needed and overflow are errors."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            if (b == 0 and shift) or n >= 1 << 64:
                raise ValueError("bad varint")
            return n, at
        shift += 7


class Bloom:
    """A filter of 10 bits a key and seven probes, by double hashing of the first 16 bytes of a digest."""

    K = 7

    def __init__(self, n: int, bits: np.ndarray | None = None):
        self.m = max(64, -(-10 * n // 8) * 8)
        self.bits = np.zeros(self.m // 8, np.uint8) if bits is None else bits

    def probes(self, digest: bytes) -> list[int]:
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:16], "little") | 1
        return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % self.m for i in range(self.K)]

    def add(self, digest: bytes) -> None:
        for p in self.probes(digest):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.probes(digest))

    def _probes_of(self, digests: list[bytes]) -> np.ndarray:
        """The probes of many digests, a row each."""
        x = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
        return (x[:, :1] + np.arange(self.K, dtype=np.uint64) * (x[:, 1:] | np.uint64(1))) % np.uint64(self.m)

    def add_all(self, digests: list[bytes]) -> None:
        on = np.unpackbits(self.bits, bitorder="little")
        on[self._probes_of(digests).ravel()] = 1
        self.bits = np.packbits(on, bitorder="little")

    def contains_all(self, digests: list[bytes]) -> np.ndarray:
        p = self._probes_of(digests)
        return (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def xorshift_bytes(n: int, seed: int) -> bytes:
    """Deterministic noise (xorshift64*)."""
    x, out = seed or 1, bytearray()
    while len(out) < n:
        x ^= x >> 12
        x = (x ^ (x << 25)) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 27
        out += ((x * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return bytes(out[:n])


def lcg_bytes(n: int, seed: int) -> bytes:
    out, s = bytearray(), seed
    for _ in range(n):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(s >> 24)
    return bytes(out)
