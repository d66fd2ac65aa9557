"""Secret scans with multipart credential linking.

Base matches are found anywhere. Beside them, weak parts are gathered: access
identifiers, secret-looking tokens and endpoints. Parts lie in scopes: a scope
ends at a blank line or where the next part is further than ``REACH``
characters away. An interval join puts every part into its scope, and a weak
part is reported only if the scope holds what completes it: an identifier
needs a secret, a secret an identifier or endpoint, an endpoint both or one of
the strong base kinds.

Matching runs in Python over Arrow batches, text by text, in linear memory.

Defined results: a null text is empty; repeated rows are scanned alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import whole_text_batches

#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 200

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:ASIA[A-Z0-9]{12,}|(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{4,})""", re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,12}://[^\s"'<>]+|(?i:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.A)
BLANK = re.compile(r"\n[\x20\t]*\n")


def looks_random(token: str) -> bool:
    """Two kinds of characters at least, one a digit, and over 3.2 bits a character."""
    kinds = sum(bool(re.search(k, token)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds > 1 and bool(re.search("[0-9]", token)) and -sum(n / len(token) * log2(n / len(token)) for n in Counter(token).values()) > 3.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    small = text.lower()
    if any(k in small for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted(found)


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts that their scope completes."""
    small = text.lower()  # each of these words is in every match
    weak = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if any(k in small for k in ("asia", "client", "key", "account", "user", "login")) else []
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if any(k in small for k in ("://", "endpoint", "host", "server")) else []
    if not weak and not base:
        return []
    if weak or any(k == 1 for _, k, _ in base):
        weak += [(m.start(), 4, m.end()) for m in SECRET.finditer(text) if looks_random(m.group())]
    # a weak part that touches a base match is that match; of weak parts that touch, the first stays
    taken, kept, far = sorted(base), [], -1
    starts, ends = [s for s, _, _ in taken], np.maximum.accumulate([e for *_, e in taken]).tolist() if taken else []
    for s, k, e in sorted(weak):
        at = int(np.searchsorted(starts, e, "left")) if starts else 0
        if s >= far and not (at and ends[at - 1] > s):
            kept.append((s, k, e))
            far = e
    if not kept:
        return []
    blanks = np.array([m.start() for m in BLANK.finditer(text)], np.int64)
    scope, last, cell, holds, where = -1, -1, -1, [], []
    for s, k, e in sorted(taken + kept):
        block = int(np.searchsorted(blanks, s))
        if scope < 0 or block != cell or s - last > reach:
            scope, cell = scope + 1, block
            holds.append(set())
        last = max(last, e)
        holds[scope].add({0: "secret", 1: "identifier", 2: "secret", 3: "identifier", 4: "secret", 5: "endpoint"}[k])
        if k > 2:
            where.append((s, k, e, scope))
    needs = {3: lambda h: "secret" in h, 4: lambda h: "identifier" in h or "endpoint" in h, 5: lambda h: "secret" in h}
    return [(s, k, e) for s, k, e, c in where if needs[k](holds[c])]


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text) -> doc_id and spans, an array of (kind, start, end, base) by start and kind."""
    whole_text_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                both = sorted(base + linked_spans(text or "", base, reach))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
