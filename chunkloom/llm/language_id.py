"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters (code points) of the
lower-cased text, in which all ASCII characters but letters are blanks; counts are damped, weighted
by inverse document frequency and scaled to length one. Document frequencies
come from all labelled texts. Weights are learned by FTRL-proximal with
elastic-net penalties on a bounded sample (``per_label`` texts of each label,
chosen by a hash of the text), and a fifth of that sample sets the temperature
of the probabilities.

Labels are a small set (languages): their counts come to the driver, as do
the sample's features and one document frequency per hashed feature. Copies of
a text are one text of the sample, and only one leaves the executors.

A probability is among the learned languages alone. What a text has in common
with any of them is told by ``lang_known``, the share of its n-grams that
some labelled text has; a caller that rejects texts goes by it.

Defined results: a null text, or one without a letter, is ``und`` with score
and known share 0; so is every text when no row has a label; ties of probability go to the
first label in order; repeated rows are predicted alike; an empty table gives
an empty result; extra columns go along, and lang_pred, lang_score or
lang_known is replaced. Very long texts are counted in pieces of ``PIECE`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, whole_text_batches

FEATURES = 1 << 15
UNKNOWN = "und"
#: Characters of an n-gram at most, and of a text that are counted together.
GRAM, PIECE = 3, 1 << 20
_SALT, _ODD = np.uint32(0x9E3779B1), np.uint32(2654435761)
#: ASCII characters but letters as blanks.
_FOLDED = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the text, with a blank before and after it, occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", errors="surrogatepass"), "<u4").copy()
    low = points < 128
    points[low] = _FOLDED[points[low]]
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    out = np.zeros(FEATURES, np.int64)
    for k in range(0, len(points), PIECE):
        key = np.zeros(min(PIECE, len(points) - k), np.uint32)
        for n in range(GRAM):
            # n-grams that begin in this piece; those of n + 1 characters extend those of n
            after = points[k + n : k + n + len(key)]
            key = (key[: len(after)] + after + _SALT) * _ODD
            key ^= key >> np.uint32(15)
            out += np.bincount((key * _ODD) >> shift, minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def weighted(index: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[index]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0

    def logits(self, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighted(index, n, self.idf) @ self.weights[index] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its probability, and the share of n-grams that are known."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        c = counts(text)
        index = np.flatnonzero(c)
        z = self.logits(index, c[index]) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.labels[k], float(p[k] / p.sum()), float(c[self.seen].sum() / c.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, rounds: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (features and a last row of intercepts) after ``rounds`` passes over (index, value, label)."""
    z, n = np.zeros((FEATURES + 1, labels)), np.zeros((FEATURES + 1, labels))

    def solved(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(rounds):
        for index, value, label in rows:
            at, x = np.append(index, FEATURES), np.append(value, 1.0)
            w = solved(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return solved(slice(None))


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature that makes held-back labels likeliest, by golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]))

    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Of all rows of ``text``: per feature the texts that have it, and last the number of texts.

    A partition sends a row per feature, so what moves doesn't grow with the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[:-1] += counts(text or "") > 0
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])

    out = np.zeros(FEATURES + 1)
    for feature, n in texts.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n")).toPandas().itertuples(index=False):
        out[feature] = n
    return out


def train(labelled: DataFrame, per_label: int = 600, seed: int = 7) -> Model:
    """A model from the rows of (text, lang) that have both."""
    whole_text_batches(labelled.sparkSession)
    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES + 1, 0)), np.zeros(FEATURES, bool))
    df = document_frequencies(known)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    # texts whose hash falls below the label's share: about per_label of each, wherever they are
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1 << 30, (per_label << 30) // sizes[k]))) for k in labels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                c = counts(text)
                at = np.flatnonzero(c)
                found.append((at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)]], ["lang", "hash", "at", "n"])

    drawn = known.where(draw < share).select("text", "lang", F.xxhash64("text").alias("hash")).mapInArrow(run, "lang string, hash long, at binary, n binary")
    drawn = drawn.groupBy("hash", "lang").agg(F.first("at").alias("at"), F.first("n").alias("n")).toPandas().sort_values(["hash", "lang"])
    rows = []
    for r in drawn.itertuples():
        index = np.frombuffer(r.at, np.uint16).astype(np.int64)
        rows.append((index, np.frombuffer(r.n, np.uint32), labels.index(r.lang)))
    held, used = rows[::5] if len(rows) >= 50 else [], [r for i, r in enumerate(rows) if len(rows) < 50 or i % 5]
    model = Model(labels, idf, ftrl([(i, weighted(i, n, idf), k) for i, n, k in used], len(labels)).astype(np.float32), df[:-1] > 0)
    if held:
        model.temperature = temperature_of(np.array([model.logits(i, n) for i, n, _ in held]), np.array([k for *_, k in held]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_known."""
    whole_text_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, lang_score double, lang_known double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "lang_score", "lang_known"])

    own = ("lang_pred", "lang_score", "lang_known")
    kept = Kept(docs, "lang_", own)
    return kept.df.withColumn("lang_guess", guess("text")).select(*kept.columns, *[F.col(f"lang_guess.{c}").alias(c) for c in own])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the id falls into the fold that is never learned from; a null id does."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
