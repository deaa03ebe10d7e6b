"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of hashed n-grams (1 to 3 characters of the lower-cased text) are damped by a logarithm, weighted by inverse document
frequencies that are counted over all training documents, and scaled to length 1. The regression is fitted on a bounded sample
(``TRAIN_ROWS`` rows, those of smallest id hash) by follow-the-regularised-leader with elastic-net penalties, which keeps most weights at exactly zero; a temperature
fitted on a held-back part of the sample calibrates its probabilities.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0. Rows with a null language are not learned from. Texts are read
whole, in blocks. With no training rows every text is ``und``. Repeated rows get equal results; further columns pass through, but
``lang_pred`` and ``score`` are replaced. A letter is a character of the general category L.
Ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, held_out, table, unboxed

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the sample that the regression is fitted on.
TRAIN_ROWS = 6000
_BLOCK = 1 << 17
_LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, a block at a time."""
    out = np.zeros(BUCKETS, np.int64)
    most = max(ORDERS) - 1
    for a in range(0, max(len(text), 1), _BLOCK):
        piece = f" {text[a : a + _BLOCK + most].lower()} " if a == 0 else text[a : a + _BLOCK + most].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        value = np.zeros(len(code), np.uint32)
        for i in range(max(ORDERS)):
            n = min(len(code) - i, _BLOCK + 2)
            if n <= 0:
                break
            value = value[:n] * np.uint32(0x01000193) ^ code[i : i + n]
            if i + 1 in ORDERS:
                h = (value * np.uint32(2654435761)) >> np.uint32(32 - 15)
                out += np.bincount(h, minlength=BUCKETS)
    return out


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero buckets and their weights, of length 1."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, float(np.sqrt((x * x).sum())))


class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties, one weight row for each class."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the held-back labels likeliest, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf.astype(np.float32), weights.astype(np.float32), heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or _LETTER.search(text) is None:
            return "und", 0.0
        at, x = vector(text, self.idf)
        p = softmax(self.weights[:, at].astype(np.float64) @ x / self.heat)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def fit(train: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = 3) -> Model:
    """``train`` has doc_id, text and lang. Document frequencies are counted over all of it."""
    learn = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def count(rows):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in rows:
            for text in batch.column("text"):
                seen += gram_counts(text.as_py()) > 0
                n += 1
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["bucket", "docs"])

    found = learn.select("text").mapInArrow(count, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toArrow()
    docs = dict(zip(found["bucket"].to_pylist(), found["docs"].to_pylist(), strict=True))
    total = docs.pop(-1, 0)
    if not total:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), 1.0)
    seen = np.zeros(BUCKETS)
    seen[list(docs)] = list(docs.values())
    idf = np.log((1 + total) / (1 + seen)) + 1
    ids = learn.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("_h")).orderBy("_h", "_id").limit(train_rows)  # a proven bound

    def vectors(rows):
        for batch in rows:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [vector(t.as_py(), idf) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([i.astype(np.uint16).tobytes() for i, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())], ["id", "lang", "at", "x"])

    sample = learn.withColumn("_h", F.xxhash64("doc_id")).join(F.broadcast(ids), ["_h"], "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(vectors, "id long, lang string, at binary, x binary").toArrow()
    order = sorted(range(len(sample)), key=lambda i: (_spread(sample["id"][i].as_py()), sample["at"][i].as_py()))[: 2 * train_rows]
    languages = sorted(set(sample["lang"].to_pylist()))
    y = np.array([languages.index(sample["lang"][i].as_py()) for i in order])
    rows = [(np.frombuffer(sample["at"][i].as_py(), np.uint16).astype(np.int64), np.frombuffer(sample["x"][i].as_py(), np.float32).astype(np.float64)) for i in order]
    check = np.arange(len(rows)) % 5 == 4
    model = Ftrl(len(languages))
    for _ in range(epochs):
        for i in np.flatnonzero(~check):
            model.learn(*rows[i], y[i])
    w = model.weights(slice(None))
    heat = temperature(np.array([w[:, at] @ x for (at, x), c in zip(rows, check, strict=True) if c]), y[check]) if check.sum() >= 20 else 1.0
    return Model(languages, idf, w, heat)


def _spread(i: int | None) -> int:
    return ((i or 0) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("language string, p double")
    def run(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in rows:
            got = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["language", "p"])

    found = boxed(docs, found=run.asNondeterministic()(docs["text"]))
    return unboxed(found, lang_pred=F.col("found.language"), score=F.col("found.p"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
