"""Toxicity: a convolutional text classifier trained in numpy.

Every word is the sum of hashed embeddings: its own bucket and those of its first 4, 5 and 6 bytes. Filters of
several widths run over the words of the whole text, the largest value of each filter goes to a logistic output. Labelled rows are split by a
hash of their id. Of four fifths, the net is fitted on a bounded sample (``MOST_TOXIC`` and ``MOST_CLEAN`` rows and ``MOST_BYTES`` of text of
each kind, those of smallest id hash). All rows of the last fifth, however many, are scored where they lie, and their counts by bin of the
score set the scale of the scores and a threshold for each language. Labels, language, source and id are no inputs of a score; a language only selects the
threshold of the decision ``toxic``.

Nulls and empties: a null text is an empty one; empty texts get the score of no words. Texts are read whole, in blocks of
bounded size. Null labels are not learned from; a null or unseen language has the threshold ``CUT``. With no labels of one of the two kinds
every score is the share of toxic labels (0 if there are none); with none of one kind in the last fifth the scale stays 1 and thresholds are ``CUT``. Repeated
rows get equal scores, and a row whose id has several labels counts once for each. Further columns pass through; those named ``score``, ``threshold`` or ``toxic`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, boxed, few_broadcast, give_back, held_out, mix, table, unboxed

#: Bounds of the labelled sample: rows of each kind, and bytes of their texts (a row is taken while those before it are within).
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 3000, 5000, 24 << 20
#: Of so many parts of the labelled rows, the last is kept for scale and thresholds.
PARTS = 5
#: Width of the bins in which logits are counted.
BIN = 0.02
CUT = 0.3
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
PAD = max(WIDTHS) - 1


def word_buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, ``(words, 1 + prefixes)``, and where each text's words begin. Bucket 0 is empty."""
    words = Words([t or b"" for t in texts], lower=True)
    n = words.end - words.start
    out = np.zeros((len(n), 1 + len(PREFIXES)), np.uint32)
    out[:, 0] = words.hashes() % np.uint64(BUCKETS - 1) + np.uint64(1)
    raw = np.concatenate([words.raw, np.zeros(max(PREFIXES), np.uint8)])
    value = np.zeros(len(n), np.uint64)
    for i in range(max(PREFIXES)):
        value = value * np.uint64(257) + raw[words.start + i] * (n > i) + np.uint64(1)
        if i + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(i + 1)] = np.where(n > i, mix(value) % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
    return out, words.first


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = (r.normal(0, 0.1, (BUCKETS, DIM))).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.scale, self.offset = 1.0, 0.0

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        x = self.emb[buckets[:, 0]]
        for i in range(1, buckets.shape[1]):
            x += self.emb[buckets[:, i]]
        return x

    def maps(self, x: np.ndarray, w: int) -> np.ndarray:
        """Filter values of width number w at each row that has all its rows."""
        n = len(x) - WIDTHS[w] + 1
        z = x[:n] @ self.conv[w][0]
        for j in range(1, WIDTHS[w]):
            z += x[j : j + n] @ self.conv[w][j]
        return z + self.bias[w]

    def steady_maps(self, x: np.ndarray, w: int, block: int = 4096) -> np.ndarray:
        """``maps`` with all sums in one order, so that a row's values do not depend on its place, as they do in a matrix product."""
        n = len(x) - WIDTHS[w] + 1
        out = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, block):
            z = np.broadcast_to(self.bias[w], (min(block, n - a), FILTERS)).copy()
            for j in range(WIDTHS[w]):
                part = x[a + j : a + j + len(z)]
                for d in range(DIM):
                    z += part[:, d : d + 1] * self.conv[w][j][d]
            out[a : a + block] = z
        return out

    def pooled(self, buckets: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The largest value of each filter over a text of any length, in blocks."""
        padded = np.concatenate([buckets if len(buckets) else np.zeros((1, buckets.shape[1]), np.uint32), np.zeros((PAD, buckets.shape[1]), np.uint32)])
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for a in range(0, len(padded) - PAD, block):
            x = self.rows(padded[a : a + block + PAD])
            best = np.maximum(best, np.concatenate([self.steady_maps(x, w)[: len(x) - PAD].max(0) for w in range(len(WIDTHS))]))
        return best

    def pooled_all(self, buckets: np.ndarray, first: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """``pooled`` of many texts; short ones together."""
        out = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        n = np.diff(first)
        for i in np.flatnonzero(n > block):
            out[i] = self.pooled(buckets[first[i] : first[i + 1]])
        short = np.flatnonzero(n <= block)
        total = np.cumsum(np.maximum(n[short], 1) + PAD)
        for group in np.split(short, np.flatnonzero(np.diff(total // block)) + 1):
            if len(group):
                size = np.maximum(n[group], 1) + PAD
                start = np.cumsum(size) - size
                flat = np.zeros((int(size.sum()), buckets.shape[1]), np.uint32)
                take = np.repeat(first[group] - (np.cumsum(n[group]) - n[group]), n[group]) + np.arange(int(n[group].sum()))
                put = np.repeat(start - (np.cumsum(n[group]) - n[group]), n[group]) + np.arange(int(n[group].sum()))
                flat[put] = buckets[take]
                x = self.rows(np.concatenate([flat, np.zeros((PAD, flat.shape[1]), np.uint32)]))
                edges = np.stack([start, start + size - PAD], 1).ravel()
                out[group] = np.concatenate([np.maximum.reduceat(self.steady_maps(x, w)[: len(flat)], edges)[0::2] for w in range(len(WIDTHS))], 1)
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled, 0) * self.out).sum(1) + self.shift

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        return self.logit(self.pooled_all(*word_buckets(texts))).astype(np.float64)

    def score(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logit(self.pooled_all(buckets, first)) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(z, np.float64), -60, 60)))


def start_from_odds(net: Net, docs: list[np.ndarray], y: np.ndarray) -> None:
    """The first embedding dimension begins as the log-odds of a bucket's texts, drawn to 0 where it is rare, and one filter of width 1 reads it."""
    seen = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d)] += 1
    rate = (seen + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    odds = np.log(rate[1] / rate[0]) * seen.sum(0) / (seen.sum(0) + 10)
    net.emb[:, 0] = np.clip(odds, -1, 6) / 3
    net.emb[0] = 0
    net.conv[0][:, :, 0] = 0
    net.conv[0][0, 0, 0] = 1
    net.out[0] = 1


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = 4, rate: float = 0.02, size: int = 64, seed: int = 7) -> Net:
    """Cross-entropy by mini-batches: Adam for filters and output, Adagrad for the embedding rows that a maximum has picked."""
    net, r = Net(seed), np.random.default_rng(seed)
    start_from_odds(net, docs, y)
    net.shift = np.float32(-2)
    dense = [*net.conv, *net.bias, net.out]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    seen = np.full(BUCKETS, 1e-2, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(docs))
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            tops, places, rows = [], [], []
            for i in batch:
                b = np.concatenate([docs[i] if len(docs[i]) else np.zeros((1, 1 + len(PREFIXES)), np.uint32), np.zeros((PAD, 1 + len(PREFIXES)), np.uint32)])
                x = net.rows(b)
                z = [net.maps(x, w)[: len(x) - PAD] for w in range(len(WIDTHS))]
                at = [q.argmax(0) for q in z]
                tops.append(np.concatenate([q[a, np.arange(FILTERS)] for q, a in zip(z, at, strict=True)]))
                places.append(at)
                rows.append((b, x))
            top = np.array(tops)
            g = ((sigmoid(net.logit(top)) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads = [np.zeros_like(p) for p in dense]
            grads[-1] = np.maximum(top, 0).T @ g + 1e-4 * net.out
            back = g[:, None] * net.out[None, :] * (top > 0)
            where, what = [], []
            for (b, x), at, d in zip(rows, places, back, strict=True):
                for w, a in enumerate(at):
                    gd = d[w * FILTERS : (w + 1) * FILTERS]
                    grads[len(WIDTHS) + w] += gd
                    for j in range(WIDTHS[w]):
                        grads[w][j] += x[a + j].T * gd
                        where.append(b[a + j])
                        what.append(net.conv[w][j].T * gd[:, None])
            step += 1
            for p, q, a, c in zip(dense, grads, m, v, strict=True):
                a += 0.1 * (q - a)
                c += 0.001 * (q * q - c)
                p -= rate / 4 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
            net.shift -= np.float32(rate * g.sum())
            where, what = np.concatenate(where), np.concatenate(what)
            flat, change = where.ravel(), np.repeat(what, where.shape[1], 0)
            ids, inverse = np.unique(flat, return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, change)
            seen[ids] += (total**2).mean(1)
            net.emb[ids] -= rate * total / np.sqrt(seen[ids])[:, None]
            net.emb[0] = 0
    return net


def fit_scale(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and offset of the logits by weighted logistic regression (Newton steps), drawn to scale 1."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        g = np.array([(weight * (p - y) * z).sum() + 1.0 * (a - 1), (weight * (p - y)).sum() + 1e-3 * b])
        h = weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        d *= min(1, 2 / max(1e-9, np.abs(d).max()))
        a, b = max(0.05, a - d[0]), b - d[1]
    return float(a), float(b)


def best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of highest weighted F1, halfway to the next lower score; CUT where one kind is missing."""
    if not (y == 1).any() or not (y == 0).any():
        return CUT
    order = np.argsort(-score, kind="stable")
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    i = int(f1.argmax())
    return float((score[order][i] + (score[order][i + 1] if i + 1 < len(score) else 0)) / 2)


class Model:
    """A trained net, or a constant where there was nothing to learn from."""

    def __init__(self, net: Net | None, share: float, cuts: dict[str, float]):
        self.net, self.share, self.cuts = net, share, cuts

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return np.full(len(texts), self.share) if self.net is None else self.net.score(*word_buckets(texts))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Model:
    """``docs`` has doc_id, text and lang, of which only rows with a label in ``labels`` (doc_id, toxic) are learned from."""
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("part")), F.lit(PARTS))
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"), (part == PARTS - 1).alias("_last")).where("_y in (0, 1)")
    sizes = {(r["_y"], r["_last"]): r["n"] for r in known.groupBy("_y", "_last").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sum(n for (y, _), n in sizes.items() if y) / max(1, sum(sizes.values()))
    pick = lambda y, n: known.where(F.col("_y") == y).where("not _last").orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = pick(1, most_toxic).union(pick(0, most_clean))  # a proven bound, so it may be broadcast
    texts = docs.select("doc_id", "text", "lang")
    lengths = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_id", "_y", F.xxhash64("_id").alias("_h"), "n")
    total, taken = {0: 0, 1: 0}, []
    for r in lengths.groupBy("_h", "_id", "_y").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy("_h", "_id", "_y").collect():
        if total.get(r["_y"], 0) < most_bytes:
            taken.append((r["_id"], r["_y"]))
        total[r["_y"]] = total.get(r["_y"], 0) + r["n"]

    def run(rows):
        for held in batches(rows, most=2 << 20):
            buckets, first = word_buckets(held["text"])
            yield pa.RecordBatch.from_arrays([pa.array(held["_id"], pa.int64()), pa.array(held["_y"], pa.int32()), pa.array([buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "y", "b"])

    chosen = docs.sparkSession.createDataFrame(taken, "_id long, _y int")
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text").mapInArrow(run, "id long, y int, b binary").toArrow()
    rows = sorted(zip(sample["id"].to_pylist(), sample["y"].to_pylist(), sample["b"].to_pylist(), strict=True))
    del sample
    y = np.array([r[1] for r in rows], np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return Model(None, share, {})
    net = train([np.frombuffer(r[2], np.uint32).reshape(-1, 1 + len(PREFIXES)) for r in rows], y)
    del rows
    give_back()  # the driver keeps the net, not the sample
    last = known.where("_last").select(F.col("_id").cast("long"), "_y")
    kept = texts.withColumn("_doc", F.col("doc_id").cast("long")).join(few_broadcast(last), F.col("_doc") == F.col("_id"))
    binned = kept.select("_y", "lang", of_texts(docs.sparkSession, net.logits)("text").alias("z")).groupBy("_y", F.coalesce("lang", F.lit("")).alias("lang"), F.round(F.col("z") / BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    seen = binned.orderBy("lang", "_y", "bin").toArrow()
    y, n, z = (np.array(seen[c].to_pylist(), np.float64) for c in ("_y", "n", "bin"))
    lang = np.array(seen["lang"].to_pylist())
    z = z * BIN
    if (y == 1).any() and (y == 0).any():
        net.scale, net.offset = fit_scale(z, y, n)
    score = sigmoid(net.scale * z + net.offset)
    cuts = {str(g): best_cut(score[lang == g], y[lang == g], n[lang == g]) for g in np.unique(lang)}
    return Model(net, share, cuts)


def of_texts(spark: SparkSession, function):
    """``function`` of texts as a column function, about 1 MB at a time. Only the texts go to Python, and only the values come back."""
    shared = spark.sparkContext.broadcast(function)

    @F.arrow_udf("double")
    def run(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        value = shared.value
        for column in rows:
            texts = column.cast("binary")
            found, at, size = [], 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 1 << 20:
                    if i > at:
                        found.append(value(texts.slice(at, i - at).to_pylist()))
                    at, size = i, 0
                if i < len(texts):
                    size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            del texts, column
            give_back()

    return run.asNondeterministic()  # so that no filter is pushed below it, which would have it run twice


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``threshold`` (of its language) and ``toxic`` (score at or over threshold)."""
    score = of_texts(docs.sparkSession, model.scores)
    out = boxed(docs, lang=F.coalesce(docs["lang"], F.lit("")), value=score(docs["text"]))
    cuts = F.create_map(*[F.lit(v) for pair in model.cuts.items() for v in pair]) if model.cuts else None
    threshold = F.coalesce(cuts[F.col("lang")], F.lit(CUT)) if cuts is not None else F.lit(CUT)
    return unboxed(out, score=F.col("value"), threshold=threshold, toxic=F.col("value") >= threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    out = scored(docs.withColumn("held_out", held_out("doc_id", 4, 2)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "toxic")
