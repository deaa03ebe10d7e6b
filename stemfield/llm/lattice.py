"""Language-model scores from a subword lattice.

The probability of a word is the sum over all its segmentations into pieces of an existing vocabulary, by a forward recursion in log
space (words start with the vocabulary's word mark; a byte without a piece has its byte piece, so every word has a path).

Learning. The vocabulary's own scores (its order of merges, read as ranks of Zipf's law) first weight all segmentations of every distinct
training word; the expected counts of the pieces give the lattice its probabilities. Words seen in training keep their relative frequency
less a discount, and the discounted mass goes to the lattice:

    p(w) = max(c(w) - D, 0) / N + D V / N * lattice(w),  D = n1 / (n1 + 2 n2)

with counts, N, V, n1 and n2 over all training tokens, an end token for each text among them. The training texts of a language k
(the ``MOST_CLASSES`` commonest, all others together) have such a distribution too, ``max(c_k(w) - D, 0) / N_k + D V_k / N_k * p(w)``, and
the probability of a text is the sum over k of the share of k times the product over its tokens. Sums over all words give 1. No
text's own language is used to score it.

Plan. Texts are packed in rows of about 4 MB. Each row asks for its distinct words, in compressed lists by word bucket; a bucket merges
the lists of all rows, so each distinct word is solved once, and answers each list in its order; a row meets its answers and is scored.
What a bucket holds of a word that all texts share is one entry a row.

Nulls and empties: a null text is an empty one and has only the end token. A null id counts as empty text for the fold and stays null. With no
training text the lattice alone scores words and the end is certain. Repeated rows are rows of their own, in training too; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table
from .common import _LOWER, batches, held_out, pack, table, unpack

MARK = "▁"
MOST_CLASSES = 16
_ZIPF = 2.7


class Vocabulary:
    """Pieces as bytes (the word mark as a space), their prior log-probabilities, and a trie for matching.

    Pieces 0..255 are the bytes; pieces with a mark inside can match no word and are left out.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes] = [bytes([b]) for b in range(256)]
        self.bare = 256
        ranks = []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            text = model.id_to_piece(i)
            if text.lower() == text and MARK not in text[1:]:
                self.pieces.append(text.replace(MARK, " ").encode())
                ranks.append(-model.get_score(i))
        prior = np.concatenate([np.full(256, 1e-6), 1 / (np.array(ranks) + _ZIPF)])
        prior[0x20] = 0  # a word starts with a piece that has the mark
        self.prior = prior / prior.sum()
        edges: dict[int, int] = {}
        leaf, count = [-1], 1
        for number, piece in enumerate(self.pieces[256:], 256):
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = count
                    leaf.append(-1)
                    count += 1
                node = edges[key]
            leaf[node] = number
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.leaf = np.array(leaf, np.int64)

    def matches(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge: all pieces in ``raw`` that do not cross ``stop`` (the end of each byte's word)."""
        at = np.arange(len(raw))
        byte = raw != 0x20
        found = [(at[byte], at[byte] + 1, raw[byte].astype(np.int64))]
        start, node, depth = at, np.zeros(len(raw), np.int64), 0
        while len(start):
            key = node << 8 | raw[start + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            start, node = start[ok], self.to[i[ok]]
            depth += 1
            piece = self.leaf[node]
            hit = piece >= 0
            found.append((start[hit], start[hit] + depth, piece[hit]))
            more = start + depth < stop[start]
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def solve(words: list[bytes], vocab: Vocabulary, log_p: np.ndarray, expected: np.ndarray | None = None, block: int = 20_000) -> np.ndarray:
    """Log-probability of each word, summed over its segmentations; adds the expected counts of the pieces to ``expected``."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), block):
        part = [b" " + w for w in words[lo : lo + block]]
        raw = np.frombuffer(b"".join(part), np.uint8)
        size = np.array([len(w) for w in part])
        stop = np.repeat(np.cumsum(size), size)
        first = np.cumsum(size) - size
        s, e, piece = vocab.matches(raw, stop)
        keep = np.isfinite(log_p[piece])
        s, e, piece = s[keep], e[keep], piece[keep]
        word = np.repeat(np.arange(len(part)), size)
        own = word[s]
        # node ids: one more than bytes for each word, so the end of a word is not the start of the next
        src, dst = s + own, e + own
        weight = log_p[piece]
        alpha = np.full(len(raw) + len(part), -np.inf)
        alpha[first + np.arange(len(part))] = 0
        _sweep(alpha, src, dst, weight, e - first[own])
        last = first + np.arange(len(part)) + size
        out[lo : lo + block] = alpha[last]
        if expected is not None:
            beta = np.full(len(alpha), -np.inf)
            beta[last] = 0
            _sweep(beta, dst, src, weight, stop[s] - s)
            expected += np.bincount(piece, np.exp(alpha[src] + weight + beta[dst] - alpha[last][own]), len(expected))
    return out


def _sweep(value: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, depth: np.ndarray) -> None:
    """``value[dst] = logsumexp(value[src] + weight)``, over edges in the order of their depth."""
    order = np.lexsort((dst, depth))
    src, dst, weight, depth = src[order], dst[order], weight[order], depth[order]
    edges = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        to = dst[a:b]
        head = np.flatnonzero(np.diff(to, prepend=-1))
        value[to[head]] = np.logaddexp.reduceat(value[src[a:b]] + weight[a:b], head)


_VOCABULARIES: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def packed(docs: DataFrame, most: int = 4 << 20) -> DataFrame:
    """Rows of about ``most`` bytes: ``split, size, blob`` with ids, classes (-1: not learned from) and the lower-cased words of the texts."""

    def run(rows):
        task, number = TaskContext.get().partitionId(), 0
        for held in batches(rows, most=most):
            texts = [b" ".join(_LOWER[np.frombuffer(t, np.uint8)].tobytes().split()) if t else b"" for t in held["text"]]
            ids = np.array([0 if i is None else i for i in held["doc_id"]], np.int64)
            null = np.array([i is None for i in held["doc_id"]], np.uint8)
            out = np.array([-1 if h else c for h, c in zip(held["held_out"], held["class"], strict=True)], np.int8)
            buf = b"\n".join(texts)
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | number], pa.int64()), pa.array([len(buf)], pa.int64()), pa.array([pack({}, buf, ids, null, out, level=3)], pa.binary())], ["split", "size", "blob"])
            number += 1

    return docs.select("doc_id", "text", "held_out", "class").mapInArrow(run, "split long, size long, blob binary")


def lists(buf: bytes, out: np.ndarray, buckets: int, classes: int = 0) -> tuple[dict[int, list[bytes]], list[Counter]]:
    """The distinct words of a packed row by bucket, in a fixed order, and their counts in its training texts of each class."""
    words: list[list[bytes]] = [[] for _ in range(classes)]
    distinct: set[bytes] = set()
    for text, k in zip(buf.split(b"\n"), out.tolist(), strict=True):
        if 0 <= k < classes:
            words[k] += text.split()
        else:
            distinct.update(text.split())
    counts = [Counter(w) for w in words]
    distinct.update(*counts)
    by: dict[int, list[bytes]] = {}
    for w in sorted(distinct):
        by.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return by, counts


def requests(rows: DataFrame, buckets: int, classes: int) -> DataFrame:
    def run(it):
        for batch in it:
            for split, blob in zip(batch.column("split").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                _, (buf, _, _, out) = unpack(blob)
                by, counts = lists(buf, np.frombuffer(out, np.int8), buckets, classes)
                got = [(b, pack({}, b" ".join(ws), np.array([[c[w] for w in ws] for c in counts], np.int32))) for b, ws in by.items()]
                for a in range(0, len(got), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(got[a : a + 64]), pa.int64()), pa.array([b for b, _ in got[a : a + 64]], pa.int64()), pa.array([x for _, x in got[a : a + 64]], pa.binary())], ["split", "bucket", "blob"])

    return rows.select("split", "blob").mapInArrow(run, "split long, bucket long, blob binary")


def merged(frame: pd.DataFrame, classes: int) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """The distinct words of a bucket, their training counts in each class, and each request as numbers of words."""
    number: dict[bytes, int] = {}
    asked, counted = [], []
    for blob in frame["blob"]:
        _, (words, counts) = unpack(blob)
        asked.append(np.array([number.setdefault(w, len(number)) for w in words.split(b" ")], np.int64))
        counted.append(np.frombuffer(counts, np.int32).reshape(classes, -1))
    at, counted = np.concatenate(asked), np.concatenate(counted, 1)
    return list(number), np.array([np.bincount(at, c, len(number)) for c in counted]).astype(np.int64), asked


class Trained:
    """What is learned: of all and of each class the tokens, types and texts; the discount; the log-probabilities of the pieces."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray, texts: np.ndarray, all_types: int, discount: float, log_p: np.ndarray):
        self.tokens, self.types, self.texts, self.all_types, self.discount, self.log_p = tokens, types, texts, all_types, discount, log_p
        self.all_tokens, self.all_texts = int(tokens.sum()), int(texts.sum())

    def log_words(self, counts: np.ndarray, lattice: np.ndarray | float) -> np.ndarray:
        """Natural logarithms, ``(classes, words)``, from the counts in each class and the logarithms of the lattice."""
        if not self.all_tokens:
            return np.broadcast_to(lattice, counts.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = lambda c, n: np.log(np.maximum(c - self.discount, 0) / n)
            every = np.logaddexp(rest(counts.sum(0), self.all_tokens), np.log(self.discount * self.all_types / self.all_tokens) + lattice)
            n = np.maximum(self.tokens, 1)[:, None]
            own = np.logaddexp(rest(counts, n), np.log(self.discount * self.types[:, None] / n) + every)
            return np.where(self.tokens[:, None] > 0, own, -np.inf)

    def log_end(self) -> np.ndarray:
        return self.log_words(self.texts[:, None], -np.inf)[:, 0] if self.all_tokens else np.zeros(len(self.texts))

    def log_share(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.texts / self.all_texts) if self.all_texts else np.log(np.full(len(self.texts), 1 / len(self.texts)))


def train(asked: DataFrame, texts: np.ndarray, path: str) -> Trained:
    """``texts``: the number of training texts in each class."""
    classes = len(texts)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        vocab = load(path)
        words, by_class, _ = merged(frame, classes)
        counts = by_class.sum(0)
        expected = np.zeros(len(vocab.pieces))
        with np.errstate(divide="ignore"):
            solve([w for w, c in zip(words, counts.tolist(), strict=True) if c], vocab, np.log(vocab.prior), expected)
        at = np.flatnonzero(expected)
        stats = {-1: (counts > 0).sum(), -2: (counts == 1).sum(), -3: (counts == 2).sum()}
        stats |= {-10 - 2 * k: c.sum() for k, c in enumerate(by_class)} | {-11 - 2 * k: (c > 0).sum() for k, c in enumerate(by_class)}
        return pd.DataFrame({"piece": [*stats, *at.tolist()], "n": [*map(float, stats.values()), *expected[at].tolist()]})

    sums = {r["piece"]: r["n"] for r in asked.groupBy("bucket").applyInPandas(gather, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    types, once, twice = (int(sums.pop(k, 0)) for k in (-1, -2, -3))
    tokens = np.array([int(sums.pop(-10 - 2 * k, 0)) for k in range(classes)]) + texts
    own = np.array([int(sums.pop(-11 - 2 * k, 0)) for k in range(classes)]) + (texts > 0)
    vocab = load(path)
    expected = np.zeros(len(vocab.pieces))
    expected[list(sums)] = list(sums.values())
    extra = 1 + 0.01 * expected.sum()
    p = (expected + extra * vocab.prior) / (expected.sum() + extra)
    ends = int(texts.sum())
    once, twice = once + (ends == 1), twice + (ends == 2)
    with np.errstate(divide="ignore"):
        return Trained(tokens, own, texts, types + (ends > 0), once / (once + 2 * twice) if once and twice else 0.5, np.log(p))


def scored(docs: DataFrame, path: str, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` has doc_id, text, lang and held_out (not learned from); see the module for the result's meaning."""
    found = docs.where("not held_out").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_CLASSES).collect()
    names = [r["lang"] for r in found if r["lang"] is not None]
    number = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")), F.lit(0)) if names else F.lit(0)
    classed = docs.withColumn("class", number.cast("int"))
    in_class = {r["class"]: r["n"] for r in classed.where("not held_out").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_class = np.array([in_class.get(k, 0) for k in range(len(names) + 1)])
    rows = persist_table(packed(classed), "lm-packed")
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    buckets = max(1, -(-size["s"] // bucket_bytes))
    asked = persist_table(requests(rows, buckets, len(per_class)), "lm-requests")
    model = train(asked, per_class, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        words, counts, wanted = merged(frame, len(per_class))
        value = solve(words, load(path), shared.value.log_p)
        return pd.DataFrame({"split": frame["split"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "answer": [pack({}, counts[:, w].astype(np.int64), value[w]) for w in wanted]})

    answers = asked.groupBy("bucket").applyInPandas(answer, "split long, bucket long, answer binary")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        answer_of = dict(zip(right["bucket"], right["answer"], strict=True))
        frames = []
        for blob in left["blob"]:
            _, (buf, ids, null, out) = unpack(blob)
            out = np.frombuffer(out, np.int8)
            by, _ = lists(buf, out, buckets)
            number, count, value = {}, [np.zeros((len(per_class), 0))], [np.zeros(0)]
            for b, ws in by.items():
                number |= zip(ws, range(len(number), len(number) + len(ws)), strict=True)
                _, (c, v) = unpack(answer_of[b])
                count.append(np.frombuffer(c, np.int64).reshape(len(per_class), -1))
                value.append(np.frombuffer(v, np.float64))
            counts = np.concatenate(count, 1)
            log_p = np.ascontiguousarray(model.log_words(counts, np.concatenate(value)).T)
            count = counts.sum(0)
            level = np.log10(model.all_tokens + model.all_types + 1)
            base = np.log10(count + 1) - level
            start = model.log_share() + model.log_end()
            texts = buf.split(b"\n")
            n, known, low, high = (np.zeros(len(texts)) for _ in range(4))
            for i, t in enumerate(texts):
                at = np.fromiter(map(number.__getitem__, t.split()), np.int64)
                n[i], known[i], low[i] = len(at), (count[at] > 0).sum(), base[at].sum()
                high[i] = np.logaddexp.reduce(start + log_p[at].sum(0)) / np.log(10)
            frame = pd.DataFrame({"doc_id": pd.array(np.frombuffer(ids, np.int64), "Int64"), "held_out": out < 0, "n_tokens": n + 1, "n_known": known + (model.all_texts > 0), "train_tokens": model.all_tokens, "base_score": low + np.log10(model.all_texts + 1) - level, "score": high})
            frame.loc[np.frombuffer(null, np.uint8) == 1, "doc_id"] = pd.NA
            frames.append(frame.astype({"n_tokens": "int64", "n_known": "int64"}))
        return pd.concat(frames) if frames else pd.DataFrame({c.split()[0]: [] for c in result.split(", ")})

    return rows.select("split", "blob").groupBy("split").cogroup(answers.groupBy("split")).applyInPandas(score, result)


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 7, 2).alias("held_out"))
    return scored(docs, vocabulary())
