"""Shared parts of the corpus operators: table access, word rules, salted lookups, packed rows."""

from __future__ import annotations

import ctypes
import gc
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``more``: whatever the caller's columns are called, they clash with none of an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unboxed(rows: DataFrame, **results: Column) -> DataFrame:
    """The caller's columns again, with ``results`` behind them; one of the caller's that has a result's name is replaced."""
    fields = [f.name for f in rows.schema["row"].dataType.fields if f.name not in results]
    return rows.select(*[F.col("row").getField(f).alias(f) for f in fields], *[c.alias(n) for n, c in results.items()])


def few_broadcast(ids: DataFrame, most: int = 250_000) -> DataFrame:
    """``ids`` (a few numbers a row) to be broadcast while they are few, as counted now; larger tables are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % folds == fold


def total_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column, from all rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def salted_min(df: DataFrame, key: str, value: str, salts: int = 64) -> DataFrame:
    """``df`` with the smallest ``value`` of each row's ``key`` as ``_first`` and the key's row count as ``_count``.

    A key may hold any share of the rows: they are counted by (key, salt) first, the few rows of each key are
    joined among themselves, and the large side meets the answer on (key, salt), spread over all salts.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = parts.groupBy(F.col(key).alias("_k")).agg(F.min("_m").alias("_first"), F.sum("_n").alias("_count"))
    answers = parts.join(whole, F.col(key).eqNullSafe(F.col("_k"))).select("_k", F.col("_salt").alias("_s"), "_first", "_count")
    return salted.join(answers, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_k", "_s")


class Words:
    """The words of many texts in one buffer: ``[^\\x20\\x09-\\x0D]+`` as bytes, with 64-bit hashes.

    ``start``/``end`` are byte positions of each word in ``buf``; ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = buf = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(buf, np.uint8)
        if lower:
            raw = _LOWER[raw]
            self.buf = raw.tobytes()
        self.raw = raw
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))

    def hashes(self, seed: int = 0x9E3779B97F4A7C15, block: int = 1 << 17) -> np.ndarray:
        """A 64-bit polynomial hash of each word, mixed so that all bits depend on all bytes."""
        out = np.zeros(len(self.start), np.uint64)
        longest = int((self.end - self.start).max(initial=0))
        power = powers(seed, min(longest, 1 << 12))
        for a in range(0, len(out), block):
            s, e = self.start[a : a + block], self.end[a : a + block]
            lo, hi = int(s[0]), int(e[-1])
            width = e - s
            if width.max() > len(power):  # a word of more than 4096 bytes: by slices of that length
                for i in range(len(s)):
                    h = 0
                    for at in range(int(s[i]), int(e[i]), len(power)):
                        piece = self.raw[at : min(at + len(power), int(e[i]))].astype(np.uint64) + np.uint64(1)
                        h = (h * 0x100000001B3 + int((piece * power[: len(piece)]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
                    out[a + i] = h
                continue
            pos = np.arange(lo, hi) - np.repeat(s, np.append(s[1:], hi) - s)
            value = self.raw[lo:hi].astype(np.uint64) + np.uint64(1)
            inside = pos < np.repeat(width, np.append(s[1:], hi) - s)
            value *= power[np.minimum(pos, len(power) - 1)]
            value *= inside
            out[a : a + block] = np.add.reduceat(value, s - lo)
        return mix(out ^ (self.end - self.start).astype(np.uint64))


def powers(seed: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(seed | 1))
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive words that start at each word; the last k - 1 run over the end."""
    out = words.copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            nxt = np.concatenate([words[i:], np.zeros(min(i, len(words)), np.uint64)])
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + nxt)
    return out


def pack(head: dict, *parts: bytes | np.ndarray, level: int = 1) -> bytes:
    """One compressed row of arrays; ``unpack`` gives them back as bytes."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    top = json.dumps(head | {"_": [len(r) for r in raw]}).encode()
    return zstandard.ZstdCompressor(level=level).compress(len(top).to_bytes(4, "little") + top + b"".join(raw))


def unpack(blob: bytes) -> tuple[dict, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    at = 4 + int.from_bytes(raw[:4], "little")
    head, out = json.loads(raw[4:at]), []
    for n in head.pop("_"):
        out.append(raw[at : at + n])
        at += n
    return head, out


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and the next operator's memory comes on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def pieces(texts: list[bytes | None], most: int = 1 << 20):
    """Ranges of the texts with about ``most`` bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most or i - at >= 4096:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def batches(rows, column: str = "text", most: int = 8 << 20, rows_most: int = 20_000):
    """Regroup Arrow batches of ``(columns...)`` into lists of Python rows with at most about ``most`` bytes of text.

    ``rows`` is what mapInArrow hands over; each item of the result is a dict of lists, texts as UTF-8 bytes (null: None).
    """
    held: dict[str, list] = {}
    size = 0
    for whole in rows:
        names = whole.schema.names
        at = names.index(column)
        for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
            texts = batch.column(at).cast("binary").to_pylist()
            others = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if i != at}
            for i, t in enumerate(texts):
                held.setdefault(column, []).append(t)
                for n, values in others.items():
                    held.setdefault(n, []).append(values[i])
                size += len(t) if t else 0
                if size >= most or len(held[column]) >= rows_most:
                    yield held
                    held, size = {}, 0
    if held:
        yield held
        held = {}
    give_back()
