"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of its runs of ``m`` words, so
equal windows have equal minimisers. Consecutive windows that share a minimiser travel as one string of words (a super-k-mer)
to the minimiser's bucket, packed with others into compressed rows. A map task sends a string that it holds several times once, with all
its places, so what a bucket gets of a group of copies grows with the tasks and not with the copies. In the bucket the windows
are sorted by hash in the order of (doc_id, start), equal neighbours are compared byte by byte, and every window behind the first of
its kind is reported. Words that such a window covers are removed from their documents.

Nulls and empties: a null or empty text has no words, and its kept text is empty. A null doc_id counts as the smallest and stays
null. Rows that share a doc_id are told apart by their text: equal windows at the same (doc_id, start) are not earlier
than one another, so identical rows keep or lose the same words. Further columns pass through; those named ``kept``, ``n_words`` or ``n_removed`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, boxed, give_back, mix, pack, pieces, shingle_hashes, table, total_bytes, unboxed, unpack

_LEAST = -(2**63)
_LONGEST = 4096  # windows of one super-k-mer
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """``min(x[i : i + w])``; the last ``w - 1`` places see fewer values."""
    big = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, size = x, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out, np.concatenate([out[step:], np.full(min(step, len(out)), big)]))
        size += step
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, by doubling; the last k - 1 run over the end."""
    ahead = lambda x, n: np.concatenate([x[n:], np.zeros(min(n, len(x)), np.uint64)])
    power, size, out, have = words, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                out, have = (power, size) if out is None else (mix(out * _GOLD + ahead(power, have)), have + size)
            size *= 2
            if size > k:
                return out
            power = mix(power * _GOLD + ahead(power, size // 2))


def super_kmers(texts: list[bytes], k: int, m: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, and of each super-k-mer: text number, first word, number of windows, minimiser."""
    words = Words(texts)
    n = np.diff(words.first)
    minimal = sliding_min(mix(shingle_hashes(words.hashes(), m) ^ np.uint64(m)), k - m + 1)
    at = np.flatnonzero(np.arange(len(words.start)) + k <= np.repeat(words.first[1:], n))
    text = np.repeat(np.arange(len(texts)), n)[at]
    least = minimal[at]
    if not len(at):
        return words, at, at, at, least
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | ((at[1:] - words.first[text[1:]]) % _LONGEST == 0)
    head = np.flatnonzero(fresh)
    return words, text[head], at[head], np.diff(np.append(head, len(at))), least[head]


def repeated(windows: list[bytes], k: int, first: list[tuple[int, int]]):
    """Of strings in the order of their first places: for each string, which of its windows have occurred at an earlier place."""
    words = Words(windows)
    n = np.diff(words.first) - (k - 1)
    at = np.flatnonzero(np.arange(len(words.start)) + k <= np.repeat(words.first[1:], np.diff(words.first)))
    string = np.repeat(np.arange(len(windows)), n)
    offset = at - words.first[string]
    key = run_hashes(words.hashes(), k)[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(len(order), bool)
    head[1:] = key[1:] != key[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    late = np.zeros(len(at), bool)
    doc, start = np.array([f[0] for f in first], np.int64), np.array([f[1] for f in first], np.int64)
    a, b = words.start[at], words.end[at + k - 1]
    buf, odd = words.buf, set()
    for w, f in zip(order[~head].tolist(), lead[~head].tolist(), strict=True):
        if buf[a[w] : b[w]] == buf[a[f] : b[f]]:
            late[w] = True
        else:
            odd.add(f)  # two windows of one hash: this run is settled by its bytes
    where = start[string] + offset
    late &= (doc[string] != doc[string[_back(lead, order, len(at))]]) | (where != where[_back(lead, order, len(at))])
    for f in odd:
        seen: dict[bytes, int] = {}
        for w in order[lead == f].tolist():
            g = seen.setdefault(buf[a[w] : b[w]], w)
            late[w] = (doc[string[w]], where[w]) != (doc[string[g]], where[g])
    return np.split(late, np.cumsum(n)[:-1])


def _back(lead: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[order] = lead
    return out


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of each run of true values."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(int(s), int(e - s)) for s, e in zip(edge[0::2], edge[1::2], strict=True)]


def late_windows(docs: DataFrame, k: int, m: int = 3, group_bytes: int = 6 << 20) -> DataFrame:
    """``doc, h, start, n``: runs of n windows from word ``start`` that occur earlier. ``docs`` has doc, h (32 bits of the text's hash) and text."""
    _, size = total_bytes(docs)
    groups = max(1, -(-3 * size // group_bytes))

    def cut(rows):
        schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
        for held in batches(rows, most=6 << 20):
            strings: list[bytes] = []
            parts = []
            for lo, hi in pieces(held["text"]):
                words, text, at, n, least = super_kmers([b" ".join(t.split()) if t else b"" for t in held["text"][lo:hi]], k, m)
                if len(at):
                    strings += [words.buf[a:b] for a, b in zip(words.start[at].tolist(), words.end[at + n + k - 2].tolist(), strict=True)]
                    parts.append((lo + text, at - words.first[text], (mix(least + np.uint64(1)) % np.uint64(groups)).astype(np.int64)))
            if not parts:
                continue
            text, start, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts, words, at, n, least
            docs_of, h_of = np.array(held["doc"], np.int64), np.array(held["h"], np.int64)
            held.clear()
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            out, waiting = [], 0
            for i, lo in enumerate(edges):
                rows_in = order[lo : edges[i + 1] if i + 1 < len(edges) else len(order)]
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(strings[j], len(number)) for j in rows_in.tolist()], np.int32)
                blob = pack({}, b"\n".join(number), which, docs_of[text[rows_in]], h_of[text[rows_in]].astype(np.uint32), start[rows_in].astype(np.int32), level=3)
                out.append({"bucket": int(bucket[rows_in[0]]), "blob": blob})
                waiting += len(blob)
                if waiting > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, waiting = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        which, doc, h, start = [], [], [], []
        for blob in frame["blob"]:
            _, (strings, w, d, hh, s) = unpack(blob)
            local = np.array([number.setdefault(x, len(number)) for x in strings.split(b"\n")], np.int64)
            which.append(local[np.frombuffer(w, np.int32)])
            doc.append(np.frombuffer(d, np.int64))
            h.append(np.frombuffer(hh, np.uint32).astype(np.int64))
            start.append(np.frombuffer(s, np.int32))
        which, doc, h, start = (np.concatenate(x) for x in (which, doc, h, start))
        order = np.lexsort((h, start, doc, which))
        which, doc, h, start = which[order], doc[order], h[order], start[order]
        head = np.flatnonzero(np.diff(which, prepend=-1))
        lead = head[np.cumsum(np.diff(which, prepend=-1) > 0) - 1]
        first_doc, first_start = doc[head], start[head].astype(np.int64)
        strings = list(number)
        rank = np.lexsort((first_start, first_doc))
        flags: list = [None] * len(strings)
        for r, f in zip(rank, repeated([strings[r] for r in rank], k, [(int(first_doc[r]), int(first_start[r])) for r in rank]), strict=True):
            flags[r] = f
        sizes = np.array([len(f) for f in flags])
        again = (doc != doc[lead]) | (start != start[lead])
        out = [(doc[again], h[again], start[again], sizes[which[again]])]
        marked = np.array([f.any() for f in flags])
        for i in np.flatnonzero(~again & marked[which]).tolist():
            got = spans(flags[which[i]])
            out.append((np.full(len(got), doc[i]), np.full(len(got), h[i]), np.array([start[i] + s for s, _ in got]), np.array([n for _, n in got])))
        d, hh, s, n = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        got = pd.DataFrame({"doc": d, "h": hh, "start": s.astype(np.int32), "n": n.astype(np.int32)})
        del strings, number, flags, out, which, doc, h, start
        give_back()
        return got

    return docs.select("doc", "h", "text").mapInArrow(cut, "bucket long, blob binary").groupBy("bucket").applyInPandas(settle, "doc long, h long, start int, n int")


def covered(n_words: int, starts: list[int], counts: list[int], k: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(np.add(starts, counts) + k - 1, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, k: int = 20, keep_clean: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``kept`` (the words that stay, joined by one space; the text itself where nothing is
    removed and ``keep_clean``), ``n_words`` and ``n_removed``."""
    keyed = boxed(docs, doc=F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)), h=F.xxhash64(docs["text"]).bitwiseAND(0xFFFFFFFF), text=docs["text"])
    found = late_windows(keyed, k).groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = keyed.drop("text").join(found, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left").select("row", "starts", "counts")

    @F.arrow_udf("left string, size long, gone long")
    def cut(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, starts, counts in rows:
            kept, size, gone = [], [], []
            for t, s, c in zip(texts, starts, counts, strict=True):
                t = t.as_py()
                words = (t or "").encode().split()
                size.append(len(words))
                if s.is_valid:
                    drop = covered(len(words), s.as_py(), c.as_py(), k)
                    stay = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    gone.append(len(words) - len(stay))
                    kept.append(b" ".join(stay).decode())
                else:
                    gone.append(0)
                    kept.append(None if keep_clean else b" ".join(words).decode())
            yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64())], ["left", "size", "gone"])
            del kept, texts, starts, counts
            give_back()

    done = joined.select("row", cut.asNondeterministic()(F.col("row").getField("text"), "starts", "counts").alias("cut"))
    return unboxed(done, kept=F.coalesce("cut.left", F.col("row").getField("text"), F.lit("")), n_words=F.col("cut.size"), n_removed=F.col("cut.gone"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_clean=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS s FROM x),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS j FROM r WHERE n > 1),
l AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT doc_id, unnest(range(len(ws))) AS j, ws FROM w),
q AS (SELECT p.doc_id, string_agg(p.ws[p.j + 1], ' ' ORDER BY p.j) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT k.doc_id, len(ws) AS n_words, len(js)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN q USING (doc_id)
"""
