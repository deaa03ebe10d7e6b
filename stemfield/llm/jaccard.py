"""N-gram Jaccard self-join by vertical partitioning, and its connected classes.

The global order of shingles is their hash order. It is cut into fragments twice.

*Candidates.* Two sets of similarity t differ in at most ``d = (|A| + |B|)(1 - t)/(1 + t)`` shingles, and a shingle spoils one
fragment. With more filled fragments than d, at least ``filled - d`` of them are equal in both sets, so their hashes are signatures both
have. The number of fragments depends on the size class of a set (a factor 1.5 wide); a set near the upper end of its class also emits
for the next. A set with too few filled fragments (very rare) also emits each shingle, so no link is lost. Only sets that share so many
signatures with others go on.

*Counting.* For a pair of sets the overlap is counted in each of ``FRAGMENTS`` coarse fragments separately, and the partial
overlaps are summed per pair.

*Large groups.* Only components are asked for, so the pairs of a group are never enumerated. Equal sets are one class from the start.
Each set is counted against one leader, that of most of its signatures. Then the sets meet once more, by the rarest shingles of each
(``prefixes``: the order is by the number of sets that have a shingle), and only those of different components, and of sizes that
the places of the shingle allow, are paired: first with a few leaders again, then all that are left. Two sets of a link share a shingle
at places that allow their sizes, so no link between different components is lost.

Nulls and empties: a text that is null or has no words has an empty set, is linked with nothing and is its own component. A null
doc_id links nothing and has a null component. Rows that share a doc_id are one vertex, which has the links of each of its rows.
Shingles are compared by 64-bit hash. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import persist_table
from .common import Words, batches, mix, pack, pieces, salted_min, table, total_bytes, unpack
from .substring import run_hashes

FRAGMENTS = 4
#: Leaders that a set is counted against before all pairs that are left.
LEADERS = 4
#: A set that stands in very many pairs meets them under so many keys.
SALTS = 64
#: Up to so many ids (a few numbers each) may be broadcast, as they are counted first; more are joined by shuffle.
BROADCAST_IDS = 250_000
_STEP = 1.5


class Sets:
    """Shingle sets of a batch of texts, as sorted arrays of distinct hashes."""

    def __init__(self, texts: list[bytes | None], k: int):
        words = Words([t or b"" for t in texts], lower=True)
        one = words.hashes()
        runs = run_hashes(one, k)
        self.sets: list[np.ndarray] = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            n = b - a
            own = runs[a : b - k + 1] if n >= k else mix(run_hashes(one[a:b], n)[:1] + np.uint64(n)) if n else runs[:0]
            self.sets.append(np.unique(own))

    def ids(self) -> list[int | None]:
        """A 64-bit id of each set; None for the empty set."""
        return [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in self.sets]


def fragment_count(upper: int, percent: int) -> tuple[int, int]:
    """Most differing shingles of two similar sets of at most ``upper`` shingles, and the number of fragments used."""
    most = 2 * upper * (100 - percent) // (100 + percent)
    return most, int(1.15 * most) + 4


def size_classes(n: int, percent: int) -> list[int]:
    """The classes in which a set of n shingles meets others: its own, and the next if a similar set may be there."""
    c = 0
    while lower(c + 1) <= n:
        c += 1
    return [c, c + 1] if 100 * n >= percent * lower(c + 1) else [c]


def lower(c: int) -> int:
    return int(np.ceil(_STEP**c))


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    out = []
    for c in size_classes(len(s), percent):
        most, count = fragment_count(lower(c + 1) - 1, percent)
        if not most:
            continue  # only equal sets are similar
        part = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        head = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5)), head)
            out.append(mix(whole + part[head] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c + 1)))
        if len(head) <= most:
            out.append(mix(s ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
    return np.concatenate(out) if out else s[:0]


def named(sig: np.ndarray, buckets: int) -> np.ndarray:
    """The name by which a signature is known in all map batches: its low 32 bits and its bucket. Signatures of one name are tried as one."""
    return (sig & np.uint64(0xFFFFFFFF)) | ((sig >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32))


def filled(s: np.ndarray, percent: int, buckets: int) -> tuple[int, int, int]:
    """Size class of a set and how many fragments it fills there and in the next class (0: it does not take part there), less those
    signatures of the set that have the name of another of its own, as they cannot be counted apart."""
    classes = size_classes(len(s), percent) if len(s) else []
    counts = [len(np.unique(((s >> np.uint64(32)) * np.uint64(fragment_count(lower(c + 1) - 1, percent)[1])) >> np.uint64(32))) for c in classes]
    sig = np.unique(signatures(s, percent))
    alike = len(sig) - len(np.unique(named(sig, buckets)))
    own, above = (max(0, n - alike) for n in (*counts, 0, 0)[:2])
    return (classes[0] if classes else 0), own, above


def fewest(s: np.ndarray, percent: int, buckets: int) -> int:
    """How many names of signatures a set shares at least with any other set that it links to."""
    if not len(s):
        return 1
    n, (_, *counts) = len(s), filled(s, percent, buckets)
    out = []
    for c, kept in zip(size_classes(n, percent), counts):  # noqa: B905  the second count is of a class it need not take part in
        most = min(lower(c + 1) - 1, 100 * n // percent)
        out.append(kept - (n + most) * (100 - percent) // (100 + percent))
    return max(1, min(out))


def described(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """``doc_id, n_shingles, cid, least``: the size and the id of each row's set, and the names it shares at least with one it links to."""

    def run(rows):
        for held in batches(rows, most=4 << 20):
            for a, b in pieces(held["text"]):
                sets = Sets(held["text"][a:b], k)
                least = [fewest(s, percent, buckets) for s in sets.sets]
                yield pa.RecordBatch.from_arrays([pa.array(held["doc_id"][a:b], pa.int64()), pa.array([len(s) for s in sets.sets], pa.int64()), pa.array(sets.ids(), pa.int64()), pa.array(least, pa.int32())], ["doc_id", "n_shingles", "cid", "least"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cid long, least int")


def bucket_count(docs: DataFrame, group_bytes: int = 32 << 20) -> int:
    """Buckets of about ``group_bytes`` of text, and some at any size."""
    _, size = total_bytes(docs)
    return max(24, -(-size // group_bytes))


def shared_signatures(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """``sig, cid``: which sets have a signature (by its name) that another set has too.

    A map task that holds several sets of a signature knows that it is shared: it sends one of them to the bucket, marked, and
    passes the others on as they are, spread over further buckets. So a signature of very many sets brings its bucket one entry a batch.
    """

    def cut(rows):
        schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
        for held in batches(rows, most=8 << 20):
            known, parts = set(), []
            for a, b in pieces(held["text"]):
                sets = Sets(held["text"][a:b], k)
                for cid, s in zip(sets.ids(), sets.sets, strict=True):
                    if cid is not None and cid not in known:
                        known.add(cid)
                        sig = np.unique(named(signatures(s, percent), buckets))
                        parts.append((sig, np.full(len(sig), cid, np.int64)))
            if not parts:
                continue
            sig, cid = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.lexsort((cid, sig))
            sig, cid = sig[order], cid[order]
            if not len(sig):
                continue
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            size = np.diff(np.append(np.flatnonzero(head), len(sig)))
            several = np.repeat(size > 1, size)
            out, waiting = [], 0
            for kind, own in enumerate((head, ~head)):
                s, c, m = sig[own], cid[own], several[own]
                where = (s >> np.uint64(32)).astype(np.int64)
                if kind:  # passed on as they are: spread by what they hold
                    where = buckets + (mix(s ^ c.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((s, c, where))
                edges = np.flatnonzero(np.diff(where[by], prepend=-1))
                for i, lo in enumerate(edges):
                    rows_in = by[lo : edges[i + 1] if i + 1 < len(edges) else len(by)]
                    names = s[rows_in] if kind else s[rows_in].astype(np.uint32)
                    blob = pack({"kind": kind}, names, np.diff(c[rows_in], prepend=0), m[rows_in])
                    out.append({"bucket": int(where[rows_in[0]]), "blob": blob})
                    waiting += len(blob)
                    if waiting > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, waiting = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        parts, out = [], []
        for bucket, blob in zip(frame["bucket"], frame["blob"], strict=True):
            head, (s, c, m) = unpack(blob)
            c, m = np.cumsum(np.frombuffer(c, np.int64)), np.frombuffer(m, bool)
            if head["kind"]:
                out.append((np.frombuffer(s, np.int64), c))
            else:
                parts.append((np.frombuffer(s, np.uint32), c, m))
        if parts:
            s, c, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((c, s))
            s, c, m = s[order], c[order], m[order]
            twice = np.zeros(len(s), bool)
            twice[1:] = (s[1:] == s[:-1]) & (c[1:] == c[:-1])  # equal sets of several batches
            first = np.flatnonzero(np.diff(s.astype(np.int64), prepend=-1))
            size = np.diff(np.append(first, len(s)))
            keep = np.repeat(np.logical_or.reduceat(m, first) | (np.add.reduceat(~twice, first) > 1), size) & ~twice
            out.append((s[keep].astype(np.int64) | (int(bucket) << 32), c[keep]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"sig": a, "cid": b})

    return docs.select("text").mapInArrow(cut, "bucket long, blob binary").groupBy("bucket").applyInPandas(meet, "sig long, cid long")


def limited(rows: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``ids`` on ``column`` = ``key``; the ids are counted, and broadcast while they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(column) == F.col(key))


def packed_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``batch, blob``: the wanted sets, many a row. ``wanted`` has rep (a doc_id of the set), cid, leader (or null) and leads."""
    side = wanted.select(F.col("rep").alias("_rep"), F.col("cid").alias("_cid"), F.col("leader").alias("_leader"), F.col("leads").alias("_leads"))
    rows = limited(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), "_id", side, "_rep").select("_cid", "_leader", "_leads", "text")

    def run(rows):
        schema = pa.schema([("batch", pa.int64()), ("blob", pa.binary())])
        for held in batches(rows, most=4 << 20):
            sets = Sets(held["text"], k)
            some = [i for i, (want, cid) in enumerate(zip(held["_cid"], sets.ids(), strict=True)) if want == cid]
            if not some:
                continue
            cids = np.array([held["_cid"][i] for i in some], np.int64)
            leader = np.array([held["_leader"][i] or 0 for i in some], np.int64)
            flags = np.array([(held["_leader"][i] is not None) + 2 * bool(held["_leads"][i]) for i in some], np.uint8)
            sizes = np.array([len(sets.sets[i]) for i in some], np.int64)
            batch = int.from_bytes(hashlib.blake2b(cids.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_pylist([{"batch": batch, "blob": pack({}, cids, leader, flags, sizes, np.concatenate([sets.sets[i] for i in some]))}], schema)

    return rows.mapInArrow(run, "batch long, blob binary")


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """cids, leaders, flags (1: has a leader, 2: is one), sizes and all elements of a row of ``packed_sets``."""
    return tuple(np.frombuffer(p, t) for p, t in zip(unpack(blob)[1], (np.int64, np.int64, np.uint8, np.int64, np.uint64), strict=True))


def fragments(packed: DataFrame) -> DataFrame:
    """``cid, n, leader, leads, frag, part``: the sets, cut into coarse fragments of the hash order."""

    def run(rows):
        cuts = np.array([f * (2**64 // FRAGMENTS) for f in range(1, FRAGMENTS)], np.uint64)
        for batch in rows:
            for blob in batch.column(batch.schema.names.index("blob")).to_pylist():
                cids, leader, flags, sizes, every = unpacked(blob)
                number = np.repeat(np.arange(len(cids)), sizes) * FRAGMENTS + np.searchsorted(cuts, every, "right")
                head = np.flatnonzero(np.diff(number, prepend=-1))
                own, ends = number[head] // FRAGMENTS, np.append(head, len(every))
                for lo in range(0, len(head), 2048):
                    i = own[lo : lo + 2048]
                    edge = ends[lo : lo + len(i) + 1]
                    part = pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(every[edge[0] : edge[-1]].view(np.int64)))
                    cols = [pa.array(cids[i]), pa.array(sizes[i]), pa.array(leader[i], mask=(flags[i] & 1) == 0), pa.array((flags[i] & 2) > 0), pa.array((number[head[lo : lo + len(i)]] % FRAGMENTS).astype(np.int32)), part]
                    yield pa.RecordBatch.from_arrays(cols, ["cid", "n", "leader", "leads", "frag", "part"])

    return packed.mapInArrow(run, "cid long, n long, leader long, leads boolean, frag int, part array<long>")


def counted(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs that are linked: ``right`` has a row for each pair and fragment of b, ``left`` one for each fragment of a
    and salt. Partial overlaps are counted in each fragment separately, and summed per pair."""
    both = left.join(right, ["a", "salt", "frag"]).select("a", "b", "frag", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("shared"))
    parts = both.groupBy("a", "b", "frag").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("shared").alias("shared"))  # a set may be there twice
    sums = parts.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    return sums.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def with_leaders(frags: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links of the sets with their leaders. A leader of very many sets meets them on (leader, salt)."""
    right = frags.where("leader is not null").select(F.col("leader").alias("a"), salt("cid").alias("salt"), "frag", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    used = stars.select(F.col("leader").alias("a"), salt("cid").alias("salt")).distinct()
    left = used.join(frags.where("leads").select(F.col("cid").alias("a"), F.col("n").alias("na"), "frag", F.col("part").alias("pa")), "a")
    return counted(left, right, percent)


def verified(pairs: DataFrame, frags: DataFrame, percent: int) -> DataFrame:
    """Links among any pairs a, b; only the sets that stand in them are moved."""
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    held = persist_table(limited(frags.select("cid", "n", "frag", "part"), "cid", ids, "_id").drop("_id"), "jaccard-open-sets")
    salted = pairs.withColumn("salt", salt("b"))
    left = salted.select("a", "salt").distinct().join(held.select(F.col("cid").alias("a"), F.col("n").alias("na"), "frag", F.col("part").alias("pa")), "a")
    right = salted.join(held.select(F.col("cid").alias("b"), F.col("n").alias("nb"), "frag", F.col("part").alias("pb")), "b")
    return counted(left, right, percent)


def prefixes(packed: DataFrame, total: int, percent: int, group: int = 3_000_000) -> DataFrame:
    """``e, cid, n, most, band``: the shingles by which a set meets similar ones.

    The order of shingles is by the number of sets that have them, then by hash. At place p of a set of n shingles, the rest bounds
    the overlap with any set that shares no earlier one, hence the size of the partner (``most``). Shingles that no other set has are
    left out, but fill their places; so a set that has many of its own meets nobody by the shingles that a large group shares.

    Each packed row asks the buckets of shingles for the number of sets, in a compressed list of distinct shingles, and is answered in the
    same order. A shingle that all sets have brings its bucket one entry a row.
    """
    groups = max(12, -(-total // group))

    def keyed(every: np.ndarray) -> np.ndarray:
        return ((every >> np.uint64(32)) % np.uint64(groups) << np.uint64(32)) | (every & np.uint64(0xFFFFFFFF))

    def ask(rows):
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])
        for batch in rows:
            names = batch.schema.names
            for number, blob in zip(batch.column(names.index("batch")).to_pylist(), batch.column(names.index("blob")).to_pylist(), strict=True):
                key, count = np.unique(keyed(unpacked(blob)[4]), return_counts=True)
                where = (key >> np.uint64(32)).astype(np.int64)
                edges = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(key))
                out = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    low = key[a:b].astype(np.uint32)
                    out.append({"batch": number, "bucket": int(where[a]), "blob": pack({}, np.diff(low, prepend=np.uint32(0)), np.minimum(count[a:b], 255).astype(np.uint8))})
                yield pa.RecordBatch.from_pylist(out, schema)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [[np.frombuffer(p, t) for p, t in zip(unpack(blob)[1], (np.uint32, np.uint8), strict=True)] for blob in frame["blob"]]
        names = np.concatenate([np.cumsum(low, dtype=np.uint32) for low, _ in asked])
        _, at = np.unique(names, return_inverse=True)
        total = np.bincount(at, np.concatenate([count for _, count in asked]))
        code = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)[at]  # 0: a single set has it
        ends = np.cumsum([len(low) for low, _ in asked])[:-1]
        return pd.DataFrame({"batch": frame["batch"], "bucket": frame["bucket"], "blob": [pack({}, c) for c in np.split(code, ends)]})

    def ordered(sets: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in sets["blob"]:
            cids, _, _, sizes, every = unpacked(blob)
            key, at = np.unique(keyed(every), return_inverse=True)
            got = dict(zip(answers["bucket"], answers["blob"], strict=True))  # equal rows have equal answers
            code = np.concatenate([np.frombuffer(unpack(got[b])[1][0], np.uint8) for b in np.unique((key >> np.uint64(32)).astype(np.int64)).tolist()])[at]
            own = np.repeat(np.arange(len(cids)), sizes)
            order = np.lexsort((every, code, own))
            place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = sizes[own]
            most = (n - place) * (100 + percent) // percent - n
            keep = (most * 100 >= n * percent) & (code[order] > 0)
            out.append(pd.DataFrame({"e": every[order][keep].view(np.int64), "cid": cids[own[keep]], "n": n[keep], "most": most[keep]}))
        frame = pd.concat(out) if out else pd.DataFrame({c: np.array([], np.int64) for c in ("e", "cid", "n", "most")})
        # sizes of similar sets are in the same band or in the next
        frame["band"] = np.floor(np.log(frame["n"]) / np.log(100.1 / percent)).astype(np.int32)
        return frame

    asked = packed.mapInArrow(ask, "batch long, bucket long, blob binary")
    answered = asked.groupBy("bucket").applyInPandas(answer, "batch long, bucket long, blob binary")
    return packed.groupBy("batch").cogroup(answered.groupBy("batch")).applyInPandas(ordered, "e long, cid long, n long, most long, band int").distinct()


def meetings(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``e, cid, n, most, c, m, small, large``: sets that can link, by this shingle, to one of size m of another component."""
    placed = rows.join(found.select(F.col("node").alias("_node"), "component"), F.col("cid") == F.col("_node"), "left").withColumn("c", F.coalesce("component", "cid")).drop("_node", "component")
    here = placed.groupBy(F.col("e").alias("_e"), F.col("band").alias("_band"), F.col("n").alias("m")).agg(F.min("c").alias("_c"), F.max("c").alias("_d"), F.max("most").alias("_most"))
    look = placed.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    fits = (F.col("e") == F.col("_e")) & (F.col("near") == F.col("_band")) & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("_most")) & ((F.col("c") != F.col("_c")) | (F.col("c") != F.col("_d")))
    return look.join(here, fits).select("e", "cid", "n", "most", "c", "m", F.least("n", "m").alias("small"), F.greatest("n", "m").alias("large"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row; sets of k-word shingles link at Jaccard similarity ``percent`` / 100."""
    if percent * _STEP < 100:
        raise ValueError(f"percent must be at least {100 / _STEP:.0f}")
    buckets = bucket_count(docs)
    rows = persist_table(described(docs, k, percent, buckets), "jaccard-docs")
    firsts = salted_min(rows.where("cid is not null and doc_id is not null"), "cid", "doc_id")
    same = persist_table(firsts.select("doc_id", "cid", F.col("_first").alias("rep"), F.col("n_shingles").alias("n"), "least").distinct(), "jaccard-same")
    shared = shared_signatures(docs.where("doc_id is not null"), k, percent, buckets)
    held = shared.groupBy(F.col("cid").alias("_c")).agg(F.collect_set("sig").alias("sigs"))
    # sets that share too few signatures with all others together link to none
    about = same.select("cid", "rep", "n", "least").distinct().join(held, F.col("cid") == F.col("_c")).where(F.size("sigs") >= F.col("least"))
    near = persist_table(about.select("cid", "rep", "n", "sigs"), "jaccard-near")
    # the leader of a signature is its set that shares most with others; a set's leader is the one of most of its signatures
    each = near.select("cid", F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    weights = each.join(common, "sig").groupBy("cid").agg(F.sum("many").alias("weight"))
    named_by = near.join(weights, "cid").select("cid", "n", F.struct("weight", "cid", "n").alias("w"), F.explode("sigs").alias("sig"))
    leads = named_by.groupBy("sig").agg(F.max("w").alias("l"), F.count(F.lit(1)).alias("many")).where("many > 1").select("sig", F.col("l.cid").alias("leader"), F.col("l.n").alias("size"))
    behind = named_by.join(leads, "sig").where(f"leader <> cid and 100 * least(n, size) >= {percent} * greatest(n, size)")
    stars = persist_table(behind.groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("many")).groupBy("cid").agg(F.max(F.struct("many", "leader")).alias("l")).select("cid", F.col("l.leader").alias("leader")), "jaccard-stars")
    led = stars.select(F.col("leader").alias("cid"), F.lit(True).alias("leads")).distinct()
    wanted = near.select("cid", "rep").join(stars, "cid", "left").join(led, "cid", "left")
    packed = persist_table(packed_sets(docs, wanted, k), "jaccard-sets")
    frags = fragments(packed)
    links = persist_table(with_leaders(frags, stars, percent), "jaccard-links")
    found = persist_table(connected_components(links, "a", "b"), "jaccard-components")
    meet = persist_table(prefixes(packed, near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], percent), "jaccard-prefixes")
    for turn in ("central", "any", "all"):
        live = persist_table(meetings(meet, found, percent), "jaccard-open")
        if live.isEmpty():
            break
        place = ["e", "small", "large"]
        if turn == "all":
            other = live.select(*place, F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
            pairs = live.withColumnRenamed("cid", "a").join(other, place).where("a < b and c <> cb and nb = m").select("a", "b").distinct()
        else:  # first each set with few leaders only: those of most of its places, with few rare shingles before them, then some others
            order = F.col("most") if turn == "central" else F.xxhash64("cid", "e")
            lead = live.groupBy(*place).agg(F.max(F.struct(order.alias("order"), "cid", "n", "c")).alias("l"))
            tried = live.join(lead, place).where("c <> l.c and m = l.n").groupBy(F.col("l.cid").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("many"))
            best = F.slice(F.sort_array(F.collect_list(F.struct("many", "a")), False), 1, LEADERS)
            pairs = tried.groupBy("b").agg(best.alias("ls")).select(F.explode("ls.a").alias("a"), "b")
        more = persist_table(verified(persist_table(pairs, "jaccard-pairs"), frags, percent), "jaccard-links")
        if not more.isEmpty():
            links = links.union(more)
            found = persist_table(connected_components(links, "a", "b"), "jaccard-components")
    of_class = found.select(F.col("node").alias("cid"), F.col("component").alias("_in"))
    edges = same.join(of_class, "cid", "left").select("doc_id", F.coalesce("_in", "cid").alias("group"))
    # a row's class stands for its component; rows of one doc_id join the components of their classes
    least = edges.groupBy("group").agg(F.min("doc_id").alias("least"))
    joined = salted_group(edges, least)
    tangled = joined.groupBy("doc_id").agg(F.min("least").alias("component_id"), F.max("least").alias("_most"))
    final = persist_table(tangled, "jaccard-doc-components")
    if not final.where("component_id <> _most").isEmpty():
        merged = connected_components(joined, "doc_id", "least")
        final = merged.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = rows.select(F.col("doc_id"), "n_shingles").join(final.select(F.col("doc_id").alias("_d"), "component_id"), F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def salted_group(edges: DataFrame, least: DataFrame, salts: int = SALTS) -> DataFrame:
    """``doc_id, least`` of each edge's group, with the rows of a large group spread over salts."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(salted.select("group", "salt").distinct().join(least, "group"), ["group", "salt"]).select("doc_id", "least").distinct()


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, g, n FROM g JOIN n USING (doc_id)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * k >= 90 * (n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b.y, r.root FROM reach r JOIN b ON b.x = r.doc_id WHERE r.root < b.y),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
