"""Corpus operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemfield.llm import bpe, jaccard, knn, langid, lattice, merkle, mixing, substring, toxicity, warc

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, key string"


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def documents(spark, texts, langs=None):
    """Rows with extra columns whose names the operators use inside; ids may repeat or be null."""
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, langs[n] if langs else "en", "s", len(t or ""), "p", "k") for n, (i, t) in enumerate(rows)], SCHEMA)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    base = [prose(r, 60) for _ in range(25)]
    out = [None, "", " \t\n", "one", "two words", "same", "same", prose(r, 3000), "a " * 200]
    for b in base:
        w = b.split()
        out.append(b)
        if r.random() < 0.7:
            w[r.randrange(60)] = "changed"
            out.append("\n".join(w))
    passage = prose(r, 30)
    out += [f"{prose(r, 10)} {passage} {prose(r, 10)}" for _ in range(6)] + [base[0], base[0], base[1].upper()]
    return out


def test_substring_equals_brute_force(spark, corpus):
    docs = documents(spark, [*corpus, (None, corpus[9]), (10**12, corpus[9])])
    rows = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text) for r in docs.collect()), key=lambda x: x[0])
    seen, want = {}, {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (i, s))
        drop = {j for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] < (i, s) for j in range(s, s + 20)}
        want[i] = (len(w), len(drop), b" ".join(x for j, x in enumerate(w) if j not in drop).decode())
    got = {r.doc_id if r.doc_id is not None else -(2**63): (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(docs, keep_clean=False).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_repeated_strings_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(substring, "run_hashes", lambda w, k: np.zeros(len(w), np.uint64))
    flags = substring.repeated([b"a b c a b", b"b c a"], 2, [(0, 0), (1, 0)])
    assert [f.tolist() for f in flags] == [[False, False, False, True], [True, True]]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, corpus, k, percent):
    sets, parent = {}, {}
    for i, t in enumerate(corpus):
        w = words(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, corpus), k, percent).collect()}
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 5


def linked(texts, k, percent):
    """Size and smallest linked id of each text by brute force; ids are positions."""
    sets, parent = [], list(range(len(texts)))
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def behind_leaders(r, k, percent, n, tag, both_sides):
    """Two map batches of texts of n shingles: the first has a leader and a text similar to it, the second a text similar to the
    latter only, alone or behind its own leader. All signatures of that link are the leaders' too, so no first star tries it."""
    while True:
        tag += "x"
        base = [f"{tag}{i}" for i in range(n + k - 1)]
        p = len(base) // 2
        edit = lambda w, at: [*w[:at], f"{tag}e{r.random()}", *w[at + 1 :]]  # noqa: E731, B023
        ones = [edit(base, p) for _ in range(1500)]
        other = edit(base, p + 1)
        twos = [edit(other, p + 2) for _ in range(1500)] if both_sides else []
        every = jaccard.Sets([" ".join(w).encode() for w in [base, other, *ones, *twos]], k)
        ids, sigs = every.ids(), [set(jaccard.signatures(s, percent).tolist()) for s in every.sets]
        link = sigs[0] & sigs[1]
        ok = lambda i, cid: ids[i] < cid and link <= sigs[i]  # noqa: E731, B023
        one = next((i for i in range(2, 1502) if ok(i, ids[0])), None)
        two = next((i for i in range(1502, len(ids)) if ok(i, ids[1])), None)
        if one and (two or not both_sides):
            return [" ".join(ones[one - 2]), " ".join(base)], [" ".join(other)] + ([" ".join(twos[two - 1502])] if two else [])


def in_batches(spark, groups):
    """Rows of each group in one partition, hence one map batch."""
    ids = iter(range(sum(map(len, groups))))
    rows = [[(next(ids), t, "en", "s", len(t), "p", "k") for t in g] for g in groups]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)).flatMap(lambda x: x), SCHEMA)


@pytest.mark.parametrize(("k", "percent", "n"), [(3, 90, 60), (5, 80, 46)])
def test_jaccard_links_behind_leaders_of_other_batches(spark, k, percent, n):
    r = random.Random(11)
    groups = [[] for _ in range(6)]
    for i in range(6):
        first, second = behind_leaders(r, k, percent, n, f"t{i}", i % 2)
        groups[i] += first
        groups[(i + 1 + i // 2) % 6] += second
    for f in range(8):  # near-threshold families, dealt over all batches
        w = [f"f{f}w{i}" for i in range(n + k - 1)]
        for i in range(24):
            v = list(w)
            for at in r.sample(range(10, 20), r.randint(1, 2)):
                v[at] = f"f{f}e{r.randrange(3)}"
            groups[(i + f) % 6].append(" ".join(v))
    texts = [t for g in groups for t in g]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(in_batches(spark, groups), k, percent).collect()}
    assert got == linked(texts, k, percent)


def test_a_signature_has_one_name_over_all_batches(spark):
    r = random.Random(5)
    base = prose(r, 80).split()
    groups = [[" ".join([*base[:at], f"e{g}", *base[at + 1 :]]) for at in r.sample(range(80), 12)] for g in range(4)]
    every = jaccard.Sets([t.encode() for g in groups for t in g], 3)
    holders, found = defaultdict(set), defaultdict(set)
    for cid, s in zip(every.ids(), every.sets, strict=True):
        for sig in jaccard.signatures(s, 90).tolist():
            holders[sig].add(cid)
    for row in jaccard.shared_signatures(in_batches(spark, groups), 3, 90, 1).collect():
        found[row.sig].add(row.cid)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in holders.values() if len(c) > 1)


@pytest.mark.parametrize("bits", [6, 8, 32])
def test_similar_sets_share_as_many_names_as_the_filter_asks(monkeypatch, bits):
    """Also where signatures of one set have the same name, as happens seldom with 32 bits."""
    monkeypatch.setattr(jaccard, "named", lambda sig, buckets: sig & np.uint64((1 << bits) - 1))
    r = np.random.default_rng(2)
    tried = 0
    for n in (20, 60, 150, 400):
        for percent in (80, 90):
            for _ in range(60):
                a = np.unique(r.integers(0, 2**64, n, np.uint64))
                gone = n * (100 - percent) // (100 + percent)
                b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**64, gone, np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                names = [set(jaccard.named(jaccard.signatures(s, percent), 1).tolist()) for s in (a, b)]
                bands = [jaccard.filled(s, percent, 1) for s in (a, b)]
                top = max(x[0] for x in bands)
                kept = max(own if band == top else above for band, own, above in bands)
                assert len(names[0] & names[1]) >= kept - (len(a) + len(b)) * (100 - percent) // (100 + percent)
                tried += 1
    assert tried > 300


@pytest.mark.parametrize(("k", "percent", "few"), [(3, 90, 2), (5, 80, 3)])
def test_jaccard_large_group_of_near_copies(spark, k, percent, few):
    """Most texts are copies of one with some edits each, around the threshold, of sizes that differ; some share an id."""
    r = random.Random(k)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for _ in range(260):
        v = list(base)
        for _ in range(r.randint(0, few + 1)):
            at = r.randrange(len(v))
            v[at : at + 1] = r.choice([[f"n{r.random()}"], [], [v[at], f"n{r.randrange(4)}"]])
        texts.append(" ".join(v))
    other = [prose(r, 40) for _ in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(in_batches(spark, [texts[i::5] for i in range(5)] + [other]), k, percent).collect()}
    order = [t for i in range(5) for t in texts[i::5]] + other
    want = linked(order, k, percent)
    assert got == want and 5 < len({c for _, c in want.values()}) < 250
    # ids that several rows share join the components of their texts
    docs = documents(spark, [(i // 2, t) for i, t in enumerate(order)] + [(None, order[0]), (10**9, None)])
    joined = list(range(len(order) // 2))
    for i, (_, c) in want.items():
        a, b = joined[i // 2], joined[c // 2]
        joined = [min(a, b) if x in (a, b) else x for x in joined]
    assert {(x.doc_id, x.component_id) for x in jaccard.near_duplicates(docs, k, percent).collect()} == {(i, c) for i, c in enumerate(joined)} | {(None, None), (10**9, 10**9)}


def test_signatures_meet_whenever_sets_are_similar():
    r = np.random.default_rng(8)
    for n in (9, 12, 20, 60, 400):
        for percent in (80, 90):
            for _ in range(60):
                a = np.unique(r.integers(0, 2**64, n, np.uint64))
                most = 2 * n * (100 - percent) // (100 + percent)
                b = np.unique(np.concatenate([a[most // 2 :], r.integers(0, 2**64, most // 2, np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) > len(np.intersect1d(a, b)):
                    assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size


def test_knn_equals_brute_force(spark):
    r = np.random.default_rng(0)
    v = np.round(r.normal(0, 0.3, (300, 6)), 2)
    v[50:80] = v[50]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [math.nan] * 6), (1003, [math.inf] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").withColumn("key", F.lit("x"))
    q = np.floor(64 * v).astype(int)
    want = {}
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(300) if j != i)[:20]
        want |= {(i, n): (j, -m) for n, (m, j) in enumerate(best, 1)}
    for shard, block in ((65536, 512), (64, 2)):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(df, "vec_id", "e", shard=shard, block=block, pivots=8).collect()}
        assert got == want
    assert knn.top_k(df.limit(0), "vec_id", "e").count() == 0


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    r = random.Random(2)
    alphabet = "aAbtheSs''''  \t\n\r\x0b\x1c\x1f\x85\xa0.,;!0129éÉßİıΣσς中文한ﾞ́e‍🙂²½ªŉǅ"
    texts = ["", "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>", "'S'T can't WE'LL", "a" * 3000, "İstanbul ΣΑΣ"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    for text, ids, ref in zip(texts, own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == ref.ids, text
        assert own.decode(ids) == library.decode(ref.ids, skip_special_tokens=False)


def test_bpe_does_no_work_twice():
    """Words last used the longest ago make room first, and the vocabulary is not searched again for what a state has found."""
    coder, calls = bpe.Codec(bpe.vocabulary(), most_words=30), []
    first, second, third = (" ".join(f"{c}{d}x" for d in "abcdefghijklmno"[:n]) for c, n in (("s", 10), ("t", 15), ("u", 10)))
    coder.encode_all([first])
    known = coder.encode_all([second]) + coder.encode_all([third])
    encode = coder.trie.encode
    coder.trie.encode = lambda word: calls.append(word) or encode(word)
    again = coder.encode_all([second, third])
    assert calls == [] and again == known and len(coder.bytes_of) <= 30

    class Searched(dict):
        found = 0

        def __contains__(self, token):
            self.found += 1
            return super().__contains__(token)

    trie = bpe.Trie(bpe.vocabulary())
    before = trie.encode("internationally"), trie.encode("a")
    trie.ids = Searched(trie.ids)
    assert (trie.encode("internationally"), trie.encode("a")) == before and trie.ids.found == 0


def test_bpe_with_small_memories_and_without_runs():
    from tokenizers import Tokenizer

    path, r = bpe.vocabulary(), random.Random(5)
    library, small, whole = Tokenizer.from_file(path), bpe.Codec(path, most_words=20), bpe.Codec(path)
    small.trie.most_pairs, whole.by_space = 20, False
    for _ in range(5):
        texts = ["".join(r.choice("aAbtheSs'',.!! \t\n\xa0012éÉßİªº½ŉǅ中文") for _ in range(r.randint(0, 60))) for _ in range(60)]
        ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for coder in (small, whole):
            assert [np.frombuffer(i, np.uint32).tolist() for i in coder.encode_all(texts)] == ids


def test_bpe_rows(spark):
    docs = documents(spark, [None, "", "Hello, world", "Hello, world"])
    rows = sorted(bpe.encoded(docs, bpe.vocabulary()).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].ids_sha256 == rows[3].ids_sha256 and rows[2].n_tokens > 0


def test_lattice_sums_all_segmentations():
    vocab = lattice.Vocabulary(lattice.vocabulary())
    price = dict(zip(vocab.pieces[256:], vocab.prior[256:], strict=True))
    with np.errstate(divide="ignore"):
        log_p = np.log(vocab.prior)
    for word in (b"the", b"hello", "éà".encode(), b"zzqx", b"1,2"):
        text, f = b" " + word, [1.0]
        for j in range(1, len(text) + 1):
            f.append(sum(f[i] * (price.get(text[i:j], 0) + (vocab.prior[text[i]] if j == i + 1 else 0)) for i in range(j)))
        expected = np.zeros(len(vocab.pieces))
        got = lattice.solve([word], vocab, log_p, expected)[0]
        assert got == pytest.approx(math.log(f[-1])) and sum(e * len(p) for e, p in zip(expected, vocab.pieces, strict=True)) == pytest.approx(len(text))


def test_lattice_counts(spark, corpus):
    docs = documents(spark, [*corpus, (None, "no id")], [None if i % 5 == 0 else "en" if i % 2 else "fr" for i in range(len(corpus) + 1)])
    held = docs.withColumn("held_out", lattice.held_out("doc_id", 7, 2))
    tokens = {r.doc_id: [*words(r.text, True), None] for r in docs.collect()}
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = lattice.scored(held, lattice.vocabulary()).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert lattice.scored(held.limit(0), lattice.vocabulary()).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é?x=1#y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"), (5, "u", "other"), (None, "u", "<p>é</p>")], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(pages), path, max_file_bytes=200)
    rows = warc.read_warc(spark, path, verify=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.record_id].append(r)
    assert len(rows) == 7 and by["urn:x-page:2"][0].warc_type == "response" and bytes(by["urn:x-page:2"][0].payload).decode() == "<p>é</p>"
    first = by["urn:x-page:1"][0]
    assert (first.warc_type, first.refers_to, first.payload, first.payload_bytes, first.target_uri) == ("revisit", "urn:x-page:2", None, 9, "http://a/é?x=1#y")
    assert by["urn:x-page:null"][0].warc_type == "revisit" and by["urn:x-page:3"][0].refers_to == "urn:x-page:4"
    assert sorted(bytes(r.payload) for r in by["urn:x-page:5"]) == [b"WARC/1.1\r\n\r\n", b"other"]
    assert warc.read_warc(spark, path, payload=False).where("warc_type = 'revisit'").count() == 3
    assert warc.read_warc(spark, path, where={"warc_type": ["revisit"]}).select("payload").distinct().collect()[0].payload is None
    empty = str(tmp_path / "none")
    warc.write_warc(warc.page_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_merkle(spark):
    docs = documents(spark, ["First. Second!\nThird line", None, "", "First. Second!\nOther line", "First. Second!\nThird line"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "part")
    rows = {r.doc_id: r for r in docs.withColumn("f", merkle.fingerprint(F.col("text"))).collect()}
    assert rows[0].f == rows[4].f != rows[3].f and rows[1].f == rows[2].f
    pair = spark.createDataFrame([(rows[0].f, rows[3].f)], "a string, b string").select(merkle.differing_sections(F.col("a"), F.col("b")).alias("d"), merkle.likeness(merkle.leaves_of(F.col("a")), merkle.leaves_of(F.col("b"))).alias("s")).first()
    assert pair.d == [1] and 0 < pair.s < 1
    many = spark.range(500).selectExpr("id * 7 doc_id", "cast(id as string) text")
    nxt = {r.doc_id: r.next_text for r in merkle.with_successor(many, ["text"], rows_per_bucket=40).collect()}
    assert nxt == {7 * i: str((i - 1) % 500) for i in range(500)}
    assert merkle.with_successor(many.limit(0), ["text"]).count() == 0
    assert merkle.with_successor(many.where("doc_id = 7"), ["text"]).first().next_text == "1"


def language_rows(r, n):
    stems = {"aa": ["bado", "kelu", "mira"], "bb": ["thron", "wizk", "fresh"], "cc": ["éclou", "ñandu", "über"]}
    rows = [(lang, " ".join(r.choice(stems[lang]) + r.choice("xyz") for _ in range(r.randint(3, 30)))) for _ in range(n) for lang in stems]
    r.shuffle(rows)
    return rows


def test_language(spark):
    rows = language_rows(random.Random(1), 80)
    docs = documents(spark, [t for _, t in rows] + [None, "12 34 !", ""], [x for x, _ in rows] + ["aa", None, "bb"])
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    held = [i for i in range(len(rows)) if i % 3 == 1]
    assert sum(got[i].lang_pred == rows[i][0] for i in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(len(rows), len(rows) + 3))
    assert (model.weights == 0).mean() > 0.5
    none = langid.fit(docs.limit(0))
    assert langid.identified(docs, none).select("lang_pred").distinct().first().lang_pred == "und"


def test_toxicity(spark):
    r = random.Random(3)
    texts, marks = [], []
    for i in range(600):
        w = prose(r, r.randint(5, 80), 3000).split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grommel", "snarfox", "grommelix"]))
        texts.append(" ".join(w))
        marks.append(int(i % 5 == 0))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i % 4] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.scored(docs, model).collect()}
    held = range(0, 600, 4)
    assert sum((got[i].score >= 0.3) == marks[i] for i in held) >= 0.9 * len(held)
    assert got[600].score == got[601].score < 0.3 and all(0 <= x.score <= 1 for x in got.values())
    assert toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_pooling_in_blocks_is_whole():
    net = toxicity.Net()
    b, first = toxicity.word_buckets([b"a b c d e f g", b"", b"x " * 300])
    whole = net.pooled_all(b, first)
    assert np.allclose(whole, [net.pooled(b[s:e], block=4) for s, e in zip(first, first[1:])], atol=1e-5)
    assert np.allclose(whole, net.pooled_all(b, first, block=2), atol=1e-5)


def test_mixing(spark):
    r = random.Random(6)
    rows = language_rows(r, 60)
    docs = documents(spark, [t if i % 4 else "$$ " + t for i, (_, t) in enumerate(rows)] + [None], [x for x, _ in rows] + ["aa"])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(len(rows)) if i % 2] + [(0, None)], "doc_id long, quality int")
    mix = mixing.fit_mix(docs, labels, mixing.smoothed(), keep=True)
    out = mixing.with_rates(mix.documents, mix)
    sums = out.agg(F.min("rate"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[i]) for i in range(len(mix.targets))]).first()
    assert sums[0] >= 0 and mix.residual < 0.01
    assert list(sums[1:]) == pytest.approx(mix.targets, rel=0.02)
    assert mixing.realised(mix).columns == docs.columns
    assert mixing.fit_mix(docs.limit(0), labels, mixing.smoothed()).documents.count() == 0


def test_jaccard_equals_its_sql(spark, corpus):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(corpus)), pa.int64()), "text": pa.array(corpus, pa.string())}))
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(documents(spark, corpus), 3, 90).collect()}
    assert got == set(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({jaccard.OP9_SQL})").fetchall())
    assert any(c < d for d, _, c in got)
