"""Extra columns that clash, values at the edges, and the trained operators against plain loops."""

import hashlib
import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from test_operators import documents, language_rows, linked, prose, words

from stemfield.llm import bpe, jaccard, knn, langid, lattice, merkle, mixing, substring, toxicity, warc

CLASHES = """row text_ score threshold toxic value language p lang_pred kept n_words n_removed doc h starts counts left size gone _doc _h _starts _counts _tokens _chars _bytes _sym
_lines _distinct _text _bins _scores _weights _total posterior domain rate n_tokens copy rank bucket to b ghost after fingerprint next_text _head _serves part key cid sig batch blob class
held_out _id _rep _cid _leader _leads _c n frag least rep e v id vectors ids kind _y _last z bin _salt _k _s _first _count digest payload last _own""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(9)
    texts = [prose(r, 40) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", None, "", "½ ② ² Ⅷ", " ".join(prose(r, 30).split() * 4)]
    docs = documents(spark, texts, ["aa", "bb"] * 9)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).cache()


@pytest.mark.parametrize("op", ["toxicity", "langid", "substring", "mixing", "rated", "merkle", "jaccard", "bpe", "lattice"])
def test_extra_columns_may_have_any_name(spark, clashing, op):
    docs = clashing
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 > 0), "x") for i in range(14)], "doc_id long, toxic int, quality int, _id string")
    mix = lambda keep: mixing.fit_mix(docs, labels, mixing.smoothed(), keep=keep)
    run = {
        "toxicity": lambda: (toxicity.scored(docs, toxicity.fit(docs, labels)), {"score", "threshold", "toxic"}),
        "langid": lambda: (langid.identified(docs, langid.fit(docs)), {"lang_pred", "score"}),
        "substring": lambda: (substring.without_repeats(docs), {"kept", "n_words", "n_removed"}),
        "mixing": lambda: (mixing.realised(mix(True)), set()),
        "rated": lambda: (mixing.rated(docs, mix(False)), {"n_tokens", "domain", "posterior", "rate"}),
        "merkle": lambda: (merkle.with_successor(docs, ["text"]), {"next_text"}),
        "jaccard": lambda: (jaccard.near_duplicates(docs, 3, 90), None),
        "bpe": lambda: (bpe.encoded(docs, bpe.vocabulary()), None),
        "lattice": lambda: (lattice.scored(docs.withColumn("held_out", F.lit(False)), lattice.vocabulary()), None),
    }
    out, made = run[op]()
    rows = out.collect()
    if made is None:
        assert len(rows) == 18 and sorted(x.doc_id for x in rows) == list(range(18))
        return
    assert set(out.columns) == set(docs.columns) | made and len(out.columns) == len(set(out.columns))
    assert len(rows) == 18 or op == "mixing"
    assert all(x[c] == f"own {c}" for x in rows for c in CLASHES if c not in made)
    if op == "langid":
        assert {x.doc_id for x in rows if x.lang_pred == "und"} == {14, 15, 16}


def test_warc_and_knn_ignore_extra_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a")], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHES})
    warc.write_warc(warc.page_records(pages), str(tmp_path / "one"))
    assert sorted((x.warc_type, x.refers_to) for x in warc.read_warc(spark, str(tmp_path / "one")).collect()) == [("response", None), ("revisit", "urn:x-page:2")]
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, f array<double>").withColumns({c: F.lit("x") for c in CLASHES})
    assert [(x.query_id, x.vec_id, x.score) for x in knn.top_k(vectors, "vec_id", "f").collect()] == [(0, 1, 64 * 128)]


def test_a_second_write_leaves_the_first_archives(spark, tmp_path):
    path = str(tmp_path / "two")
    page = lambda i, size: warc.page_records(spark.createDataFrame([(i, "u", "x" * size)], "page_id long, url string, html string"))
    warc.write_warc(page(1, 10), path)
    warc.write_warc(page(2, 3 << 20), path)
    assert sorted((x.record_id, x.payload_bytes) for x in warc.read_warc(spark, path).collect()) == [("urn:x-page:1", 10), ("urn:x-page:2", 3 << 20)]
    warc.write_warc(page(3, 1), path, mode="overwrite")
    assert [x.record_id for x in warc.read_warc(spark, path).collect()] == ["urn:x-page:3"]


def top(rows, k, every):
    q = {}
    for i, v in rows:
        w = [math.floor(x * 64) for x in v]
        q[i] = w
    out = {}
    for i in q:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
            out |= {(i, n): (j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


def test_knn_of_large_values_and_several_lengths(spark):
    r = random.Random(2)
    large = [2e7, 1.5e7, -2e7, 1e7, 0.5]
    rows = [(i, [r.choice(large) if j == i % 3 else 0.25 * r.randint(-4, 4) for j in range(3)]) for i in range(60)]
    rows += [(100 + i, [r.random() for _ in range(5)]) for i in range(25)] + [(200, []), (201, [])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, e array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in knn.top_k(frame(rows), "vec_id", "e", k=7, pivots=5).collect()}
    assert got == top(rows, 7, 20)
    wide = [(0, [2e15, 0.0]), (1, [0.0, 2e15]), (2, [1e-2, 3e15])]
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in knn.top_k(frame(wide[:2]), "vec_id", "e").collect()} == {(0, 1): (1, 0)}
    assert knn.top_k(frame(wide), "vec_id", "e").count() == 2
    for rows in ([(0, [2e15]), (1, [3e15])], [(0, [2e15]), (1, [-3e15])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="64-bit"):
            knn.top_k(frame(rows), "vec_id", "e").collect()


def test_knn_prunes_clusters(spark):
    r = np.random.default_rng(5)
    centres = 3 * np.eye(8)
    rows = [(i, [float(x) for x in centres[i % 8] + r.normal(0, 0.02, 8)]) for i in range(800)]
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in knn.top_k(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e", block=8).collect()}
    assert got == top(rows, 20, 20)


def test_net_by_loops():
    net = toxicity.Net(3)
    net.shift = np.float32(0.3)
    for text in (b"some words of a text and more of them", b"", b"one"):
        buckets, _ = toxicity.word_buckets([text])
        x = [sum(net.emb[b].astype(float) for b in w) for w in buckets] or [np.zeros(toxicity.DIM)]
        x += [np.zeros(toxicity.DIM)] * toxicity.PAD
        z = 0.3
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(x[i + j] @ net.conv[w][j][:, f]) for j in range(width)) + float(net.bias[w][f]) for i in range(len(x) - toxicity.PAD))
                z += max(best, 0) * float(net.out[w * toxicity.FILTERS + f])
        assert net.logits([text])[0] == pytest.approx(z, abs=1e-4)


def test_toxicity_of_long_equal_and_few_rows(spark):
    r = random.Random(1)
    long = prose(r, 60_000)
    docs = documents(spark, [long, long, "snarfox", "snarfox", (7, "a"), (7, "b"), (None, "c")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(0, 1)], "doc_id long, toxic int")
    got = [(x.doc_id, x.score) for x in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()]
    of = lambda i: [s for d, s in got if d == i]
    assert len(got) == 7 and of(0) == of(1) and of(2) == of(3) and all(0 <= s <= 1 for _, s in got)
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_ftrl_by_dense_loops():
    rows = [(langid.vector(t, np.ones(langid.BUCKETS)), y) for t, y in (("abc abd", 0), ("xyz", 1), ("abc xyz", 2), ("abd", 0), ("xyz zyx", 1))]
    model = langid.Ftrl(3)
    z, n = np.zeros((3, langid.BUCKETS)), np.zeros((3, langid.BUCKETS))
    for (at, x), y in rows * 2:
        model.learn(at, x, y)
        dense = np.zeros(langid.BUCKETS)
        dense[at] = x
        w = np.zeros_like(z)
        for c in range(3):
            for i in np.flatnonzero(np.abs(z[c]) > model.l1).tolist():
                w[c, i] = -(z[c, i] - math.copysign(model.l1, z[c, i])) / ((model.beta + math.sqrt(n[c, i])) / model.alpha + model.l2)
        s = w @ dense
        p = np.exp(s) / np.exp(s).sum()
        for c in range(3):
            for i in np.flatnonzero(dense).tolist():
                g = (p[c] - (c == y)) * dense[i]
                z[c, i] += g - (math.sqrt(n[c, i] + g * g) - math.sqrt(n[c, i])) / model.alpha * w[c, i]
                n[c, i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.abs(z).max() > 0.1


def test_language_of_long_and_equal_texts(spark):
    rows = language_rows(random.Random(4), 30)
    long = " ".join(t for x, t in rows if x == "bb") * 200
    docs = documents(spark, [t for _, t in rows] + [long, long, (3, "bado"), (3, "thron")], [x for x, _ in rows] + ["bb"] * 4)
    model = langid.fit(docs)
    got = [(x.doc_id, x.lang_pred, x.score) for x in langid.identified(docs, model).collect()]
    assert len(got) == len(rows) + 4 and {x[1:] for x in got if x[0] in (len(rows), len(rows) + 1)} == {("bb", model.predict(long)[1])}


def test_mixing_by_dense_descent(spark):
    r = random.Random(8)
    rows = language_rows(r, 25)
    docs = documents(spark, [t for _, t in rows] + [None, (3, rows[0][1])], [x for x, _ in rows] + ["aa", "aa"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, quality int")
    mix = mixing.fit_mix(docs, labels, mixing.smoothed(), iterations=13, tolerance=0.0)
    held = mixing.with_rates(mix.documents, mix).collect()
    p, n = np.array([x.posterior for x in held]), np.array([x.n_tokens for x in held], float)
    rate, total = np.ones(len(held)), n.sum()
    pi = np.maximum((n @ p) / total, 1e-9)
    target = np.array(mixing.smoothed()(mix.classifier.domains, (n @ p / total).tolist()))
    for _ in range(13):
        rate = np.maximum(0, rate - p @ (((rate * n) @ p / total - target) / pi))
    assert np.allclose(rate, [x.rate for x in held], atol=1e-9) and len(held) == len(rows) + 2
    assert all(x.n_tokens == len(words(t)) for x, t in zip(sorted((x for x in held if x.doc_id < len(rows) and x.doc_id != 3), key=lambda x: x.doc_id), [t for i, (_, t) in enumerate(rows) if i != 3], strict=True))


def test_domains_beyond_the_most_are_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    docs = documents(spark, [f"t{i} word" for i in range(40)], [f"l{i % 8}" for i in range(40)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    model = mixing.fit(docs, labels)
    assert len(model.domains) == 3 and "other" in model.domains and sum(model.prior) == pytest.approx(1)


def test_lattice_score_by_plain_loops(spark):
    """The whole model on a small corpus, with dictionaries and one word at a time."""
    texts = ["the cat sat on the mat", "The dog sat", "le chat the", None, "zzqx the", "un chat dort"]
    langs = ["en", "en", "fr", "en", "en", "fr"]
    train = [True, True, True, True, False, True]
    vocab = lattice.load(lattice.vocabulary())
    prior = dict(zip(vocab.pieces[256:], vocab.prior[256:], strict=True))

    def pieces(p, text, i, j):
        return p.get(text[i:j], 0.0) + (p.get((text[i],), 0.0) if j == i + 1 else 0.0)

    prior |= {(b,): vocab.prior[b] for b in range(256)}

    def forward(p, w):
        text, f = b" " + w, [1.0]
        for j in range(1, len(text) + 1):
            f.append(sum(f[i] * pieces(p, text, i, j) for i in range(j)))
        return text, f

    tokens = [words(t, True) for t in texts]
    types = {w for t, keep in zip(tokens, train, strict=True) if keep for w in t}
    expected = Counter()
    for w in types:
        text, f = forward(prior, w)
        back = [0.0] * len(text) + [1.0]
        for i in range(len(text) - 1, -1, -1):
            back[i] = sum(pieces(prior, text, i, j) * back[j] for j in range(i + 1, len(text) + 1))
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                for name in [text[i:j]] + [(text[i],)] * (j == i + 1):
                    expected[name] += f[i] * prior.get(name, 0.0) * back[j] / f[-1]
    extra = 1 + 0.01 * sum(expected.values())
    learned = {x: (expected[x] + extra * q) / (sum(expected.values()) + extra) for x, q in prior.items()}
    end = object()
    by = {k: Counter(w for t, c, keep in zip(tokens, langs, train, strict=True) if keep and c == k for w in [*t, end]) for k in ("en", "fr")}
    every = by["en"] + by["fr"]
    once, twice = (sum(c == i for c in every.values()) for i in (1, 2))
    d = once / (once + 2 * twice)

    def p_all(w):
        lower = 0.0 if w is end else forward(learned, w)[1][-1]
        return max(every[w] - d, 0) / every.total() + d * len(every) / every.total() * lower

    def p_own(w, k):
        return max(by[k][w] - d, 0) / by[k].total() + d * len(by[k]) / by[k].total() * p_all(w)

    n_texts = {k: by[k][end] for k in by}
    docs = documents(spark, texts, langs).withColumn("held_out", ~F.array(*[F.lit(x) for x in train])[F.col("doc_id").cast("int")])
    for x in lattice.scored(docs, lattice.vocabulary()).collect():
        want = sum(n_texts[k] / sum(n_texts.values()) * math.prod(p_own(w, k) for w in [*tokens[x.doc_id], end]) for k in by)
        assert x.score == pytest.approx(math.log10(want), rel=1e-6) and x.train_tokens == every.total()


def test_bpe_of_no_rows_and_its_ids(spark):
    docs = documents(spark, ["Hello, world", None])
    assert bpe.encoded(docs.limit(0), bpe.vocabulary()).count() == 0
    coder = bpe.Codec(bpe.vocabulary())
    for x in bpe.encoded(docs, bpe.vocabulary(), keep_ids=True).collect():
        raw = np.array(x.ids, np.int32).tobytes()
        assert hashlib.sha256(raw).hexdigest() == x.ids_sha256 and hashlib.sha256(coder.decode(raw).encode()).hexdigest() == x.decoded_sha256


def test_successors_of_uneven_ids_long_texts_and_repeats(spark):
    r = random.Random(3)
    ids = [r.randrange(50) for _ in range(60)] + [10**12 + r.randrange(10**6) for _ in range(300)] + [-5, None, None]
    rows = [(i, f"{'x' * (70_000 if n % 50 == 0 else 3)} {n}") for n, i in enumerate(ids)]
    got = merkle.with_successor(documents(spark, rows), ["text", "doc_id"], rows_per_bucket=7).collect()
    assert len(got) == len(rows)
    order = sorted({i for i in ids if i is not None}, reverse=True)
    after = Counter((x.doc_id, x.next_doc_id) for x in got)
    count = Counter(ids)
    chain = [*order, None]
    want = Counter()
    for a, b in zip(chain, [*chain[1:], chain[0]], strict=True):
        want[a, a] += count[a] - 1
        want[a, b] += 1
    assert after == +want and len({x.next_text for x in got}) == len(rows)


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    r = random.Random(12)
    passage = prose(r, 60)
    texts = []
    for i in range(150):
        t = prose(r, r.randint(20, 90), 3000)
        texts.append(f"{t} grommel snarfox grommelix" if i % 6 == 0 else f"{t} {passage}" if i % 17 == 1 else t)
        if i % 10 == 3:
            texts.append(t + " end")
    texts += [None, "", "x", texts[1], texts[1]]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, texts, [("aa", "bb")[i % 2] for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i % 3 > 0), int("snarfox" in (t or ""))) for i, t in enumerate(texts) if i % 5]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_corpus_pipeline(spark, corpus_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x.doc_id: x for x in docs.collect()}
        out = stage(spark, docs, corpus_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            kept = {x.doc_id for x in rows}
            toxic = {i for i, x in before.items() if "snarfox" in (x.text or "")}
            assert len(toxic & kept) <= 0.1 * len(toxic) and len(set(before) - kept - toxic) <= 0.1 * len(before)
        elif name == "near_duplicates":
            order = sorted(before)
            want = linked([before[i].text or "" for i in order], 5, 80)
            assert {x.doc_id for x in rows} == {i for n, i in enumerate(order) if want[n][1] == n} != set(order)
        elif name == "substring_dedup":
            assert len(rows) == len(before) and sum(x.text != before[x.doc_id].text for x in rows) > 3
            assert all(x.n_chars == len(x.text) for x in rows if x.text != before[x.doc_id].text)
        elif name == "mixing":
            assert rows and {(x.doc_id, x.text) for x in rows} <= {(x.doc_id, x.text) for x in before.values()}
        else:
            assert len(rows) == docs.count() and all(x.n_tokens == len(x.ids) for x in rows)
    last = Counter(tuple(x) for x in rows_of(docs))
    assert Counter(tuple(x) for x in rows_of(corpus_pipeline.run(spark, corpus_dir))) == last


def rows_of(df):
    return [(x.doc_id, x.n_tokens, x.ids_sha256) for x in df.collect()]


def test_corpus_pipeline_of_empty_tables(spark, corpus_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
