"""Mixing sources to target weights by soft membership, in DataFrame and SQL functions only.

1. A naive Bayes classifier is fitted on a bounded sample of labelled rows (``train_rows``, those of smallest id hash; domain
   = language of the labelled row and its quality): the text's shape (share of symbols, of non-ASCII bytes, of distinct
   lines, word length, length) in bins, and whether it holds each of the words that tell the domains apart best.
2. It gives every document a posterior over the domains; expected tokens of a domain are the sum of tokens * posterior.
3. Projected gradient descent fits rates r >= 0, one for each document, that minimise
   ``sum_k (sum_d r_d n_d p_dk - T_k)^2 / (2 pi_k N^2)``. In the metric of the token counts the step is 1 (the largest
   eigenvalue of the scaled Gram matrix is exactly 1), so an iteration is one sum of K numbers over all documents and
   ``r <- max(0, r - g.p)``. Only these K-vectors are on the driver; rates are a fold over them, so applying the mix is one scan.

Nulls and empties: a null text is an empty one, with no tokens; it takes part with weight 0 and gets the rate of its posterior.
Labelled rows with a null label or language are not learned from; with no labelled rows there is one domain ``all``. Repeated
rows and repeated ids are rows of their own with equal rates. An empty table gives an empty result; further columns pass through,
but ``n_tokens``, ``domain``, ``posterior`` and ``rate`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table
from .common import boxed, table, unboxed

#: The parameter that bounds the labelled sample of the classifier.
TRAIN_ROWS = 20_000
WORDS = 24
#: Shape features: name, expression, number of bins.
SHAPE = [
    ("symbols", "least(15, int(floor(log2(1 + 1024D * _sym / greatest(1, _chars)) * 1.5D)))", 16),
    ("non_ascii", "least(15, int(floor(log2(1 + 1024D * (_bytes - _chars) / greatest(1, _chars)) * 1.5D)))", 16),
    ("lines", "int(floor(15 * _distinct / greatest(1, _lines)))", 16),
    ("word_length", "least(15, int(floor(2D * _chars / greatest(1, _tokens)))) ", 16),
    ("size", "least(15, int(floor(log2(1D + _tokens))))", 16),
]
#: So many domains at most have a target of their own, the commonest of the sample; all others together are the domain ``other``.
MOST_DOMAINS = 64
SHRINK = 0.5  # features are not independent: their log-likelihoods count half


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with what the features need; ``_tokens`` counts words ``[^\\x20\\x09-\\x0D]+``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    return docs.withColumns({
        "_tokens": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "_chars": F.char_length(t), "_bytes": F.octet_length(t),
        "_sym": F.char_length(F.regexp_replace(t, r"[\p{L}\s]+", "")), "_lines": F.size(lines), "_distinct": F.size(F.array_distinct(lines)), "_text": F.concat(F.lit(" "), F.lower(F.translate(t, "\n\t", "  ")), F.lit(" ")),
    })


def _features(words: list[str]) -> list[tuple[str, int]]:
    """Expression of each feature's bin (from 0) and its number of bins."""
    quoted = [w.replace("\\", "\\\\").replace("'", "\\'") for w in words]
    return [(e, n) for _, e, n in SHAPE] + [(f"int(contains(_text, ' {w} '))", 2) for w in quoted]


class Classifier:
    """Domains, priors and the log-likelihood tables; all of bounded size."""

    def __init__(self, domains: list[str], prior: list[float], words: list[str], tables: list[list[list[float]]]):
        self.domains, self.prior, self.words, self.tables = domains, prior, words, tables

    def classified(self, rows: DataFrame, name: str = "posterior") -> DataFrame:
        """``rows`` of ``measured`` with the posterior, ``array<double>`` over the domains."""
        num = lambda x: f"{x!r}D"
        arr = lambda xs: "array(" + ",".join(xs) + ")"
        tables = F.expr(arr(arr(arr(map(num, b)) for b in t) for t in self.tables))
        prior = F.expr(arr(num(math.log(x)) for x in self.prior))
        bins = rows.withColumn("_bins", F.array(*[F.expr(e) for e, _ in _features(self.words)]))
        picked = F.zip_with("_bins", tables, lambda b, t: t[b])
        scored = bins.withColumn("_scores", F.aggregate(picked, prior, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + SHRINK * y)))
        weights = scored.withColumn("_weights", F.transform("_scores", lambda x: F.exp(x - F.array_max("_scores"))))
        total = F.aggregate("_weights", F.lit(0.0), lambda x, y: x + y)
        return weights.withColumn("_total", total).withColumn(name, F.transform("_weights", lambda x: x / F.col("_total"))).drop("_bins", "_scores", "_weights", "_total")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier of (language, label) from a bounded sample of labelled rows."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    sample = docs.select("doc_id", "text", "lang").where("lang is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))  # at most train_rows rows are broadcast
    sample = persist_table(measured(sample.select("text", F.concat_ws("-", "lang", F.col("_label").cast("string")).alias("_domain"))).drop("text"), "mix-sample")
    sizes = {r["_domain"]: r["n"] for r in sample.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_domain").collect()}  # at most one a row of the sample
    if len(sizes) > MOST_DOMAINS:
        own = list(sizes)[: MOST_DOMAINS - 1]
        sample = sample.withColumn("_domain", F.when(F.col("_domain").isin(own), F.col("_domain")).otherwise("other"))
        sizes = {d: sizes[d] for d in own} | {"other": sum(n for d, n in sizes.items() if d not in own)}
    domains = sorted(sizes)
    if not domains:
        return Classifier(["all"], [1.0], [], [[[0.0]] * n for _, n in _features([])])
    # words by which the domains differ most: variance of the share of documents that hold them
    share = sample.select("_domain", F.explode(F.array_distinct(F.split("_text", " +"))).alias("w")).where("length(w) between 1 and 32").groupBy("w", "_domain").agg(F.count(F.lit(1)).alias("n"))
    weight = F.create_map(*[F.lit(x) for d in domains for x in (d, 1.0 / sizes[d])])
    spread = share.withColumn("s", F.col("n") * weight[F.col("_domain")]).groupBy("w").agg((F.sum(F.col("s") * F.col("s")) / len(domains) - F.pow(F.sum("s") / len(domains), 2)).alias("v"))
    words = [r["w"] for r in spread.orderBy(F.desc(F.round("v", 9)), "w").limit(WORDS).collect()]
    features = _features(words)
    bins = F.array(*[F.expr(e) for e, _ in features])
    counts = {(r["f"], r["b"], r["_domain"]): r["n"] for r in sample.select("_domain", F.posexplode(bins).alias("f", "b")).groupBy("f", "b", "_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    tables = [[[math.log((counts.get((f, b, d), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * n)) for d in domains] for b in range(n)] for f, (_, n) in enumerate(features)]
    total = sum(sizes.values())
    return Classifier(domains, [sizes[d] / total for d in domains], words, tables)


class Mix:
    """A fitted mix: the classifier, the targets in tokens, the gradient of each iteration, how far the tokens of any domain are from their target in the
    end (``residual``, as a share of it), and the table of documents (``row, n_tokens, posterior``)."""

    def __init__(self, classifier: Classifier, tokens: float, current: list[float], targets: list[float], steps: list[list[float]], residual: float, documents: DataFrame):
        self.classifier, self.tokens, self.current, self.targets, self.steps, self.residual, self.documents = classifier, tokens, current, targets, steps, residual, documents

    def rate(self, posterior: Column) -> Column:
        return fold(F.lit(1.0), self.steps, posterior)


def fold(start: Column, steps: list[list[float]], posterior: Column) -> Column:
    """``max(0, r - g.p)`` for each gradient g in turn."""
    if not steps:
        return start
    given = F.expr("array(" + ",".join("array(" + ",".join(f"{x!r}D" for x in g) + ")" for g in steps) + ")")
    dot = lambda g: F.aggregate(F.zip_with(g, posterior, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(given, start, lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_mix(docs: DataFrame, labels: DataFrame, goal, iterations: int = 60, tolerance: float = 1e-3, every: int = 10, train_rows: int = TRAIN_ROWS, keep: bool = False) -> Mix:
    """``goal(domains, shares) -> list`` gives the target tokens of each domain as shares of all present tokens. ``keep``: the table of documents
    has all their columns, as ``realised`` needs, not the id alone. Ends within ``tolerance`` of all targets or after ``iterations``."""
    model = fit(docs, labels, train_rows=train_rows)
    k = len(model.domains)
    rows = boxed(docs if keep else docs.select("doc_id", "text"), text=docs["text"])
    base = model.classified(measured(rows)).select("row" if keep else F.struct("row.doc_id").alias("row"), F.col("_tokens").alias("n_tokens"), "posterior")
    base = persist_table(base, "mix-docs")
    narrow = base.select(F.col("n_tokens").alias("_tokens"), F.col("posterior").alias("p"), F.lit(1.0).alias("r"))
    sums = lambda df: [F.coalesce(F.sum(F.col("_tokens") * F.col("r") * F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
    first = narrow.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("n"), *sums(narrow)).first()
    total = max(1.0, float(first["n"]))
    now = [first[f"s{i}"] / total for i in range(k)]
    pi = [max(x, 1e-9) for x in now]
    tau = [float(x) for x in goal(model.domains, now)]
    steps, recent, at, left = [], [], now, 0.0
    for i in range(iterations):
        left = max(abs(a - t) / max(t, 1e-6) for a, t in zip(at, tau, strict=True))
        if left <= tolerance:
            break
        recent.append([(a - t) / p for a, t, p in zip(at, tau, pi, strict=True)])
        steps.append(recent[-1])
        moved = narrow.withColumn("r", fold(F.col("r"), recent, F.col("p")))
        if len(recent) == every:
            narrow, recent = persist_table(moved, "mix-docs"), []
            moved = narrow
        row = moved.agg(*sums(moved)).first()
        at = [row[f"s{j}"] / total for j in range(k)]
    return Mix(model, total, [x * total for x in now], [t * total for t in tau], steps, left, base)


def with_rates(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (row, n_tokens, posterior) as the caller's columns with ``n_tokens``, ``domain``, the likeliest, ``posterior`` and ``rate``."""
    names = F.array(*[F.lit(d) for d in mix.classifier.domains])
    domain = names[(F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")]
    return unboxed(rows, n_tokens=F.col("n_tokens"), domain=domain, posterior=F.col("posterior"), rate=mix.rate(F.col("posterior")))


def rated(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with ``n_tokens, domain, posterior, rate``, from their texts alone; they may be other documents than those of the fit."""
    rows = mix.classifier.classified(measured(boxed(docs, text=docs["text"])))
    return with_rates(rows.select("row", F.col("_tokens").alias("n_tokens"), "posterior"), mix)


def realised(mix: Mix) -> DataFrame:
    """Each document of the fit (with ``keep``) as often as its rate says: the whole part, and one more with the rest as probability, drawn
    from a hash of the id and text, so that repeats of the run draw alike."""
    row = F.col("row")
    draw = F.pmod(F.xxhash64(row.getField("doc_id"), row.getField("text"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = mix.documents.select("row", mix.rate(F.col("posterior")).alias("rate"))
    copies = F.floor("rate").cast("int") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    return unboxed(rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))))


def smoothed(power: float = 0.5, poor: float = 0.25):
    """Shares in proportion to ``share ** power``; those of documents labelled poor (``-0``) by a factor ``poor`` less."""

    def goal(domains: list[str], shares: list[float]) -> list[float]:
        raw = [max(s, 0.0) ** power * (poor if d.endswith("-0") else 1.0) for d, s in zip(domains, shares, strict=True)]
        whole = sum(raw) or 1.0
        return [x / whole for x in raw]

    return goal


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mix = fit_mix(docs, table(spark, sf_dir, "labels"), smoothed())
    return with_rates(mix.documents, mix).select("doc_id", "n_tokens", "domain", "posterior", "rate", F.lit(mix.residual).alias("residual"))
