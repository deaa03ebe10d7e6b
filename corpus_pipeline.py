"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
sources are mixed to target weights, and the rest is encoded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemfield.llm import bpe, jaccard, mixing, substring, toxicity
from stemfield.llm.common import table
from stemfield.session import persist_table, ship_package

#: Near duplicates: shingles of five words, similarity of at least 0.8.
SHINGLE, PERCENT = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language. The classifier learns from the labelled documents; with no labels of
    one kind all stay. A null or empty text has the score of no words; rows of one id are judged each by its text. No documents give none."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("not toxic").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates; rows without an id stay."""
    ship_package(spark)
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"), SHINGLE, PERCENT)
    gone = persist_table(groups.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "pipeline-gone")
    few = gone.count() <= jaccard.BROADCAST_IDS  # ids of bounded size spare the texts a shuffle
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; a text that loses nothing stays as it is, null and empty ones with it. A row
    whose text is all repeats stays with an empty one. A null id is the smallest, and rows of one id are told apart by their texts."""
    ship_package(spark)
    out = substring.without_repeats(docs).withColumns({"text": F.when(F.col("text").isNotNull(), F.col("kept"))})
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def goal(domains: list[str], shares: list[float]) -> list[float]:
    """Good domains grow towards even shares, none shrinks; poor ones (``-0``) are halved."""
    good = [s for d, s in zip(domains, shares, strict=True) if not d.endswith("-0")]
    most = max(good, default=1.0) or 1.0
    return [0.5 * s if d.endswith("-0") else 1.05 * s * (most / max(s, 1e-9)) ** 0.3 for d, s in zip(domains, shares, strict=True)]


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that the expected tokens of the domains meet the goal. Null and empty texts have no
    tokens and the rate of their posterior; rows of one id are drawn each by its text. With no labels there is one domain, at 1.05 of its tokens."""
    ship_package(spark)
    mix = mixing.fit_mix(docs, table(spark, sf_dir, "labels"), goal, keep=True)
    return mixing.realised(mix)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row: the corpus as token ids. A null or empty text has none; rows of
    one id are encoded each for itself."""
    ship_package(spark)
    return bpe.encoded(docs, bpe.vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("substring_dedup", without_passages),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
