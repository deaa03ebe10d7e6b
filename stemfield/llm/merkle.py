"""Document fingerprints: a Merkle tree over paragraphs (leaves) and sections, in DataFrame functions only.

A section is a line of the text; its paragraphs are pieces of at most 24 code points that end early behind
``. ! ?`` or the line. Every paragraph is hashed, a section's hash covers its paragraphs' hashes, the root covers
the sections'. The fingerprint is ``root:section=leaf,leaf,...;section=...`` with the root in full and eight hex
digits of every other node: roots decide equality, differing sections and leaves locate edits.

Nulls and empties: a null text is the empty text, which has one section with no paragraphs and a defined root. Likeness
of two fingerprints is 2 * shared / (paragraphs of both), each distinct paragraph counted once; two texts with no paragraphs have
likeness 1, one against another with some 0. Repeated rows give repeated results; rows of equal doc_id follow each other in
the order of their texts' hashes. A table of one row is its own successor. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import persist_table
from .common import boxed, few_broadcast, table, unboxed

#: Longest paragraph, in code points.
LEAF = 24
#: Quantiles of the ids that the driver holds, at most.
CUTS = 256
PIECES = rf"(?s).{{1,{LEAF}}}?[.!?]+ ?|.{{1,{LEAF}}}"


def tree(text: Column) -> Column:
    """Sections as ``struct(hash, leaves)``, hashes in full hex."""
    line = lambda x: F.transform(F.regexp_extract_all(x, F.lit(PIECES), F.lit(0)), lambda y: F.sha2(y, 256))
    return F.transform(F.transform(F.split(text, "\n", -1), line), lambda leaves: F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("hash"), leaves.alias("leaves")))


def render(sections: Column) -> Column:
    """The fingerprint of a tree."""
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)
    part = lambda s: F.concat(F.substring(s["hash"], 1, 8), F.lit("="), F.array_join(F.transform(s["leaves"], lambda x: F.substring(x, 1, 8)), ","))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(sections, part), ";"))


def fingerprint(text: Column) -> Column:
    return render(tree(F.coalesce(text, F.lit(""))))


def leaves_of(fp: Column) -> Column:
    """Distinct paragraph hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit("(?<=[=,])[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of paragraph hashes."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections in which two fingerprints differ; empty exactly if the roots are equal
    or only the count of sections is the same and all agree."""
    parts = lambda x: F.split(F.substring_index(x, ":", -1), ";", -1)
    x, y = parts(a), parts(b)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    )


def with_successor(docs: DataFrame, carried: list[str], rows_per_bucket: int = 2048) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the ``carried`` columns of the row behind in descending doc_id as ``next_*``; behind
    the last comes the first. Columns of those names are replaced.

    Rows are dealt into ranges of doc_id, in proportion to their number; the head row of each range also goes to the range before it as a
    ghost, so every row finds its successor in its own range and the texts are shuffled once. ``CUTS`` quantiles at most are taken to the driver, and the
    ids between two of them are cut evenly. The heads, one a range, are a table.
    """
    rank = F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1))
    ids = docs.select(rank.alias("rank"))
    n, low, high = ids.agg(F.count(F.lit(1)), F.coalesce(F.min("rank"), F.lit(0)), F.coalesce(F.max("rank"), F.lit(0))).first()
    ranges = max(1, n // rows_per_bucket)
    top = min(CUTS, ranges)
    cuts = sorted({int(x) for x in ids.agg(F.percentile_approx("rank", [i / top for i in range(1, top)], 10_000)).first()[0]}) if top > 1 else []
    each = -(-ranges // (len(cuts) + 1))
    lists = lambda xs: "array(" + ",".join(f"{x}D" for x in xs) + ")"
    at = f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < rank))" if cuts else "0"
    left, right = (f"get({lists(x)}, {at})" for x in ([low, *cuts], [*cuts, high]))
    inside = f"least({each - 1}L, greatest(0L, cast(floor((double(rank) - {left}) / greatest(1D, {right} - {left}) * {each}D) as long)))" if each > 1 else "0L"
    bucket = F.expr(f"{at} * {each}L + {inside}")
    heads = ids.select("rank", bucket.alias("bucket")).groupBy("bucket").agg(F.min("rank").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row a range
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    serves = persist_table(heads.select(F.col("head").alias("_head"), before.alias("_serves")), "merkle-heads")
    dealt = boxed(docs, rank=rank).withColumn("bucket", bucket).join(few_broadcast(serves), F.col("rank") == F.col("_head"), "left")
    to = F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("_serves").alias("b"), F.lit(1).alias("ghost"))), lambda x: x["b"].isNotNull())
    dealt = dealt.select("row", "rank", F.explode(to).alias("to")).select("row", "rank", "to.b", "to.ghost")
    w = Window.partitionBy("b").orderBy("ghost", "rank", F.xxhash64("row.text"))
    followed = dealt.withColumn("after", F.lead("row").over(w)).where("ghost = 0")  # the row itself: an expression of it would be shuffled beside it
    return unboxed(followed, **{f"next_{c}": F.col("after").getField(c) for c in carried})


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_successor(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    pairs = pairs.withColumns({"_own": leaves_of(F.col("fingerprint")), "_edited": leaves_of(F.col("edited_fingerprint")), "_after": leaves_of(F.col("next_fingerprint"))})
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, length(text) AS n, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM o),
s AS (SELECT doc_id, n, edited, list_transform([text, edited, nxt], lambda t: list_transform(string_split(t, chr(10)),
        lambda x: list_transform(regexp_extract_all(x, '(?s).{{1,{LEAF}}}?[.!?]+ ?|.{{1,{LEAF}}}'), lambda y: sha256(y)))) AS trees FROM e),
h AS (SELECT doc_id, n, edited, list_transform(trees, lambda t: list_transform(t, lambda leaves: {{'hash': sha256(array_to_string(leaves, '')), 'leaves': leaves}})) AS trees FROM s),
f AS (SELECT doc_id, n, edited, list_transform(trees, lambda t: sha256(array_to_string(list_transform(t, lambda x: x.hash), '')) || ':' ||
        array_to_string(list_transform(t, lambda x: left(x.hash, 8) || '=' || array_to_string(list_transform(x.leaves, lambda y: left(y, 8)), ',')), ';')) AS fps,
        list_transform(trees, lambda t: list_distinct(flatten(list_transform(t, lambda x: list_transform(x.leaves, lambda y: left(y, 8)))))) AS ls FROM h)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fps[1] AS fingerprint, fps[2] AS edited_fingerprint,
  CASE WHEN len(ls[1]) + len(ls[2]) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(ls[1], ls[2])) / (len(ls[1]) + len(ls[2])) END AS near_edited,
  CASE WHEN len(ls[1]) + len(ls[3]) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(ls[1], ls[3])) / (len(ls[1]) + len(ls[3])) END AS near_next
FROM f
"""
