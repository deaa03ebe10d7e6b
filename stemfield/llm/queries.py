"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, jaccard, knn, langid, lattice, merkle, mixing, substring, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc": warc.op2_warc,
    "op3_knn": knn.op3_knn,
    "op4_langid": langid.op4_langid,
    "op5_substring": substring.op5_substring,
    "op6_bpe": bpe.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_lattice": lattice.op8_lattice,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_fingerprints": merkle.op10_fingerprints,
}

SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_knn": knn.OP3_SQL,
    "op5_substring": substring.OP5_SQL,
    "op9_jaccard": jaccard.OP9_SQL,
    "op10_fingerprints": merkle.OP10_SQL,
}
