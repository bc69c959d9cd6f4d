"""Queries of the operators in this package, and the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from tracewright.llm import divergence, exact_dedup, hard_negatives, langid, licenses, mixing, order_minhash, packing, pii, quality, top_k, vector_graph, wordpiece

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": wordpiece.op4_token_counts,
    "op5_near_duplicates": order_minhash.op5_near_duplicates,
    "op6_quality": quality.op6_quality,
    "op7_vector_links": vector_graph.op7_vector_links,
    "op8_language_id": langid.op8_language_id,
    "op9_licenses": licenses.op9_licenses,
    "op10_mixing": mixing.op10_mixing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_top_k": top_k.op13_top_k,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_top_k": top_k.OP13_SQL,
}
