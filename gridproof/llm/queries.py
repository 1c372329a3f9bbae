"""Registered queries of the operators, one module each, and their SQL."""

from __future__ import annotations

from . import q_bpe, q_clusters, q_divergence, q_langid, q_minhash, q_packing, q_quality, q_secrets, q_substrings, q_tokencounts, q_toxicity, q_training_order, q_vectors

_MODULES = (q_packing, q_bpe, q_quality, q_toxicity, q_training_order, q_vectors, q_secrets, q_langid, q_minhash, q_substrings, q_divergence, q_clusters, q_tokencounts)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQLS.items()}
