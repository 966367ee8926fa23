"""Queries of the text operators."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, embedding_dups, filter_audit, langid, pii, quality, secret_forest, simhash, suffix_dedup, toxicity, warc

MODULES = (simhash, bpe, secret_forest, pii, toxicity, langid, decontaminate, suffix_dedup, warc, quality, filter_audit, divergence, embedding_dups)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
