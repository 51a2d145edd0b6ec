"""The queries of all modules here, and their SQL."""

from __future__ import annotations

from quarryline.llm import backoff, exact_dedup, fingerprints, langid, mixing, packing, pii, secrets, sharding, signature_join, toxicity, treap_search, whitening

MODULES = (backoff, exact_dedup, fingerprints, langid, mixing, packing, pii, secrets, sharding, signature_join, toxicity, treap_search, whitening)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
