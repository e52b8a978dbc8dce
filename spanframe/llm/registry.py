"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from spanframe.llm import ann, bpe_codec, language_id, media, mixing, pii, secret_scan, simhash_dedup, substring_dedup, token_counts

MODULES = [pii, token_counts, ann, media, bpe_codec, language_id, mixing, secret_scan, simhash_dedup, substring_dedup]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
