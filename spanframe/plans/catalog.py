"""The queries over the given tables and their DuckDB equivalents.

Each runs over its whole tables, but string_hashes, fuzzy_predicates and phrase_match_candidates take what their SQL can follow;
the queries of the same names with _whole take all tokens and passages, and have no SQL. A query and its SQL name their columns alike.
"""

from __future__ import annotations

from spanframe.plans import catalog_labels, catalog_lexical, catalog_models, catalog_more, catalog_rules, catalog_vectors

_PARTS = (catalog_lexical, catalog_rules, catalog_labels, catalog_vectors, catalog_models, catalog_more)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
