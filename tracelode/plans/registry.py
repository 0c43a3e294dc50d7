"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import cases, curation, episodes, packs, retrieval, rules

QUERIES = retrieval.QUERIES | episodes.QUERIES | curation.QUERIES | cases.QUERIES | rules.QUERIES | packs.QUERIES
ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | episodes.ORACLE_SQL | curation.ORACLE_SQL | cases.ORACLE_SQL | rules.ORACLE_SQL | packs.ORACLE_SQL
FLAGSHIP = "bm25_topk"
