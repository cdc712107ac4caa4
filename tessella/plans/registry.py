"""All queries of the core, by name."""

from __future__ import annotations

from . import clauses, conflicts, corpus, documents, extraction, extractor, extras, retrieval, rights, search, staging

MODULES = [corpus, rights, conflicts, retrieval, search, clauses, extraction, extractor, documents, extras, staging]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
