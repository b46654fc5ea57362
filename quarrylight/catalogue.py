"""Every registered query of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from quarrylight.plans import decisions, documents, lookups, pages, state

QUERIES = decisions.QUERIES | documents.QUERIES | lookups.QUERIES | pages.QUERIES | state.QUERIES
ORACLE_SQL = decisions.SQL | documents.SQL | lookups.SQL | pages.SQL | state.SQL
flagship = documents.doc_prefix_duplicates
