"""Every named query of the engine and its SQL counterpart."""

from __future__ import annotations

from . import checks, episodes, records, redacted, whole

PARTS = (episodes, records, checks, whole)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in (*PARTS, redacted) for name, sql in part.ORACLES.items()}
