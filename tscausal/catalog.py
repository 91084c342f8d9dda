"""Every query of the library, with its SQL twin."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, edges, edm, forecasts, panels  # noqa: F401

FLAGSHIP = "crossmap_skill"
