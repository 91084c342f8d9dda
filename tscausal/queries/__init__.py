"""Registered queries: each a function of (spark, sf_dir), most with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Less than half a unit of the last place: means of prices often end in an exact half there, which engines round differently.
NUDGE = 3.7e-8
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def rounded(x: str | Column) -> Column:
    """Six places, without a negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + NUDGE, 6) + 0.0


def r6(x: str) -> str:
    """The same in SQL."""
    return f"(round({x} + {NUDGE}, 6) + 0.0)"


def corr(x: str, y: str) -> str:
    """SQL: correlation, null if either side does not vary."""
    return f"CASE WHEN var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) > 0 AND var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) > 0 THEN corr({x}, {y}) END"
