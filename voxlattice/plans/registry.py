"""Queries with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Moves exact halves of the sixth decimal, which engines round either way, off the edge.
_NUDGE = 3.37e-8


def r6(x) -> Column:
    """Six decimals, so that the order of a sum doesn't show."""
    return F.round((F.col(x) if isinstance(x, str) else x) + _NUDGE, 6)


def R(x: str) -> str:
    return f"(round({x} + {_NUDGE}, 6) + 0.0)"


def query(sql: str | None = None):
    """Register a query under its function's name; the views that the SQL names are put before it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            used = [v for v in views.SQL if re.search(rf"\b{v}\b", sql)]
            head = ", ".join(f"{v} AS ({views.SQL[v]})" for v in used)
            body = sql.strip()
            recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body) else ""
            own = re.match(r"WITH (RECURSIVE )?", body)
            if used:
                body = f"WITH {recursive}{head}, {body[own.end():]}" if own else f"WITH {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return keep
