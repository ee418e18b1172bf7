"""Exact SQL literals for building large expressions as one SQL string.

Building an expression tree from many small ``Column`` objects costs one
driver->JVM call per node; a generated SQL fragment is parsed in a single
call.  Doubles are written with a ``D`` suffix (an unsuffixed ``0.1`` is a
DECIMAL literal in Spark SQL) using Python's shortest round-trip repr, so
the value is bit-exact.
"""

from __future__ import annotations

import math


def dlit(v) -> str:
    """Double literal (NULL, +-Infinity and NaN included)."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"{v!r}D" if v >= 0 else f"({v!r}D)"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
