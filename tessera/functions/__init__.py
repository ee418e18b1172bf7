"""Column-expression helpers and distributed statistics primitives."""

from tessera.functions.columns import (  # noqa: F401
    numeric_cols, any_of, stack_long,
)
from tessera.functions.quantile import quantiles, quantile_table  # noqa: F401
from tessera.functions.mode import modes  # noqa: F401
