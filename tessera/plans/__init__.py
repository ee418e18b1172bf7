"""Registered end-to-end queries over the test tables, each with its SQL oracle.

``REGISTRY`` maps a query name to ``(builder(spark, sf_dir) -> DataFrame, sql | None)``.
Modules under this package register themselves on import.
"""

from tessera.plans.registry import REGISTRY, register  # noqa: F401
from tessera.plans import (  # noqa: F401,E402
    q_retail, q_profile, q_preprocess, q_rules, q_outlier, q_classify, q_cluster,
)
