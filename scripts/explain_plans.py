"""Print the physical plans of representative stages (for plan review).

usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from pyspark.sql import functions as F  # noqa: E402

from tessera.functions.columns import stack_long  # noqa: E402
from tessera.operators import rules as R  # noqa: E402
from tessera.operators.neighbors import pair_distances  # noqa: E402
from tessera.operators.retail import clean_retail  # noqa: E402
from tessera.plans.common import LINEITEM_NUM, lineitem_nulls  # noqa: E402
from tessera.session import get_spark  # noqa: E402
from tessera.sources.tables import load, retail_view  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 16)
    stages = {
        "rfm per-customer aggregate": clean_retail(retail_view(spark, sf)).groupBy("CustomerID").agg(
            F.max("InvoiceDate"), F.count_distinct("InvoiceNo"), F.sum("TotalPrice")),
        "describe moments (long form)": stack_long(lineitem_nulls(spark, sf), LINEITEM_NUM)
            .groupBy("column").agg(F.avg("value"), F.skewness("value")),
        "baskets": R.build_baskets(retail_view(spark, sf), "InvoiceNo", "Description"),
        "pair tiles": pair_distances(load(spark, sf, "customer").limit(200), "c_custkey",
                                     ["c_acctbal", "c_nationkey"], blocks=4),
    }
    for name, df in stages.items():
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
