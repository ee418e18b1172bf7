"""Benchmark: wall time of the headline queries at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_QUERIES (comma list, optional), BENCH_REPEAT (1), BENCH_GROWTH (0).  Each
query is built and fully executed (noop sink, no collect) in a warm session;
prints one JSON line with per-query seconds, their sum and, with
BENCH_GROWTH=1, the factor from the next smaller scale factor to this one (all
queries run there too, so allow twice the time).  Queries under
``AGAIN_S`` seconds are repeated and give their median; longer ones run once.
Every modelling query derives its customer table itself.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import REGISTRY  # noqa: E402
from tessera.session import get_spark  # noqa: E402

HEADLINE = [
    "retail_clean", "rfm", "rfm_subday", "column_profile", "describe_stats", "histogram", "box_stats",
    "corr_pearson", "corr_spearman", "pairwise_euclidean", "impute_median", "cap_iqr", "scale_robust",
    "bin_quantile", "pca", "outlier_flags", "impact", "baskets", "itemsets_type", "rules_type",
    "itemsets_brand", "gaussian_nb", "class_report", "roc", "auc", "cluster_profile", "kmeans",
    "model_dt", "corr_kendall", "outlier_lof", "knn_classify", "dbscan",
    "outlier_iforest", "silhouette", "model_rf",
]
AGAIN_S = 4.0
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g"),
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-bench-")})
    small = None
    if os.environ.get("BENCH_GROWTH", "0") == "1":
        base = os.path.basename(sf_dir.rstrip("/"))
        small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), SMALLER.get(base, ""))
        small = small if base in SMALLER and os.path.isdir(small) else None

    def run(name: str, where: str) -> float:
        t0 = time.perf_counter()
        REGISTRY[name][0](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("retail_clean", sf_dir)  # warm-up: JVM, parquet readers, codegen caches
    times, growth = {}, {}
    for name in names:
        before = run(name, small) if small else None
        runs = [run(name, sf_dir)]
        while len(runs) < repeat and runs[0] < AGAIN_S:
            runs.append(run(name, sf_dir))
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
        if before:
            growth[name] = round(times[name] / before, 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir, "growth": growth}))
    spark.stop()


if __name__ == "__main__":
    main()
