"""Silhouette with plain Euclidean distance in linear work (K-02).

The mean distance of a row to a cluster is a weighted sum over a sample of the
cluster.  A member y enters with probability ``min(1, m * p)``, ``p``
proportional to its distance from the cluster's mean plus the average such
distance, decided by a hash of its id, and counts ``1 / probability``.  As the
mean distance of any row to the cluster is at least its distance to the mean
and at least half that average, the estimate is unbiased with a relative
root-mean-square error of at most ``2 / sqrt(m)``, whatever the shape of the
cluster.  Clusters of at most m / 2 rows enter whole and are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lloyd import _chunks, _squared
from tessera.session import materialize

#: Values (rows x features) of all samples together, and expected sampled rows of a cluster at least.
VALUES, LEAST = 2_000_000, 64


def silhouette_euclidean(df: DataFrame, id_col: str, cols: list[str], label: str, m: int = 4_096) -> tuple[DataFrame, float]:
    """``((id, label, silhouette), bound)``: the silhouette per row and the
    relative error bound of the mean distances behind it (0 when exact).

    Rows with a null label or feature are left out; a lone row and a single
    cluster give 0.  With many clusters ``m`` shrinks so that all samples hold
    ``VALUES`` values, and the bound grows; where fewer than ``LEAST`` rows a
    cluster would be left it raises (``VALUES / LEAST / features`` clusters).
    """
    d = len(cols)
    xs = [f"_x{i}" for i in range(d)]
    rows = materialize(df.select(F.col(id_col).alias("_id"), F.col(label).alias("_lab"),
                                 *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]).na.drop(subset=["_lab", *xs]), "sil")
    means = rows.groupBy("_lab").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(x).alias(f"_m{x}") for x in xs])
    far = F.sqrt(reduce(add, [(F.col(x) - F.col(f"_m{x}")) * (F.col(x) - F.col(f"_m{x}")) for x in xs]))
    off = rows.join(means, "_lab").withColumn("_off", far)
    stats = materialize(off.groupBy("_lab").agg(F.first("_n").alias("_n"), F.avg("_off").alias("_avg")), "sil_c")
    count = stats.count()
    if count * d * LEAST > VALUES:
        raise ValueError(f"{count} clusters; at most {VALUES // (d * LEAST)} are compared")
    if count < 2:
        return rows.select(F.col("_id").alias(id_col), F.col("_lab").alias(label), F.lit(0.0).alias("silhouette")), 0.0
    m = max(LEAST, min(m, VALUES // (count * d)))
    share = F.when(F.col("_avg") > 0, F.lit(m) * (F.col("_off") + F.col("_avg")) / (2 * F.col("_n") * F.col("_avg"))) \
        .otherwise(F.lit(m) / F.col("_n"))
    draw = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("sil"), F.col("_id").cast("string"), *[F.col(x).cast("string") for x in xs])),
                               1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)
    # about m rows a cluster, VALUES values in all
    picked = off.drop("_n").join(stats, "_lab").withColumn("_p", F.least(F.lit(1.0), share)).where(draw <= F.col("_p")) \
        .select("_lab", "_n", "_p", *xs).orderBy("_lab", *xs, "_p").toPandas()
    known = [r["_lab"] for r in stats.orderBy("_lab").collect()]
    place = {c: i for i, c in enumerate(known)}
    size = np.zeros(count)
    for r in stats.collect():
        size[place[r["_lab"]]] = r["_n"]
    at = picked["_lab"].map(place).to_numpy()
    y = picked[xs].to_numpy(float).reshape(len(picked), d)
    weight = 1 / (picked["_n"].to_numpy() * picked["_p"].to_numpy())
    here = np.flatnonzero(np.diff(at, prepend=-1))  # the sample lies cluster by cluster
    held = at[here]
    bound = 0.0 if (picked["_p"] >= 1).all() and len(picked) == size.sum() else 2 / float(np.sqrt(m))
    squared, chunks = _squared, _chunks

    def run(it):
        for part, x in chunks(it, xs):
            mean = np.full((len(x), count), np.inf)  # a cluster without a sample is never the nearest
            for i in range(0, len(x), 256):
                mean[i:i + 256, held] = np.add.reduceat(np.sqrt(squared(x[i:i + 256], y)) * weight, here, axis=1)
            own, me = part["_lab"].map(place).to_numpy(), np.arange(len(x))
            n = size[own]
            a = mean[me, own] * n / np.maximum(n - 1, 1)
            mean[me, own] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            s = np.where((n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pd.DataFrame({"_id": part["_id"], "_lab": part["_lab"], "silhouette": s})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInPandas(run, f"_id {kind['_id']}, _lab {kind['_lab']}, silhouette double")
    return out.select(F.col("_id").alias(id_col), F.col("_lab").alias(label), "silhouette"), bound
