"""Labelled 2-D point sets (S-07..S-11), generated by Spark from ``spark.range``.

Every row draws its own coordinates from seeded ``rand``/``randn`` column
expressions, so generation is parallel and needs no driver-side arrays.
(The reference draws from numpy; values are statistically, not bitwise,
comparable.)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_blobs(spark: SparkSession, n: int = 500, centers: int = 3, std: float = 1.0,
                seed: int = 42, box: float = 10.0) -> DataFrame:
    """Gaussian blobs; centres drawn uniformly in [-box, box]^2 from the seed."""
    import random
    rnd = random.Random(seed)
    cs = [(rnd.uniform(-box, box), rnd.uniform(-box, box)) for _ in range(centers)]
    lab = (F.col("id") % centers).cast("int")
    cx = F.element_at(F.array(*[F.lit(c[0]) for c in cs]), lab + 1)
    cy = F.element_at(F.array(*[F.lit(c[1]) for c in cs]), lab + 1)
    return spark.range(n).select("id", (cx + F.randn(seed) * std).alias("f1"),
                                 (cy + F.randn(seed + 1) * std).alias("f2"), lab.alias("label"))


def synth_moons(spark: SparkSession, n: int = 500, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Two interleaving half circles."""
    half = n // 2
    outer = F.col("id") < half
    t = F.when(outer, F.col("id") / F.lit(max(half - 1, 1))).otherwise(
        (F.col("id") - half) / F.lit(max(n - half - 1, 1))) * F.lit(math.pi)
    x = F.when(outer, F.cos(t)).otherwise(1 - F.cos(t))
    y = F.when(outer, F.sin(t)).otherwise(0.5 - F.sin(t))
    return spark.range(n).select("id", (x + F.randn(seed) * noise).alias("f1"),
                                 (y + F.randn(seed + 1) * noise).alias("f2"),
                                 F.when(outer, 0).otherwise(1).alias("label"))


def synth_circles(spark: SparkSession, n: int = 500, noise: float = 0.05, factor: float = 0.5,
                  seed: int = 42) -> DataFrame:
    """Two concentric circles, the inner one scaled by ``factor``."""
    half = n // 2
    outer = F.col("id") < half
    t = F.when(outer, F.col("id") / F.lit(half)).otherwise((F.col("id") - half) / F.lit(n - half)) \
        * F.lit(2 * math.pi)
    r = F.when(outer, F.lit(1.0)).otherwise(F.lit(factor))
    return spark.range(n).select("id", (r * F.cos(t) + F.randn(seed) * noise).alias("f1"),
                                 (r * F.sin(t) + F.randn(seed + 1) * noise).alias("f2"),
                                 F.when(outer, 0).otherwise(1).alias("label"))


def synth_aniso(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Three blobs sheared by the fixed matrix [[0.6, -0.6], [-0.4, 0.8]]."""
    b = synth_blobs(spark, n, 3, 1.0, seed)
    return b.select("id", (F.col("f1") * 0.6 + F.col("f2") * -0.4).alias("f1"),
                    (F.col("f1") * -0.6 + F.col("f2") * 0.8).alias("f2"), "label")


def synth_varied(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Three blobs of n//3 points: centres (0,0), (3,3), (-3,3); std 0.3, 1.0, 0.5."""
    m = n // 3
    parts = []
    # Centres and spreads of the varied-density set.
    for i, (cx, cy, sd) in enumerate([(0.0, 0.0, 0.3), (3.0, 3.0, 1.0), (-3.0, 3.0, 0.5)]):
        parts.append(spark.range(i * m, (i + 1) * m).select(
            "id", (F.lit(cx) + F.randn(seed + 2 * i) * sd).alias("f1"),
            (F.lit(cy) + F.randn(seed + 2 * i + 1) * sd).alias("f2"), F.lit(i).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SHAPES = {"blobs": synth_blobs, "moons": synth_moons, "circles": synth_circles,
          "aniso": synth_aniso, "varied": synth_varied}
