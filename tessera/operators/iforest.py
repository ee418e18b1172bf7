"""Isolation forest (O-04): hash-sampled trees built in parallel, scored in
Arrow batches.

1. Sampling: each row draws a seeded hash per tree and is kept for the trees
   where it falls below ~3·psi/n, the same way at every size.  Each tree keeps
   its ``psi`` smallest hashes.
2. Building: ``groupBy(tree).applyInPandas`` — one task per tree, psi rows
   each (bounded), random feature / split, depth limit ceil(log2 psi).
3. Scoring: the forest (trees x <= 2·psi nodes) is a small table shipped to
   every task; ``mapInPandas`` walks all trees for a batch with numpy.
4. Flag: score above the exact (1 - contamination) quantile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.quantile import quantiles
from tessera.operators.core import require_rows
from tessera.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size long"


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _build(features: list[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_h", "_id"]).head(psi)
        X = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng(seed * 100003 + tree)
        rows = []

        def grow(idx, depth):
            node = len(rows)
            rows.append(None)
            if depth >= max_depth or len(idx) <= 1:
                rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
                return node
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if len(cand) == 0:
                rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
                return node
            f = int(rng.choice(cand))
            s = float(rng.uniform(lo[f], hi[f]))
            left = grow(idx[sub[:, f] < s], depth + 1)
            right = grow(idx[sub[:, f] >= s], depth + 1)
            rows[node] = (tree, node, f, s, left, right, len(idx))
            return node

        grow(np.arange(len(X)), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "size"])
    return build


def fit(df: DataFrame, id_col: str, features: list[str], n_trees: int = 100, psi: int = 256,
        seed: int = 42) -> pd.DataFrame:
    """Returns the forest as a small pandas table (trees x nodes)."""
    n = df.count()
    psi = min(psi, n)
    keep = min(1.0, 3.0 * psi / max(n, 1) + 1e-9)
    feats = [F.col(c).cast("double").alias(c) for c in features]
    rid = F.col(id_col).cast("string")
    # every tree draws its own sample by a hash of row and tree
    h = lambda t: F.pmod(F.xxhash64(rid, F.lit(seed), t),
                         F.lit(1 << 40)).cast("double") / float(1 << 40)
    trees = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                 lambda t: F.struct(t.alias("tree"), h(t).alias("_h"))),
                     lambda s: s["_h"] < F.lit(keep))
    sampled = df.select(rid.alias("_id"), *feats, F.explode(trees).alias("_t")) \
        .select("_id", *features, "_t.tree", "_t._h")
    nodes = sampled.groupBy("tree").applyInPandas(_build(features, psi, seed), NODE_SCHEMA)
    forest = nodes.toPandas()  # trees x <= 2*psi rows: bounded by the parameters
    forest.attrs["psi"] = psi
    return forest


def score(df: DataFrame, forest: pd.DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Adds ``score`` = 2^(-E[h(x)] / c(psi)) (higher = more anomalous)."""
    psi = forest.attrs.get("psi", 256)
    trees = []
    for _, g in forest.groupby("tree"):
        g = g.sort_values("node")
        leaf = g["feature"].to_numpy() < 0
        here = np.arange(len(g))
        left, right = np.where(leaf, here, g["left"]), np.where(leaf, here, g["right"])
        depth = np.zeros(len(g))
        for i in here[~leaf]:  # parents come before their children
            depth[left[i]] = depth[right[i]] = depth[i] + 1
        # a leaf leads to itself: every row takes as many steps as the tree is deep
        trees.append((np.where(leaf, 0, g["feature"]), g["split"].to_numpy(), np.stack([right, left], axis=1).ravel(),
                      depth + np.array([_c(n) for n in g["size"]]), int(depth.max())))
    cpsi = _c(psi)

    def run(it):
        for pdf in it:
            X = pdf[features].to_numpy(dtype=float)
            flat, first = X.ravel(), np.arange(len(X)) * X.shape[1]
            total = np.zeros(len(X))
            for feat, split, kids, path, steps in trees:
                node = np.zeros(len(X), dtype=np.int64)
                for _ in range(steps):
                    node = kids[2 * node + (flat[first + feat[node]] < split[node])]
                total += path[node]
            out = pdf[keep].copy()
            out["score"] = np.power(2.0, -(total / len(trees)) / cpsi)
            yield out
    cols = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c not in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.select(*keep).schema.fields)
    return cols.mapInPandas(run, f"{schema}, score double")


def outlier_iforest(df: DataFrame, id_col: str, features: list[str], contamination: float = 0.05,
                    n_trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """``(id, score, iforest)``: flag = score above its (1 - contamination) quantile."""
    data = df.na.drop(subset=features)
    require_rows(data, 10, "outlier detection")
    forest = fit(data, id_col, features, n_trees, psi, seed)
    # scored once; the threshold and the flags read the written scores
    sc = materialize(score(data, forest, features, [id_col]), "iforest")
    thr = quantiles(sc, [], [1.0 - contamination], value="score")[()][0]
    return sc.withColumn("iforest", (F.col("score") > F.lit(thr)).cast("int"))
