"""Gradient boosting with the softmax (two classes: logistic) loss for any
number of classes (C-08).

A round grows one tree per class (one in all for two classes), all in the same
jobs: a level is one scan that sums residuals and p(1 - p) per (tree, node,
feature, bin) inside each task, and one grouped sum over the tasks' tables.
The best cut of a node takes most squared residual away; a leaf is one Newton
step.  Residuals are summed as integers (2^-28 steps), so neither the order of
tasks nor a repeated task changes a tree.

A feature with at most ``bins`` values is cut between any two of them, others
at ``bins`` - 1 of their values, equally spaced in rank.  Among equally good
cuts (6 decimals) the smaller feature position, then the smaller value, wins.
Rows with a missing feature or label are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.session import discard, materialize

#: Unit of the integer sums; cells (class, node, feature, bin) that a task sums; rounds between written scores.
UNIT, CELLS, WRITE_EVERY = float(1 << 28), 1 << 24, 10


def bin_edges(long: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins but the last, per feature, from (feature, value) rows."""
    c = running_totals(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")), ["feature"], "value", ["c"])
    size = c.groupBy("feature").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
    step = F.floor(F.col("cum_c") * bins / F.col("n")) > F.floor((F.col("cum_c") - F.col("c")) * bins / F.col("n"))
    edge = c.join(size, "feature").where((F.col("cum_c") < F.col("n")) & ((F.col("d") <= bins) | step))
    rows = edge.select("feature", "value").collect()  # at most bins - 1 a feature
    return [np.sort([r["value"] for r in rows if r["feature"] == f]) for f in range(n_features)]


def _probability(scores: np.ndarray) -> np.ndarray:
    """P(class 1) of one score a row, or softmax."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _walk(tree: dict, x: np.ndarray) -> np.ndarray:
    """Heap number of the node that each row of bins has reached."""
    at = np.ones(len(x), dtype=np.int64)
    for node in sorted(tree):
        f, b = tree[node][:2]
        if f >= 0:
            here = at == node
            at[here] = 2 * node + (x[here, f] > b)
    return at


def _add(scores: np.ndarray, x: np.ndarray, rounds: list[list[dict]]) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            at = _walk(tree, x)
            for node in np.unique(at):
                scores[at == node, c] += tree[node][2]
    return scores


def boost_fit(train: DataFrame, features: list[str], label: str = "label", n_classes: int | None = None,
              n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, bins: int = 64) -> dict:
    """``label`` holds 0..n_classes-1."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    x = F.array(*[F.col(f).cast("double") for f in features])
    d = train.select(F.col(label).cast("int").alias("y"), x.alias("x")) \
        .where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    d = materialize(d, "boost_x")
    count = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}  # a row per class
    k, n, nf = max(2, n_classes or max(count, default=1) + 1), sum(count.values()), len(features)
    outs = 1 if k == 2 else k
    if outs * 2 ** (max_depth - 1) * nf * bins > CELLS:
        raise ValueError(f"more than {CELLS} (class, node, feature, bin) cells")
    model = {"features": features, "k": k, "edges": [np.empty(0)] * nf, "rounds": [], "prior": np.zeros(outs)}
    if not n:
        return model
    share = np.clip([count.get(c, 0) / n for c in range(k)], np.finfo(np.float32).eps, 1 - np.finfo(np.float32).eps)
    model["prior"] = np.log(share[1:] / (1 - share[1:])) if outs == 1 else np.log(share)
    edges = model["edges"] = bin_edges(d.select(F.posexplode("x").alias("feature", "value")), nf, bins)
    prior, start = model["prior"], np.tile(model["prior"], (1, 1))

    def binned(it):
        for pdf in it:
            m = np.array(pdf["x"].tolist(), float).reshape(len(pdf), nf)
            b = np.stack([np.searchsorted(edges[f], m[:, f]) for f in range(nf)], axis=1).astype(np.uint8)
            s = np.repeat(start, len(pdf), axis=0)
            yield pd.DataFrame({"y": pdf["y"], "b": [r.tobytes() for r in b], "s": [r.tobytes() for r in s]})

    rows = materialize(d.mapInPandas(binned, "y int, b binary, s binary"), "boost")
    discard(d)
    pending: list[list[dict]] = []
    for t in range(n_estimators):
        # node -> (feature or -1, last bin on the left, value)
        trees: list[dict] = [{1: (-1, -1, 0.0)} for _ in range(outs)]
        for depth in range(max_depth):
            best = _level(rows, trees, pending, depth, nf, bins, outs)
            if not best:
                break
            for r in best:
                tree, node = trees[r["tree"]], r["node"]
                tree[node] = (r["feature"], r["bin"], 0.0)
                for side, g, h in ((0, r["gl"], r["hl"]), (1, r["g"] - r["gl"], r["h"] - r["hl"])):
                    newton = g / h if h > 0 else 0.0
                    tree[2 * node + side] = (-1, -1, learning_rate * newton * (1 if outs == 1 else (k - 1) / k))
        model["rounds"].append(trees)
        pending.append(trees)
        if len(pending) == WRITE_EVERY and t + 1 < n_estimators:
            new = materialize(_scored(rows, pending, nf, outs), "boost")
            discard(rows)
            rows, pending = new, []
    discard(rows)
    return model


def _unpack(pdf: pd.DataFrame, nf: int, outs: int, pending: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), nf)
    return x, _add(np.frombuffer(b"".join(pdf["s"]), np.float64).reshape(len(pdf), outs), x, pending)


def _scored(rows: DataFrame, pending: list, nf: int, outs: int) -> DataFrame:
    def run(it):
        for pdf in it:
            yield pdf.assign(s=[r.tobytes() for r in _unpack(pdf, nf, outs, pending)[1]])

    return rows.mapInPandas(run, rows.schema)


def _level(rows: DataFrame, trees: list[dict], pending: list, depth: int, nf: int, bins: int, outs: int) -> list:
    """The best cut of every open node: (tree, node, feature, bin, gl, hl, g, h)."""
    base = 1 << depth

    def table(it):
        total = np.zeros((3, outs, base * nf * bins), dtype=np.int64)
        for pdf in it:
            if not len(pdf):
                continue
            x, scores = _unpack(pdf, nf, outs, pending)
            p, y = _probability(scores), pdf["y"].to_numpy()
            for c in range(outs):
                at = _walk(trees[c], x)
                here = at >= base
                cell = (((at[here] - base)[:, None] * nf + np.arange(nf)) * bins + x[here]).ravel()
                q = p[here, c]
                own = y[here] == (1 if outs == 1 else c)
                for i, v in enumerate((np.ones(len(q)), np.rint((own - q) * UNIT), np.rint(q * (1 - q) * UNIT))):
                    # integers below 2^53 in a batch: the sums are exact
                    total[i, c] += np.bincount(cell, np.repeat(v, nf), minlength=base * nf * bins).astype(np.int64)
        tree, cell = np.nonzero(total[0])
        yield pd.DataFrame({"tree": tree, "node": cell // (nf * bins) + base, "feature": cell // bins % nf, "bin": cell % bins,
                            "n": total[0, tree, cell], "g": total[1, tree, cell], "h": total[2, tree, cell]})

    t = rows.mapInPandas(table, "tree int, node int, feature int, bin int, n long, g long, h long") \
        .groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    own = Window.partitionBy("tree", "node", "feature")  # at most ``bins`` rows
    so_far = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("tree", "node", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}l") for c in "ngh"],
                 *[F.sum(c).over(own).alias(c) for c in "ngh"])
    g, gl, n, nl = (F.col(c).cast("double") for c in ("g", "gl", "n", "nl"))
    gain = F.round((gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n) / (UNIT * UNIT), 6)
    t = t.where("nl < n").withColumn("gain", gain).where("gain > 0")
    return t.groupBy("tree", "node").agg(F.min(F.struct((-F.col("gain")).alias("o"), "feature", "bin", "gl", "hl", "g", "h")).alias("e")) \
        .select("tree", "node", "e.*").collect()  # a row per open node


def boost_predict(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``prediction`` (smallest of the likeliest classes) and
    ``probability`` (a number per class); rows with a missing feature are left out."""
    edges, rounds, prior, nf = model["edges"], model["rounds"], model["prior"], len(model["features"])

    def run(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), float).reshape(len(x), nf)
        b = np.stack([np.searchsorted(edges[f], m[:, f]) for f in range(nf)], axis=1)
        p = _probability(_add(np.tile(prior, (len(x), 1)), b, rounds))
        return pd.Series((np.hstack([1 - p, p]) if p.shape[1] == 1 else p).tolist())

    chance = F.pandas_udf(run, "array<double>")
    d = df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in model["features"]])) \
        .where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v))).withColumn("probability", chance("_x"))
    best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    return d.withColumn("prediction", best).select(*df.columns, "prediction", "probability")
