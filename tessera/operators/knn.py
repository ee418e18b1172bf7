"""Exact k-nearest neighbours without an all-pairs join (N-02, J-05, J-07),
and the operators built on it: local outlier factor (O-03) and the kNN
classifier (C-10).

* Identical feature vectors are merged into weighted vertices, so a value
  repeated by a third of the rows is one vertex.
* Build vertices lie in leaves (``leaves.py``) that cut space on all features.
  A query first takes its k nearest from its own leaf; their largest distance
  bounds the search, and only leaves whose box is nearer are visited, each
  once.  Every (query, leaf) keeps at most k candidates before the shuffle.
* Two passes, whatever the data: no rounds, no grid, no feature left out.
  Leaves with many queries are served by several tasks.
* Where boxes overlap so much that these visits would move more rows than
  whole blocks (many features), every query block is held by a task that reads
  all build vertices as a stream, within the same bound; only the ``k`` kept
  candidates a query leave the task.  There are as many query blocks as keep
  the cores busy (more only where one would exceed ``VALUES``), so the rows
  moved grow with the build.  The choice compares the two measured row counts;
  both ways are exact.
* Euclidean distances are shortlisted by a matrix product with its rounding
  error as slack and then computed from the differences.
* The k nearest are taken in (distance, vertex id) order with weights (a
  vertex of weight w counts as w neighbours at the same distance).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.leaves import LEAF, matrix, measure_leaves, plan_leaves, with_leaf
from tessera.session import materialize

#: Queries of one leaf that a task takes, and rows compared at once.
QUERIES, BLOCK = 20_000, 256
#: Values (rows x features) of a query block, of a piece of the stream it meets, and pieces between merges.
VALUES, PIECE, MERGE = 4_000_000, 131_072, 16


def vertices(df: DataFrame, id_col: str, cols: list[str], extra: list[str] | None = None) -> tuple:
    """(vertex table (vid, w, cols, extra), row -> vid map)."""
    extra = extra or []
    data = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols], *extra) \
        .na.drop(subset=cols).select("_id", F.array(*cols).alias("_f"), *extra)  # one key, however many features
    v = data.groupBy("_f", *extra).agg(F.min("_id").alias("vid"), F.count(F.lit(1)).alias("w"))
    v = materialize(v.select("*", *[F.element_at("_f", i + 1).alias(c) for i, c in enumerate(cols)]), "knn_v")
    rowmap = data.join(v.select("_f", *extra, "vid").hint("merge"), ["_f", *extra]).select("_id", "vid")
    return v, rowmap


def _length(metric: str, p: float):
    """Length of difference vectors (features on the last axis, added in order)."""
    def run(diff: np.ndarray) -> np.ndarray:
        diff = np.abs(diff)
        total = np.zeros(diff.shape[:-1])
        for i in range(diff.shape[-1]):
            d = diff[..., i]
            total = np.maximum(total, d) if metric == "chebyshev" else \
                total + (d if metric == "manhattan" else d * d if metric == "euclidean" else d ** p)
        return np.sqrt(total) if metric == "euclidean" else total ** (1 / p) if metric == "minkowski" else total

    if metric not in ("euclidean", "manhattan", "minkowski", "chebyshev"):
        raise ValueError(f"unknown metric {metric}")
    return run


def _pairwise(x: np.ndarray, y: np.ndarray, metric: str, p: float) -> tuple[np.ndarray, np.ndarray | float]:
    """Distances (rows of x by rows of y) to choose by, and their possible
    error.  Euclidean ones come from a matrix product."""
    if metric == "euclidean":
        x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
        slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (x2[:, None] + (y2.max() if len(y2) else 0.0))
        d2 = np.maximum(x2[:, None] + y2 - 2 * (x @ y.T), 0)
        # an error e of the square moves the root by sqrt(e) at most
        return np.sqrt(d2), np.sqrt(slack)
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = np.abs(x[:, i, None] - y[None, :, i])
        total = np.maximum(total, d) if metric == "chebyshev" else total + (d if metric == "manhattan" else d ** p)
    return (total ** (1 / p) if metric == "minkowski" else total), 0.0


def _nearest(x, who, reach, y, ids, w, need: int, self_join: bool, metric: str, p: float, names=None) -> pd.DataFrame:
    """(a, b, dist, wb): for each row of ``x`` the rows of ``y`` (in id order)
    within ``reach`` that hold its ``need`` nearest by weight; ``a`` is its
    entry in ``names`` (default ``who``)."""
    names = who if names is None else names
    length = _length(metric, p)
    out = []
    for at in range(0, len(x), BLOCK):
        xs, me, bound, called = x[at:at + BLOCK], who[at:at + BLOCK], reach[at:at + BLOCK], names[at:at + BLOCK]
        near, slack = _pairwise(xs, y, metric, p)
        cut = bound[:, None] + slack
        if need + 1 < len(y) and np.count_nonzero(near <= cut) > 2 * (need + 1) * len(xs):
            cut = np.minimum(cut, np.partition(near, need, axis=1)[:, need, None] + 2 * slack)
        i, j = np.nonzero(near <= cut)
        dist = length(xs[i] - y[j])
        weight = w[j] - (ids[j] == me[i] if self_join else 0)
        keep = (dist <= bound[i]) & (weight > 0)
        i, j, dist, weight = i[keep], j[keep], dist[keep], weight[keep]
        order = np.lexsort((j, dist, i))
        i, j, dist, weight = i[order], j[order], dist[order], weight[order]
        # weight before a row within its query
        before = np.cumsum(weight) - weight
        first = np.searchsorted(i, i, side="left")
        keep = before - before[first] < need if len(i) else np.zeros(0, bool)
        out.append(pd.DataFrame({"a": called[i[keep]], "b": ids[j[keep]], "dist": dist[keep], "wb": weight[keep]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "dist", "wb"])


def _merge(found: DataFrame, by: list[str], need: int) -> DataFrame:
    """The candidates that can be among the ``need`` nearest of their group, with ``_before``."""
    w = Window.partitionBy(*by).orderBy("dist", "b")
    before = F.coalesce(F.sum("wb").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("_before", before).where(F.col("_before") < need)


def knn(queries: DataFrame, build: DataFrame, cols: list[str], k: int, self_join: bool,
        metric: str = "euclidean", p: float = 2.0, leaf: int | None = None, way: str | None = None) -> DataFrame:
    """``(a, b, dist, used)`` — for each query vertex ``a`` its nearest build
    vertices with the weight ``used`` each contributes (sum = k per query,
    or all available weight when fewer exist).

    ``queries``: (vid, cols...[, w]); ``build``: (vid, w, cols...).  With
    ``self_join`` the query's own vertex counts w-1 times at distance 0.
    ``way``: "leaves" or "blocks"; None compares the rows that each would move.
    """
    spark = queries.sparkSession
    length = _length(metric, p)
    a_type, b_type = (d.schema["vid"].dataType.simpleString() for d in (queries, build))
    found = f"a {a_type}, b {b_type}, dist double, wb long"
    size, total = build.agg(F.count(F.lit(1)), F.sum("w")).first()
    total = total or 0
    need = int(min(k, total - 1 if self_join else total))
    if need <= 0:
        return spark.createDataFrame([], f"a {a_type}, b {b_type}, dist double, used long")
    leaves = plan_leaves(build, cols, leaf or max(LEAF, 4 * k))
    b = materialize(with_leaf(build.select("vid", "w", *cols), cols, leaves), "knn_b")
    measure_leaves(leaves, b, cols)
    q = materialize(with_leaf(queries.select(F.col("vid").alias("a"), *cols), cols, leaves), "knn_q")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ``need`` nearest by weight of each query among one leaf's or block's vertices."""
        right = right.sort_values("vid", kind="stable")
        reach = left["r"].to_numpy() if "r" in left else np.full(len(left), np.inf)
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["a", "b", "dist", "wb"])
        return _nearest(matrix(left, cols), left["a"].to_numpy(), reach, matrix(right, cols), right["vid"].to_numpy(),
                        right["w"].to_numpy(), need, self_join, metric, p)

    def search(rows: DataFrame) -> DataFrame:
        """Queries meet their leaf's vertices; crowded leaves by several tasks."""
        parts = rows.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_parts"))
        left = rows.join(parts, "_leaf").withColumn("_s", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int")).drop("_parts")
        right = b.join(parts, "_leaf").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return left.groupBy("_leaf", "_s").cogroup(right.groupBy("_leaf", "_s")).applyInPandas(nearest, found)

    own = materialize(search(q), "knn_own")
    reach = own.groupBy("a").agg(F.when(F.sum("wb") >= need, F.max("dist")).alias("r"))
    todo = materialize(q.join(reach, "a", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))), "knn_todo")

    def away(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row, leaf_no = leaves.near(matrix(pdf, cols), pdf["r"].to_numpy(), length)
        other = leaf_no != pdf["_leaf"].to_numpy()[row]
        return row[other], leaf_no[other]

    def visit(it):
        for pdf in it:
            row, leaf_no = away(pdf)
            yield pdf.iloc[row].assign(_leaf=leaf_no)

    def count(it):
        for pdf in it:
            yield pd.DataFrame({"n": [len(pdf)], "visits": [len(away(pdf)[0])]})

    n, visits = todo.mapInPandas(count, "n long, visits long").agg(F.sum("n"), F.sum("visits")).first()
    n = n or 0
    rows = max(1, VALUES // len(cols))
    # enough query blocks to keep every core busy, as long as they are worth a task
    query_blocks = max(-(-n // rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK)), 1)
    if way is None:
        way = "blocks" if n + size * query_blocks < visits else "leaves"
    if way == "blocks":
        every = _streamed(todo, b, cols, query_blocks, found, need, self_join, metric, p)  # holds the own leaf's rows too
    else:
        far = search(materialize(todo.mapInPandas(visit, todo.schema), "knn_visits"))
        every = own.unionByName(far)
    return _merge(every, ["a"], need) \
        .select("a", "b", "dist", F.least(F.col("wb"), F.lit(need) - F.col("_before")).alias("used"))


def _streamed(q: DataFrame, b: DataFrame, cols: list[str], query_blocks: int, found: str, need: int, self_join: bool,
              metric: str, p: float) -> DataFrame:
    """``found`` rows of query blocks that each meet all of ``b``.  A partition holds
    one block's queries, which come first, and then reads the build rows batch by batch."""
    a_type, b_type = (d.schema[c].dataType.simpleString() for d, c in ((q, "a"), (b, "vid")))
    x, d = F.array(*cols).alias("x"), len(cols)
    piece, merge = max(1, min(PIECE, VALUES) // d), MERGE
    left = q.select(F.pmod(F.xxhash64("a"), F.lit(query_blocks)).cast("int").alias("_i"), F.lit(0).alias("_side"), "a",
                    F.lit(None).cast(b_type).alias("b"), F.lit(None).cast("long").alias("w"), "r", x)
    right = b.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_i"), F.lit(1).alias("_side"),
                     F.lit(None).cast(a_type).alias("a"), F.col("vid").alias("b"), "w", F.lit(None).cast("double").alias("r"), x)

    def values(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + \
            [batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)]

    def run(it):
        held, kept, waiting, who = [], [], 0, None
        for batch in it:
            side = batch.column("_side")
            if (part := batch.filter(pc.equal(side, 0))).num_rows:
                held.append(values(part, "a", "r"))
            if not held or not (part := batch.filter(pc.equal(side, 1))).num_rows:
                continue
            kind = batch.column("a").type, batch.column("b").type
            if who is None:
                who, reach, mine = (np.concatenate(v) for v in zip(*held))
                me = np.arange(len(who))
            ids, w, theirs = values(part, "b", "w")
            for at in range(0, len(ids), piece):
                order = at + np.argsort(ids[at:at + piece], kind="stable")
                near = _nearest(mine, who, reach, theirs[order], ids[order], w[order], need, self_join, metric, p, me)
                if len(near):
                    kept.append(near)
                waiting += 1
                if waiting >= merge and kept:
                    kept, waiting = [_keep(pd.concat(kept), need, reach)], 0
        if kept:
            last = _keep(pd.concat(kept), need, reach)
            for at in range(0, len(last), 100_000):
                part = last.iloc[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[part["a"].to_numpy(np.int64)], kind[0]), pa.array(part["b"].to_numpy(), kind[1]),
                     pa.array(part["dist"].to_numpy(float)), pa.array(part["wb"].to_numpy(np.int64))], ["a", "b", "dist", "wb"])

    return left.unionByName(right).repartitionById(query_blocks, F.col("_i")).sortWithinPartitions("_side").mapInArrow(run, found)


def _keep(found: pd.DataFrame, need: int, reach: np.ndarray) -> pd.DataFrame:
    """The nearest rows of every query in ``a`` (its place) that hold ``need`` by
    weight; ``reach`` shrinks to the last of them."""
    found = found.sort_values(["a", "dist", "b"], kind="stable")
    upto = found.groupby("a")["wb"].cumsum().to_numpy()
    keep = upto - found["wb"].to_numpy() < need
    full = keep & (upto >= need)  # one row of a query at most
    reach[found["a"].to_numpy(np.int64)[full]] = found["dist"].to_numpy()[full]
    return found[keep]


def lof_scores(df: DataFrame, id_col: str, cols: list[str], k: int = 20) -> DataFrame:
    """``(id, lof)`` — local outlier factor with k neighbours (ties in
    (distance, id) order)."""
    v, rowmap = vertices(df, id_col, cols)
    nn = materialize(knn(v, v, cols, k, self_join=True), "lof_nn")
    kd = nn.groupBy("a").agg(F.max("dist").alias("kdist"), F.sum("used").alias("k"))
    reach = nn.join(kd.select(F.col("a").alias("b"), F.col("kdist").alias("kb")), "b") \
        .select("a", "b", "used", F.greatest("kb", "dist").alias("reach"))
    lrd = reach.groupBy("a").agg((F.sum(F.col("used") * F.col("reach")) / F.sum("used")).alias("_m")) \
        .select("a", (1.0 / (F.col("_m") + F.lit(1e-10))).alias("lrd"))
    lrd = materialize(lrd, "lof_lrd")
    lof = nn.join(lrd.select(F.col("a").alias("b"), F.col("lrd").alias("lrd_b")), "b") \
        .groupBy("a").agg((F.sum(F.col("used") * F.col("lrd_b")) / F.sum("used")).alias("_ml")) \
        .join(lrd, "a").select(F.col("a").alias("vid"), (F.col("_ml") / F.col("lrd")).alias("lof"))
    return rowmap.join(lof, "vid").select(F.col("_id").alias(id_col), "lof")


def outlier_lof(df: DataFrame, id_col: str, cols: list[str], k: int = 20, threshold: float = 1.5) -> DataFrame:
    """``(id, lof, lof_flag)``: flagged when the factor exceeds ``threshold``."""
    s = lof_scores(df, id_col, cols, k)
    return s.withColumn("lof_flag", (F.col("lof") > F.lit(threshold)).cast("int"))


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, cols: list[str], label: str = "label",
                 k: int = 5, metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """``(id, prediction, score)``: majority of the k nearest training rows
    (ties -> smallest class); ``score`` = share of votes for class 1."""
    tv, _ = vertices(train.select(id_col, *cols, label), id_col, cols, extra=[label])
    qv, qmap = vertices(test, id_col, cols)
    nn = knn(qv.select("vid", *cols), tv.select("vid", "w", *cols), cols, k, self_join=False, metric=metric, p=p)
    votes = nn.join(tv.select(F.col("vid").alias("b"), F.col(label).alias("_cls")), "b") \
        .groupBy("a", "_cls").agg(F.sum("used").alias("_v"))
    best = votes.groupBy("a").agg(
        F.min(F.struct((-F.col("_v")).alias("nv"), F.col("_cls").alias("c"))).alias("_b"),
        (F.sum(F.when(F.col("_cls") == 1, F.col("_v")).otherwise(0)) / F.sum("_v")).alias("score"))
    pred = best.select(F.col("a").alias("vid"), F.col("_b.c").cast("double").alias("prediction"), "score")
    return qmap.join(pred, "vid").select(F.col("_id").alias(id_col), "prediction", "score")
