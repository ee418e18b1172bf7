"""DBSCAN (K-07) over cells: core cells -> connected components -> borders.

* Identical feature vectors are merged first (vertex = smallest id, weight
  = multiplicity).
* Space is cut into cells of side eps/sqrt(d) over all features, so any two
  points of a cell are within eps.  A cell that holds ``min_samples`` weight
  is core as a whole, without a distance test, and all core points of a cell
  share a cluster.  Dense regions have many points but few cells.
* Cells near each other are found through leaves (``leaves.py``) over cell
  positions, with the boxes of their points.
* Only points of thin cells count neighbours; blocks of points meet blocks of
  points and return one number per point, never pairs.  Blocks travel as flat
  lists and are read in place: a worker holds one Arrow batch, however many
  points the cells have.
* Two core cells are joined if one close pair of core points exists: their
  first blocks are tried, then all blocks of those that found none.
* Connected components run over cells.  Clusters are numbered 0.. by their
  smallest core id (the order an index-order scan discovers them); a border
  point takes the smallest cluster among its core neighbours; the rest is
  noise (-1).
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.rank import avg_rank
from tessera.operators.graph import connected_components
from tessera.operators.leaves import matrix, measure_leaves, plan_leaves, with_leaf
from tessera.session import materialize

#: Points of a cell that lie in one block.
BLOCK = 1_000


def _near_cells(cells: DataFrame, d: int, eps: float, side: float) -> DataFrame:
    """Directed pairs ``(a, b)`` of different cells whose points' boxes are
    within eps.  A cell visits the leaves within reach of its position."""
    grid = [f"g{i}" for i in range(d)]
    box = [f"l{i}" for i in range(d)] + [f"h{i}" for i in range(d)]
    leaves = plan_leaves(cells, grid)
    at = materialize(with_leaf(cells.select("cid", *grid, *box), grid, leaves), "dbscan_at")
    measure_leaves(leaves, at, grid)

    def length(gap: np.ndarray) -> np.ndarray:  # cells at position difference g are at least (g - 1) sides apart
        g = np.maximum(gap - 1, 0) * side
        return np.sqrt((g * g).sum(axis=-1)) * (1 - 1e-9)

    def visit(it):
        for pdf in it:
            row, leaf = leaves.near(matrix(pdf, grid), np.full(len(pdf), eps), length)
            yield pdf.iloc[row].assign(_leaf=leaf)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        lo, hi, ids = matrix(right, box[:d]), matrix(right, box[d:]), right["cid"].to_numpy()
        a_lo, a_hi, a_ids = matrix(left, box[:d]), matrix(left, box[d:]), left["cid"].to_numpy()
        for i in range(len(left)):
            gap = np.maximum(0, np.maximum(lo - a_hi[i], a_lo[i] - hi))
            j = np.flatnonzero(((gap * gap).sum(axis=1) <= eps * eps * (1 + 1e-9)) & (ids != a_ids[i]))
            out_a.append(np.repeat(a_ids[i:i + 1], len(j)))
            out_b.append(ids[j])
        return pd.DataFrame({"a": np.concatenate(out_a or [a_ids]), "b": np.concatenate(out_b or [ids[:0]])})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema.fields)
    kind = cells.schema["cid"].dataType.simpleString()
    return at.mapInPandas(visit, fields).groupBy("_leaf").cogroup(at.groupBy("_leaf")) \
        .applyInPandas(meet, f"a {kind}, b {kind}")


def _blocks(points: DataFrame, cols: list[str]) -> DataFrame:
    """``(cid, blk, vids, ws, xs)``: a cell's points in blocks of about ``BLOCK``; ``xs`` holds them end to end."""
    n = points.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    p = points.join(n, "cid").withColumn("blk", F.pmod(F.xxhash64("vid"), F.col("_n")).cast("int"))
    one = F.struct("vid", "w", F.array(*cols).alias("x"))
    g = p.groupBy("cid", "blk").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return g.select("cid", "blk", F.col("p.vid").alias("vids"), F.col("p.w").alias("ws"), F.flatten("p.x").alias("xs"))


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, d: int, eps: float, fn, schema: str,
          extra: list[str] | None = None) -> DataFrame:
    """Rows of ``fn(pair, near matrix)`` for the blocks of every pair of cells.
    A pair has a, b, ``av()``, the ids of a's points, bw, the weights of b's, and the extra columns."""
    extra = extra or []
    j = pairs.join(left.select(F.col("cid").alias("a"), F.col("vids").alias("av"), F.col("xs").alias("ax")), "a") \
        .join(right.select(F.col("cid").alias("b"), F.col("ws").alias("bw"), F.col("xs").alias("bx"),
                           *extra), "b")
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    fixed = {"long": pa.int64(), "int": pa.int32()}

    def run(it):
        for batch in it:
            ends = {c: batch.column(c).offsets.to_numpy() for c in ("av", "ax", "bw", "bx")}
            flat = {c: batch.column(c).values for c in ends}
            num = {c: flat[c].to_numpy(zero_copy_only=False) for c in ("ax", "bw", "bx")}
            out = []
            for i in range(batch.num_rows):
                ax, bw, bx = (num[c][ends[c][i]:ends[c][i + 1]] for c in ("ax", "bw", "bx"))
                x, y = ax.reshape(-1, d), bx.reshape(-1, d)
                d2 = np.zeros((len(x), len(y)))
                for f in range(d):
                    d2 += (x[:, None, f] - y[None, :, f]) ** 2
                at, upto = ends["av"][i], ends["av"][i + 1]
                out += fn(SimpleNamespace(av=lambda: flat["av"].slice(at, upto - at).to_pylist(), bw=bw,  # noqa: B023
                                          **{c: batch.column(c)[i].as_py() for c in ("a", "b", *extra)}), d2 <= eps * eps)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, fixed.get(k, batch.column("a").type)) for v, k in zip(cols, kinds)],
                                             list(names))

    return j.mapInArrow(run, schema)


def dbscan(df: DataFrame, id_col: str, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``(id, cluster)``: cluster 0.. or -1 for noise; also ``is_core``.  Rows
    with a missing feature take no part."""
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-9)  # strictly inside: same cell => within eps
    data = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]) \
        .na.drop()
    xs = [f"x{i}" for i in range(d)]
    kind = df.schema[id_col].dataType.simpleString()
    grid = [F.rint(F.floor(F.col(c) / F.lit(side)).cast("double")).alias(f"g{i}") for i, c in enumerate(xs)]
    v = materialize(data.groupBy(*xs).agg(F.min("_id").alias("vid"), F.count(F.lit(1)).alias("w")).select("*", *grid),
                    "dbscan_v")
    keys = [f"g{i}" for i in range(d)]
    cells = v.groupBy(*keys).agg(
        F.min("vid").alias("cid"), F.sum("w").alias("cw"), *[F.min(c).alias(f"l{i}") for i, c in enumerate(xs)],
        *[F.max(c).alias(f"h{i}") for i, c in enumerate(xs)])
    cells = materialize(cells, "dbscan_cells")
    if cells.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, is_core boolean")
    v = materialize(v.join(cells.select("cid", "cw", *keys), keys).select("vid", "w", "cid", "cw", *xs), "dbscan_vc")
    near = materialize(_near_cells(cells, d, eps, side), "dbscan_near")
    thin = cells.where(F.col("cw") < min_samples).select("cid")
    blocks = materialize(_blocks(v, xs), "dbscan_blocks")
    thin_blocks = blocks.join(thin, "cid", "left_semi")

    # weight near each point of a thin cell: its whole own cell and what adjacent cells add
    from_thin = near.join(thin.select(F.col("cid").alias("a")), "a", "left_semi")
    counted = _meet(thin_blocks, blocks, from_thin, d, eps,
                    lambda r, m: [(vid, int(n)) for vid, n in zip(r.av(), m @ np.asarray(r.bw, float)) if n],
                    f"vid {kind}, n long").groupBy("vid").agg(F.sum("n").alias("n"))
    core = v.join(counted, "vid", "left").select(
        "vid", "cid", "w", *xs, ((F.col("cw") + F.coalesce("n", F.lit(0))) >= min_samples).alias("is_core"))
    core = materialize(core, "dbscan_core")
    core_blocks = materialize(_blocks(core.where("is_core"), xs), "dbscan_core_blocks")
    core_cells = core.where("is_core").groupBy("cid").agg(F.min("vid").alias("least"))

    # core cells with one close pair of core points
    pairs = near.where(F.col("a") < F.col("b")).join(core_cells.select(F.col("cid").alias("a")), "a", "left_semi") \
        .join(core_cells.select(F.col("cid").alias("b")), "b", "left_semi")
    pairs = materialize(pairs, "dbscan_pairs")
    edge = f"src {kind}, dst {kind}"
    first = core_blocks.join(core_blocks.groupBy("cid").agg(F.min("blk").alias("blk")), ["cid", "blk"])
    touch = lambda r, m: [(r.a, r.b)] if m.any() else []
    linked = materialize(_meet(first, first, pairs, d, eps, touch, edge), "dbscan_edges")
    rest = pairs.join(linked.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    more = core_blocks.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cid")
    big = rest.join(more.select(F.col("cid").alias("a")), "a", "left_semi").unionByName(
        rest.join(more.select(F.col("cid").alias("b")), "b", "left_semi")).distinct()
    linked = linked.unionByName(_meet(core_blocks, core_blocks, big, d, eps, touch, edge).distinct())
    comp = connected_components(linked, "src", "dst")
    root = core_cells.join(comp.withColumnRenamed("vertex", "cid"), "cid", "left") \
        .select("cid", "least", F.coalesce("component", "cid").alias("component"))
    least = root.groupBy("component").agg(F.min("least").alias("value"))
    ranks = avg_rank(least.select("value"), [], "value")
    label = root.join(least, "component").join(ranks, "value") \
        .select("cid", (F.col("rank") - 1).cast("int").alias("cluster"))
    label = materialize(label, "dbscan_label")

    # borders: points that are not core take the smallest cluster of a core point within eps
    labelled = core_blocks.join(label.withColumnRenamed("cluster", "bc"), "cid")
    edge_blocks = _blocks(core.where(~F.col("is_core")), xs)
    border = _meet(edge_blocks, labelled, from_thin, d, eps,
                   lambda r, m: [(vid, int(r.bc)) for vid, any_ in zip(r.av(), m.any(axis=1)) if any_],
                   f"vid {kind}, bc int", ["bc"])
    own = core.where(~F.col("is_core")).join(label, "cid").select("vid", F.col("cluster").alias("bc"))
    border = border.unionByName(own).groupBy("vid").agg(F.min("bc").alias("bc"))
    lab = core.join(label, "cid", "left").join(border, "vid", "left").select(
        *xs, "is_core", F.coalesce(F.when(F.col("is_core"), F.col("cluster")), F.when(~F.col("is_core"), F.col("bc")),
                                   F.lit(-1)).cast("int").alias("cluster"))
    return data.join(lab, xs).select(F.col("_id").alias(id_col), "cluster", "is_core")
