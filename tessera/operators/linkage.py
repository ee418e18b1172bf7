"""Single-linkage clustering (K-05, K-06) from a minimum spanning tree, all rows,
no distance matrix and no merge loop.

* Rows are numbered from 0 by id; equal vectors are one vertex, their copies
  hang on it at height 0.  Edges are ordered by (distance, smaller number,
  larger number), so tree, merges and labels are unique.
* Tree: inside a leaf (``leaves.py``) Prim's tree with one row of distances at
  a time; its edges are kept where they are shorter than the way out of the
  leaf.  Then Boruvka rounds: each component's best edge inside its leaves
  bounds the search, points visit only leaves nearer than that, and leaves
  wholly of their own component are left out.
* Merges: edges are cut at the median rank, level by level.  The lower half's
  components stand for its points in the upper half, so both halves go on
  alone; blocks of at most ``BLOCK_EDGES`` edges end in a task each.

Rows with a null or NaN id or a null, NaN or infinite feature are left out; ids
must be unique.  Distances beyond the range of a double are an error.  Joins of
tables that grow with the rows are shuffled ("merge"), never broadcast: the
levels' tables would all pass through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.operators.graph import connected_components
from tessera.operators.knn import BLOCK, QUERIES, _length, _pairwise, vertices
from tessera.operators.leaves import LEAF, Leaves, matrix, measure_leaves, plan_leaves, with_leaf
from tessera.session import discard, materialize

#: Merges that one task resolves in order.
BLOCK_EDGES = 20_000

_FOUND = "comp long, dist double, a long, b long, other long"


class Tree(NamedTuple):
    """``rows`` (row, id), ``edges`` (rk, a, b, dist) by rising distance, ``n`` rows."""
    rows: DataFrame
    edges: DataFrame
    n: int


def _prim(x: np.ndarray, length) -> pd.DataFrame:
    """Minimum spanning tree of the rows of ``x``: (src, at, dist) per row but the first."""
    todo = np.arange(1, len(x))
    dist, src, last, out = np.full(len(todo), np.inf), np.zeros(len(todo), np.int64), 0, []
    while len(todo):
        new = length(x[todo] - x[last])
        lo, hi = np.minimum(todo, last), np.maximum(todo, last)
        was_lo, was_hi = np.minimum(todo, src), np.maximum(todo, src)
        nearer = (new < dist) | (new == dist) & ((lo < was_lo) | (lo == was_lo) & (hi < was_hi))
        dist, src = np.where(nearer, new, dist), np.where(nearer, last, src)
        ties = np.flatnonzero(dist == dist.min())
        pick = ties[np.lexsort((np.maximum(todo, src)[ties], np.minimum(todo, src)[ties]))[0]]
        last = todo[pick]
        out.append((src[pick], last, dist[pick]))
        keep = np.arange(len(todo)) != pick
        todo, dist, src = todo[keep], dist[keep], src[keep]
    return pd.DataFrame(out, columns=["src", "at", "dist"])


def _root(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _sure(x: np.ndarray, out: np.ndarray, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, other end, distance) per row: the local tree's edges that
    leave a component by less than its way ``out`` of the leaf.  Rows without
    such an edge have other end -1."""
    up, to, far = np.arange(len(x)), np.full(len(x), -1), np.full(len(x), np.nan)
    out = out.copy()
    tree = _prim(x, length)
    order = np.lexsort((np.maximum(tree["src"], tree["at"]), np.minimum(tree["src"], tree["at"]), tree["dist"]))
    for s, t, d in tree.iloc[order].itertuples(index=False):
        s, t = int(s), int(t)
        a, b = _root(up, s), _root(up, t)
        if d < max(out[a], out[b]):
            a, b = min(a, b), max(a, b)
            up[b] = a
            out[a] = min(out[a], out[b])
            to[t], far[t] = s, d
    return np.array([_root(up, i) for i in range(len(x))], dtype=np.int64), to, far


def _siblings(leaves: Leaves) -> list[list[int]]:
    """Per leaf the nodes that hold all other leaves."""
    beside, todo = [[] for _ in range(leaves.n)], [(0, [])]
    while todo:
        node, path = todo.pop()
        if leaves.kids[node] is None:
            beside[leaves.leaf[node]] = path
        else:
            a, b = leaves.kids[node]
            todo += [(a, path + [b]), (b, path + [a])]
    return beside


def _best(left: pd.DataFrame, right: pd.DataFrame, cols: list[str], metric: str, p: float) -> pd.DataFrame:
    """Each component's least edge from ``left`` to a row of ``right`` in another component."""
    length, rows = _length(metric, p), []
    y, ids, theirs = matrix(right, cols), right["vid"].to_numpy(), right["comp"].to_numpy()
    for at in range(0, len(left), BLOCK):
        part = left.iloc[at:at + BLOCK]
        x, me, mine = matrix(part, cols), part["vid"].to_numpy(), part["comp"].to_numpy()
        near, slack = _pairwise(x, y, metric, p)
        near = np.where(mine[:, None] == theirs[None, :], np.inf, near)
        least = near.min(axis=1, keepdims=True)
        i, j = np.nonzero((near <= least + 2 * slack) & np.isfinite(near))
        rows.append(pd.DataFrame({"comp": mine[i], "dist": length(x[i] - y[j]), "a": np.minimum(me[i], ids[j]),
                                  "b": np.maximum(me[i], ids[j]), "other": theirs[j]}))
    if not rows:
        return pd.DataFrame(columns=["comp", "dist", "a", "b", "other"])
    return pd.concat(rows).sort_values(["comp", "dist", "a", "b"]).drop_duplicates("comp")


def _edges(v: DataFrame, cols: list[str], metric: str, p: float, leaf: int) -> DataFrame:
    """Minimum spanning tree of the vertices, (a, b, dist)."""
    length = _length(metric, p)
    leaves = plan_leaves(v, cols, leaf)
    placed = materialize(with_leaf(v.select("vid", *cols), cols, leaves), "mst_leaf")
    measure_leaves(leaves, placed, cols)
    beside = _siblings(leaves)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid", kind="stable")
        x, ids = matrix(pdf, cols), pdf["vid"].to_numpy()
        out = np.full(len(x), np.inf)
        for node in beside[int(pdf["_leaf"].iloc[0])]:
            out = np.minimum(out, length(np.maximum(0, np.maximum(leaves.lo[node] - x, x - leaves.hi[node]))))
        comp, to, far = _sure(x, out, length)
        return pdf.assign(comp=ids[comp], to=ids[to], dist=far)

    types = ", ".join(f"`{c}` double" for c in cols)
    first = materialize(placed.groupBy("_leaf").applyInPandas(
        inside, f"vid long, {types}, _leaf long, comp long, to long, dist double"), "mst_sure")
    discard(placed)
    sure = first.where(F.col("dist").isNotNull()).select(F.least("vid", "to").alias("a"), F.greatest("vid", "to").alias("b"), "dist")
    tree, points = [sure], first.select("vid", *cols, "_leaf", "comp")
    while True:
        held = points.groupBy("_leaf").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        owner = {r["_leaf"]: (r["lo"], r["hi"]) for r in held.collect()}  # a row per leaf
        if len({c for pair in owner.values() for c in pair}) <= 1:
            break
        chosen, points = _round(points, owner, leaves, cols, metric, p)
        tree.append(chosen)
    out = tree[0]
    for t in tree[1:]:
        out = out.unionByName(t)
    return out


def _round(points: DataFrame, owner: dict, leaves: Leaves, cols: list[str], metric: str, p: float):
    """One Boruvka round: (chosen edges, points with their new components)."""
    length = _length(metric, p)
    whole = {leaf: lo for leaf, (lo, hi) in owner.items() if lo == hi}
    least = F.min(F.struct("dist", "a", "b", "other")).alias("e")

    def among(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best(pdf if pdf["comp"].nunique() > 1 else pdf[:0], pdf, cols, metric, p)

    near = materialize(points.groupBy("_leaf").applyInPandas(among, _FOUND), "mst_near")
    bound = near.groupBy("comp").agg(F.min("dist").alias("r"))
    # a component without an edge so far fills its leaves: any other leaf's far corner bounds its way
    node_of = {leaf: node for node, leaf in enumerate(leaves.leaf) if leaf in owner}
    lo, hi = (np.array([side[node_of[i]] for i in sorted(owner)]) for side in (leaves.lo, leaves.hi))
    sole = np.array([whole.get(i, -1) for i in sorted(owner)])

    def corner(it):
        for pdf in it:
            r = []
            for leaf, comp in zip(pdf["_leaf"], pdf["comp"]):
                other = sole != comp
                node = node_of[leaf]
                r.append(length(np.maximum(hi[other] - leaves.lo[node], leaves.hi[node] - lo[other])).min())
            yield pd.DataFrame({"comp": pdf["comp"], "r": np.array(r, dtype=float)})

    spots = materialize(points.select("_leaf", "comp").distinct(), "mst_spots")
    lone = spots.join(bound.hint("merge"), "comp", "left_anti").mapInPandas(corner, "comp long, r double")
    reach = spots.join(bound.unionByName(lone.groupBy("comp").agg(F.min("r").alias("r"))).hint("merge"), "comp")

    def visit(it):
        for pdf in it:
            row, leaf = leaves.near(matrix(pdf, cols), pdf["r"].to_numpy(), length)
            comp = pdf["comp"].to_numpy()[row]
            away = (leaf != pdf["_leaf"].to_numpy()[row]) & (np.array([whole.get(i, -1) for i in leaf]) != comp)
            yield pdf.iloc[row[away]].assign(_leaf=leaf[away])[["vid", *cols, "_leaf", "comp"]]

    # (leaf, component) as the key: a component may hold most rows, a leaf does not
    visits = materialize(points.join(reach.hint("merge"), ["_leaf", "comp"]).select("vid", *cols, "_leaf", "comp", "r")
                         .mapInPandas(visit, points.schema), "mst_visits")
    parts = visits.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_parts"))
    left = visits.join(parts, "_leaf").withColumn("_s", F.pmod(F.xxhash64("vid"), F.col("_parts")).cast("int")).drop("_parts")
    right = points.join(parts, "_leaf").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    far = left.groupBy("_leaf", "_s").cogroup(right.groupBy("_leaf", "_s")).applyInPandas(
        lambda a, b: _best(a if len(b) else a[:0], b, cols, metric, p), _FOUND)
    best = materialize(near.unionByName(far).groupBy("comp").agg(least).select("comp", "e.*"), "mst_best")
    discard(visits)
    discard(near)
    if best.count() < spots.select("comp").distinct().count():
        raise ValueError("distances overflow")
    name = connected_components(best, "comp", "other").withColumnRenamed("vertex", "comp")
    moved = spots.join(name.hint("merge"), "comp").select("_leaf", "comp", F.col("component").alias("_to"))
    points = materialize(points.join(moved.hint("merge"), ["_leaf", "comp"]).select("vid", *cols, "_leaf", F.col("_to").alias("comp")),
                         "mst_points")
    return best.select("a", "b", "dist").distinct(), points


def single_linkage(df: DataFrame, id_col: str, cols: list[str], metric: str = "euclidean", p: float = 2.0,
                   leaf: int = LEAF) -> Tree:
    """The minimum spanning tree that holds all single-linkage clusterings."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    x = [f"x{i}" for i in range(len(cols))]
    for c in x:
        rows = rows.where(F.abs(c) < float("inf"))
    rows = materialize(running_totals(rows.withColumn("one", F.lit(1)), [], "id", ["one"])
                       .select((F.col("cum_one") - 1).alias("row"), "id", *x), "sl_rows")
    v, copies = vertices(rows, "row", x)
    same = copies.where(F.col("_id") != F.col("vid")).select(F.col("vid").alias("a"), F.col("_id").alias("b"),
                                                             F.lit(0.0).alias("dist"))
    every = _edges(v, x, metric, p, leaf).unionByName(same)
    ranked = running_totals(every.select(F.struct("dist", "a", "b").alias("e"), F.lit(1).alias("one")), [], "e", ["one"])
    edges = materialize(ranked.select((F.col("cum_one") - 1).alias("rk"), "e.a", "e.b", "e.dist"), "sl_edges")
    return Tree(rows.select("row", "id"), edges, rows.count())


def linkage_labels(tree: Tree, k: int) -> DataFrame:
    """(id, cluster): ``k`` clusters (all rows apart if there are fewer), numbered
    from 0 in the order of their smallest ids."""
    if k < 1:
        raise ValueError("at least one cluster")
    comp = connected_components(tree.edges.where(F.col("rk") < tree.n - k), "a", "b")
    lab = materialize(tree.rows.join(comp.withColumnRenamed("vertex", "row").hint("merge"), "row", "left")
                      .select("id", F.coalesce("component", "row").alias("comp")), "sl_comp")
    codes = lab.select("comp").distinct() \
        .withColumn("cluster", (F.row_number().over(Window.orderBy("comp")) - 1).cast("int"))  # k rows
    return lab.join(codes, "comp").select("id", "cluster")


def linkage_table(tree: Tree, block: int = BLOCK_EDGES) -> DataFrame:
    """(merge, left, right, height, size), one row per merge, from 0 by rising
    height.  ``left`` < ``right`` are row numbers, or ``n`` + the merge that
    made the cluster; ``size`` counts the rows of the new cluster."""
    n = tree.n
    ends = tree.edges.select("rk", "dist", *[F.struct(F.col(c).alias("v"), F.col(c).alias("node"), F.lit(1).cast("long").alias("size"))
                                             .alias(c) for c in ("a", "b")])
    span = block
    while span < n - 1:
        span *= 2
    while span > block:
        half = span // 2
        e = materialize(ends.withColumn("seg", F.floor(F.col("rk") / span)), "sl_level")
        low = (F.col("rk") % span) < half
        # the last stretch may have no upper half to serve
        under = e.where(low & (F.col("seg") * span + half < n - 1))
        name = materialize(connected_components(
            under.select(*[F.struct("seg", F.col(f"{c}.v").alias("v")).alias(c) for c in ("a", "b")]), "a", "b")
            .select(F.col("vertex.seg").alias("seg"), F.col("vertex.v").alias("v"), F.col("component.v").alias("to")), "sl_names")
        points = under.select("seg", F.explode(F.array("a", "b")).alias("p")).select("seg", "p.v", "p.size").distinct()
        size = points.join(name.hint("merge"), ["seg", "v"]).groupBy("seg", "to").agg(F.sum("size").alias("size"))
        top = under.select("seg", F.col("a.v").alias("v"), "rk").join(name.hint("merge"), ["seg", "v"]) \
            .groupBy("seg", "to").agg((F.max("rk") + n).alias("node"))
        made = name.join(size.join(top.hint("merge"), ["seg", "to"]).hint("merge"), ["seg", "to"]).select("seg", "v", F.struct(
            F.col("to").alias("v"), "node", "size").alias("new"))
        over = e.where(~low)
        for c in ("a", "b"):
            over = over.withColumn("v", F.col(f"{c}.v")).join(made.hint("merge"), ["seg", "v"], "left") \
                .withColumn(c, F.coalesce("new", c)).drop("v", "new")
        ends = materialize(over.unionByName(e.where(low)).select("rk", "dist", "a", "b"), "sl_ends")
        discard(e)
        span = half

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        names, at = np.unique(np.concatenate([pdf["av"], pdf["bv"]]), return_inverse=True)
        a, b = at[:len(pdf)], at[len(pdf):]
        node, size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        for c, i in (("a", a), ("b", b)):
            node[i], size[i] = pdf[f"{c}n"], pdf[f"{c}s"]
        up, out = np.arange(len(names)), []
        for rk, i, j, d in zip(pdf["rk"], a, b, pdf["dist"]):
            i, j = _root(up, i), _root(up, j)
            out.append((rk, min(node[i], node[j]), max(node[i], node[j]), d, size[i] + size[j]))
            up[j], node[i], size[i] = i, n + rk, size[i] + size[j]
        return pd.DataFrame(out, columns=["merge", "left", "right", "height", "size"])

    flat = ends.select("rk", "dist", *[F.col(f"{c}.{f}").alias(f"{c}{f[0]}") for c in ("a", "b") for f in ("v", "node", "size")],
                       F.floor(F.col("rk") / block).alias("seg"))
    return flat.groupBy("seg").applyInPandas(resolve, "merge long, left long, right long, height double, size long")
