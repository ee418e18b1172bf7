"""Space cut into leaves: the partitioning behind the neighbour operators.

A bounded sample of the points is split at medians of the widest feature, over
all features, until there is a leaf per ``target`` points (``MAX_LEAVES`` at
most, so the tree that travels with a task has a fixed bound).  Every point
then belongs to one leaf, leaf boxes are measured on all points, and a search
visits only the leaves whose box is near enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points the tree is built from, points a leaf should hold, leaves at most.
SAMPLE, LEAF, MAX_LEAVES = 100_000, 2_000, 16_384


class Leaves:
    """A binary tree over space; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        self.feature, self.split, self.kids, self.leaf = [], [], [], []
        self.n = 0
        d = sample.shape[1]
        todo = [(self._node(), np.arange(len(sample)), n_leaves)]
        while todo:
            node, idx, want = todo.pop()
            x = sample[idx]
            span = x.max(axis=0) - x.min(axis=0) if len(idx) else np.zeros(d)
            f = int(span.argmax()) if len(idx) else 0
            if want <= 1 or len(idx) < 2 or not span[f] > 0:
                self.leaf[node] = self.n
                self.n += 1
                continue
            at = np.median(x[:, f])
            if not (x[:, f] < at).any():  # the median is the least value
                at = x[:, f][x[:, f] > at].min()
            below = x[:, f] < at
            self.feature[node], self.split[node] = f, float(at)
            self.kids[node] = (self._node(), self._node())
            todo.append((self.kids[node][0], idx[below], want // 2))
            todo.append((self.kids[node][1], idx[~below], want - want // 2))
        self.lo = np.full((len(self.leaf), d), np.inf)
        self.hi = np.full((len(self.leaf), d), -np.inf)

    def _node(self) -> int:
        self.feature.append(-1)
        self.split.append(0.0)
        self.kids.append(None)
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.kids[node] is None:
                out[idx] = self.leaf[node]
                continue
            below = x[idx, self.feature[node]] < self.split[node]
            todo.append((self.kids[node][0], idx[below]))
            todo.append((self.kids[node][1], idx[~below]))
        return out

    def measure(self, boxes: dict[int, tuple[list[float], list[float]]]) -> None:
        """Set the boxes of leaves and of the nodes above them."""
        for node in range(len(self.leaf) - 1, -1, -1):
            if self.kids[node] is None:
                if self.leaf[node] in boxes:
                    self.lo[node], self.hi[node] = boxes[self.leaf[node]]
            else:
                a, b = self.kids[node]
                self.lo[node] = np.minimum(self.lo[a], self.lo[b])
                self.hi[node] = np.maximum(self.hi[a], self.hi[b])

    def near(self, x: np.ndarray, reach: np.ndarray, gap_to_distance) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) with the leaf's box within ``reach`` of the row;
        ``gap_to_distance`` turns per-feature gaps into a distance."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            gap = np.maximum(0, np.maximum(self.lo[node] - x[idx], x[idx] - self.hi[node]))
            idx = idx[gap_to_distance(gap) <= reach[idx]]
            if not len(idx):
                continue
            if self.kids[node] is None:
                rows.append(idx)
                leaves.append(np.full(len(idx), self.leaf[node]))
            else:
                todo += [(k, idx) for k in self.kids[node]]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def plan_leaves(points: DataFrame, cols: list[str], target: int = LEAF) -> Leaves:
    """Leaves for ``points`` (distinct rows of ``cols``, all double)."""
    n = points.count()
    sample = points.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(SAMPLE).toPandas()
    return Leaves(sample.to_numpy(float).reshape(len(sample), len(cols)), min(MAX_LEAVES, -(-n // target)))


def with_leaf(df: DataFrame, cols: list[str], leaves: Leaves) -> DataFrame:
    """``df`` with ``_leaf``."""
    def run(it):
        for pdf in it:
            yield pdf.assign(_leaf=leaves.assign(pdf[cols].to_numpy(float).reshape(len(pdf), len(cols))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, _leaf long")


def measure_leaves(leaves: Leaves, df: DataFrame, cols: list[str]) -> None:
    """Boxes from all points of ``df`` (one row per leaf comes to the driver)."""
    box = df.groupBy("_leaf").agg(*[F.min(c).alias(f"_l{i}") for i, c in enumerate(cols)],
                                  *[F.max(c).alias(f"_h{i}") for i, c in enumerate(cols)]).collect()
    d = range(len(cols))
    leaves.measure({r["_leaf"]: ([r[f"_l{i}"] for i in d], [r[f"_h{i}"] for i in d]) for r in box})


def matrix(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return pdf[cols].to_numpy(float).reshape(len(pdf), len(cols))
