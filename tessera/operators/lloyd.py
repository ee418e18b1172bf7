"""K-means, all starts and all cluster counts in the same scans (K-01, K-03).

* Starts are D² samples drawn with a portable hash: the next centre of a start
  is the row of the least ``-ln(u) / D²``, ``u`` from the MD5 of (seed, start,
  step, row id).  A step is one scan for all starts; the first k centres of a
  start serve every count k.
* A Lloyd iteration is one scan: a task keeps, per (k, start, cluster), its
  rows, their sums and their squared distances, so one row per cluster and
  task is shuffled.  Runs that have converged leave the scan.
* What the driver holds is the centres: ``n_init * sum(ks)`` rows, bounded by
  the parameters whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: Rows compared with the centres at once.
CHUNK = 2_048
#: Inertias closer than this (relative) count as equal; the first start wins.
SAME = 1e-9


@dataclass
class Fit:
    """One fitted run: ``centres`` (k x features), its inertia and iterations."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float = 0.0
    iterations: int = 0

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def _squared(x: np.ndarray, centres: np.ndarray, room: tuple | None = None) -> np.ndarray:
    """Squared distances (rows x centres), features added in order; ``room``
    (two arrays of that width) is written over."""
    total, diff = (r[:len(x)] for r in room) if room else (np.empty((len(x), len(centres))) for _ in range(2))
    total[:] = 0
    for i, c in enumerate(np.ascontiguousarray(centres.T)):
        np.subtract(x[:, i, None], c, out=diff)
        np.multiply(diff, diff, out=diff)
        total += diff
    return total


def _chunks(it, cols: list[str]):
    for pdf in it:
        for at in range(0, len(pdf), CHUNK):
            part = pdf.iloc[at:at + CHUNK]
            yield part, part[cols].to_numpy(float).reshape(len(part), len(cols))


def _seeds(data: DataFrame, id_col: str, cols: list[str], k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """Up to ``k`` centres per start (fewer when the rows have fewer distinct values)."""
    chosen = [np.empty((0, len(cols))) for _ in range(n_init)]
    id_type = data.schema[id_col].dataType.simpleString()
    xs = ", ".join(f"x{i} double" for i in range(len(cols)))
    squared, chunks = _squared, _chunks
    for step in range(k):
        draws = [F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(s), F.lit(step), F.col(id_col).cast("string"))),
                                    1, 13), 16, 10).cast("double").alias(f"_u{s}") for s in range(n_init)]

        def race(it, centres=list(chosen), step=step):
            best = {}
            for part, x in chunks(it, cols):
                for s, c in enumerate(centres):
                    if step and not len(c):
                        continue
                    d2 = squared(x, c).min(axis=1) if step else np.ones(len(x))
                    u = (part[f"_u{s}"].to_numpy() + 0.5) / 2.0 ** 52
                    with np.errstate(divide="ignore"):
                        key = np.where(d2 > 0, -np.log(u) / d2, np.inf)
                    i = int(key.argmin())
                    tied = np.flatnonzero(key == key[i])
                    i = min(tied.tolist(), key=lambda j: part[id_col].iloc[j]) if len(tied) > 1 and np.isfinite(key[i]) else i
                    found = (key[i], part[id_col].iloc[i], tuple(x[i]))
                    if np.isfinite(key[i]) and (s not in best or found < best[s]):
                        best[s] = found
            yield pd.DataFrame([(s, key, who, *x) for s, (key, who, x) in best.items()],
                               columns=["s", "key", "who", *[f"x{i}" for i in range(len(cols))]])

        won = data.select(id_col, *cols, *draws).mapInPandas(race, f"s int, key double, who {id_type}, {xs}") \
            .groupBy("s").agg(F.min(F.struct("key", "who", *[f"x{i}" for i in range(len(cols))])).alias("b")).collect()
        for r in won:
            x = np.array([[r["b"][f"x{i}"] for i in range(len(cols))]])
            chosen[r["s"]] = np.concatenate([chosen[r["s"]], x])
    return chosen


def _scan(data: DataFrame, cols: list[str], fits: list[Fit], last: bool = False) -> dict:
    """``{(run, cluster): (rows, squared distances, sums, sum of squares)}`` of the
    nearest centres; squared distances and sum of squares are 0 but in the ``last`` scan."""
    table = np.concatenate([f.centres for f in fits])
    ends = np.cumsum([0] + [len(f.centres) for f in fits])
    d = len(cols)
    squared, chunks = _squared, _chunks

    # runs of as many centres lie side by side and are compared at once
    alike = []
    for size, group in groupby([len(f.centres) for f in fits]):
        alike.append((size, len(list(group))))

    def run(it):
        acc = np.zeros((len(table), d + 3))
        room = tuple(np.empty((CHUNK, len(table))) for _ in range(2))
        for _, x in chunks(it, cols):
            dist = squared(x, table, room)
            at, a = [], 0
            for size, m in alike:
                at.append(dist[:, a:a + size * m].reshape(len(x), m, size).argmin(axis=2) + np.arange(a, a + size * m, size))
                a += size * m
            at = np.concatenate(at, axis=1)  # rows x runs
            where = at.ravel()
            near, sq = (dist[np.arange(len(x))[:, None], at].ravel(), (x * x).sum(axis=1)) if last else (None, None)
            for col, v in enumerate([None, near, sq, *x.T]):
                if col and v is None:
                    continue
                acc[:, col] += np.bincount(where, v if v is None or col == 1 else np.repeat(v, at.shape[1]), len(table))
        used = np.flatnonzero(acc[:, 0])
        out = pd.DataFrame(acc[used], columns=["n", "near", "sq", *[f"x{i}" for i in range(d)]])
        out.insert(0, "c", used)
        yield out

    names = ["n", "near", "sq", *[f"x{i}" for i in range(d)]]
    got = data.select(*cols).mapInPandas(run, "c long, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = {}
    for r in got:
        i = int(np.searchsorted(ends, r["c"], side="right")) - 1
        out[i, r["c"] - int(ends[i])] = (r["n"], r["near"], np.array([r[f"x{j}"] for j in range(d)]), r["sq"])
    return out


def fit_all(df: DataFrame, id_col: str, cols: list[str], ks: list[int], n_init: int = 10, seed: int = 42,
            max_iter: int = 300, tol: float = 1e-4) -> tuple[DataFrame, dict[int, Fit], dict]:
    """``(rows, {k: best fit}, statistics)`` for every count in ``ks``.

    Rows with a null feature are left out; the rest are written once with all
    columns of ``df``.  A run ends when its centres' summed squared shift is at
    most ``tol`` times the features' mean variance (0: until they stand still),
    or after ``max_iter`` scans.  A cluster that loses its rows keeps its
    centre.  With fewer distinct rows than k a run has that many clusters.  The
    best fit has the least inertia, ties (``SAME``) to the first start.
    Statistics are those of the best fits, keyed (k, cluster).
    """
    data = materialize(df.select(*[c for c in df.columns if c not in cols],
                                 *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=cols), "lloyd")
    first = data.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    if first[0] is None:
        return data, {}, {}
    least = max(tol, 1e-20) * sum(first) / len(cols)
    seeds = _seeds(data, id_col, cols, max(ks), n_init, seed)
    fits = [Fit(k, s, seeds[s][:k].copy()) for k in ks for s in range(n_init)]
    active = list(fits)
    for _ in range(max_iter):
        if not active:
            break
        got = _scan(data, cols, active)
        moving = []
        for i, f in enumerate(active):
            new = f.centres.copy()
            for c in range(len(new)):
                if (i, c) in got:
                    new[c] = got[i, c][2] / got[i, c][0]
            shift = float(((new - f.centres) ** 2).sum())
            f.centres, f.iterations = new, f.iterations + 1
            if shift > least:
                moving.append(f)
        active = moving
    got = _scan(data, cols, fits, last=True)
    best = {}
    for i, f in enumerate(fits):
        f.inertia = float(sum(got[i, c][1] for c in range(len(f.centres)) if (i, c) in got))
    for k in ks:
        runs = [f for f in fits if f.k == k]
        floor = min(f.inertia for f in runs) * (1 + SAME)
        best[k] = next(f for f in runs if f.inertia <= floor)
    at = {(f.k, f.start): i for i, f in enumerate(fits)}
    stats = {(k, c): got[at[k, f.start], c] for k, f in best.items() for c in range(len(f.centres))
             if (at[k, f.start], c) in got}
    return data, best, stats


def assign(data: DataFrame, cols: list[str], fit: Fit, out: str = "cluster") -> DataFrame:
    """``data`` with the number of the nearest centre (ties: the smaller)."""
    dist = F.array(*[reduce(add, [(F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) for c, m in zip(cols, centre)])
                     for centre in fit.centres])
    return data.withColumn("_d", dist).withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def silhouettes_squared(data: DataFrame, cols: list[str], best: dict[int, Fit], stats: dict) -> dict[int, float]:
    """Mean silhouette (squared Euclidean distance) of every fit, in one scan:
    a row's mean distance to a cluster follows from the cluster's statistics.
    A lone row counts 0, a single cluster gives 0."""
    plans = {}
    for k, f in best.items():
        cs = [c for c in range(len(f.centres)) if (k, c) in stats]
        if len(cs) > 1:
            n = np.array([stats[k, c][0] for c in cs])
            plans[k] = (f.centres, np.searchsorted(cs, np.arange(len(f.centres))), n,
                        np.array([stats[k, c][2] for c in cs]), np.array([stats[k, c][3] for c in cs]))
    squared, chunks = _squared, _chunks

    def run(it):
        total = dict.fromkeys(plans, 0.0)
        rows = 0
        for _, x in chunks(it, cols):
            rows += len(x)
            sq = (x * x).sum(axis=1)
            for k, (centres, place, n, sums, psi) in plans.items():
                own = place[squared(x, centres).argmin(axis=1)]
                mean = (n * sq[:, None] - 2 * (x @ sums.T) + psi) / n
                me = np.arange(len(x))
                size = n[own]
                a = mean[me, own] * size / np.maximum(size - 1, 1)
                mean[me, own] = np.inf
                b = mean.min(axis=1)
                top = np.maximum(a, b)
                total[k] += float(np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).sum())
        yield pd.DataFrame([(k, v, rows) for k, v in total.items()], columns=["k", "total", "n"])

    got = data.select(*cols).mapInPandas(run, "k int, total double, n long").groupBy("k") \
        .agg((F.sum("total") / F.sum("n")).alias("v")).collect() if plans else []
    return dict.fromkeys(best, 0.0) | {r["k"]: r["v"] for r in got}
