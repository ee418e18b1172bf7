"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots,
nearest first.  A shard of the index holds, for every pivot, a posting list with
the place that each of the shard's vectors gives to this pivot.  A query adds up
the differences to its own places over all pivots' lists (Spearman's footrule),
keeps the nearest share of the shard and reranks these by exact cosine on the
original vectors in double precision.

Queries meet shards in blocks: an equi-join of block rows, whose sizes are
fixed, so no task depends on the size of either side.  Equal vectors are one
entry that knows the smallest ids that carry it (more can never be asked for),
which removes hot groups of copies without losing a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stream
from tessera.session import materialize

#: Sample from which pivots are chosen, pivots, vectors in a shard, queries in a block.
PIVOT_SAMPLE, PIVOTS, SHARD, BLOCK = 4_096, 256, 4_096, 4_096


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False)) \
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(sample: np.ndarray, k: int, alike: float = 0.8) -> np.ndarray:
    """First ``k`` unit vectors that are not too alike, then any others."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(unit)):
        if len(chosen) < k and (not chosen or float((unit[chosen] @ unit[i]).max()) < alike):
            chosen.append(i)
    rest = [i for i in range(len(unit)) if i not in set(chosen)]
    return unit[(chosen + rest)[:k]]


def places(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in every vector's order (equal distances: lower
    pivot first)."""
    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is scaled out first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(vectors: DataFrame, is_query: Column, k: int = 5, share: float = 0.05, least: int = 100,
           row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each query row: ``query_id, rank, vec_id,
    score``, nearest first, equal scores by smaller id.

    ``share`` of each shard, ``least`` vectors at the minimum, is reranked.
    Rows that are not ``usable`` and rows without an id take no part; rows equal
    in id and vector count once; a vector is only compared with vectors of its
    own length.  Fewer candidates than ``k`` (small tables) are all returned,
    as a shard never reranks fewer than ``least``.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = vectors.where(usable(F.col(vector)) & F.col(row_id).isNotNull()) \
        .select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                is_query.alias("q")).withColumn("c", F.xxhash64("v"))
    rows = v.groupBy("c", "id").agg(F.first("v").alias("v"), F.max("q").alias("q"))
    rows = materialize(rows, "ann-rows")
    first = F.row_number().over(Window.partitionBy("c").orderBy("id"))
    entries = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("c").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    entries = materialize(entries.withColumn("dim", F.size("v")), "ann-entries")
    dims = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().limit(1_001).collect()}
    if len(dims) > 1_000:
        raise ValueError("more than 1000 different vector lengths")
    pivots = {}
    for dim in dims:
        sample = entries.where(F.col("dim") == dim).orderBy(F.xxhash64("c")).limit(PIVOT_SAMPLE).select("v").collect()
        pivots[dim] = choose_pivots(np.array([r["v"] for r in sample]), PIVOTS)
    if not dims:
        return spark.createDataFrame([], out)

    def shard_rows(it):
        """Pack a partition's entries into shard rows with their posting lists."""
        buf: dict = {}

        def pack(dim):
            got = buf.pop(dim)
            x = np.array([g[1] for g in got])
            files = np.ascontiguousarray(places(_unit(x), pivots[dim]).T)  # one posting list per pivot
            n = [len(g[0]) for g in got]
            return (dim, len(got), x.tobytes(), files.tobytes(), np.array(n, np.int32).tobytes(),
                    np.array([i for g in got for i in g[0]], np.int64).tobytes())

        for ids, x in it:
            buf.setdefault(len(x), []).append((ids, x))
            if len(buf[len(x)]) == SHARD:
                yield pack(len(x))
        for dim in list(buf):
            yield pack(dim)

    shards = stream(entries.select("ids", "v"), shard_rows,
                    "dim int, n int, x binary, files binary, n_ids binary, ids binary", step=4)

    def query_rows(it):
        buf: dict = {}

        def pack(dim):
            got = buf.pop(dim)
            return (dim, np.array([g[0] for g in got], np.int64).tobytes(), np.array([g[1] for g in got]).tobytes())

        for i, x in it:
            buf.setdefault(len(x), []).append((i, x))
            if len(buf[len(x)]) == BLOCK:
                yield pack(len(x))
        for dim in list(buf):
            yield pack(dim)

    asked = rows.where("q").select("id", "v")
    full = max(1, -(-asked.count() // BLOCK))  # so many tasks fill their blocks, each reading a part of the queries
    blocks = stream(asked.coalesce(full), query_rows, "dim int, qid binary, qx binary", step=4)
    blocks = materialize(blocks, "ann-queries")
    # every shard meets every query block of its vector length: an equi-join of rows of fixed size
    n_rows = blocks.groupBy("dim").count()
    blocks = blocks.withColumn("key", F.sha2(F.concat("qid", "qx"), 256))
    # numbered without their vectors: a short key per block passes the window
    number = blocks.select("dim", "key").withColumn("b", F.row_number().over(Window.partitionBy("dim").orderBy("key")))
    blocks = blocks.join(number, ["dim", "key"]).drop("key")
    shards = materialize(shards, "ann-shards")
    pairs = shards.join(n_rows, "dim").withColumn("b", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))) \
        .join(blocks, ["dim", "b"]).drop("b", "count")
    pairs = pairs.repartition(F.xxhash64("qid", "ids"))

    def probe(it):
        for dim, n, x, files, n_ids, ids, qid, qx in it:
            x = np.frombuffer(x, np.float64).reshape(n, dim)
            unit = _unit(x)
            files = np.frombuffer(files, np.uint8).reshape(-1, n).astype(np.int16)
            n_ids, ids = np.frombuffer(n_ids, np.int32), np.frombuffer(ids, np.int64)
            at = np.concatenate(([0], np.cumsum(n_ids)))
            qid = np.frombuffer(qid, np.int64)
            q = _unit(np.frombuffer(qx, np.float64).reshape(len(qid), dim))
            mine = places(q, pivots[dim]).astype(np.int16)
            depth = min(n, max(least, int(np.ceil(share * n))))
            for i in range(len(qid)):
                footrule = np.abs(files - mine[i][:, None]).sum(axis=0, dtype=np.int32)
                near = np.argpartition(footrule, depth - 1)[:depth] if depth < n else np.arange(n)
                s = (unit[near] * q[i]).sum(axis=1)
                # copies are in id order, so k + 1 of the best entries' ids always hold the k best
                found = []
                for j in near[np.lexsort((ids[at[near]], -s))]:
                    same = ids[at[j]:at[j + 1]]
                    score = float((unit[j] * q[i]).sum())
                    if len(found) >= k and score < found[k - 1][0]:
                        break
                    found += [(score, int(c)) for c in same if c != qid[i]]
                    found.sort(key=lambda t: (-t[0], t[1]))
                for score, c in found[:k]:
                    yield int(qid[i]), c, min(1.0, max(-1.0, score))

    hits = stream(pairs.select("dim", "n", "x", "files", "n_ids", "ids", "qid", "qx"), probe,
                  "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    result = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
    return result


