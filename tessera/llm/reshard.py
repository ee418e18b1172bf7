"""Resharding by minimum-cost flow.

Old shards hold known numbers of bytes, new shards have capacities.  Moving a
byte costs one, leaving it costs nothing, so the cheapest plan is a minimum
cost flow on a bipartite graph of shards, solved on the driver from one number
per shard (both counts are parameters).  Each old shard is a line of rows in
hash order, cut into blocks; the flow cuts the line into consecutive stretches,
one per destination.  Whole blocks move, and the few rows around a cut decide
by the middle of their bytes; a few single rows then even out the rest.  Offsets are block totals plus running sums
inside a block, so no task ever sees a whole shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import n_partitions
from tessera.session import checkpoint_dir, discard, materialize


def cheapest_transfers(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow ``{(old, new): bytes}`` of least total cost (successive shortest
    augmenting paths, Bellman-Ford on the residual graph)."""
    n, m = len(supply), len(capacity)
    src, dst = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, cap: int, w: int) -> None:
        graph[u].append([v, cap, w, len(graph[v])])
        graph[v].append([u, 0, -w, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(src, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, dst, c, 0)
    while True:
        dist: dict[int, int] = {src: 0}
        via: dict[int, list] = {}
        todo = [src]
        while todo:
            nxt = []
            for u in todo:
                for e in graph[u]:
                    if e[1] > 0 and dist[u] + e[2] < dist.get(e[0], 1 << 60):
                        dist[e[0]] = dist[u] + e[2]
                        via[e[0]] = [u, e]
                        nxt.append(e[0])
            todo = nxt
        if dst not in dist:
            break
        path, v = [], dst
        while v != src:
            u, e = via[v]
            path.append(e)
            v = u
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i]
            if n <= e[0] < n + m and graph[e[0]][e[3]][1] > 0}


def even_capacities(total: int, n_new: int) -> list[int]:
    return [total // n_new + (j < total % n_new) for j in range(n_new)]


def _corrections(cut: DataFrame, capacity: list[int]) -> list[tuple[int, int, int]]:
    """Single rows ``(tie, size, new shard)`` that even out what the cuts left,
    at most half a row each: one row per shard and size class is offered (a
    few dozen a shard), the best fitting one goes from the fullest shard to
    the emptiest while that helps."""
    n = len(capacity)
    load = {r["_shard"]: r["s"] for r in cut.groupBy("_shard").agg(F.sum("_size").alias("s")).collect()}
    over = [load.get(j, 0) - capacity[j] for j in range(n)]
    same = cut.groupBy("_shard", "_tie", "_size").agg(F.count(F.lit(1)).alias("c")).where("c = 1")  # not repeated rows
    size_class = F.floor(F.log2(F.col("_size").cast("double")) * 2)
    offer = [(r["_shard"], r["m"]["_size"], r["m"]["_tie"]) for r in same.groupBy("_shard", size_class.alias("k")).agg(
        F.min(F.struct("_tie", "_size")).alias("m")).collect()]
    out = []
    while True:
        j, k = max(range(n), key=over.__getitem__), min(range(n), key=over.__getitem__)
        want = min(over[j], -over[k])
        mine = sorted((abs(size - want), size, tie) for s, size, tie in offer if s == j)
        if not mine or max(abs(over[j] - mine[0][1]), abs(over[k] + mine[0][1])) >= max(over[j], -over[k]):
            return out
        _, size, tie = mine[0]
        offer.remove((j, size, tie))
        over[j] -= size
        over[k] += size
        out.append((tie, size, k))


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int = 8,
            text: str = "text", row_id: str = "doc_id", carry: tuple[str, ...] = (),
            rows_per_block: int = 20_000) -> DataFrame:
    """Place every row of ``docs`` into one of ``n_new`` shards of near equal
    bytes, moving the fewest bytes from the ``old_shard`` layout (0 to
    ``n_old - 1``).

    Returns ``row_id, size, text_crc32, old_shard, shard, slot`` and the
    columns named in ``carry``.  ``size`` is the UTF-8 length plus one (null
    text: one byte, crc of the empty text); ``slot`` counts from 0 without gaps
    in each shard.  A null ``old_shard`` counts as 0.  Other columns of ``docs`` are ignored, so their names never
    clash.  Null ids and repeated rows are ordinary rows; an empty table gives
    an empty result.  Rows equal in id and text are interchangeable, all other
    ties are broken by hash, so reruns agree.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(row_id), *[F.col(c) for c in carry if c != row_id],
                    (F.octet_length(t) + 1).cast("long").alias("_size"), F.crc32(t).alias("_crc"),
                    F.coalesce(old_shard.cast("int"), F.lit(0)).alias("_old"), F.xxhash64(F.col(row_id), t).alias("_tie"))
    d = materialize(d, "reshard")
    rows = d.count()
    n_blocks = max(4 * n_partitions(spark), -(-rows // rows_per_block))
    d = d.withColumn("_block", F.pmod("_tie", F.lit(n_blocks)).cast("int"))
    blocks = materialize(d.groupBy("_old", "_block").agg(F.sum("_size").alias("_bytes")), "reshard-blocks")
    sums = {r["_old"]: r["_s"] for r in blocks.groupBy("_old").agg(F.sum("_bytes").alias("_s")).collect()}
    supply = [sums.get(i, 0) for i in range(n_old)]
    capacity = even_capacities(sum(supply), n_new)
    flow = cheapest_transfers(supply, capacity, lambda i, j: int(i != j))

    cuts = []  # a basic flow has fewer than n_old + n_new stretches
    for i in range(n_old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, at, j))
            at += flow[i, j]
    shard = F.lit(None).cast("int")
    if cuts:
        shard = F
        for i, at, j in reversed(cuts):
            shard = shard.when((F.col("_old") == i) & (F.col("_mid") >= at), F.lit(j))
    before = blocks.select("_old", "_block", (F.sum("_bytes").over(
        Window.partitionBy("_old").orderBy("_block")) - F.col("_bytes")).alias("_before"))
    order = ["_tie", row_id, "_size"]
    run = F.sum("_size").over(Window.partitionBy("_old", "_block").orderBy(*order)
                              .rowsBetween(Window.unboundedPreceding, 0))
    cut = d.join(before, ["_old", "_block"]) \
        .withColumn("_mid", F.col("_before") + run - F.col("_size") / 2).withColumn("_shard", shard)
    cut = materialize(cut.drop("_before", "_mid"), "reshard-cut")
    moved = F.col("_shard")
    for tie, size, j in _corrections(cut, capacity):
        moved = F.when((F.col("_tie") == tie) & (F.col("_size") == size), F.lit(j)).otherwise(moved)
    placed = cut.withColumn("_shard", moved) \
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_old", "_block", "_shard").orderBy(*order)))
    placed = materialize(placed, "reshard-placed")
    discard(cut)
    slots = placed.groupBy("_shard", "_old", "_block").agg(F.count(F.lit(1)).alias("_n"))
    slots = slots.select("_shard", "_old", "_block", (F.sum("_n").over(
        Window.partitionBy("_shard").orderBy("_old", "_block")) - F.col("_n")).alias("_off"))
    return placed.join(slots, ["_shard", "_old", "_block"]).select(
        row_id, *[c for c in carry if c != row_id], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_old").alias("old_shard"), F.col("_shard").alias("shard"),
        (F.col("_off") + F.col("_rn") - 1).alias("slot"))


def affected_shards(placed: DataFrame) -> list[int]:
    """New shards whose contents change; the others keep exactly their old rows."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    touched = moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    new = placed.select("shard").distinct().join(touched, F.col("shard") == F.col("s")).select("shard")
    return sorted(r[0] for r in new.collect())  # at most one row per new shard


def rewrite_affected(placed: DataFrame, path: str, affected: list[int] | None = None) -> list[int]:
    """Write the shards whose contents change (``path/shard=j``) and return
    their numbers; shards that keep exactly their old rows are left alone."""
    if affected is None:
        affected = affected_shards(placed)
    placed.where(F.col("shard").isin(affected)).write.mode("overwrite").partitionBy("shard").parquet(path)
    return affected


def reshard_files(docs: DataFrame, old_shard: Column, n_old: int, n_new: int = 8, text: str = "text",
                  row_id: str = "doc_id") -> DataFrame:
    """``reshard()``, then the affected shards written with their texts below
    the checkpoint folder.  Returns the same columns without ``carry``; size,
    crc and slot are those of the rows in the written shards, and in shards
    that nothing touches those of the rows as they lie.

    Rows are placed without their texts, which then travel once: to the places
    of their id and contents.  Equal rows are interchangeable, so one text
    serves all of them.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(row_id).alias("_row"), F.col(text).alias("_text"),
                      F.coalesce(old_shard.cast("int"), F.lit(0)).alias("_from"), F.xxhash64(F.col(row_id), t).alias("_key"),
                      F.col(text).isNull().alias("_void"))
    placed = reshard(own, F.col("_from"), n_old, n_new, "_text", "_row", carry=("_key", "_void"))
    placed = materialize(placed, "reshard-places")
    keys = [F.col("_key"), F.col("_void"), (F.octet_length(F.coalesce("_text", F.lit(""))) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("_text", F.lit(""))).alias("text_crc32")]
    # no null in a key, so that the join takes the texts where the aggregation left them
    ids = [F.coalesce(F.col("_row").cast("string"), F.lit("")).alias("_id"), F.col("_row").isNull().alias("_none")]
    same = ["_key", "_void", "size", "text_crc32", "_id", "_none"]
    texts = own.select(*keys, *ids, "_text").groupBy(*same).agg(F.first("_text").alias("_text"))
    full = placed.select("*", *ids).join(texts, same).select(
        F.col("_row").alias(row_id), F.col("_text").alias(text), "old_shard", "shard", "slot")
    affected = affected_shards(placed)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-shards-{uuid.uuid4().hex}"
    rewrite_affected(full, path, affected)
    kept = full.where(~F.col("shard").isin(affected))
    if affected:
        back = spark.read.schema(full.schema).parquet(path).select(*full.columns)
        rest = placed.select("shard").distinct().where(~F.col("shard").isin(affected)).count()
        full = back.unionByName(kept) if rest else back
    t = F.coalesce(F.col(text), F.lit(""))
    return full.select(row_id, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
                       "old_shard", "shard", "slot")
