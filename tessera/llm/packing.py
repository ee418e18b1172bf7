"""Packing by cutting-stock column generation.

Documents become token ids; whole sequences are cut off their front, what
remains is shorter than a sequence.  The lengths of the pieces form a histogram
over at most a few hundred classes (exact up to 64 tokens, then steps of 8), a
size fixed by the sequence length and not by the data.  On it a linear program
over patterns is solved by column generation: a knapsack by dynamic programming
prices new patterns.  Rounded patterns give sequences; pieces are ranked within
their class and take the pattern slots in that order, so assignment is a join
with a table of at most a few thousand rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import n_partitions, salted, stream
from tessera.session import materialize

EXACT, STEP = 64, 8


def classes_of(capacity: int) -> list[int]:
    """Ascending class tops; a piece belongs to the least top not below it."""
    tops = list(range(1, min(EXACT, capacity) + 1))
    return tops + list(range(EXACT + STEP, capacity, STEP)) + ([capacity] if capacity > EXACT else [])


def best_pattern(width: np.ndarray, value: np.ndarray, capacity: int, most: np.ndarray) -> tuple[float, np.ndarray]:
    """Most valuable multiset of classes that fits, with at most ``most`` of
    each (knapsack by dynamic programming; copies enter in doubling bundles)."""
    best = np.zeros(capacity + 1)
    taken = []
    for c in np.flatnonzero((value > 1e-12) & (most > 0)):
        w, v, k = int(width[c]), float(value[c]), 1
        room = min(int(most[c]), capacity // w)
        while room > 0:
            k = min(k, room)
            cand = best[:-w * k] + v * k
            better = cand > best[w * k:] + 1e-12
            best[w * k:] = np.where(better, cand, best[w * k:])
            taken.append((c, k, w * k, better))
            room -= k
            k *= 2
    out = np.zeros(len(width), dtype=np.int64)
    at = capacity
    for c, k, w, better in reversed(taken):
        if at >= w and better[at - w]:
            out[c] += k
            at -= w
    return float(best[capacity]), out


def cutting_stock(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3,
                  limit: int = 4_000) -> list[tuple[int, np.ndarray]]:
    """``[(copies, pattern)]`` that meets every class's demand exactly.

    Column generation on the linear covering relaxation, priced at duals
    smoothed towards the best ones seen, until Farley's bound shows a relative
    gap below ``gap`` (or after ``limit`` pivots: every basis is feasible).
    Copies are rounded down, the rest is filled pattern by pattern."""
    n = len(width)
    if not n:
        return []
    d = demand + np.random.default_rng(0).random(n) * 1e-6  # breaks ties between degenerate bases
    per = np.minimum(capacity // width, np.maximum(1, demand)).astype(float)
    cols = [row * int(k) for row, k in zip(np.eye(n, dtype=np.int64), per)]
    inv, x, cost = np.diag(1.0 / per), d / per, np.ones(n)
    bound, anchor = 0.0, width / capacity  # widths are feasible duals
    for _ in range(limit):
        y = cost @ inv
        if y.min() < -1e-9:  # covering more than asked for pays
            c = int(y.argmin())
            a, price = -np.eye(n, dtype=np.int64)[c], 0.0
        else:
            for pull in (0.8, 0.5, 0.0):
                z = pull * anchor + (1 - pull) * y
                worth, a = best_pattern(width, z, capacity, demand)
                if worth > 1 and float(z @ d) / worth > bound:
                    bound, anchor = float(z @ d) / worth, z / worth
                elif worth <= 1 and float(z @ d) > bound:
                    bound, anchor = float(z @ d), z
                if y @ a > 1 + 1e-9:
                    break
            total = float(cost @ x)
            if y @ a <= 1 + 1e-9 or total - bound <= gap * total:
                break
            price = 1.0
        u = inv @ a
        ok = u > 1e-9
        ratio = np.where(ok, x / np.where(ok, u, 1), np.inf)
        r = int(ratio.argmin())
        theta = ratio[r]
        x = np.maximum(x - theta * u, 0)
        x[r] = theta
        inv[r] /= u[r]
        u[r] = 0
        inv -= np.outer(u, inv[r])
        cols[r], cost[r] = a, price
    left = demand.astype(np.int64).copy()
    out = []

    def use(k: int, a: np.ndarray) -> None:
        while k > 0 and a.any():  # classes that run out leave the pattern
            a = np.minimum(a, left)
            if not a.any():
                return
            t = min(k, int((left[a > 0] // a[a > 0]).min()))
            out.append((t, a))
            left[:] -= t * a
            k -= t

    for k, a, c in sorted(zip(np.floor(x + 1e-5).astype(np.int64), cols, cost), key=lambda p: -int(p[0])):
        if c and k > 0:
            t = min(int(k), int((left[a > 0] // a[a > 0]).min()))
            if t > 0:
                use(t, a)
    while left.any():  # what rounding left: the largest piece, and the fullest filling of its room
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        a = best_pattern(width, width.astype(float), capacity - int(width[top]), rest)[1]
        a[top] += 1
        use(int((left[a > 0] // a[a > 0]).min()), a)
    return out


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Bytes of every ordinary token of a byte-level BPE file.  Such files
    write a byte as itself where printable, others as the characters from
    U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    spec = json.loads(tokenizer_json)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


def make_encoder(tokenizer_json: str, ranks: dict[bytes, int], pattern: str):
    """Text to ids as the tokenizer file defines them.

    The merges run in ``tiktoken`` over the same vocabulary, which gives equal
    ids several times faster; the first texts are checked against the
    ``tokenizers`` library, which takes over if they ever differ, and always
    for texts that spell out an added token."""
    import tiktoken
    from tokenizers import Tokenizer
    slow = Tokenizer.from_str(tokenizer_json)
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
    state = {"checks": 3, "fast": True}

    def encode(text: str) -> list[int]:
        if not state["fast"] or any(a in text for a in added):
            return slow.encode(text, add_special_tokens=False).ids
        ids = fast.encode_ordinary(text)
        if state["checks"] and len(text) < 100_000:
            state["checks"] -= 1
            if ids != slow.encode(text, add_special_tokens=False).ids:
                state["fast"] = False
                return encode(text)
        return ids

    return encode


def tokenize(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, keep: list[Column],
             text: str = "text", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: whole sequences first, then the rest.

    Returns the ``keep`` columns, ``start, length, ids_crc32, doc_tokens`` and,
    if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    ranks = byte_ranks(spec)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(rows):
        encode = None
        for *cols, t in rows:
            if encode is None:
                encode = make_encoder(spec, ranks, pattern)
            ids = np.array([*(encode(t) if t else ()), end_id], dtype="<u4")
            for at in range(0, len(ids), capacity):
                piece = ids[at:at + capacity].tobytes()
                yield (*cols, at, len(piece) // 4, zlib.crc32(piece), len(ids), *((piece,) if with_ids else ()))

    return stream(kept, run, f"{fields}, start long, length long, ids_crc32 long, doc_tokens long"
                  + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, row_id: str = "doc_id",
         text: str = "text", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``capacity`` ids.

    One row per piece: ``row_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids`` if asked for).  A null text counts as
    empty and holds just ``end_id``.  Null ids and repeated rows are packed like
    any others; other columns are ignored; an empty table gives an empty
    result.  Ranks follow a hash of id, position and contents, so reruns agree.
    """
    spark = docs.sparkSession
    pieces = tokenize(docs, tokenizer_path, pattern, capacity, [F.col(row_id).alias("_row")], text, end_id, with_ids)
    tops = classes_of(capacity)
    cls = F.when(F.col("length") <= min(EXACT, capacity), F.col("length")).otherwise(
        F.least(F.ceil(F.col("length") / STEP) * STEP, F.lit(capacity))).cast("int")
    pieces = materialize(pieces.withColumn("_cls", cls)
                         .withColumn("_tie", F.xxhash64("_row", "start", "length", "ids_crc32")), "pack-pieces")
    hist = {r["_cls"]: r["n"] for r in pieces.groupBy("_cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = np.array([t for t in tops if t in hist], dtype=np.int64)
    patterns = cutting_stock(width, np.array([hist[int(t)] for t in width], dtype=np.int64), capacity)
    used, seq, slots = {int(t): 0 for t in width}, 0, []
    for copies, a in patterns:
        for c in np.flatnonzero(a):
            t, per = int(width[c]), int(a[c])
            slots.append((t, used[t], used[t] + per * copies, seq, per))
            used[t] += per * copies
        seq += copies
    schema = "_cls int, _lo long, _hi long, _seq long, _per long"
    table = spark.createDataFrame(slots, schema)
    r = salted(pieces, ["_cls"], ["_tie", "start"], F.col("_tie"), 4 * n_partitions(spark))
    r = r.join(F.broadcast(table), "_cls").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))) \
        .withColumn("sequence_id", F.col("_seq") + F.expr("(_rank - _lo) div _per"))
    w = Window.partitionBy("sequence_id").orderBy(F.col("_cls").desc(), "_rank").rowsBetween(
        Window.unboundedPreceding, 0)
    return r.withColumn("offset", F.sum("length").over(w) - F.col("length")).select(
        F.col("_row").alias(row_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """Token sequences of packed pieces (``with_ids=True``): at most
    ``capacity`` ids per group, so a group is never large."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(part.alias("p"), F.sum("length").alias("length")).select(
        "sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
