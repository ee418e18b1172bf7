"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over hashed word shingles.  Equal
fingerprints are one vertex.  Two fingerprints within ``max_bits`` differing
bits agree on some choice of whole blocks (pigeonhole), so for every choice the
bits are permuted to bring its blocks to the front and the fingerprints are
sorted by the Gray rank of the result.  Consecutive fingerprints then share
their leading bits and most of the next ones:

* the top level of the index is the agreed prefix,
* below it are runs of at most ``RUN`` fingerprints, each with the pattern and
  the mask of the bits all of them share,
* below these, groups of ``GROUP`` with patterns and masks of their own.

A search compares node with node: differences on the bits that both share are
accumulated downwards, and whole groups fall out once they exceed the limit.
Groups that are already connected are not compared again.  Only links that
connect something new leave a task, at most one fewer than its fingerprints, so
a dense group of copies never becomes all its pairs.  Runs of one prefix that
fell into different tasks are joined by prefix and pruned by the same rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, groupby, islice

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import n_partitions, stream
from tessera.operators.graph import connected_components
from tessera.session import materialize

RUN, GROUP = 1_024, 32


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """Majority vote over XXH64 (seed 42) of ``size``-word shingles of the
    lower-cased (A-Z) text; fewer words: the whole sequence; none: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    votes = np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[size - 1:].tolist()
    for at in range(0, n, 8_192):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + 8_192], ends[at:at + 8_192])],
                     dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[Column], text: str = "text", size: int = 4) -> DataFrame:
    """``keep`` columns plus ``_fp`` (the fingerprint as a signed long)."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    last = len(kept.columns) - 1

    def run(rows):
        for *ids, t in rows:
            f = fingerprint(t, size)
            yield (*ids, f - (1 << 64) if f >> 63 else f)

    return stream(kept, run, f"{fields}, _fp long", binary=(last,))


def tables_for(n: int, max_bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks ``(shift, width)`` of the 64 bits and the choices of blocks to
    agree on.  Any choice of parameters is exact; more blocks are taken when
    there are more fingerprints, so that about 256 share a prefix."""
    blocks = max_bits + 1
    while blocks < 16:
        agreed = blocks - max_bits
        if 64 // blocks * agreed >= math.log2(max(2, n)) - 8:
            break
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(blocks)]
    return cut, list(combinations(range(blocks), blocks - max_bits))


def layout(cut: Sequence[tuple[int, int]], choice: Sequence[int]) -> list[tuple[int, int, int]]:
    """``(shift, width, new shift)`` that brings the chosen blocks to the front."""
    out, at = [], 64
    for i in [*choice, *(i for i in range(len(cut)) if i not in choice)]:
        at -= cut[i][1]
        out.append((cut[i][0], cut[i][1], at))
    return out


def gray_ranks(x: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    """Gray rank of fingerprints whose blocks have been moved."""
    out = np.zeros_like(x)
    for shift, width, to in moves:
        out |= ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(to)
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _back(x: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros_like(x)
    for shift, width, to in moves:
        out |= ((x >> np.uint64(to)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
    return out


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of the bits that all fingerprints of each group share."""
    at = np.arange(0, len(x), GROUP)
    both, some = np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)
    return both, ~(both ^ some)


def links(x: np.ndarray, y: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect something new among ``x``, or between ``x`` and
    ``y``; positions in ``y`` follow those in ``x``.  Within one array the
    groups are taken as they lie, so neighbours in Gray order connect first."""
    both = x if y is None else np.concatenate((x, y))
    forest, found = _Forest(len(both)), []
    px, mx = nodes(x)
    py, my = (px, mx) if y is None else nodes(y)
    apart = np.bitwise_count((px[:, None] ^ py[None, :]) & mx[:, None] & my[None, :])
    todo = np.argwhere(apart <= max_bits)
    if y is None:
        todo = todo[todo[:, 0] <= todo[:, 1]]
        todo = todo[np.lexsort((todo[:, 0], todo[:, 1] - todo[:, 0]))]
    base = 0 if y is None else len(x)
    z = x if y is None else y
    for i, j in todo.tolist():
        a, b = x[i * GROUP:(i + 1) * GROUP], z[j * GROUP:(j + 1) * GROUP]
        if len({forest.root(i * GROUP + k) for k in range(len(a))}
               | {forest.root(base + j * GROUP + k) for k in range(len(b))}) == 1:
            continue
        near = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits)
        for p, q in near.tolist():
            p, q = i * GROUP + p, base + j * GROUP + q
            if p != q and forest.join(p, q):
                found.append((p, q))
    return found


def fingerprint_links(fps: DataFrame, max_bits: int = 4, col: str = "_fp") -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all pairs of distinct
    fingerprints within ``max_bits`` differing bits."""
    spark = fps.sparkSession
    n = fps.count()
    cut, choices = tables_for(n, max_bits)
    moves = [layout(cut, c) for c in choices]
    prefix = [sum(cut[i][1] for i in c) for c in choices]

    def expand(it):
        while part := list(islice(it, 8_192)):
            x = np.array([r[0] for r in part], dtype=np.int64).view(np.uint64)
            for t, m in enumerate(moves):
                yield from zip([t] * len(x), gray_ranks(x, m).view(np.int64).tolist())

    spread = stream(fps.select(col), expand, "t int, g long", step=16_384)
    spread = spread.repartitionByRange(n_partitions(spark), "t", "g").sortWithinPartitions("t", "g")
    schema = "a long, b long, t int, key long, run long, pattern long, mask long, x binary"

    def long(v) -> int:
        return int(np.uint64(v).astype(np.int64))

    def index(it):
        """Links inside runs; the runs themselves only where their prefix has others."""
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()

        def keyed():
            while buf := list(islice(it, 16_384)):
                t = np.array([r[0] for r in buf])
                g = np.array([r[1] for r in buf], dtype=np.int64).view(np.uint64)
                x = g ^ (g >> np.uint64(1))  # Gray code of the rank: the permuted fingerprint
                key = x >> (np.uint64(64) - np.array(prefix, dtype=np.uint64)[t])
                yield from zip(t.tolist(), key.tolist(), x.tolist())

        def runs():
            for (t, key), members in groupby(keyed(), key=lambda r: r[:2]):
                buf = []
                for r in members:
                    if len(buf) == RUN:
                        yield t, key, buf, True
                        buf = []
                    buf.append(r[2])
                yield t, key, buf, False

        count, held, before = 0, None, None
        for t, key, xs, more in runs():
            x = np.array(xs, dtype=np.uint64)
            if len(x) > 1:
                got = links(x, None, max_bits)
                if got:
                    o = _back(x, moves[t]).view(np.int64)
                    for p, q in got:
                        yield int(o[p]), int(o[q]), None, None, None, None, None, None
            both, some = np.bitwise_and.reduce(x), np.bitwise_or.reduce(x)
            node = (None, None, t, key, (part << 40) + count, long(both), long(~(both ^ some)), x.tobytes())
            # a prefix may go on in another task only at this one's first and last run
            if count == 0 or more or before == (t, key):
                yield node
                held = None
            else:
                held = node
            before, count = (t, key), count + 1
        if held:
            yield held

    tree = materialize(stream(spread, index, schema, step=512), "simhash-index")
    near = tree.where(F.col("a").isNotNull()).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    runs = tree.where(F.col("x").isNotNull()).drop("a", "b")

    def members(it):
        for t, run, x in it:
            for f in _back(np.frombuffer(x, np.uint64), moves[t]).view(np.int64).tolist():
                yield t, run, f

    # runs that links inside runs have already connected need not meet again: a dense
    # group that fills many runs is compared along its runs, not run by run
    comp = connected_components(near)
    one = stream(runs.select("t", "run", "x"), members, "t int, run long, vertex long") \
        .join(comp, "vertex", "left").withColumn("c", F.coalesce("component", "vertex")).groupBy("t", "run") \
        .agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    runs = runs.join(one, ["t", "run"]).withColumn("whole", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).drop("lo", "hi")
    other = runs.select("t", "key", F.col("run").alias("run2"), F.col("pattern").alias("p2"),
                        F.col("mask").alias("m2"), F.col("x").alias("x2"), F.col("whole").alias("whole2"))
    shared = F.col("mask").bitwiseAND(F.col("m2"))
    pairs = runs.join(other, ["t", "key"]).where(
        (F.col("run") < F.col("run2")) & ~F.coalesce(F.col("whole") == F.col("whole2"), F.lit(False))
        & (F.bit_count(F.col("pattern").bitwiseXOR(F.col("p2")).bitwiseAND(shared)) <= max_bits))
    pairs = pairs.select("t", "x", "x2").repartition(n_partitions(spark))

    def across(it):
        for t, x, y in it:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            o = _back(np.concatenate((x, y)), moves[t]).view(np.int64)
            for p, q in links(x, y, max_bits):
                yield int(o[p]), int(o[q])

    return near.unionByName(stream(pairs, across, "src long, dst long"))


def components(docs: DataFrame, keep: list[Column] = (), row_id: str = "doc_id", text: str = "text",
               size: int = 4, max_bits: int = 4) -> DataFrame:
    """Fingerprint and component of every row: ``row_id``, the ``keep``
    columns, ``fingerprint`` (16 hex digits), ``component_id``, the smallest id
    reachable over fingerprints at ``max_bits`` differing bits or fewer, and
    ``component_root``, which is never null.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    without an id link by their text; a component without any id has a null
    ``component_id``.  Repeated rows share their component.  Other columns are
    ignored; an empty table gives an empty result.
    """
    d = materialize(fingerprints(docs, [F.col(row_id).alias("_id"), *keep], text, size), "simhash-docs")
    fps = materialize(d.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-fps")
    comp = connected_components(fingerprint_links(fps.select("_fp"), max_bits))
    root = fps.join(comp, F.col("_fp") == F.col("vertex"), "left") \
        .select("_fp", "_least", F.coalesce("component", "_fp").alias("_root"))
    root = materialize(root, "simhash-roots")
    least = root.groupBy("_root").agg(F.min("_least").alias("component_id"))
    root = root.join(least, "_root").select("_fp", "component_id", F.col("_root").alias("component_root"))
    hexed = F.lpad(F.lower(F.hex(F.col("_fp"))), 16, "0")
    return d.join(root, "_fp").select(F.col("_id").alias(row_id), *[c for c in d.columns if c not in ("_id", "_fp")],
                                      hexed.alias("fingerprint"), "component_id", "component_root")


def keep_first(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = 4,
               max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest
    id (null last), of several texts under that id the one with the smallest
    hash, of rows equal in id and text any one."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = [F.xxhash64(F.col(row_id), t).alias("_key"), F.crc32(t).alias("_crc")]
    comp = components(docs, keys, row_id, text, size, max_bits)
    best = comp.groupBy("component_root").agg(F.min(F.struct(
        F.col(row_id).isNull().alias("n"), F.col(row_id).alias("i"), "_key", "_crc")).alias("b"))
    keep = best.select("b._key", "b._crc")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *keys) \
        .join(keep, ["_key", "_crc"], "left_semi")
    one = F.row_number().over(Window.partitionBy("_key", "_crc").orderBy("_key"))
    return rows.withColumn("_n", one).where(F.col("_n") == 1).select("_row.*")


