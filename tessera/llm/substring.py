"""Substring dedup with suffix automata of reference shards.

A window of ``length`` words is removed if the same words start earlier, in a
document before it or earlier in its own.  Matching statistics from a suffix
automaton tell at every word how long a suffix has been seen before; stretches
at or above the threshold are the windows to remove.

Streaming all documents past the automata of all documents would be quadratic,
so texts meet only where they can match:

1. Every window names a seed, the least hash among its short word sequences.
   Equal windows name equal seeds.  Seeds are counted over all texts; a window
   whose seed lies in one place only cannot repeat.
2. A repeated seed belongs to the reference shard of one text that holds it.
   Stretches of consecutive windows of one shard travel there together, so a
   copied document is one row.  Windows of seeds with more than ``HOT`` places
   travel one by one by their own hash, which splits passages that a large part
   of all documents share.
3. A shard's automaton grows in document order: each stretch is matched, and
   what was new in it is added.  A passage is held once, however often it
   comes.

Equal texts are one reference: later copies repeat the first in every window.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_partitions, rows_of, stream
from tessera.llm.sketch import rolling, word_hashes
from tessera.session import discard, materialize

LENGTH, SEED = 20, 5
#: Places from which on a seed's windows travel one by one; words that a shard's stretches should have.
HOT, SHARD_WORDS = 20_000, 50_000
_LAST = (1 << 63) - 1


def window_seeds(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``seed``-word sequences, and the least of them per window."""
    k = rolling(h, seed)
    n = len(h) - length + 1
    if n <= 0:
        return k, k[:0]
    least, have, need = k, 1, length - seed + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return k, least[:n]


class Automaton:
    """Suffix automaton of several word sequences, grown word by word."""

    def __init__(self, length: int):
        self.window = length
        self.link, self.len, self.next = [-1], [0], {}
        self.out: list[list[int]] = [[]]  # words that leave each state, to copy it

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.len)
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.out.append(list(self.out[q]))
        nxt = self.next
        for w in self.out[q]:
            nxt[new, w] = nxt[q, w]
        self.link[q] = new
        while p >= 0 and nxt.get((p, c)) == q:
            nxt[p, c] = new
            p = self.link[p]
        return new

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt.get((last, c))
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        self.out.append([])
        p = last
        while p >= 0 and (p, c) not in nxt:
            nxt[p, c] = cur
            self.out[p].append(c)
            p = link[p]
        if p >= 0:
            q = nxt[p, c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _step(self, v: int, matched: int, c: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.len
        q = nxt.get((v, c))
        while q is None and v:
            v = link[v]
            matched = length[v]
            q = nxt.get((v, c))
        return (0, 0) if q is None else (q, matched + 1)

    def feed(self, words: list[int]) -> list[tuple[int, int]]:
        """Ranges ``[from, to)`` of windows seen before; then learn the rest."""
        w = self.window
        n = len(words) - w + 1
        seen = [False] * n
        v = matched = 0
        get, link, length = self.next.get, self.link, self.len
        for i, c in enumerate(words):  # matching statistics against what the shard holds
            q = get((v, c))
            while q is None and v:
                v = link[v]
                matched = length[v]
                q = get((v, c))
            if q is None:
                v = matched = 0
                continue
            v = q
            matched += 1
            if matched >= w:
                seen[i - w + 1] = True
        at = 0
        while at < n:  # new stretches, with repeats inside this sequence
            if seen[at]:
                at += 1
                continue
            end = at
            while end < n and not seen[end]:
                end += 1
            v = matched = last = 0
            for i in range(at, end + w - 1):
                v, matched = self._step(v, matched, words[i])
                if matched >= w:
                    seen[i - w + 1] = True
                last = self.extend(last, words[i])
                while v and self.len[self.link[v]] >= matched:  # the state was split
                    v = self.link[v]
            at = end
        out, i = [], 0
        while i < n:
            if seen[i]:
                j = i
                while j < n and seen[j]:
                    j += 1
                out.append((i, j))
                i = j
            else:
                i += 1
        return out


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """For ``docs`` with ``_id, _tid, _text``: ``_tid`` and ``spans``, the
    ranges of window starts to remove in the first document of each text."""
    spark = docs.sparkSession

    def find_seeds(batches):
        schema = pa.schema([("seed", pa.int64()), ("tid", pa.int64()), ("twice", pa.bool_())])
        cache: dict = {}
        met: set = set()
        buf, size = [], 0

        def out():
            s, t, d = (np.concatenate([b[i] for b in buf]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(d)], schema=schema)

        for tid, text in rows_of(batches, (1,)):
            if tid in met:  # equal texts count once a task
                continue
            if len(met) > 200_000:
                met.clear()
            met.add(tid)
            k, least = window_seeds(word_hashes(text.split(), cache), length, seed)
            if not len(least):
                continue
            s = np.unique(least)
            k.sort()
            twice = np.searchsorted(k, s, "right") - np.searchsorted(k, s, "left") > 1
            buf.append((s.view(np.int64), np.full(len(s), tid, np.int64), twice))
            size += len(s)
            if size > 50_000:
                yield out()
                buf, size = [], 0
        if buf:
            yield out()

    seeds = materialize(docs.select("_tid", "_text").mapInArrow(find_seeds, "seed long, tid long, twice boolean"),
                        "substr-seeds")
    many = seeds.groupBy("seed").agg(F.min("tid").alias("route"), F.max("tid").alias("_other"),
                                     F.max("twice").alias("_twice"), F.count(F.lit(1)).alias("_n")) \
        .where((F.col("route") != F.col("_other")) | F.col("_twice")) \
        .select("seed", "route", (F.col("_n") > hot).alias("hot"))
    matched = materialize(seeds.join(many, "seed").select(F.col("tid").alias("_tid"), "seed", "route", "hot"),
                          "substr-matched")
    discard(seeds)
    n_shards = max(4 * n_partitions(spark), -(-matched.count() * length // (2 * SHARD_WORDS)))
    per_text = matched.groupBy("_tid").agg(F.collect_set(F.struct("seed", "route", "hot")).alias("seeds"))
    first = docs.groupBy("_tid").agg(F.min("_id").alias("_id"))
    wanted = per_text.join(first, "_tid").select("_id", "_tid", F.col("seeds.seed").alias("s"),
                                                 F.col("seeds.route").alias("r"), F.col("seeds.hot").alias("h"))

    def cut(it):
        cache: dict = {}
        for i, tid, text, s, r, h in it:
            words = text.split()
            hs = word_hashes(words, cache)
            _, least = window_seeds(hs, length, seed)
            s = np.array(s, dtype=np.int64).view(np.uint64)
            order = np.argsort(s)
            s, r, h = s[order], np.array(r, dtype=np.int64).view(np.uint64)[order], np.array(h, dtype=bool)[order]
            at = np.minimum(np.searchsorted(s, least), len(s) - 1)
            known = s[at] == least
            shard = np.where(known, (r[at] % np.uint64(n_shards)).astype(np.int64), -1)
            single = known & h[at]
            if single.any():
                own = (rolling(hs, length) % np.uint64(n_shards)).astype(np.int64)
                for p in np.flatnonzero(single).tolist():
                    yield int(own[p]), i, tid, p, b" ".join(words[p:p + length])
                shard[single] = -1
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if shard[a] >= 0:
                    yield int(shard[a]), i, tid, a, b" ".join(words[a:b - 1 + length])

    texts = docs.join(wanted, ["_id", "_tid"]).select("_id", "_tid", "_text", "s", "r", "h")
    parts = stream(texts, cut, "shard int, id long, tid long, start int, words binary", binary=(2,))
    parts = parts.repartition(n_partitions(spark), "shard").sortWithinPartitions("shard", "id", "tid", "start")

    def match(it):
        shard = sam = before = None
        number: dict = {}
        for s, i, tid, start, words in it:
            if s != shard:
                shard, sam, number = s, Automaton(length), {}
            if (s, i, tid, start) == before:  # a repeated row
                continue
            before = (s, i, tid, start)
            for a, b in sam.feed([number.setdefault(w, len(number)) for w in words.split(b" ")]):
                yield tid, start + a, start + b

    spans = stream(parts, match, "_tid long, a int, b int")
    return spans.groupBy("_tid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedup_substrings(docs: DataFrame, keep: list[Column], row_id: str = "doc_id", text: str = "text",
                     length: int = LENGTH, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """``keep`` columns plus ``n_words, n_removed, kept_sha256`` for every row
    and, if asked for, ``kept``: the text without the removed words.

    Documents are ordered by id (null last, all null ids being one place), rows
    of one id by a hash of their text.  Rows equal in id and text are the same
    document, so neither repeats the other.  A null text has no words.  An
    empty table gives an empty result.
    """
    tid = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(*keep)
    cols = [f"_k{i}" for i in range(len(named.columns))]
    d = docs.select(*[c.alias(a) for c, a in zip(keep, cols)], F.coalesce(F.col(row_id).cast("long"), F.lit(_LAST))
                    .alias("_id"), tid.alias("_tid"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    slim = materialize(d.select("_id", "_tid").distinct(), "substr-ids")
    spans = repeated_windows(d.select("_id", "_tid", "_text"), length, hot=hot)
    first = slim.groupBy("_tid").agg(F.min("_id").alias("_first"))
    info = slim.join(first.join(spans, "_tid", "left"), "_tid") \
        .select("_id", "_tid", (F.col("_id") > F.col("_first")).alias("_copy"), F.col("spans.a").alias("_a"),
                F.col("spans.b").alias("_b"))
    rows = d.join(info, ["_id", "_tid"]).select(*cols, "_text", "_copy", "_a", "_b")
    fields = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(cols, named.schema.fields))
    n_cols = len(cols)

    def apply(it):
        for row in it:
            t, copy, a, b = row[n_cols:]
            words = t.split()
            n = len(words)
            if n >= length and (copy or a):
                gone = np.zeros(n + 1, np.int32)
                for x, y in [(0, n - length + 1)] if copy else zip(a, b):
                    gone[x] += 1
                    gone[y - 1 + length] -= 1
                mask = np.cumsum(gone[:n]) > 0
                left = [w for w, g in zip(words, mask.tolist()) if not g]
            else:
                mask, left = None, words
            kept = ()
            if with_text:
                kept = (t.decode("utf-8", "replace"),) if mask is None else (_without(t, mask).decode("utf-8", "replace"),)
            yield (*row[:n_cols], n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), *kept)

    out = stream(rows, apply, f"{fields}, n_words long, n_removed long, kept_sha256 string"
                 + (", kept string" if with_text else ""), binary=(n_cols,))
    return out.select(*[F.col(a).alias(f.name) for a, f in zip(cols, named.schema.fields)], *out.columns[n_cols:])


def _without(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words; white space between kept neighbours
    stays as it is, a cut becomes one space."""
    out, kept_before, end = [], False, 0
    for m, gone in zip(re.finditer(rb"[^\x20\x09-\x0D]+", text), mask.tolist()):
        if not gone:
            out.append(text[end:m.start()] if kept_before or not out else b" ")
            out.append(m.group())
        kept_before, end = not gone, m.end()
    return b"".join(out)
