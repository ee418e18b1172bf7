"""Toxicity: a factorisation machine over hashed terms.

Terms of a text are its distinct words (runs of letters, lower-cased) and the
prefixes of ``PREFIXES`` letters of longer words, so that an inflected insult
shares a term with the forms seen in training.  Terms are hashed to ``BUCKETS``
and enter as present or absent.  The score is the logistic function of

    w0 + sum_i w_i + 1/2 sum_f [ (sum_i v_if)^2 - sum_i v_if^2 ]

over the buckets present: pairs of terms (an insult with the mention of a
group) add what neither adds alone, in linear time.

Training counts in how many labelled texts, and in how many toxic ones, each
bucket occurs, keeps the buckets whose association with the label is beyond
chance (log-likelihood ratio over 2 ln(buckets seen)) and raises the rate of
toxic texts ``LIFT`` times (of these, the ``DIMS`` strongest), groups the texts by label and kept buckets, and fits those patterns.  Chance
terms of long texts and words of a language with more toxic texts than others
thus have no weight that could add up.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import runs, stream
from tessera.session import discard, materialize

#: Labelled rows that training takes at most, the ones with the smallest id hashes.
SAMPLE = 40_000
BUCKETS, DIMS, RANK = 1 << 20, 4_096, 4
#: A kept bucket raises the rate of toxic texts at least so many times.
LIFT = 2
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose buckets a task keeps at hand.
HELD = 200_000

RUN, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its proper prefixes."""
    terms = [word + "$"] + [word[:k] for k in PREFIXES if k < len(word)]
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms)


def present(text: bytes | None, look: dict, to: dict | None = None) -> set[int]:
    """The distinct buckets of a text or, with ``to``, what ``to`` maps them to
    (unmapped ones are left out).  ``look`` remembers words."""
    out: set[int] = set()
    for found in runs((text or b"").decode("utf-8", "replace").lower(), RUN, GAP):
        for w in set(found):
            ids = look.get(w)
            if ids is None:
                if len(look) > HELD:
                    look.clear()
                ids = buckets_of(w)
                if to is not None:
                    ids = tuple(to[i] for i in ids if i in to)
                look[w] = ids
            out.update(ids)
    return out


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "label",
        sample: int = SAMPLE, steps: int = 400, seed: int = 7) -> dict:
    """Fit on the labelled ids with the smallest hashes, ``sample`` at most.

    ``labels`` has ``row_id`` and a 0/1 ``label``; null ids and labels are left
    out, of several labels of an id the largest counts.  Rows of ``docs`` that
    share an id share its label; a null text is an empty one.  Without both
    classes the model is constant."""
    chosen = labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(F.col(row_id).alias("_id")).agg(F.max(label).cast("int").alias("_y")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).cast("binary").alias("_t")) \
        .join(F.broadcast(chosen), "_id").select("_y", "_t")

    def count(it):
        look: dict = {}
        seen = np.zeros((2, BUCKETS + 1), np.int32)  # the last place counts the texts
        for y, t in it:
            ids = np.fromiter(present(t, look), np.int64)
            seen[int(y == 1), ids] += 1
            seen[int(y == 1), BUCKETS] += 1
        for b in np.flatnonzero(seen.any(0)):
            yield int(b), int(seen[0, b]), int(seen[1, b])

    counts = materialize(stream(rows, count, "b int, n0 long, n1 long").groupBy("b")
                         .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic")
    model = {"w0": 0.0, "dims": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, RANK))}
    total = counts.where(F.col("b") == BUCKETS).first()
    if total is None or not total["n0"] or not total["n1"]:
        model["w0"] = 0.0 if total is None else (4.0 if total["n1"] else -4.0)
        discard(counts)
        return model
    c0, c1 = float(total["n0"]), float(total["n1"])
    n_seen = counts.count()

    def part(x, of, rest):  # one cell of the log-likelihood ratio
        return F.when(x > 0, x * F.log(x * (c0 + c1) / (of * rest))).otherwise(0.0)

    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    here, away = n0 + n1, c0 + c1 - n0 - n1
    ratio = 2 * (part(n0, F.lit(c0), here) + part(n1, F.lit(c1), here)
                 + part(c0 - n0, F.lit(c0), away) + part(c1 - n1, F.lit(c1), away))
    top = counts.where(F.col("b") < BUCKETS)\
        .select("b", F.round(ratio, 6).alias("g"), (n1 / here >= LIFT * c1 / (c0 + c1)).alias("often")) \
        .where((F.col("g") > 2 * np.log(max(2, n_seen))) & F.col("often")).orderBy(F.desc("g"), "b").limit(DIMS).collect()
    discard(counts)
    dims = np.array(sorted(r["b"] for r in top), np.int64)
    to = {int(b): k for k, b in enumerate(dims)}

    def pattern(it):
        look: dict = {}
        for y, t in it:
            yield int(y == 1), np.array(sorted(present(t, look, to)), np.int16).tobytes()

    got = stream(rows, pattern, "y int, x binary").groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "y", "x").limit(sample).collect()
    got = sorted((r["y"], bytes(r["x"]), r["n"]) for r in got)
    model.update(dims=dims, **_descend(got, len(dims), c1 / (c0 + c1), steps, seed))
    return model


def _descend(rows: list, n_dims: int, rate: float, steps: int, seed: int) -> dict:
    """Adam over weighted (label, buckets, count) patterns, a bounded number
    of buckets at a time."""
    y = np.array([r[0] for r in rows], np.float64)
    n = np.array([r[2] for r in rows], np.float64)
    n /= n.sum()
    ids = [np.frombuffer(r[1], np.int16).astype(np.int64) for r in rows]
    size = np.array([len(i) for i in ids])
    cuts = [0]
    for k in np.flatnonzero(np.diff(np.cumsum(size) // 200_000)) + 1:
        cuts.append(int(k))
    blocks = [(a, b, np.concatenate(ids[a:b]), np.repeat(np.arange(b - a), size[a:b]))
              for a, b in zip(cuts, cuts[1:] + [len(rows)])]
    rng = np.random.default_rng(seed)
    p = {"w0": np.array([np.log(rate / (1 - rate))]), "w": np.zeros(n_dims), "v": rng.normal(0, 0.1, (n_dims, RANK))}
    m = {k: np.zeros_like(a) for k, a in p.items()}
    s2 = {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        g = {"w0": np.zeros(1), "w": 1e-5 * p["w"], "v": 1e-4 * p["v"]}
        for a, b, i, r in blocks:
            v = p["v"][i]
            s = np.stack([np.bincount(r, v[:, f], b - a) for f in range(RANK)], 1)
            z = p["w0"][0] + np.bincount(r, p["w"][i], b - a) \
                + 0.5 * ((s * s).sum(1) - np.bincount(r, (v * v).sum(1), b - a))
            e = n[a:b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b])
            g["w0"] += e.sum()
            g["w"] += np.bincount(i, e[r], n_dims)
            d = e[r, None] * (s[r] - v)
            g["v"] += np.stack([np.bincount(i, d[:, f], n_dims) for f in range(RANK)], 1)
        lr = 0.1 / (1 + 3 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s2[k] = 0.999 * s2[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s2[k] / (1 - 0.999 ** step)) + 1e-12)
    return {"w0": float(p["w0"][0]), "w": p["w"], "v": p["v"]}


def logit(model: dict, ids: list[int]) -> float:
    if not ids:
        return model["w0"]
    v = model["v"][ids]
    s = v.sum(0)
    return float(model["w0"] + model["w"][ids].sum() + 0.5 * (s @ s - (v * v).sum()))


def score(docs: DataFrame, model: dict, keep: list[Column], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1, higher: toxic likelier) and
    ``predicted`` (1 from ``threshold`` on) for every row, whatever its length;
    a null text scores like an empty one.  Only the text is looked at."""
    kept = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    to = {int(b): k for k, b in enumerate(model["dims"])}

    def run(rows):
        look: dict = {}
        for *ids, t in rows:
            z = logit(model, sorted(present(t, look, to)))
            p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield (*ids, p, int(p >= threshold))

    return stream(kept, run, f"{fields}, score double, predicted int")
