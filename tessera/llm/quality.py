"""Quality classifier: a factorisation machine.

Inputs of a document are hashed words (log term frequencies of unit length),
structure statistics of its characters, words and lines, and its length as
metadata.  The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

so pairwise interactions of rank ``k`` cost linear time.  The model is fitted
on a bounded sample of labelled rows (``SAMPLE``); scoring streams every whole
text through Arrow batches with the model in the closure (its size depends on
``DIM`` and ``RANK`` alone).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stream

#: Labelled rows that training takes at most, the ones with the smallest id hashes.
SAMPLE = 8_000
DIM, RANK = 2_048, 8
N_STATS = 18


def features(text: bytes | None, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word dimensions present, their values (unit length), statistics."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, dtype=np.uint8)
    c = np.bincount(raw, minlength=256)
    nb, nw, nl = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    get, ids = cache.get, []
    for w in words:
        i = get(w)
        if i is None:
            if len(cache) > 400_000:
                cache.clear()
            i = cache[w] = zlib.crc32(w.lower()) % DIM
        ids.append(i)
    arr = np.array(ids, dtype=np.int64)
    tf = np.bincount(arr, minlength=DIM)
    idx = np.flatnonzero(tf)
    val = np.log1p(tf[idx])
    val = val / max(1e-12, float(np.sqrt((val * val).sum())))
    letters = int(c[65:91].sum() + c[97:123].sum() + c[128:].sum())
    punct = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    bag = set(words)
    same = int((arr[1:] == arr[:-1]).sum()) if len(arr) > 1 else 0
    stats = np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        c[65:91].sum() / max(1, letters), letters / nb, c[48:58].sum() / nb, punct / nb, c[32] / nb, c[10] / nb,
        c[33] / nb, (c[124] + c[123] + c[125] + c[60] + c[62] + c[61]) / nb, c[128:].sum() / nb,
        c[:32].sum() / nb, len(bag) / nw, len(set(lines)) / nl, same / nw,
        sum(map(len, bag)) / max(1, len(bag)) / 10, len(words) / nl / 100,
    ], dtype=np.float64)
    return idx, val, stats


def logits(model: dict, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> float:
    z = np.clip((stats - model["mean"]) / model["std"], -5, 5)
    i = np.concatenate((idx, DIM + np.arange(N_STATS)))
    x = np.concatenate((val, z))
    v = model["v"][i]
    s = x @ v
    return float(model["w0"] + x @ model["w"][i] + 0.5 * (s @ s - ((x * x) @ (v * v)).sum()))


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "label",
        sample: int = SAMPLE, epochs: int = 12, seed: int = 7) -> dict:
    """Fit on the labelled rows with the smallest id hashes, ``sample`` at most.

    ``labels`` has ``row_id`` and a 0/1 ``label``; null ids and labels are left
    out, of several labels of an id the smallest counts, so that a repeated id
    cannot change between runs.  Without both classes the model is constant."""
    chosen = labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(F.col(row_id).alias("_id")).agg(F.min(label).cast("int").alias("_y")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id") \
        .orderBy(F.xxhash64("_id"), F.xxhash64("_t")).limit(sample).select("_t", "_y")

    def extract(it):
        cache: dict = {}
        for t, y in it:
            i, v, s = features(t, cache)
            yield y, i.astype(np.int16).tobytes(), v.astype(np.float32).tobytes(), s.tobytes()

    got = sorted(map(tuple, stream(rows, extract, "y int, i binary, v binary, s binary", binary=(0,)).collect()))
    model = {"w0": 0.0, "w": np.zeros(DIM + N_STATS), "v": np.zeros((DIM + N_STATS, RANK)),
             "mean": np.zeros(N_STATS), "std": np.ones(N_STATS)}
    y = np.array([r[0] for r in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        model["w0"] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    st = np.array([np.frombuffer(bytes(r[3])) for r in got])
    model["mean"], model["std"] = st.mean(0), np.maximum(st.std(0), 1e-6)
    z = np.clip((st - model["mean"]) / model["std"], -5, 5)
    rng = np.random.default_rng(seed)
    p = {"w0": np.array([np.log(y.mean() / (1 - y.mean()))]), "w": model["w"],
         "v": rng.normal(0, 0.05, model["v"].shape)}
    m = {k: np.zeros_like(a) for k, a in p.items()}
    s2 = {k: np.zeros_like(a) for k, a in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            b = order[at:at + 128]
            x = np.zeros((len(b), DIM + N_STATS))
            for r, k in enumerate(b):
                x[r, np.frombuffer(bytes(got[k][1]), np.int16)] = np.frombuffer(bytes(got[k][2]), np.float32)
            x[:, DIM:] = z[b]
            s = x @ p["v"]
            x2 = x * x
            f = p["w0"][0] + x @ p["w"] + 0.5 * ((s * s).sum(1) - x2 @ (p["v"] ** 2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[b]) / len(b)
            g = {"w0": np.array([e.sum()]), "w": x.T @ e + 1e-4 * p["w"],
                 "v": x.T @ (e[:, None] * s) - (x2.T @ e)[:, None] * p["v"] + 1e-3 * p["v"]}
            step += 1
            lr = 0.02 / (1 + epoch / 4)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s2[k] = 0.999 * s2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s2[k] / (1 - 0.999 ** step)) + 1e-8)
    model.update(w0=float(p["w0"][0]), w=p["w"], v=p["v"])
    return model


def score(docs: DataFrame, model: dict, keep: list[Column], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``predicted`` for every row;
    a null text scores like an empty one.  Only the text is looked at."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    at = len(kept.columns) - 1

    def run(rows):
        cache: dict = {}
        for *ids, t in rows:
            f = logits(model, *features(t, cache))
            p = float(1 / (1 + np.exp(-np.clip(f, -30, 30))))
            yield (*ids, p, int(p >= threshold))

    return stream(kept, run, f"{fields}, score double, predicted int", binary=(at,))


def keep_good(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as
    they were (whole Arrow slices are filtered, only texts become objects)."""
    at = docs.columns.index(text)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                f = np.array([logits(model, *features(t, cache)) for t in texts])
                keep = pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))) >= threshold)
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)
