"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3 letters, word
edges included) in order of frequency.  A document's own most frequent n-grams
are compared to each profile by out-of-place distance: the sum of rank
differences, with the profile length for an n-gram the profile lacks.

Learning counts every n-gram of every training text: tasks pre-count, a grouped
sum totals, and only ``top`` rows per language come to the driver.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stream

#: N-grams are packed into 63 bits, 21 per code point; 0 stands for a word edge.
SHIFT = 21


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code point for every letter, 0 for everything else."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 1- to 3-grams of a text and their counts; both empty without letters.

    Trigrams are sorted once, shorter n-grams are sums over them."""
    x = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    real = x > 0
    if not real.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = np.concatenate(([0], x, [0, 0])).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:-1] = (x[1:-1] > 0) | (x[:-2] > 0)  # one edge between words
    x = x[keep]
    a, b, c = x[:-2], x[1:-1], x[2:]
    tri = (a << np.uint64(2 * SHIFT)) | (b << np.uint64(SHIFT)) | c
    tri.sort()
    first = np.flatnonzero(np.concatenate(([True], tri[1:] != tri[:-1])))
    code, n = tri[first], np.diff(np.append(first, len(tri)))
    mid, last = (code >> np.uint64(SHIFT)) & np.uint64((1 << SHIFT) - 1), code & np.uint64((1 << SHIFT) - 1)
    pair = code >> np.uint64(SHIFT)  # the first two of each trigram
    start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    pairs, pn = pair[start], np.add.reduceat(n, start)
    by = np.argsort(mid, kind="stable")
    m, mn = mid[by], n[by]
    start = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    ones, on = m[start], np.add.reduceat(mn, start)
    tri_ok = mid > 0  # an edge in the middle joins two words
    pair_ok = (pairs & np.uint64((1 << SHIFT) - 1) > 0) | (pairs >> np.uint64(SHIFT) > 0)
    one_ok = ones > 0
    tag2, tag1 = np.uint64(1 << 63), np.uint64(3 << 62)  # keep lengths apart
    return (np.concatenate((code[tri_ok], pairs[pair_ok] | tag2, ones[one_ok] | tag1)),
            np.concatenate((n[tri_ok], pn[pair_ok], on[one_ok])))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 400,
                   max_languages: int = 4096) -> dict[str, list[int]]:
    """``{language: n-gram codes, most frequent first}`` from all rows with a
    language (ties: smaller code first).  More than ``max_languages`` different
    values raise, for the profiles are held by every worker."""
    letters = letter_table()

    def count(rows):
        from collections import defaultdict
        buf, size, total = defaultdict(list), 0, {}

        def fold():
            for lg, parts in buf.items():
                old = total.get(lg)
                codes = np.concatenate([p[0] for p in parts] + ([old[0]] if old else []))
                ns = np.concatenate([p[1] for p in parts] + ([old[1]] if old else []))
                codes, at = np.unique(codes, return_inverse=True)
                total[lg] = (codes, np.bincount(at, weights=ns).astype(np.int64))
            buf.clear()

        for t, lg in rows:
            if t is None:
                continue
            c, n = ngram_counts(t, letters)
            buf[lg].append((c, n))
            size += len(c)
            if size > 2_000_000:
                fold()
                size = 0
            if sum(len(v[0]) for v in total.values()) > 3_000_000:
                for lg2, (cs, ns) in total.items():
                    yield from zip([lg2] * len(cs), cs.view(np.int64).tolist(), ns.tolist())
                total.clear()
        fold()
        for lg2, (cs, ns) in total.items():
            yield from zip([lg2] * len(cs), cs.view(np.int64).tolist(), ns.tolist())

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    n = stream(rows, count, "lang string, code long, n long", step=50_000)
    n = n.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    best = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    found = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "code"))).alias("p")) \
        .limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {r["lang"]: [x["code"] for x in r["p"]] for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[Column], text: str = "text",
            top: int = 400) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` (1 minus the distance
    over the largest possible one) for every row.

    Only the text is looked at.  ``und`` with score 0 for a null text, a text
    without letters, or without any profile; equal distances go to the language
    earlier in code point order.  Empty tables give empty results."""
    letters = letter_table()
    langs = sorted(profiles)
    table = np.unique(np.array([c for lg in langs for c in profiles[lg]], dtype=np.int64).view(np.uint64)) \
        if langs else np.empty(0, np.uint64)
    rank = np.full((len(table) + 1, max(1, len(langs))), -1, dtype=np.int32)
    for k, lg in enumerate(langs):
        codes = np.array(profiles[lg], dtype=np.int64).view(np.uint64)
        rank[np.searchsorted(table, codes), k] = np.arange(len(codes))
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(rows):
        for *ids, t in rows:
            code, n = ngram_counts(t, letters) if t is not None else ((), ())
            if not len(code) or not langs:
                yield (*ids, "und", 0.0)
                continue
            if len(code) > top:  # the most frequent, ties by code
                order = np.lexsort((code.view(np.int64), -n))[:top]
                code = code[order]
            else:
                code = code[np.lexsort((code.view(np.int64), -n))]
            at = np.searchsorted(table, code)
            at[at == len(table)] = 0
            at = np.where(table[at] == code, at, len(table))
            r = rank[at]
            d = np.where(r < 0, top, np.abs(r - np.arange(len(code))[:, None])).sum(axis=0)
            k = int(d.argmin())
            yield (*ids, langs[k], float(1.0 - d[k] / (top * len(code))))

    return stream(kept, run, f"{fields}, lang_pred string, score double")
