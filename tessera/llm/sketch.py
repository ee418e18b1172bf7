"""Document fingerprints: threshold-scaled sketches.

The sketch of a document is the set of its 5-word shingle hashes below a fixed
fraction of the hash range (``FRACTION``).  Since the threshold never depends
on the document, sketches of parts merge by union, and containment can be
estimated between documents of very unequal lengths.  A digest of the word
sequence leads the fingerprint, so that documents too short to have a retained
hash are still told apart.
Estimates on few hashes are rough: from 8 to 19 words about one in 25 is 0 for
texts that do overlap, and a text of five words or fewer has a single hash,
kept or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_partitions, stream
from tessera.session import discard, materialize

SHINGLE = 5
FRACTION = 2  # one hash in so many is kept
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes], cache: dict) -> np.ndarray:
    out, get = [], cache.get
    for w in words:
        h = get(w)
        if h is None:
            if len(cache) > 200_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hash of every k consecutive values (all of them, if fewer)."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    x = h[:n].copy()
    for i in range(1, k):
        x = x * _MUL + h[i:i + n]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(text: str, cache: dict) -> tuple[int, np.ndarray]:
    """Digest of the lower-cased word sequence and the sorted retained hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    s = rolling(word_hashes(words, cache), SHINGLE)
    s = s[s < np.uint64((1 << 64) // FRACTION)]
    return xxhash.xxh64_intdigest(b" ".join(words)), np.unique(s >> np.uint64(16))


def to_string(sk: tuple[int, np.ndarray]) -> str:
    kept = sk[1].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{sk[0]:016x}:{np.ascontiguousarray(kept).tobytes().hex()}"


def from_string(s: str) -> tuple[int, np.ndarray]:
    head, _, tail = s.partition(":")
    return int(head, 16), np.array([int(tail[i:i + 12], 16) for i in range(0, len(tail), 12)], dtype=np.uint64)


def resemblance(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the shingle sets; by the digests alone
    if neither sketch holds a hash."""
    if a[0] == b[0]:
        return 1.0
    both = len(np.intersect1d(a[1], b[1], assume_unique=True))
    union = len(a[1]) + len(b[1]) - both
    return both / union if union else 0.0


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    if a[0] == b[0]:
        return 1.0
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / len(a[1]) if len(a[1]) else 0.0


def merge(a: str, b: str) -> str:
    """Fingerprint of two parts taken together (hashes united, digests xored)."""
    x, y = from_string(a), from_string(b)
    return to_string((x[0] ^ y[0], np.union1d(x[1], y[1])))


def _bucket(key, bounds: list[int]):
    """Number of ``bounds`` above ``key`` (bounds descend), found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    lows = F.array(*[F.lit(p[-1]) for p in parts])
    at = F.size(F.filter(lows, lambda b: b > key))
    inner = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    return F.when(at >= len(parts), F.lit(len(bounds))).otherwise(
        at * step + F.size(F.filter(F.element_at(inner, F.least(at + 1, F.lit(len(parts)))), lambda b: b > key)))


def compare_neighbours(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and how alike they are.

    The edited text replaces the last floor(n/2) code points by the first as
    many of the next document in descending id order (null ids last; after the
    last document comes the first).  Rows with equal ids are ordered by a hash
    of the text, equal rows are interchangeable.  Null texts count as empty.
    Other columns are ignored; an empty table gives an empty result.

    Ids alone are range partitioned first, to know the first id of every
    range; texts then go to their range once, and each range's first document
    also to the range before it, so that neighbours meet without a one-task
    sort.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    key = F.coalesce(F.col(row_id).cast("long"), F.lit(lowest))
    n = n_partitions(spark)
    ids = materialize(docs.select(key.alias("k")).repartitionByRange(n, F.col("k").desc())
                      .withColumn("p", F.spark_partition_id()), "sketch-ids")
    ends = ids.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy(F.col("hi").desc()).collect()
    discard(ids)
    schema = (f"`{row_id}` {docs.schema[row_id].dataType.simpleString()}, n_chars long, edited_sha256 string, "
              "fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
              "contained_edited double")
    if not ends:
        return spark.createDataFrame([], schema)
    count = len(ends)
    d = docs.select(F.col(row_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), key.alias("_k"))
    b = _bucket(F.col("_k"), [r["lo"] for r in ends[:-1]]) if count > 1 else F.lit(0)
    d = d.withColumn("_own", b.cast("int"))
    his = F.array(*[F.lit(r["hi"]) for r in ends])
    first = F.col("_k") == F.element_at(his, F.col("_own") + 1)
    places = F.when(first, F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("halo")),
                                   F.struct(F.pmod(F.col("_own") + count - 1, F.lit(count)).alias("b"),
                                            F.lit(1).alias("halo")))) \
        .otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("halo"))))
    d = d.select("_id", "_text", "_k", F.explode(places).alias("_at")) \
        .select("_id", "_text", "_k", F.col("_at.b").alias("_b"), F.col("_at.halo").alias("_halo"))
    d = d.repartitionById(count, F.col("_b")) \
        .sortWithinPartitions("_b", "_halo", F.col("_k").desc(), F.xxhash64("_text")).select("_id", "_text", "_b", "_halo")

    def run(rows):
        cache: dict = {}
        prev = bucket = None
        done = False
        for i, t, b, halo in rows:
            if b != bucket:
                prev, bucket, done = None, b, False
            if done:
                continue
            sk = sketch(t, cache)
            if prev is not None:
                pi, pt, psk = prev
                half = len(pt) // 2
                edited = pt[:len(pt) - half] + t[:half]
                esk = psk if edited == pt else sketch(edited, cache)
                yield (pi, len(pt), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                       to_string(psk), to_string(esk), resemblance(psk, esk), resemblance(psk, sk),
                       containment(psk, esk))
            prev, done = (i, t, sk), halo == 1

    return stream(d, run, schema)
