"""N-gram scoring: an interpolated modified Kneser-Ney model of order 2 or 3.

The model of a large corpus fits no single worker, so documents are dealt into
blocks, and the model into buckets by word hash:

0. A block sends each bucket the hashes of its words; the bucket numbers its
   words, frequent ones first, and answers.  A word's number is its place in the
   bucket times the number of buckets, plus the bucket.  All that follows speaks
   in numbers: those of most words in a text are small and compress well.
1. A block lists its distinct word pairs and words, sorted by number, with their
   training counts, and sends each bucket its part.
2. A bucket adds up the counts of a pair over all blocks, answers every block
   in the order of its list (a count per pair, no words), and passes on what
   it knows of contexts (distinct followers that came once, twice, more often)
   and of continuations (distinct words before a word).
3. The bucket of a word adds these up and answers in the same way.
4. A block puts the answers beside its own sorted pairs, which is the part of
   the model that its documents need, writes these arrays to a scratch file,
   each number in as few bytes as the largest needs, maps it into memory and
   scores its documents.  The file is unlinked as soon as it is mapped.

Every message's size follows the data, not the number of occurrences of any
word.  Pairs of a frequent first word would all meet in one bucket; they are
dealt by their second word instead, and the pieces of such a context are added
up in step 3.  First words are not sent: a bucket's pairs follow its word list.

With order 3 a bucket of triples comes before step 2.  Triples follow the pair
that they begin with, so its context is known on the spot; where both words of
the pair are frequent, triples are dealt by their own hash and the pieces of
the context are added up in step 2.  A pair then counts the distinct words
before it (its occurrences, at the start of a text), as Kneser-Ney asks.

Texts are split into words once.  Documents travel in compressed pieces, those
of one block in a part of the input together: the distinct words, and for every
token its word's place among them.  Three steps read a block's pieces.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, rows_of

#: Tokens per block and entries per bucket (about); hot first words at most.
BLOCK_TOKENS, MAX_HOT = 3_000_000, 65_536
#: Not words, for words hold no space.
START, END = b" start", b" end"
MESSAGE = pa.schema([("to", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()),
                     ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PIECE = pa.schema([("block", pa.int32()), ("piece", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
MESSAGE_SQL = "to int, src int, kind int, a binary, b binary, c binary, d binary"
PAIRS, HOT_PAIRS, WORDS, PLACES, PAIR_ANSWER, HOT_ANSWER, CONTEXT, CONTINUATION, TOTALS, WORD_ANSWER = range(10)
#: Order 3.  Lists of triples follow PAIRS, HOT_PAIRS or none; their answers come in the same order of kinds.
TRIPLES, HOT_TRIPLES, FREE_TRIPLES, TRIPLE_ANSWER, HOT_TRIPLE_ANSWER, FREE_ANSWER = range(10, 16)
PAIR_TABLE, PAIR_PLACES, HOT_PLACES, SUFFIX, PAIR_CONTEXT, TRIPLE_TOTALS, NUMBERS = range(16, 23)
#: What goes to the blocks from step 2.  The rest goes to the buckets of step 3.
TO_BLOCKS = {PAIR_ANSWER, HOT_ANSWER, TRIPLE_ANSWER, HOT_TRIPLE_ANSWER, FREE_ANSWER}
#: Bytes of documents that a task holds to compress them by block.
PIECE_BYTES = 48_000_000
#: Pairs or triples whose probabilities are reckoned at a time.
SCORE_STEP = 500_000


def _packed(x: bytes | np.ndarray) -> bytes:
    return pa.compress(x, codec="zstd", asbytes=True)


def _unpacked(b: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size, codec="zstd", asbytes=True) if size else b"", dtype=np.uint8)


def _numbers(x: np.ndarray) -> bytes:
    """Small counts: bytes, the few from 255 on beside them."""
    x = np.ascontiguousarray(x, dtype=np.uint32).ravel()
    z = _packed(np.minimum(x, 255).astype(np.uint8)) if len(x) else b""
    return np.array([len(x), len(z)], "<u4").tobytes() + z + x[x >= 255].tobytes()


def _read(b: bytes) -> np.ndarray:
    size, n = np.frombuffer(b, "<u4", 2).tolist()
    x = _unpacked(b[8:8 + n], size).astype(np.uint32)
    x[x == 255] = np.frombuffer(b[8 + n:], dtype=np.uint32)
    return x


def _ids(x: np.ndarray) -> bytes:
    """Word numbers: the lowest bytes of all, then the next ones, each compressed."""
    planes = np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4)
    z = [_packed(np.ascontiguousarray(planes[:, k])) if len(planes) else b"" for k in range(4)]
    return np.array([len(planes), *map(len, z)], "<u4").tobytes() + b"".join(z)


def _from_ids(b: bytes) -> np.ndarray:
    size, *n = np.frombuffer(b, "<u4", 5).tolist()
    out, at = np.empty((size, 4), dtype=np.uint8), 20
    for k in range(4):
        out[:, k] = _unpacked(b[at:at + n[k]], size)
        at += n[k]
    return out.view("<u4").ravel().astype(np.uint64)


def _hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte like ``_ids``."""
    steps = np.diff(h, prepend=np.uint64(0))
    low, high = _ids(steps & np.uint64(0xFFFFFFFF)), _ids(steps >> np.uint64(32))
    return len(low).to_bytes(4, "little") + low + high


def _from_hashes(b: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(b[:4], "little")
    return np.cumsum(_from_ids(b[4:n]) | (_from_ids(b[n:]) << np.uint64(32)), dtype=np.uint64)


def bucket_of_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit hashes."""
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of word numbers."""
    return (ids % np.uint64(n)).astype(np.int32)


def both_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two columns of numbers below 2^32, in their order."""
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def hot_numbers(hot: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers of the hot words, given by hash: the first places of their
    buckets, in order of their hashes, so that every task knows them."""
    of = bucket_of_hash(hot, buckets)
    order = np.lexsort((hot, of))
    place = np.arange(len(hot)) - np.searchsorted(of[order], of[order])
    return place.astype(np.uint64) * np.uint64(buckets) + of[order].astype(np.uint64)


def by_list(x: np.ndarray) -> np.ndarray:
    """Stable order of small list numbers (short ones sort by radix)."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 65_536 else x, kind="stable")


def sort_places(x: np.ndarray) -> np.ndarray:
    """Sort unsigned 64-bit numbers in place; returns their former places.  If a
    number and its place fit 64 bits, both are sorted as one, which is several
    times faster than an indirect sort."""
    bits, step = len(x).bit_length(), 1 << 20
    if not len(x) or int(x.max()).bit_length() + bits > 64:
        by = np.argsort(x, kind="stable")
        x[:] = x[by]
        return by
    x <<= np.uint64(bits)
    for a in range(0, len(x), step):
        x[a:a + step] |= np.arange(a, min(a + step, len(x)), dtype=np.uint64)
    x.sort()
    by = np.empty(len(x), np.int32 if bits < 32 else np.int64)
    for a in range(0, len(x), step):
        by[a:a + step] = x[a:a + step] & np.uint64((1 << bits) - 1)
    x >>= np.uint64(bits)
    return by


def order_of(keys: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Order of whole numbers from 0 on, by ``low`` where they are equal."""
    x = keys.astype(np.uint64)
    if low is not None and len(x):
        bits = int(low.max()).bit_length()
        if int(x.max()).bit_length() + bits > 64:
            return np.lexsort((low, keys))
        x <<= np.uint64(bits)
        x |= low.astype(np.uint64)
    return sort_places(x)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two columns of numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new row begins among equal ones."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Words(NamedTuple):
    """Texts in words: every token's place in a list of distinct words (start
    and end of each text included), every text's tokens (with its end, without
    its start), and the words' hashes."""
    flat: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased (A-Z) words of all texts as places in the list of distinct
    words, the number of words of every text, and that list."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        sizes = np.diff(before[np.concatenate(([0], np.cumsum(sizes)))])
        words = words.filter(pa.array(full))
    found = words.dictionary_encode()
    return found.indices.to_numpy(), sizes, found.dictionary


def with_ends(flat: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> Words:
    """Words of texts, with the start and the end of each.  ``words`` may repeat."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, [START, END, *words]), np.uint64, len(words) + 2)
    h, place = np.unique(h, return_inverse=True)
    place = place.astype(np.int32)
    sizes = sizes.astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    out = np.empty(len(flat) + 2 * len(sizes), np.int32)
    word = np.ones(len(out), bool)
    word[ends - 1] = word[ends - sizes - 1] = False
    out[word] = place[2:][flat]
    out[ends - 1], out[ends - sizes - 1] = place[1], place[0]
    return Words(out, sizes, h)


def read_words(texts: list[bytes] | Words) -> Words:
    """Words of some texts, unless they are read already."""
    if isinstance(texts, Words):
        return texts
    flat, sizes, words = split_words(pa.array(texts, pa.string()))
    return with_ends(flat, sizes, words.cast(pa.binary()).to_pylist())


def pack_words(flat: np.ndarray, words: pa.Array) -> tuple[bytes, bytes]:
    """Tokens, given as places in the sorted ``words``, for a message: the words
    that occur, frequent ones first, and the tokens' places among them."""
    by = order_of(flat)
    start = _starts(flat[by])
    n = np.diff(np.append(start, len(by)))
    own = flat[by[start]]
    frequent = np.argsort(-n, kind="stable")  # words of one count stay sorted and compress well
    rank = np.empty(len(own), np.uint32)
    rank[frequent] = np.arange(len(own))
    places = np.empty(len(flat), np.uint32)
    places[by] = np.repeat(rank, n)
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], words.take(pa.array(own[frequent]))), " ")[0].as_py().encode()
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(text, asbytes=True), _ids(places)


def unpack_words(messages: list[tuple[bytes, bytes]], sizes: np.ndarray) -> Words:
    """The words of texts from one or more messages, in the order of the texts."""
    flat, words = [], []
    for text, places in messages:
        flat.append(_from_ids(places).astype(np.int32) + len(words))
        words += bytes(_unpacked(text[8:], int.from_bytes(text[:8], "little"))).split()
    return with_ends(np.concatenate(flat), sizes, words)


def lists_of(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes by bucket and size, and where each bucket's list begins."""
    of = bucket_of_hash(h, buckets)
    order = np.lexsort((h, of))
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def list_words(texts: list[bytes] | Words, block: int, buckets: int):
    """Step 0: a block's words by hash, and how often they occur."""
    flat, _, h = read_words(texts)
    n = np.bincount(flat, minlength=len(h))
    order, cuts = lists_of(h, buckets)
    for k in range(buckets):
        x = order[cuts[k]:cuts[k + 1]]
        if len(x):
            yield k, block, NUMBERS, _hashes(h[x]), _numbers(n[x]), None, None


def number_words(rows, bucket: int, buckets: int, hot: np.ndarray):
    """Step 0 for one bucket: places of its words, hot ones first, then by frequency."""
    lists = {src: (_from_hashes(a), _read(b)) for _, src, _, a, b, _, _ in rows}
    words, n = _sums(*(np.concatenate(x) for x in zip(*lists.values())))
    first = np.sort(hot[bucket_of_hash(hot, buckets) == bucket])
    if (len(words) + len(first) + 1) * buckets >= 1 << 32:
        raise RuntimeError("word numbers have 32 bits")
    order = np.lexsort((words, -n))
    place = np.empty(len(words), np.int64)
    place[order] = len(first) + np.arange(len(words))
    if len(first):
        at = np.minimum(np.searchsorted(first, words), len(first) - 1)
        place = np.where(first[at] == words, at, place)
    for src, (h, _) in lists.items():
        yield src, bucket, NUMBERS, _ids(place[np.searchsorted(words, h)]), None, None, None


class Block:
    """Distinct words, word pairs and (order 3) triples of some documents,
    sorted by number.  ``places`` are the buckets' answers to ``list_words``."""

    def __init__(self, texts: list[bytes] | Words, train: np.ndarray, buckets: int, hot: np.ndarray,
                 places: dict[int, bytes], order: int = 2):
        flat, self.sizes, h = read_words(texts)  # sizes: tokens, with the end
        del texts
        by, cuts = lists_of(h, buckets)
        numbers = np.empty_like(h)
        for k, a in places.items():
            numbers[by[cuts[k]:cuts[k + 1]]] = _from_ids(a) * np.uint64(buckets) + np.uint64(k)
        if sum(cuts[k + 1] - cuts[k] for k in places) != len(h):
            raise RuntimeError("a block's words have no numbers")
        by = np.argsort(numbers)
        rank = np.empty(len(h), dtype=np.int32)
        rank[by] = np.arange(len(h))
        self.words = numbers[by]
        flat = rank[flat]
        start = flat[0]
        ends = np.cumsum(self.sizes + 1)
        side = np.ones(len(flat), bool)
        side[ends - self.sizes - 1] = False  # nothing precedes a start
        self.second = flat[side]
        side[:] = True
        side[ends - 1] = False  # nothing follows an end
        first = flat[side]
        del flat, side
        learned = np.repeat(train, self.sizes)
        # pair: each token's place among the pairs
        self.pair_counts, at, self.pair = _counted(first, self.second, len(h), learned)
        self.v, self.w = first[at], self.second[at]
        del first, at
        self.word_counts = np.bincount(self.second[learned], minlength=len(h))
        own = bucket_of(self.words, buckets)
        is_hot = np.isin(self.words, hot)
        self.followers = np.where(is_hot, 0, np.bincount(self.v, minlength=len(h)))
        by_second = is_hot[self.v]
        part = np.where(by_second, own[self.w] * 2 + 1, own[self.v] * 2)  # two lists for each bucket
        self.pair_order = by_list(part).astype(np.int32)  # by list, then numbers
        self.pair_cuts = np.searchsorted(part[self.pair_order], np.arange(2 * buckets + 1))
        self.word_order = by_list(own)
        self.word_cuts = np.searchsorted(own[self.word_order], np.arange(buckets + 1))
        self.order = order
        if order == 3:
            self.pair_counts = np.where(self.v == start, self.pair_counts, 0)  # others count the words before them
            self._triples(learned, is_hot, by_second, part, buckets, hot)

    def _triples(self, learned, is_hot, by_second, part, buckets: int, hot: np.ndarray) -> None:
        self.later = np.ones(len(self.pair), bool)  # tokens with two before them
        self.later[np.concatenate(([0], np.cumsum(self.sizes)[:-1]))] = False
        before = self.pair[:-1][self.later[1:]]
        third = self.second[self.later]
        self.triple_counts, at, self.triple = _counted(before, third, len(self.words), learned[self.later])
        self.begin, self.triples = before[at], third[at]  # a triple is a pair and the word after it
        self.end = self.pair[self.later][at]  # the pair that it ends with
        del before, third, at
        first = self.begin
        free = by_second[first] & is_hot[self.w[first]]
        self.pair_followers = np.bincount(first[~free], minlength=len(self.v)).astype(np.int32)
        self.hot_of = np.searchsorted(hot, self.words)  # the place among hot words, if it is one
        number = self.hot_of[self.v[first]] * (len(hot) + 1) + self.hot_of[self.w[first]]
        free_to = bucket_of_hash(mix(number, self.words[self.triples]), buckets)
        list_of = np.where(free, 2 * buckets + free_to, part[first])
        del first, free, number, free_to
        self.triple_order = by_list(list_of).astype(np.int32)
        self.triple_cuts = np.searchsorted(list_of[self.triple_order], np.arange(3 * buckets + 1))

    def forget_lists(self) -> None:
        """Drop what only the lists and their answers need: memory for the scores."""
        self.pair_counts = self.pair_order = self.word_order = self.followers = None
        self.triples = self.triple_counts = self.triple_order = self.hot_of = None

    def triple_list(self, bucket: int, kind: int) -> np.ndarray:
        k = 2 * bucket + kind if kind < 2 else 2 * (len(self.word_cuts) - 1) + bucket
        return self.triple_order[self.triple_cuts[k]:self.triple_cuts[k + 1]]

    def triple_messages(self, block: int):
        for k in range(len(self.word_cuts) - 1):
            for kind in (0, 1, 2):
                x = self.triple_list(k, kind)
                if not len(x):
                    continue
                if kind < 2:
                    p = self.pair_order[self.pair_cuts[2 * k + kind]:self.pair_cuts[2 * k + kind + 1]]
                    a = _numbers(self.pair_followers[p])
                else:
                    f = self.begin[x]
                    a = _ids(np.concatenate([self.hot_of[self.v[f]], self.hot_of[self.w[f]]]))
                yield k, block, TRIPLES + kind, a, _ids(self.words[self.triples[x]]), _numbers(self.triple_counts[x]), None

    def messages(self, block: int):
        buckets = len(self.word_cuts) - 1
        for k in range(buckets):
            x = self.word_order[self.word_cuts[k]:self.word_cuts[k + 1]]
            if len(x):
                yield k, block, WORDS, _steps(self.words[x], buckets), _numbers(self.word_counts[x]), None, None
            for hot in (0, 1):
                p = self.pair_order[self.pair_cuts[2 * k + hot]:self.pair_cuts[2 * k + hot + 1]]
                if not len(p):
                    continue
                first, n = None, self.followers[x]  # first words are the bucket's own, in order
                if hot:
                    v = self.v[p]
                    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
                    first, n = _ids(self.words[v[start]]), np.diff(np.append(start, len(v)))
                yield (k, block, HOT_PAIRS if hot else PAIRS, first, _numbers(n),
                       _ids(self.words[self.w[p]]), _numbers(self.pair_counts[p]))
        if self.order == 3:
            yield from self.triple_messages(block)


def _counted(a: np.ndarray, b: np.ndarray, size: int, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the sorted distinct pairs of numbers, those of ``b`` below ``size``: how
    many of each count and where one of each stands; and every pair's place among them."""
    keys = a.astype(np.uint64)
    keys *= np.uint64(2 * size)
    keys += b.astype(np.uint32) * np.uint64(2)
    keys += counts
    by = sort_places(keys)
    n = keys.astype("<u8", copy=False).view(np.uint8)[::8] & 1
    keys >>= np.uint64(1)
    start = _starts(keys)
    del keys
    new = np.zeros(len(by), np.int32)
    new[start[1:]] = 1
    place = np.empty(len(by), np.int32)
    place[by] = np.cumsum(new, out=new)
    return np.add.reduceat(n, start, dtype=np.int32) if len(start) else by, by[start], place


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and, for each, the sums of ``values``."""
    order = order_of(keys)
    return _sums_of_sorted(keys[order], *(x[order] for x in values))


def _sums_of_sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    start = _starts(keys)
    return (keys[start], *(np.add.reduceat(x, start, dtype=np.int64) if len(start) else x[:0] for x in values))


def _steps(words: np.ndarray, buckets: int) -> bytes:
    """Sorted words of one bucket as steps between their places."""
    return _numbers(np.diff((words // np.uint64(buckets)).astype(np.int64), prepend=0))


def _from_steps(b: bytes, bucket: int, buckets: int) -> np.ndarray:
    return np.cumsum(_read(b), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def _rising(words: np.ndarray, buckets: int) -> bytes:
    """Sorted words of any buckets: steps between their places, and the buckets (mostly one)."""
    z = _ids(words % np.uint64(buckets))
    place = (words // np.uint64(buckets)).astype(np.int64)
    return len(z).to_bytes(4, "little") + z + _numbers(np.diff(place, prepend=0))


def _from_rising(b: bytes, buckets: int) -> np.ndarray:
    n = 4 + int.from_bytes(b[:4], "little")
    return np.cumsum(_read(b[n:]), dtype=np.uint64) * np.uint64(buckets) + _from_ids(b[4:n])


def add_up_own(rows, bucket: int, buckets: int, own: dict):
    """The bucket's words once, and every block's list as steps through them;
    the lists are put into ``own``."""
    counts = []
    for _, src, kind, a, b, _, _ in rows:
        if kind == WORDS:
            own[src] = _from_steps(a, bucket, buckets)
            counts.append(_read(b))
    words, total = _sums(np.concatenate(list(own.values())), np.concatenate(counts)) if own else (None, None)
    if own:
        yield bucket, bucket, WORDS, _steps(words, buckets), _numbers(total), None, None
    for src, h in own.items():
        yield bucket, src, PLACES, _numbers(np.diff(np.searchsorted(words, h), prepend=0)), None, None, None


def add_up_pairs(rows, bucket: int, buckets: int, answers: bool):
    """Step 2 for one bucket: its answers to blocks, or what it passes on."""
    asked, v, w, n, own = [], [], [], [], {}
    passed = list(add_up_own(rows, bucket, buckets, own))
    if not answers:
        yield from passed
    for _, src, kind, a, b, c, d in rows:
        if kind != WORDS:
            w.append(_from_ids(c))
            v.append(np.repeat(own[src] if kind == PAIRS else _from_ids(a), _read(b)))
            n.append(_read(d))
            asked.append((src, PAIR_ANSWER if kind == PAIRS else HOT_ANSWER, len(n[-1])))
    if not asked:
        return
    v, w, n = np.concatenate(v), np.concatenate(w), np.concatenate(n).astype(np.int64)
    order = order_of(v, w)
    keys = both_of(v, w)[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    start = np.flatnonzero(new)
    total = np.add.reduceat(n[order], start)
    if not answers:
        known = total > 0
        yield from known_pairs(v[order[start]][known], w[order[start]][known], total[known], bucket, buckets)
        return
    answer = np.empty(len(n), np.int64)
    answer[order] = total[np.cumsum(new) - 1]
    at = 0
    for src, kind, size in asked:
        yield src, bucket, kind, _numbers(answer[at:at + size]), None, None, None
        at += size


def known_pairs(v: np.ndarray, w: np.ndarray, total: np.ndarray, bucket: int, buckets: int):
    """What a bucket knows of contexts and continuations, to the buckets of their words."""
    yield (bucket, bucket, TOTALS, np.array([(total == k).sum() for k in (1, 2, 3, 4)], np.float64).tobytes(),
           None, None, None)
    ctx = _sums(v, total, total == 1, total == 2, total >= 3)
    to = bucket_of(ctx[0], buckets)
    cont = _sums(w, np.ones(len(w), np.int64))
    to2 = bucket_of(cont[0], buckets)
    by, by2 = by_list(to), by_list(to2)
    for k in np.unique(to).tolist():
        p = by[np.searchsorted(to[by], k):np.searchsorted(to[by], k, "right")]
        yield (k, bucket, CONTEXT, _ids(ctx[0][p]), _numbers(np.concatenate([x[p] for x in ctx[1:]])), None, None)
    for k in np.unique(to2).tolist():
        p = by2[np.searchsorted(to2[by2], k):np.searchsorted(to2[by2], k, "right")]
        yield k, bucket, CONTINUATION, _steps(cont[0][p], buckets), _numbers(cont[1][p]), None, None


def add_up_triples(rows, bucket: int, buckets: int, hot: np.ndarray):
    """Order 3, before step 2, for one bucket."""
    own, lists = {}, {}
    yield from add_up_own(rows, bucket, buckets, own)
    for _, src, kind, a, b, c, d in rows:
        if kind in (PAIRS, HOT_PAIRS):
            v = np.repeat((own[src] if kind == PAIRS else _from_ids(a)).astype(np.uint32), _read(b))
            lists[src, kind] = v, _from_ids(c).astype(np.uint32), _read(d)
    # the bucket's pairs once, sorted, and every block's list as steps through them
    v, w, n = (np.concatenate(x) for x in zip(*lists.values())) if lists else (np.empty(0, np.uint32),) * 3
    order = order_of(v, w)
    start = _starts(v[order], w[order])
    number = np.empty(len(v), np.int64 if len(v) >> 31 else np.int32)
    number[order] = np.repeat(np.arange(len(start), dtype=number.dtype), np.diff(np.append(start, len(v))))
    n = np.add.reduceat(n[order], start) if len(start) else n
    v, w = v[order[start]].astype(np.uint64), w[order[start]].astype(np.uint64)
    at, of = 0, {}
    for (src, kind), x in lists.items():
        of[src, kind] = number[at:at + len(x[0])]
        at += len(x[0])
        steps = np.diff(of[src, kind], prepend=0)
        yield bucket, src, PAIR_PLACES if kind == PAIRS else HOT_PLACES, _numbers(steps), None, None, None
    del lists, number, order
    asked, one, third, count = [], [], [], []
    small = np.int32 if len(v) + len(hot) ** 2 < 1 << 31 else np.int64
    for _, src, kind, a, b, c, _ in rows:
        if kind in (TRIPLES, HOT_TRIPLES, FREE_TRIPLES):
            if kind == FREE_TRIPLES:  # numbered after the bucket's pairs
                x = _from_ids(a).reshape(2, -1).astype(np.int64)
                one.append((len(v) + x[0] * len(hot) + x[1]).astype(small))
            else:
                one.append(np.repeat(of[src, PAIRS if kind == TRIPLES else HOT_PAIRS].astype(small), _read(a)))
            third.append(_from_ids(b).astype(np.uint32))
            count.append(_read(c))
            asked.append((src, kind - TRIPLES + TRIPLE_ANSWER, len(count[-1])))
    context = np.zeros((4, len(v)), np.uint32)  # as in messages
    if asked:
        del of
        one = np.concatenate(one)
        third = np.concatenate(third)
        count = np.concatenate(count)
        order = order_of(one, third)
        one, third = one[order], third[order]
        start = _starts(one, third)
        total = np.add.reduceat(count[order], start, dtype=np.int64)
        answer = np.empty(len(count), np.uint32)  # as in messages
        answer[order] = np.repeat(total, np.diff(np.append(start, len(count))))
        at = 0
        for src, kind, size in asked:
            yield bucket, src, kind, _numbers(answer[at:at + size]), None, None, None
            at += size
        known = total > 0
        one, third, total = one[start][known], third[start][known], total[known]
        del order, start, answer, count
        got = _sums_of_sorted(one, total, total == 1, total == 2, total >= 3)
        cold = got[0] < len(v)
        for row, x in zip(context, got[1:]):
            row[got[0][cold]] = x[cold]
        i = got[0][~cold] - len(v)
        if len(i):  # pieces, to the bucket of the pair, which is that of its second word
            i = i.astype(np.int64)
            first, second, x = hot[i // len(hot)], hot[i % len(hot)], np.stack(got[1:])[:, ~cold]
            yield from dealt(PAIR_CONTEXT, bucket_of(second, buckets), bucket, buckets, first, second, x)
        if len(one):
            j = np.maximum(one - len(v), 0)
            middle = hot[j % len(hot)] if len(hot) else np.zeros(len(one), np.uint64)
            if len(v):
                middle = np.where(one < len(v), w[np.minimum(one, len(v) - 1)], middle)
            order = order_of(middle, third)
            middle, third = middle[order], third[order]
            start = _starts(middle, third)
            x = np.diff(np.append(start, len(middle)))[None]
            middle, third = middle[start], third[start]
            to = bucket_of(np.where(np.isin(middle, hot), third, middle), buckets)
            yield from dealt(SUFFIX, to, bucket, buckets, middle, third, x)
            # to a bucket that has words
            yield (int(to[0]), bucket, TRIPLE_TOTALS,
                   np.array([(total == k).sum() for k in (1, 2, 3, 4)], np.float64).tobytes(), None, None, None)
    if len(v):
        first = _starts(v)
        yield (bucket, bucket, PAIR_TABLE, _ids(v[first]), _numbers(np.diff(np.append(first, len(v)))), _ids(w),
               _numbers(np.concatenate([n[None], context]).ravel()))


def dealt(kind: int, to: np.ndarray, bucket: int, buckets: int, v: np.ndarray, w: np.ndarray, x: np.ndarray):
    """Messages about sorted pairs of words, counts of a pair in a column of ``x``."""
    by = by_list(to)
    cuts = _starts(to[by])
    for p in np.split(by, cuts[1:]):
        first = _starts(v[p])
        yield (int(to[p[0]]), bucket, kind, _rising(v[p][first], buckets), _numbers(np.diff(np.append(first, len(p)))),
               _ids(w[p]), _numbers(x[:, p].ravel()))


def add_up_pairs_of_triples(rows, bucket: int, buckets: int, answers: bool):
    """Step 2 for one bucket, with order 3: its answers to blocks (of triples
    too), or what it passes on."""
    asked, pieces, v = [], [], None
    for row in rows:
        _, src, kind, a, b, c, d = row
        if kind == PAIR_TABLE:
            v, w = np.repeat(_from_ids(a), _read(b)), _from_ids(c)
            table = _read(d).astype(np.int64).reshape(5, -1)  # count, context count, followers once, twice, more
        elif kind in (PAIR_PLACES, HOT_PLACES):
            asked.append((src, PAIR_ANSWER if kind == PAIR_PLACES else HOT_ANSWER, a))
        elif kind in (SUFFIX, PAIR_CONTEXT):
            pieces.append((kind, both_of(np.repeat(_from_rising(a, buckets), _read(b)), _from_ids(c)), _read(d)))
        elif kind in TO_BLOCKS:
            if answers:
                yield src, bucket, kind, a, None, None, None
        elif not answers:
            yield row
    if v is None:
        return
    order = order_of(v, w)
    keys = both_of(v, w)[order]
    for kind, key, x in pieces:
        at = order[np.minimum(np.searchsorted(keys, key), len(keys) - 1)]
        if (both_of(v[at], w[at]) != key).any():
            raise RuntimeError("a triple's pair is not in its bucket")
        x = x.reshape(-1, len(key))
        if kind == SUFFIX:
            table[0, at] += x[0]
        else:
            table[1:, at] += x
    if answers:
        for src, kind, a in asked:
            yield src, bucket, kind, _numbers(table[:, np.cumsum(_read(a), dtype=np.int64)]), None, None, None
    else:
        known = table[0] > 0
        yield from known_pairs(v[known], w[known], table[0][known], bucket, buckets)


def add_up_words(rows, bucket: int, buckets: int):
    """Step 3 for one bucket."""
    asked, ctx, cont, pairs, triples = [], [], [], np.zeros(4), np.zeros(4)
    for _, src, kind, a, b, _, _ in rows:
        if kind == WORDS:
            words, n = _from_steps(a, bucket, buckets), _read(b).astype(np.int64)
        elif kind == PLACES:
            asked.append((src, np.cumsum(_read(a), dtype=np.int64)))
        elif kind == CONTEXT:
            ctx.append((_from_ids(a), _read(b).reshape(4, -1)))
        elif kind == CONTINUATION:
            cont.append((_from_steps(a, bucket, buckets), _read(b)))
        elif kind == TOTALS:
            pairs += np.frombuffer(a)
        elif kind == TRIPLE_TOTALS:
            triples += np.frombuffer(a)
    if not asked:
        return
    table = np.zeros((6, len(words)), np.int64)  # count, continuations, context count, followers once, twice, more
    table[0] = n
    if ctx:
        got = _sums(np.concatenate([x[0] for x in ctx]), *np.concatenate([x[1] for x in ctx], axis=1))
        table[2:, np.searchsorted(words, got[0])] = got[1:]
    if cont:
        got = _sums(np.concatenate([x[0] for x in cont]), np.concatenate([x[1] for x in cont]))
        at = np.minimum(np.searchsorted(got[0], words), len(got[0]) - 1)
        table[1] = np.where(got[0][at] == words, got[1][at], 0)
    for src, at in asked:
        yield src, bucket, WORD_ANSWER, _numbers(table[:, at]), None, None, None
    c = table[1]
    sums = [n.sum(), (n > 0).sum(), c.sum(), *((c == k).sum() for k in (1, 2, 3, 4)), (c >= 3).sum(), *pairs, *triples]
    yield asked[0][0], bucket, TOTALS, np.array(sums, np.float64).tobytes(), None, None, None


def discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's three discounts from the numbers of items that came
    1, 2, 3, 4 times, kept between 0.05 and their count less 0.05 where tiny
    corpora give none."""
    n = np.maximum(n, 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, backed by a mapped scratch file that is already unlinked."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    with tempfile.TemporaryFile() as f:  # its name is gone from the start
        for a in arrays:
            f.write(a.data if a.size else b"")
        f.flush()
        total = sum(a.nbytes for a in arrays)
        if not total:
            return arrays
        view = mmap.mmap(f.fileno(), total, access=mmap.ACCESS_READ)
    out, at = [], 0
    for a in arrays:
        out.append(np.frombuffer(view, a.dtype, a.size, at).reshape(a.shape))
        at += a.nbytes
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(x.max())) if x.size else x


def _discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(n - d[np.minimum(n, 3)], 0)


def score_block(block: Block, answers, stats: np.ndarray):
    """Per document: tokens, known tokens, base score and model score."""
    n_train, vocab, n_cont = stats[0], stats[1], stats[2]
    m, n = stats[3:7], stats[8:12]
    table = np.zeros((6, len(block.words)), np.int64)
    total = np.zeros((5 if block.order == 3 else 1, len(block.v)), np.uint32)  # as in messages
    triple = np.zeros(len(block.triples) if block.order == 3 else 0, np.uint32)
    got = 0
    for bucket, kind, a in answers:
        x = _read(a)
        if kind in (PAIR_ANSWER, HOT_ANSWER):
            part = 2 * bucket + (kind == HOT_ANSWER)
            p = block.pair_order[block.pair_cuts[part]:block.pair_cuts[part + 1]]
            total[:, p] = x.reshape(len(total), -1)
            got += len(p)
        elif kind in (TRIPLE_ANSWER, HOT_TRIPLE_ANSWER, FREE_ANSWER):
            triple[block.triple_list(bucket, kind - TRIPLE_ANSWER)] = x
            got += len(x)
        else:
            p = block.word_order[block.word_cuts[bucket]:block.word_cuts[bucket + 1]]
            table[:, p] = x.reshape(6, -1)
            got += len(p)
    if got != len(block.v) + len(block.words) + len(triple):
        raise RuntimeError("a block's answers do not match its words")
    block.forget_lists()
    d1 = np.concatenate(([0.0], discounts(m)))
    cont = table[1]
    left = (d1[1] * m[0] + d1[2] * m[1] + d1[3] * stats[7]) / n_cont if n_cont else 1.0
    p_word = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / max(1, n_cont) + left / (vocab + 1)
    d2 = np.concatenate(([0.0], discounts(n)))
    d3 = np.concatenate(([0.0], discounts(stats[12:16])))
    seen = np.maximum(table[2], 1)
    back = np.where(table[2] > 0, (table[3:].T @ d2[1:]) / seen, 1.0)
    seen, gamma, word_p, base, known, triple, *total = mapped([
        narrow(seen), back, p_word, np.log10((table[0] + 0.1) / (n_train + 0.1 * (vocab + 1))), table[0] > 0,
        narrow(triple), *map(narrow, total)])
    total, *context = total
    del table, back, p_word
    pair_p = np.empty(len(total))
    for a in range(0, len(total), SCORE_STEP):
        b = slice(a, a + SCORE_STEP)
        pair_p[b] = _discounted(total[b], d2) / seen[block.v[b]] + gamma[block.v[b]] * word_p[block.w[b]]
    w, p = block.second, pair_p[block.pair]
    if block.order == 3:
        triple_p = np.empty(len(triple))
        for a in range(0, len(triple), SCORE_STEP):
            b = slice(a, a + SCORE_STEP)
            n, *kinds = (x[block.begin[b]] for x in context)
            seen = np.maximum(n, 1)
            left = np.where(n > 0, sum(x * y for x, y in zip(kinds, d3[1:])) / seen, 1.0)
            triple_p[b] = _discounted(triple[b], d3) / seen + left * pair_p[block.end[b]]
        p[block.later] = triple_p[block.triple]
    p = np.log10(p)
    start = np.concatenate(([0], np.cumsum(block.sizes)[:-1]))
    yield from zip(block.sizes.tolist(), np.add.reduceat(known[w].astype(np.int64), start).tolist(),
                   np.add.reduceat(base[w], start).tolist(), np.add.reduceat(p, start).tolist())


def frequent_words(docs: DataFrame, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens in all rows, and the words (by hash) with a notable share of some
    partition.  They decide where pairs meet and nothing else."""
    def tally(batches):
        seen, n = Counter(), 0
        for batch in batches:
            flat, sizes, words = split_words(batch.column(0).fill_null(""))
            seen.update(dict(zip(words.cast(pa.binary()).to_pylist(), np.bincount(flat, minlength=len(words)).tolist())))
            seen[START] += len(sizes)
            n += len(flat) + len(sizes)
            if len(seen) > 400_000:
                seen = Counter({w: k for w, k in seen.items() if k * 100_000 > n})
        rows = [(0, n, True)]
        for w, k in seen.items():
            if k * 100_000 > n:
                h = xxhash.xxh64_intdigest(w)
                rows.append((h - (1 << 64) if h >> 63 else h, k, False))
        yield from batches_of(rows, pa.schema([("h", pa.int64()), ("n", pa.int64()), ("total", pa.bool_())]))

    got = docs.select(F.col(text)).mapInArrow(tally, "h long, n long, total boolean")
    rows = got.groupBy("h", "total").agg(F.sum("n").alias("n")).orderBy(F.col("total").desc(), F.col("n").desc()) \
        .limit(MAX_HOT).collect()
    total = sum(r["n"] for r in rows if r["total"])
    return total, [(r["h"], r["n"]) for r in rows if not r["total"]]


def score(docs: DataFrame, train: Column, keep: list[Column], row_id: str = "doc_id", text: str = "text",
          block_tokens: int = BLOCK_TOKENS, order: int = 2) -> DataFrame:
    """``keep`` columns plus ``n_tokens, n_known, train_tokens, base_score,
    score`` for every row; the model learns from the rows where ``train`` holds.

    Texts are lower-cased (A-Z) words and one end; a null text counts as empty
    and has the end alone.  ``base_score`` is the add-0.1 unigram score,
    ``score`` the log10 probability under the model of the given ``order`` (2:
    pairs, 3: triples; a text's first word has the start alone before it), whose
    unigrams are interpolated with a uniform share for unknown words.  Null ids, repeated
    rows and ties need no special treatment: blocks are dealt by a hash of id
    and text, and a block's lists do not depend on the order of its rows.
    Without training rows all words are unknown.  Other columns are ignored; an
    empty table gives an empty result.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    total, frequent = frequent_words(docs, text)
    n = max(1, -(-total // block_tokens))
    hot = np.sort(np.array([h for h, k in frequent if k * 8 * n > total], dtype=np.int64).view(np.uint64))
    hot_ids = np.sort(hot_numbers(hot, n))
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(*keep)
    cols = [f"_k{i}" for i in range(len(named.columns))]
    dealt = docs.select(F.pmod(F.xxhash64(F.col(row_id), t), F.lit(n)).cast("int").alias("block"),
                        t.alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"),
                        *[c.alias(a) for c, a in zip(keep, cols)])

    def pack(batches):
        """Compressed pieces: the documents of one block among some of a task's batches."""
        held, size = [], 0

        def pieces():
            t = pa.Table.from_batches(held)
            held.clear()
            to = t.column("block").to_numpy()
            by = np.argsort(to, kind="stable")
            to, t = to[by], t.take(pa.array(by))
            flat, sizes, words = split_words(t.column("_text").combine_chunks())
            by = pc.sort_indices(words).to_numpy()
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by))
            flat, words = rank[flat], words.take(pa.array(by))
            t = t.drop_columns(["block", "_text"]).append_column("_n", pa.array(sizes, pa.int32()))
            cuts, ends = np.append(_starts(to), len(to)), np.concatenate(([0], np.cumsum(sizes)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                    out.write_table(t.slice(a, b - a).combine_chunks())
                row = to[a], sink.getvalue().to_pybytes(), *pack_words(flat[ends[a]:ends[b]], words)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PIECE)], schema=PIECE)
            pa.default_memory_pool().release_unused()  # the worker stays for other steps

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PIECE_BYTES:
                yield from pieces()
                size = 0
        if held:
            yield from pieces()

    pieces = dealt.mapInArrow(pack, "block int, piece binary, words binary, tokens binary").groupBy("block")

    def documents(table: pa.Table) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("piece")])

    def words_of(table: pa.Table, docs: pa.Table) -> Words:
        return unpack_words([(x.as_py(), y.as_py()) for x, y in zip(table.column("words"), table.column("tokens"))],
                            docs.column("_n").to_numpy())

    def read(table: pa.Table, docs: pa.Table, answers: pa.Table) -> Block:
        places = {k: a.as_py() for k, kind, a in zip(answers.column("src").to_pylist(), answers.column("kind").to_pylist(),
                                                     answers.column("a")) if kind == NUMBERS}
        train = docs.column("_train").to_numpy(zero_copy_only=False).astype(bool)
        return Block(words_of(table, docs), train, n, hot_ids, places, order)

    def name(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        return pa.Table.from_batches(batches_of(list_words(words_of(table, documents(table)), k, n), MESSAGE, 64), MESSAGE)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        k = left.column("block")[0].as_py()
        return pa.Table.from_batches(batches_of(read(left, documents(left), right).messages(k), MESSAGE, 64), MESSAGE)

    def in_bucket(fn):
        def run(batches):
            rows = list(rows_of(batches))
            if rows:
                yield from batches_of(fn(rows, rows[0][0]), MESSAGE, 16)
        return run

    named_words = pieces.applyInArrow(name, MESSAGE_SQL).repartitionById(n, F.col("to")).mapInArrow(
        in_bucket(lambda rows, k: number_words(rows, k, n, hot)), MESSAGE_SQL)
    answer = [F.col("to").alias("block"), "src", "kind", "a"]
    asked = pieces.cogroup(named_words.select(*answer).groupBy("block")).applyInArrow(ask, MESSAGE_SQL)
    if order == 3:
        asked = asked.repartitionById(n, F.col("to")).mapInArrow(
            in_bucket(lambda rows, k: add_up_triples(rows, k, n, hot_ids)), MESSAGE_SQL)
    step_2 = add_up_pairs_of_triples if order == 3 else add_up_pairs
    in_buckets = asked.repartitionById(n, F.col("to"))
    # read twice, for a second sum costs less than the answers' way through the buckets of step 3
    pairs = in_buckets.mapInArrow(in_bucket(lambda rows, k: step_2(rows, k, n, False)), MESSAGE_SQL)
    pair_answers = in_buckets.mapInArrow(in_bucket(lambda rows, k: step_2(rows, k, n, True)), MESSAGE_SQL)
    answers = pairs.repartitionById(n, F.col("to")).mapInArrow(
        in_bucket(lambda rows, k: add_up_words(rows, k, n)), MESSAGE_SQL)
    answers = answers.select(*answer).unionByName(pair_answers.select(*answer)).unionByName(named_words.select(*answer)) \
        .repartition("block")

    def add(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x, k in zip(table.column("a"), table.column("kind").to_pylist()) if k == TOTALS]
        s = np.sum([np.frombuffer(x) for x in raw], axis=0).tolist() if raw else []
        return pa.table({"one": pa.array([1] if raw else [], pa.int32()),
                         "s": pa.array([s] if raw else [], pa.list_(pa.float64()))})

    parts = answers.groupBy("block").applyInArrow(add, "one int, s array<double>")
    stats = parts.groupBy("one").agg(F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(16)]).alias("stats"))
    # no filter here: with one the answers would be computed and shuffled twice
    with_stats = answers.crossJoin(F.broadcast(stats.select("stats")))  # one row

    out_schema = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(cols, named.schema.fields)) \
        + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return None
        s = np.array(right.column("stats")[0].as_py())
        got = ((k, kind, a.as_py()) for k, kind, a in zip(right.column("src").to_pylist(), right.column("kind").to_pylist(),
                                                          right.column("a")) if kind not in (NUMBERS, TOTALS))
        docs = documents(left)
        rows = list(score_block(read(left, docs, right), got, s))
        kept = [docs.column(a).combine_chunks() for a in cols]
        c = list(zip(*rows))
        more = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array([int(s[0])] * len(rows), pa.int64()),
                pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64())]
        return pa.Table.from_arrays([*kept, *more], names=[*cols, "n_tokens", "n_known", "train_tokens", "base_score",
                                                           "score"])

    out = pieces.cogroup(with_stats.groupBy("block")).applyInArrow(finish, out_schema)
    return out.select(*[F.col(a).alias(f.name) for a, f in zip(cols, named.schema.fields)], *out.columns[len(cols):])
