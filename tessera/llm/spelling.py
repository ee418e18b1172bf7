"""Spelling variant grouping: a relational trie frontier.

The words form two tries, one of the words and one of the reversed words, kept
as a distributed edge table (dir, level, node, label, ...); a node is named by
the characters that lead to it.  Edges carry one character down to ``FINE``
levels and labels of doubling length below, so that a word of n characters has
about ``FINE + log2 n`` levels.  A word ends on an edge with a label shorter
than its level's (possibly empty), which names the word.

A frontier of (word, position, node, edits) states walks down the tries level
by level, one join with that level's edges each:

* a state without edits sits on its word's own node and may leave it by one
  replaced or deleted character; insertions are the deletions of the longer
  word and replacements are followed in one order only, the pairs are mirrored
  at the end;
* a state with one edit follows the single edge that spells its rest;
* a state whose rest ends on an end edge has found a neighbour.

A word of n characters is edited from position n // 2 on in the forward trie,
and in the other half in the trie of reversed words: the crowded upper levels
are passed without an edit.  Every edge knows which rest lengths and next
characters lie below it, so most states that cannot end are never written.

Nothing is dropped or capped: every pair at one edit is found exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import runs, stream
from tessera.session import discard, materialize

#: Levels with one character each; below, labels double in length.
FINE = 32
#: Words that a task counts before it passes its counts on.
HELD = 300_000

#: Runs between blanks, and the blank where a long text may be cut.
ANY, GAP = re.compile(rb"[^ ]+"), re.compile(b" ")


def word_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_len: int = 6, min_count: int = 5,
                delete_one_in: int | None = None) -> DataFrame:
    """``(word, n)``: words of ``min_len`` code points or more that occur
    ``min_count`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered;
    a null text has none.  With ``delete_one_in=m`` a run loses the code point
    h % length when m divides h, the crc32 of ``<row_id>:<run>`` (a null id is
    the empty text).  Columns other than the two are not looked at.
    """
    # every letter of a run is one byte of Latin-1; all else becomes a blank
    blank = bytes(c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

    def count(rows):
        held: dict = {}
        for i, t in rows:
            if not t:
                continue
            head = zlib.crc32(f"{'' if i is None else i}:".encode())
            letters = t.lower().decode("utf-8", "replace").encode("latin-1", "replace").translate(blank)
            for found in runs(letters, ANY, GAP):
                for run, n in Counter(found).items():
                    if len(run) < min_len:
                        continue
                    if delete_one_in is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                        if h % delete_one_in == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1:]
                    held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield from ((w.decode("latin-1"), n) for w, n in held.items())
                    held.clear()
        yield from ((w.decode("latin-1"), n) for w, n in held.items())

    # bytes.lower() touches A-Z alone
    part = stream(docs.select(F.col(row_id).cast("string"), F.col(text).cast("binary")), count, "word string, n long")
    return part.where(F.length("word") >= min_len).groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_count)


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))


def _char_bit(c: Column) -> Column:
    """One of 61 bits for the first character (none for an empty text)."""
    return F.when(c == "", F.lit(0).cast("long")).otherwise(_bit(F.pmod(F.ascii(c), F.lit(61))))


def _levels(longest: int) -> list[int]:
    """Depths of the levels: 0, 1, ..., FINE, then doubling, past ``longest``."""
    d = list(range(FINE + 1))
    while d[-1] <= longest:
        d.append(2 * d[-1])
    return d


def _sub(v: str | Column, start: int | Column, n: int | Column) -> Column:
    """``n`` characters from the 0-based position ``start``."""
    col = F.col(v) if isinstance(v, str) else v
    s = F.lit(start) if isinstance(start, int) else start
    return F.substring(col, s + 1, F.lit(n) if isinstance(n, int) else n)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)`` for every ordered pair of words in
    ``(word, n)`` that differ by exactly one inserted, deleted or replaced code
    point.  ``word`` is not null and distinct, and may be empty."""
    spark = words.sparkSession
    both = words.select("n", F.explode(F.array(F.struct(F.lit(0).alias("dir"), F.col("word").alias("v")),
                                               F.struct(F.lit(1).alias("dir"), F.reverse("word").alias("v")))).alias("x")) \
        .select("x.dir", "x.v", "n", F.length("x.v").alias("len"))
    # the first position that may be edited in this trie
    both = both.withColumn("half", F.when(F.col("dir") == 0, F.floor(F.col("len") / 2))
                           .otherwise(F.col("len") - F.floor(F.col("len") / 2)).cast("int"))
    both = materialize(both, "spell")
    ends = both.agg(F.max("len").alias("longest"), F.min("half").alias("first")).first()
    schema = "word string, n long, near string, near_n long"
    if ends["longest"] is None:
        return spark.createDataFrame([], schema)
    depth = _levels(ends["longest"])
    first = max(k for k in range(len(depth)) if depth[k] <= ends["first"])
    last = max(k for k in range(len(depth)) if depth[k] <= ends["longest"])

    # the edge table of the levels that are ever entered
    at = F.array(*[F.lit(x) for x in depth])
    edge = both.withColumn("k", F.explode(F.filter(F.sequence(F.lit(first), F.lit(last)),
                                                   lambda k: at[k] <= F.col("len")))) \
        .withColumn("d", at[F.col("k")]).withColumn("s", at[F.col("k") + 1] - F.col("d"))
    edge = edge.withColumn("label", _sub("v", F.col("d"), F.col("s"))) \
        .withColumn("left", F.col("len") - F.col("d") - F.length("label")) \
        .withColumn("ends", F.length("label") < F.col("s"))
    edge = edge.groupBy("dir", "k", _sub("v", 0, F.col("d")).alias("node"), "label").agg(
        F.bit_or(_bit(F.least("left", F.lit(62)))).alias("lens"),
        F.bit_or(_char_bit(_sub("v", F.col("d") + F.length("label"), 1))).alias("chars"),
        F.max(F.when(F.col("ends"), F.col("n"))).alias("near_n"))
    edge = materialize(edge.repartitionByRange("k", "node").sortWithinPartitions("k"), "spell")

    steps, frontier = [], None
    for k in range(first, last + 1):
        d, s = depth[k], depth[k + 1] - depth[k]
        states = both.where((F.col("len") >= d) & (F.col("half") < d + s)) \
            .select("dir", "v", "n", "len", F.lit(d).alias("pos"), _sub("v", 0, d).alias("node"), F.lit(0).alias("edits"))
        if frontier is not None:
            states = states.unionByName(frontier)
        # the label that spells on, and what the label is cut from (one character: what it must be)
        states = states.withColumn("own", _sub("v", F.col("pos"), s)) \
            .withColumn("more", _sub("v", d + 1, 1) if s == 1 else _sub("v", d, s + 1))
        e = edge.where(F.col("k") == k).drop("k")
        own, more, label = F.col("own"), F.col("more"), F.col("label")
        if s == 1:
            swap = (own != "") & (own < label)
            cut = (own != "") & (label == more) & (label != own)
        else:
            swap = (F.length(label) == F.length(own)) & (own < label) & (F.levenshtein(label, own) == 1)
            cut = (F.length(label) == F.length(more) - 1) & ((label != own) | (F.length(more) <= s)) \
                & (F.levenshtein(label, more) == 1)
        match = F.when(F.col("edits") == 1, label == own).otherwise(swap | cut)
        tried = states.join(e, ["dir", "node"]).where(match)
        # one replaced and one deleted character may lead over the same edge: both are tried
        ahead = F.when(F.col("edits") == 1, F.array(F.col("pos") + F.length(label))).otherwise(
            F.filter(F.array(F.when(swap, d + F.length(label)), F.when(cut, d + F.length(label) + 1)), lambda x: x.isNotNull()))
        tried = tried.withColumn("at", F.explode(ahead))
        left = F.col("len") - F.col("at")
        lives = F.when(F.col("near_n").isNotNull(), left == 0).otherwise(
            (left >= 0) & (F.col("lens").bitwiseAND(_bit(F.least(left, F.lit(62)))) != 0)
            & ((left == 0) | (F.col("chars").bitwiseAND(_char_bit(_sub("v", F.col("at"), 1))) != 0)))
        step = materialize(tried.where(lives).select(
            "dir", "v", "n", "len", F.col("at").alias("pos"), F.concat("node", "label").alias("node"),
            F.lit(1).alias("edits"), "near_n"), "spell")
        steps.append(step)
        frontier = step.where(F.col("near_n").isNull()).drop("near_n")

    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)

    def forward(c):
        return F.when(F.col("dir") == 0, F.col(c)).otherwise(F.reverse(c))

    found = found.where(F.col("near_n").isNotNull()) \
        .select(forward("v").alias("word"), "n", forward("node").alias("near"), "near_n")
    pairs = materialize(found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                                       F.col("word").alias("near"), F.col("n").alias("near_n")))
                        .distinct(), "spell")
    for x in [both, edge, *steps]:
        discard(x)
    return pairs


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point
    order) if that is at least ``ratio`` times the word's own, else null;
    ``root`` is where the forms lead, the word itself without one.  ``ratio``
    is 2 or more, so that forms cannot form a circle.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = materialize(words.select("word", "n"), "spell")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    g = words.join(best, "word", "left").withColumn("form_n", -F.col("b.m"))
    g = g.withColumn("form_n", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n")))
    g = materialize(g.select("word", F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form"), "n",
                             F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "spell")
    discard(near)
    discard(words)
    # pointer jumping: after round r a word points up to 2^r forms ahead
    to = materialize(g.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spell")
    while True:
        nxt = to.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        new = materialize(to.join(nxt, "root", "left")
                          .select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")),
                          "spell")
        discard(to)
        to = new.drop("_moved")
        to._tessera_path = new._tessera_path
        if not new.where("_moved").limit(1).count():
            break
    return g.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                             "n", "n_near", "form_n")
