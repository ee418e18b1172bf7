"""Conversation prefix trie from composable fingerprints.

A conversation is rebuilt from the first turns of its base conversation (its
head) and its own later turns (its suffix).  No rebuilt text is ever made: a
sequence of turns has the fingerprint

    H(t_0 ... t_(n-1)) = sum_i h(t_i) * B^i  mod P,

an element of a monoid: H(xy) = H(x) + B^|x| * H(y).  Every stored conversation
keeps the fingerprints of its prefixes; the prefix of a rebuilt conversation is
head and suffix combined, where the suffix is the difference of two prefixes,
shifted to its new place.  Three bases and turn hashes are carried side by side
(93 bits).

A node of the trie is a (depth, fingerprint).  Equality inside a node is then
verified through the references to the stored turns: every turn hash must stand
for one (role, text), and all members of a node must agree on the hash of the
last turn and on the parent's fingerprint; by induction over the depth, members
then are equal turn by turn.  If a check fails, all is repeated with another
seed, so the result never rests on the absence of collisions.

Long conversations (one may hold a third of all turns) are ranked and summed in
range partitions; joins on a conversation are keyed by block of depths, and the
few parents with many children answer from a broadcast table of bounded size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.llm.common import n_partitions, stream
from tessera.session import discard, materialize

P = (1 << 31) - 1
#: Three bases, fixed values.
BASES = (1_000_003, 16_777_619, 987_654_323)
F3 = range(3)
#: Depths that a row of a conversation's table answers for.
BLOCK = 1_024
#: A parent with more than 1 / HOT of all children is answered from a broadcast table (at most HOT rows).
HOT = 1_000
#: Ids that one row of an ends list holds at most.
IDS = 1_024


def _power(k: int, e: Column) -> Column:
    """B_k ^ e mod P for 0 <= e < 256^5, from five tables of 256 powers."""
    out = None
    for digit in range(5):
        table = F.lit([pow(BASES[k], x * 256 ** digit, P) for x in range(256)]).cast("array<bigint>")
        x = table[F.shiftright(e, 8 * digit).bitwiseAND(255).cast("int")]
        out = x if out is None else out * x % P
    return out


def _inverse(k: int, e: Column) -> Column:
    """B_k ^ -e mod P for a small e."""
    inv = pow(BASES[k], -1, P)
    return F.lit([pow(inv, x, P) for x in range(256)]).cast("array<bigint>")[e.cast("int")]


def store_turns(turns: DataFrame, seed: int, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Stored turns: ``(c, pos, t0..t2, p0..p2, chars, role, text)`` with
    0-based positions; ``p`` is the fingerprint of the prefix that ends here."""
    t = turns.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("c is not null")
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # ranges are cut by the head of a text, so that no long text comes to the driver
    s = t.repartitionByRange(n_partitions(t.sparkSession), order[0], order[1], F.substring("role", 1, 32),
                             F.substring("text", 1, 64)).sortWithinPartitions(*order)
    s = s.select("c", "role", "text", F.length("text").cast("long").alias("chars"),
                 *[F.pmod(F.xxhash64(F.lit(100 * seed + k), "role", "text"), F.lit(P)).alias(f"t{k}") for k in F3],
                 F.monotonically_increasing_id().alias("_id"))
    s = materialize(s, "turns").withColumn("_p", F.shiftright("_id", 33))
    # positions: rows of the conversation in the ranges below, then in this range
    inside = Window.partitionBy("c", "_p").orderBy("_id")
    below = Window.partitionBy("c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    n = s.groupBy("c", "_p").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("c", "_p", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    ids = s.select("c", "_p", "_id", *[f"t{k}" for k in F3]).withColumn("_i", F.row_number().over(inside) - 1) \
        .join(n, ["c", "_p"]).withColumn("pos", F.col("_off") + F.col("_i"))
    ids = ids.select("c", "_p", "_id", "pos", *[(F.col(f"t{k}") * _power(k, F.col("pos")) % P).alias(f"x{k}") for k in F3])
    ids = materialize(ids, "turns")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    tot = ids.groupBy("c", "_p").agg(*[(F.sum(f"x{k}") % P).alias(f"y{k}") for k in F3])
    tot = tot.select("c", "_p", *[F.coalesce(F.sum(f"y{k}").over(below), F.lit(0)).alias(f"y{k}") for k in F3])
    cum = ids.select("c", "_p", "_id", "pos", *[F.sum(f"x{k}").over(upto).alias(f"x{k}") for k in F3]).join(tot, ["c", "_p"])
    cum = cum.select("_id", "pos", *[((F.col(f"x{k}") + F.col(f"y{k}")) % P).alias(f"p{k}") for k in F3])
    out = materialize(s.drop("_p").join(cum, "_id").drop("_id"), "turns")
    discard(s)
    discard(ids)
    return out


def _collisions(stored: DataFrame) -> bool:
    """Whether some turn hash stands for two different (role, text)."""
    t = [f"t{k}" for k in F3]
    twice = stored.groupBy(*t).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*t)
    same = stored.select(*t, F.struct("role", "text").alias("x")).join(twice, t, "left_semi") \
        .groupBy(*t).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return bool(same.where(F.col("a") != F.col("b")).limit(1).count())


def rebuilt_prefixes(stored: DataFrame, base: Column, head: Column, max_head: int) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and one row per conversation.

    ``base`` and ``head`` (0 to ``max_head``) are expressions of the
    conversation id ``c``.  A conversation becomes the first ``head`` turns of
    ``base`` (all if fewer, none if absent), then its own turns from position
    ``head`` on.  Returns ``(c, depth, f0..f2, q0..q2, t0..t2, chars)``, where
    ``q`` is the fingerprint one turn earlier, for depths from 1 on, and
    ``(c, length, e0..e2)`` with the fingerprint of the whole.
    """
    if max_head > 255:
        raise ValueError("max_head must be below 256")
    n = stored.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    front = stored.where(F.col("pos") < max_head).select("c", "pos", "chars", *[f"{x}{k}" for x in "tp" for k in F3])
    # prefix fingerprints of the first turns, as arrays of at most max_head entries
    tops = front.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", *[f"p{k}" for k in F3], *[f"t{k}" for k in F3], "chars"))).alias("tops"))
    conv = n.join(tops, "c", "left").select("c", "n", F.coalesce("tops", F.array().cast(tops.schema["tops"].dataType)).alias("tops"))
    conv = materialize(conv, "convs")
    heads = conv.withColumn("_b", base).withColumn("h", head.cast("long"))
    bases = conv.select(F.col("c").alias("_b"), F.col("tops").alias("base_tops"))
    heads = heads.join(bases, "_b", "left")
    hb = F.least("h", F.coalesce(F.size("base_tops").cast("long"), F.lit(0)))
    hb = F.when(F.col("base_tops").isNull(), F.lit(0).cast("long")).otherwise(hb)
    own_h = F.least(F.col("h"), F.col("n"))

    def prefix(tops: str, d: Column, k: int) -> Column:  # fingerprint of the first d turns
        return F.when(d > 0, F.get(F.col(tops), (d - 1).cast("int"))[f"p{k}"]).otherwise(F.lit(0).cast("long"))

    heads = heads.withColumn("hb", hb).withColumn("own_h", own_h)
    heads = materialize(heads.select(
        "c", "n", "h", "hb", (F.col("hb") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"),
        F.slice(F.coalesce("base_tops", F.array().cast(conv.schema["tops"].dataType)), F.lit(1), F.col("hb").cast("int")).alias("taken"),
        *[prefix("base_tops", F.col("hb"), k).alias(f"b{k}") for k in F3],
        *[prefix("tops", F.col("own_h"), k).alias(f"o{k}") for k in F3]), "convs")

    # turns of the head: references into the base
    of_head = heads.select("c", F.posexplode("taken").alias("i", "x")).select(
        "c", (F.col("i") + 1).cast("long").alias("depth"), *[F.col(f"x.p{k}").alias(f"f{k}") for k in F3],
        *[F.pmod(F.col(f"x.p{k}") - F.col(f"x.t{k}") * _power(k, F.col("i").cast("long")), F.lit(P)).alias(f"q{k}") for k in F3],
        *[F.col(f"x.t{k}").alias(f"t{k}") for k in F3], F.col("x.chars").alias("chars"))
    # own turns: blocks of positions, so that a long conversation has many keys
    block = (F.col("pos") / BLOCK).cast("long")
    keyed = heads.where(F.col("n") > F.col("h")).select(
        "c", "h", "hb", *[f"{x}{k}" for x in "bo" for k in F3],
        F.explode(F.sequence((F.col("h") / BLOCK).cast("long"), ((F.col("n") - 1) / BLOCK).cast("long"))).alias("_blk"))
    own = stored.withColumn("_blk", block).drop("role", "text").join(keyed, ["c", "_blk"]).where(F.col("pos") >= F.col("h"))

    def combined(upto: Column, k: int) -> Column:  # head, then the own turns from h on, moved to place hb
        part = F.pmod(upto - F.col(f"o{k}"), F.lit(P))
        return (F.col(f"b{k}") + part * _inverse(k, F.col("h") - F.col("hb"))) % P

    before = [F.pmod(F.col(f"p{k}") - F.col(f"t{k}") * _power(k, F.col("pos")), F.lit(P)) for k in F3]
    of_own = own.select("c", (F.col("pos") - F.col("h") + F.col("hb") + 1).alias("depth"),
                        *[combined(F.col(f"p{k}"), k).alias(f"f{k}") for k in F3],
                        *[combined(before[k], k).alias(f"q{k}") for k in F3], *[f"t{k}" for k in F3], "chars")
    rows = materialize(of_head.unionByName(of_own), "prefixes")
    whole = rows.join(heads.where("length > 0").select("c", F.col("length").alias("depth")), ["c", "depth"]) \
        .select("c", *[F.col(f"f{k}").alias(f"e{k}") for k in F3])
    ends = heads.select("c", "length").join(whole, "c", "left") \
        .select("c", "length", *[F.coalesce(f"e{k}", F.lit(0).cast("long")).alias(f"e{k}") for k in F3])
    ends = materialize(ends, "convs")
    discard(conv)
    discard(heads)
    return rows, ends


def _digests(ends: DataFrame) -> DataFrame:
    """``(depth, f0..f2, ends_sha256)``: the digest of the ascending ids that
    end at a node.  A node's ids travel as blocks of ``IDS`` values at most;
    they stream in order through one digest, which is by nature sequential."""
    key = ["depth", *[f"f{k}" for k in F3]]
    e = ends.select("c", F.col("length").alias("depth"), *[F.col(f"e{k}").alias(f"f{k}") for k in F3])
    blocks = e.groupBy(*key, F.floor(F.col("c") / IDS).alias("blk")) \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_set("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(rows):
        last, sha = None, None
        for *at, _, ids in rows:
            if at != last:
                if last is not None:
                    yield (*last, sha.hexdigest())
                last, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids)
        if last is not None:
            yield (*last, sha.hexdigest())

    s = blocks.repartition(n_partitions(ends.sparkSession), *key).sortWithinPartitions(*key, "blk")
    return stream(s, run, "depth long, f0 long, f1 long, f2 long, ends_sha256 string", binary=(5,))


def trie(turns: DataFrame, base: Column, head: Column, max_head: int, conv: str = "conv_id", turn: str = "turn",
         role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the
    subtree), ``saved_tokens`` (over the subtree: (members - 1) * code points of
    the last text), ``ends_sha256`` (of the comma-joined ascending ids that end
    here).  Turns are ordered by ``turn`` (null first), ties by role and text;
    null role and text are empty, rows with a null conversation id are left
    out.  An empty table gives no nodes.  ``base`` and ``head`` are expressions
    of the column ``c``, see ``rebuilt_prefixes``.
    """
    seed = 0
    while True:
        stored = store_turns(turns, seed, conv, turn, role, text)
        rows, ends = rebuilt_prefixes(stored, base, head, max_head)
        f, q, t = ([f"{x}{k}" for k in F3] for x in "fqt")
        key = ["depth", *f]
        nodes = rows.groupBy(*key).agg(
            F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
            *[F.min(c).alias(c) for c in [*q, *t]], *[F.max(c).alias(f"_{c}") for c in [*q, *t]])
        nodes = materialize(nodes, "nodes")
        unlike = F.lit(False)
        for c in [*q, *t]:
            unlike = unlike | (F.col(c) != F.col(f"_{c}"))
        if not _collisions(stored) and not nodes.where(unlike).limit(1).count():
            break
        for x in (stored, rows, ends, nodes):
            discard(x)
        seed += 1
    discard(stored)
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs")).where(F.col("n_convs") > 0)
    nodes = nodes.select(*key, *q, "rep", "n_convs", "chars").unionByName(root.select(
        zero.alias("depth"), *[zero.alias(x) for x in [*f, *q]], "rep", "n_convs", zero.alias("chars")))

    # children per node, parents of the nodes
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(a).alias(b) for a, b in zip(q, f)])
    kids = up.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(kids, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
                        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    total = nodes.count()
    parent = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(a).alias(b) for a, b in zip(f, q)],
                                                  F.col("rep").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > total / HOT
    near = nodes.join(F.broadcast(parent.where(hot).drop("n_children").withColumnRenamed("parent_conv_id", "_hot")),
                      ["depth", *q], "left")
    cold = near.where("_hot is null").drop("_hot").join(parent.where(~hot).drop("n_children"), ["depth", *q], "left")
    linked = near.where("_hot is not null").withColumnRenamed("_hot", "parent_conv_id").unionByName(cold)

    # what a conversation adds to the nodes above the ones it represents: its leaf, and the tokens saved there
    mine = nodes.select(F.col("rep").alias("c"), "depth", "saved", (F.col("n_children") == 0).cast("long").alias("leaf"))
    total_of = mine.groupBy("c").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.min("depth").alias("top"))
    total_of = total_of.where("saved > 0 or leaf > 0").join(ends.select("c", "length"), "c") \
        .select("c", "saved", "leaf", "top", F.explode(F.sequence(zero, (F.col("length") / BLOCK).cast("long"))).alias("_blk"))
    # above its top node a conversation is not the smallest member: all it represents lies below
    above = rows.select("c", "depth", *f).withColumn("_blk", (F.col("depth") / BLOCK).cast("long")) \
        .join(total_of, ["c", "_blk"]).where(F.col("depth") < F.col("top")).groupBy(*key) \
        .agg(F.sum("saved").alias("saved_in"), F.sum("leaf").alias("leaves_in"))
    root_in = total_of.where("_blk = 0 and top > 0").agg(F.sum("saved").alias("saved_in"), F.sum("leaf").alias("leaves_in")) \
        .select(zero.alias("depth"), *[zero.alias(x) for x in f], "saved_in", "leaves_in")
    # a node's own representative: what it represents from here down
    down = running_totals(mine, ["c"], "depth", ["saved", "leaf"], desc=True) \
        .select(F.col("c").alias("rep"), "depth", F.col("cum_saved").alias("_s"), F.col("cum_leaf").alias("_l"))
    out = linked.join(down, ["rep", "depth"]).join(above.unionByName(root_in), key, "left") \
        .join(_digests(ends), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("_l") + F.coalesce("leaves_in", zero)).alias("n_leaves"),
        (F.col("_s") + F.coalesce("saved_in", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
