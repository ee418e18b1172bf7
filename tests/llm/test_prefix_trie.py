import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import prefix_trie


def by_hand(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [x[2:] for x in sorted(v)] for c, v in stored.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(stored):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(stored.get(c - c % 100, [])[:h] + stored[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * len(s[-1][1]) if s else 0
    return sorted((members[s][0], len(s), members[s[:-1]][0] if s else -1, len(members[s]), kids[s], leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()) for s in members)


def run(turns):
    c = F.col("c")
    nodes = prefix_trie.trie(turns, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.collect())


SCHEMA = "conv_id long, turn long, role string, text string, depth int, c int, pos string, p0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert run(turns) == by_hand(rows)


def test_long_copied_and_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    rows = []
    for c in (0, 1, 2, 7, 700, 701, 733):  # long ones, equal but for their ends
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t}") for t in range(700 - c % 7)]
    for c in range(100, 160):
        rows += [(c, 0, "system", "same"), (c, 1, "user", f"q{c % 3}"), (c, 2, None, None if c % 2 else "")]
    rows += [(300 + c, None, None, None) for c in range(9)]  # turnless once the head is cut
    rows += [(450, 1, "a", "no base"), (450, None, "b", "null first"), (450, 1, "a", "no base"), (451, 3, "a", "x" * 30_000)]
    rows += [(None, 0, "a", "left out"), (990, 0, "", "ab"), (991, 0, "a", "b"), (992, 0, "a", "b"), (992, 0, "a", "b")]
    assert run(frame(spark, rows)) == by_hand(rows)


def test_collisions_are_noticed_and_mended(spark, monkeypatch):
    real = prefix_trie.store_turns
    seeds = []

    def weak(turns, seed, *names):
        seeds.append(seed)
        out = real(turns, seed, *names)
        if seed:
            return out
        for k in range(3):  # every turn hashes to the same value
            out = out.withColumn(f"t{k}", F.lit(5).cast("long")).withColumn(f"p{k}", F.col("pos"))
        return out

    monkeypatch.setattr(prefix_trie, "store_turns", weak)
    rows = [(c, t, "r", f"{c % 3} {t}") for c in range(6) for t in range(4)]
    assert run(frame(spark, rows)) == by_hand(rows)
    assert seeds == [0, 1]


def test_empty(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(None, 1, "a", "b")])) == []
