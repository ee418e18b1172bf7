"""The registered ``opN_<name>`` queries: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.registry import REGISTRY, register  # noqa: F401


@register("op1_mix_sources")
def op1(spark, sf_dir):
    from tessera.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


#: The layout that op7 starts from: 12 shards by source, very unequal.
OLD_SHARDS = 12


@register("op7_reshard")
def op7(spark, sf_dir):
    from tessera.llm.reshard import reshard_files
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    r = reshard_files(docs, old, OLD_SHARDS, 8)
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@register("op5_language_id")
def op5(spark, sf_dir):
    from tessera.llm.common import doc_crc
    from tessera.llm.langid import learn_profiles, predict
    docs = table(spark, sf_dir, "documents")
    held_out = doc_crc() % 4 == 2
    return predict(docs, learn_profiles(docs.where(~held_out)), [F.col("doc_id"), held_out.alias("held_out")])


@register("op10_quality")
def op10(spark, sf_dir):
    from tessera.llm.common import doc_crc
    from tessera.llm.quality import fit, score
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = doc_crc() % 5 == 0
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@register("op9_fingerprint")
def op9(spark, sf_dir):
    from tessera.llm.sketch import compare_neighbours
    return compare_neighbours(table(spark, sf_dir, "documents"))


def tokenizer() -> dict:
    """Where the public byte-level BPE file lies, and its pre-token pattern."""
    import public_tokenizers
    return {"tokenizer_path": str(public_tokenizers.path("byte_bpe_50k.json")), "pattern": public_tokenizers.PATTERN}


@register("op3_pack")
def op3(spark, sf_dir):
    from tessera.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), **tokenizer(), capacity=2048)


@register("op4_nearest")
def op4(spark, sf_dir):
    from tessera.llm.ann import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op2_simhash")
def op2(spark, sf_dir):
    from tessera.llm.simhash import components
    return components(table(spark, sf_dir, "documents"), size=4, max_bits=4)


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)
), again AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i FROM again, (SELECT unnest(range(20)) AS k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", OP8_SQL)
def op8(spark, sf_dir):
    from tessera.llm.substring import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents"), [F.col("doc_id")])


@register("op6_ngram_score")
def op6(spark, sf_dir):
    from tessera.llm.common import doc_crc
    from tessera.llm.ngram_lm import score
    held_out = doc_crc() % 10 == 0
    return score(table(spark, sf_dir, "documents"), ~held_out, [F.col("doc_id"), held_out.alias("held_out")], order=3)


#: crc32 in DuckDB: the table of the 256 byte steps, and the crc of a list of bytes.
CRC_SQL = """crc_table AS (
  SELECT list(step ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda z: z::BIGINT),
                          lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS step
    FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text of ASCII and Latin-1 letters (needs ``crc_table`` in FROM)."""
    return f"""xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({text}, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)),
        lambda a, z: xor(a >> 8, steps[xor(a & 255, z) + 1])), 4294967295)"""


OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.a || c.b
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs
), forms AS (
  SELECT w.word, CASE WHEN near_n >= 5 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


@register("op11_spelling_variants", OP11_SQL)
def op11(spark, sf_dir):
    from tessera.llm.spelling import group_variants, word_counts
    return group_variants(word_counts(table(spark, sf_dir, "documents"), delete_one_in=199))


OP12_SQL = f"""
WITH {CRC_SQL}, stored AS (
  SELECT conv_id, list(turn_key ORDER BY turn NULLS FIRST, role, text) AS turns FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn_key
    FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, (conv_id - conv_id % 100) AS base, ({crc_sql("conv_id::VARCHAR")} % 6)::INT AS h FROM stored, crc_table
), rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || coalesce(a.turns[a.h + 1:], []) AS seq
  FROM heads a LEFT JOIN stored b ON b.conv_id = a.base
), prefixes AS (
  SELECT conv_id, d, seq[1:d] AS node, d = len(seq) AS is_end
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(node[d].text) END AS saved
  FROM prefixes GROUP BY node, d
), kids AS (
  SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), linked AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
), sums AS (
  SELECT node[1:up] AS node, up AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM linked) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN sums s ON s.node = n.node AND s.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""


@register("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    from tessera.llm.prefix_trie import trie
    c = F.col("c")
    return trie(table(spark, sf_dir, "conversations"), base=c - c % 100,
                head=F.crc32(c.cast("string").cast("binary")) % 6, max_head=5)


@register("op13_toxicity")
def op13(spark, sf_dir):
    from tessera.llm.common import doc_crc
    from tessera.llm.toxicity import fit, score
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = doc_crc() % 4 == 2
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
