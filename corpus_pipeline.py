"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept and returns the columns of ``documents``; the last returns the
pieces of the packed sequences.  Other columns of ``docs`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, mixing, packing, quality, simhash, substring
from tessera.llm.queries import tokenizer
from tessera.session import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Factorisation machine: documents scoring under 0.3 go."""
    labels = common.table(spark, sf_dir, "labels").where(common.doc_crc() % 5 != 0)
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep_good(docs.select(*COLUMNS), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: one document of each component stays."""
    return simhash.keep_first(docs.select(*COLUMNS), size=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 20-word windows that start earlier go; a document that loses
    all of its words goes too."""
    rest = [F.col(c) for c in COLUMNS if c != "text"]
    out = substring.dedup_substrings(docs, rest, with_text=True)
    out = out.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.withColumn("n_chars", F.length("kept").cast("long")).withColumnRenamed("kept", "text").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entropy balancing: as many rows of a document as copies of it."""
    mixed = mixing.mix(docs, carry=COLUMNS).where(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cutting-stock packing into sequences of 2048 tokens."""
    return packing.pack(docs, **tokenizer(), capacity=2048)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Trained, iterated and tokenised stages have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), "stage")
        discard(written)
        docs = written = new
    return STAGES[-1][1](spark, docs, sf_dir)
