import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text, lang, source) rows in id order."""
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and
    extra columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    base = "the quick brown fox jumps over a lazy dog while rain falls on the old stone bridge and nobody minds it at all"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "a"),
            (5, " \t\n", None, "b"), (None, base + " today", "en", "b"), (None, None, None, None), (6, long, "de", "b"),
            (7, "word", "de", None), (8, "12345 --- !!!", "fr", "c"), (9, "word", "de", None),
            (10, "naïve café \U0001f600 <|endoftext|> 中文", "fr", "c"), (11, "A" * 5000, "en", "c")]
    extra = {"size": 1, "block": "x", "_text": "y", "shard": 3, "rank": 0, "score": None, "_id": 5, "taken": 1, "copies": 9}
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, block string, " \
             "`_text` string, shard int, rank int, score double, `_id` int, taken int, copies int"
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra.values()) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -1 if i is None else i


__all__ = ["Row", "key"]
