"""CSV cells as pandas reads them."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.beside import beside
from tessera.operators.metrics import confusion
from tessera.sources.csv import MISSING_WORDS, scan_csv


def test_types_and_missing_words_like_pandas(spark, tmp_path):
    words = [w for w in MISSING_WORDS if w]
    lines = ["Quantity,Price,Flag,Text,Void,Big"]
    for i, w in enumerate(words):
        lines.append(f'{w},1.5e3,True,"line one\nline ""{i}"", two",NA,{10 ** 19 + i}')
        lines.append(f"-{i},{w},False,007x,,7")
    f = tmp_path / "a.csv"
    f.write_text("\n".join(lines) + "\n", encoding="latin-1")
    got = scan_csv(spark, str(f), encoding="latin-1")
    want = pd.read_csv(f, encoding="latin-1")
    assert dict(got.dtypes) == {"Quantity": "bigint", "Price": "double", "Flag": "boolean", "Text": "string",
                                "Void": "double", "Big": "double"}
    rows = got.toPandas()
    assert len(rows) == len(want)
    for c in ("Quantity", "Price", "Text", "Flag"):
        assert [None if pd.isna(v) else v for v in rows[c]] == [None if pd.isna(v) else v for v in want[c]]
    text = scan_csv(spark, str(f), infer_schema=False)
    assert {t for _, t in text.dtypes} == {"string"} and text.where("Quantity is null").count() == len(words)


def test_no_rows(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("a,b\n")
    assert scan_csv(spark, str(f)).count() == 0


def test_beside_serves_any_number_without_a_cross_join(spark):
    few = spark.range(700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = beside(spark.range(5).withColumnRenamed("id", "r"), few, "k", F.col("r"), "all")
    rows = out.select("r", F.explode("all").alias("e")).select("r", "e.k", "e.v").collect()
    assert sorted((r["r"], r["k"], r["v"]) for r in rows) == [(r, k, 2 * k) for r in range(5) for k in range(700)]
    assert beside(spark.range(5).withColumnRenamed("id", "r"), few.limit(0), "k", F.col("r"), "all").count() == 0
    plan = confusion(spark.range(9).select((F.col("id") % 3).alias("label"), (F.col("id") % 2).alias("prediction"))) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
