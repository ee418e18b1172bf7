from tessera.streaming import write_clean


def test_clean_stream_append(spark, tmp_path):
    rows = [("1", 2.0, 1.5, 10.0, "2020-01-01 10:00:00"), ("C2", 1.0, 1.0, 11.0, "2020-01-02 10:00:00"),
            ("3", 0.0, 1.0, 12.0, "2020-01-03 10:00:00"), ("4", 1.0, 2.0, None, "2020-01-04 10:00:00")]
    schema = "InvoiceNo string, Quantity double, UnitPrice double, CustomerID double, InvoiceDate string"
    src = tmp_path / "in"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = write_clean(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["InvoiceNo"], r["CustomerID"], r["TotalPrice"]) for r in out] == [("1", "10", 3.0)]
