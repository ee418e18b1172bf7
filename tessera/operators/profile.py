"""Table and column profiling: summary, profile, missing values, attribute
types, descriptive statistics, histograms and box statistics (A-01..A-12,
A-21, A-22, F-01).

Everything that can be computed in one aggregation pass is; per-column
statistics run on a long ``(column, value)`` form so one ``groupBy`` serves
any number of columns with map-side partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric_cols, stack_long
from tessera.functions.mode import modes
from tessera.functions.quantile import grouped_quantiles, quantile_table, quantiles
from tessera.session import materialize

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
        T.DecimalType)
_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Pandas dtype names reported for Spark types.
PANDAS_DTYPE = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float32", "double": "float64", "boolean": "bool", "string": "object",
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "object",
}

# Attribute-type labels.
ATTR_ORDINAL = "Ordinal (Numeric, ≤10 unique)"
ATTR_DISCRETE = "Discrete / Ratio"
ATTR_CONTINUOUS = "Continuous / Ratio"
ATTR_INTERVAL = "Interval (Datetime)"
ATTR_BINARY = "Binary / Nominal"
ATTR_NOMINAL_LOW = "Nominal (Low Cardinality)"
ATTR_NOMINAL_HIGH = "Nominal (High Cardinality)"


def table_summary(df: DataFrame) -> DataFrame:
    """rows, columns, numeric columns, missing cells — one pass."""
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing_cells")) \
        .select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
                F.lit(len(numeric_cols(df))).cast("bigint").alias("numeric_columns"),
                "missing_cells")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, non-null, null, null % (2 dp), distinct non-null values.

    One aggregation.  Exact distinct counts expand each row once per column
    before the shuffle; ``approx=True`` uses HyperLogLog++ instead (no expand,
    ~1% error) for very wide tables.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"_nn{i}"), distinct(F.col(f"`{c}`")).alias(f"_u{i}")]
    wide = df.agg(*aggs)
    parts = []
    for i, f in enumerate(df.schema.fields):
        parts.append(F.struct(F.lit(f.name).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("type"),
                              F.col(f"_nn{i}").alias("non_null"),
                              (F.col("_rows") - F.col(f"_nn{i}")).alias("null"),
                              F.round(F.try_divide((F.col("_rows") - F.col(f"_nn{i}")) * 100.0,
                                                   F.col("_rows")), 2).alias("null_pct"),
                              F.col(f"_u{i}").cast("bigint").alias("unique")))
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing count and % (2 dp) per column, one pass."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").cast("bigint").alias("missing"),
                      F.round(F.try_divide(F.col(f"_m{i}") * 100.0, F.col("_rows")), 2)
                      .alias("missing_pct")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def attribute_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Six-way attribute type from the column type and its distinct count."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"_u{i}") for i, c in enumerate(cols)])
    parts = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        u = F.col(f"_u{i}")
        if isinstance(dt, _NUM) or isinstance(dt, T.BooleanType):
            kind = F.when(u <= 10, ATTR_ORDINAL)
            kind = kind.when(u <= 50, ATTR_DISCRETE) if isinstance(dt, _INT) else kind
            kind = kind.otherwise(ATTR_CONTINUOUS)
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            kind = F.lit(ATTR_INTERVAL)
        else:
            kind = F.when(u <= 2, ATTR_BINARY).when(u <= 20, ATTR_NOMINAL_LOW) \
                .otherwise(ATTR_NOMINAL_HIGH)
        parts.append(F.struct(F.lit(c).alias("column"),
                              F.lit(PANDAS_DTYPE.get(dt.simpleString(), dt.simpleString()))
                              .alias("data_type"),
                              u.cast("bigint").alias("unique"), kind.alias("attribute_type")))
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


STAT_NAMES = ["count", "mean", "median", "mode", "std", "variance", "min", "q1", "q3", "max",
              "iqr", "skewness", "kurtosis"]


def describe_stats(df: DataFrame, cols: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """One row per numeric column: count, mean, median, mode, std, variance,
    min, Q1, Q3, max, IQR, skewness (biased), excess kurtosis (biased).

    Moments: one ``groupBy(column)`` over the long form.  Quantiles: exact,
    linearly interpolated (:func:`quantiles`).  Mode: smallest most-frequent
    value.  NaN counts as missing.
    """
    cols = cols or numeric_cols(df)
    spark = df.sparkSession
    long = stack_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    mom = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    qres = quantiles(long, ["column"], [0.25, 0.5, 0.75])
    qt = quantile_table(spark, qres, ["column"], [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    md = modes(long, ["column"]).select("column", "mode")
    # qt / md hold one row per selected column: broadcast-sized by construction
    out = mom.join(F.broadcast(qt), "column", "left").join(md, "column", "left") \
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    r = (lambda c: F.round(F.col(c), digits)) if digits is not None else F.col
    return out.select("column", "count", *[r(c).alias(c) for c in STAT_NAMES[1:]])


def describe_numeric(df: DataFrame, cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 %, max per column (3 dp)."""
    s = describe_stats(df, cols, digits=None)
    return s.select("column", "count", *[F.round(c, digits).alias(a) for c, a in
                    [("mean", "mean"), ("std", "std"), ("min", "min"), ("q1", "p25"),
                     ("median", "p50"), ("q3", "p75"), ("max", "max")]])


def _seconds(f: T.StructField):
    """A date or timestamp as seconds since 1970-01-01 (wall clock for dates
    and timestamps without a zone)."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(c) * 86400.0
    if isinstance(f.dataType, T.TimestampType):
        return F.unix_micros(c) / 1e6
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) / 1e6


def describe_all(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every column: count; numeric columns mean / std / min / quartiles / max;
    dates and timestamps the same in seconds since 1970; all other columns
    (text, boolean, nested as JSON) unique / top / freq."""
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    is_time = [f.name for f in df.schema.fields if isinstance(f.dataType, times)]
    num = [f.name for f in df.schema.fields if f.name in numeric_cols(df) or f.name in is_time]
    txt = [f.name for f in df.schema.fields if f.name not in num]
    nested = (T.ArrayType, T.MapType, T.StructType)
    df = df.select(*[_seconds(f).alias(f.name) if f.name in is_time
                     else F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested)
                     else F.col(f"`{f.name}`").cast("string").alias(f.name) if f.name in txt
                     else F.col(f"`{f.name}`") for f in df.schema.fields])
    pieces = []
    schema_cols = ["column", "count", "unique", "top", "freq", "mean", "std", "min", "p25",
                   "p50", "p75", "max"]
    if num:
        s = describe_stats(df, num, digits=digits)
        pieces.append(s.select("column", "count", F.lit(None).cast("bigint").alias("unique"),
                               F.lit(None).cast("string").alias("top"),
                               F.lit(None).cast("bigint").alias("freq"), "mean", "std", "min",
                               F.col("q1").alias("p25"), F.col("median").alias("p50"),
                               F.col("q3").alias("p75"), "max"))
    if txt:
        long = df.select(*[F.col(c).cast("string") for c in txt]).unpivot([], txt, "column", "value") \
            .where(F.col("value").isNotNull())
        cnt = long.groupBy("column").agg(F.count("value").alias("count"),
                                         F.count_distinct("value").alias("unique"))
        top = modes(long, ["column"]).select("column", F.col("mode").alias("top"),
                                             F.col("mode_count").alias("freq"))
        t = cnt.join(top, "column", "left")
        pieces.append(t.select("column", "count", F.col("unique").cast("bigint"), "top",
                               F.col("freq").cast("bigint"),
                               *[F.lit(None).cast("double").alias(c) for c in schema_cols[5:]]))
    if not pieces:
        raise ValueError("a table without columns cannot be described")
    return reduce(DataFrame.unionByName, pieces)


def histogram(df: DataFrame, cols: list[str], nbins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max] per column, empty bins included.

    Output ``(column, bin, lo, hi, count)``; the maximum falls in the last
    bin.  Ranges come from one aggregate; counts from one partial-aggregated
    ``groupBy`` of (column, bin) — at most columns x nbins rows shuffled.
    """
    spark = df.sparkSession
    number = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    rng = df.agg(*[F.min(v).alias(f"_lo{i}") for i, v in enumerate(number)],
                 *[F.max(v).alias(f"_hi{i}") for i, v in enumerate(number)]).first()
    edges = {c: (rng[f"_lo{i}"], rng[f"_hi{i}"]) for i, c in enumerate(cols)}
    long = stack_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    lo = F.lit(None).cast("double")
    width = F.lit(None).cast("double")
    for c, (a, b) in edges.items():
        if a is None:
            continue
        lo = F.when(F.col("column") == c, F.lit(a)).otherwise(lo)
        width = F.when(F.col("column") == c, F.lit((b - a) / nbins)).otherwise(width)
    bin_ = F.least(F.lit(nbins - 1), F.coalesce(
        F.floor(F.try_divide(F.col("value") - lo, width)), F.lit(0)).cast("int"))
    counts = long.select("column", bin_.alias("bin")).groupBy("column", "bin") \
        .agg(F.count(F.lit(1)).alias("count"))
    grid_rows = [(c, i, a + i * (b - a) / nbins, a + (i + 1) * (b - a) / nbins)
                 for c, (a, b) in edges.items() if a is not None for i in range(nbins)]
    grid = spark.createDataFrame(grid_rows, "column string, bin int, lo double, hi double")
    return grid.join(counts, ["column", "bin"], "left") \
        .select("column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def box_stats(df: DataFrame, cols: list[str], by: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per column (and per ``by`` value): quartiles, IQR,
    whiskers (furthest values inside the 1.5·IQR fences), points outside."""
    keys = [by] if by else []
    long = stack_long(df, cols, keys=keys).where(F.col("value").isNotNull() & ~F.isnan("value"))
    kcols = keys + ["column"]
    qt = materialize(grouped_quantiles(long, kcols, [0.25, 0.5, 0.75], ["q1", "median", "q3"]), "box")
    qt = qt.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("_lf", F.col("q1") - whisker * F.col("iqr")) \
        .withColumn("_uf", F.col("q3") + whisker * F.col("iqr"))
    j = long.join(qt.select(*kcols, "_lf", "_uf"), kcols)
    inside = (F.col("value") >= F.col("_lf")) & (F.col("value") <= F.col("_uf"))
    w = j.groupBy(*kcols).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outside"))
    return qt.drop("_lf", "_uf").join(w, kcols, "left")
