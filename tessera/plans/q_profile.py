"""Profiling, statistics, correlation and distance queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators.correlation import pearson, spearman
from tessera.operators.neighbors import pairwise_distance
from tessera.plans.common import LINEITEM_NULLS_SQL, LINEITEM_NUM, lineitem_nulls, union_sql
from tessera.plans.registry import register
from tessera.sources.tables import load

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                  "c_acctbal": "double", "c_mktsegment": "string"}


def _profile_sql():
    parts = [f"""SELECT '{c}' AS "column", '{t}' AS "type", count({c}) AS non_null,
       count(*) - count({c}) AS "null", round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
       count(DISTINCT {c}) AS "unique" FROM customer""" for c, t in CUSTOMER_TYPES.items()]
    return union_sql(parts)


@register("column_profile", _profile_sql())
def q_column_profile(spark, sf_dir):
    return P.column_profile(load(spark, sf_dir, "customer"))


@register("table_summary", f"""
WITH t AS ({LINEITEM_NULLS_SQL})
SELECT count(*) AS "rows", CAST(10 AS BIGINT) AS "columns", CAST(7 AS BIGINT) AS numeric_columns,
       CAST(sum((l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT) AS BIGINT)
       AS missing_cells
FROM t""")
def q_table_summary(spark, sf_dir):
    return P.table_summary(lineitem_nulls(spark, sf_dir))


def _missing_sql():
    parts = [f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
       round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM t"""
             for c in LINEITEM_NUM]
    return f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + union_sql(parts)


@register("missing_report", _missing_sql())
def q_missing_report(spark, sf_dir):
    return P.missing_report(lineitem_nulls(spark, sf_dir), LINEITEM_NUM)


def _attr_sql(table, spec):
    parts = []
    for c, dtype, kind in spec:
        if kind == "num_int":
            case = f"""CASE WHEN count(DISTINCT {c}) <= 10 THEN '{P.ATTR_ORDINAL}'
                WHEN count(DISTINCT {c}) <= 50 THEN '{P.ATTR_DISCRETE}' ELSE '{P.ATTR_CONTINUOUS}' END"""
        elif kind == "num":
            case = f"""CASE WHEN count(DISTINCT {c}) <= 10 THEN '{P.ATTR_ORDINAL}'
                ELSE '{P.ATTR_CONTINUOUS}' END"""
        elif kind == "ts":
            case = f"'{P.ATTR_INTERVAL}'"
        else:
            case = f"""CASE WHEN count(DISTINCT {c}) <= 2 THEN '{P.ATTR_BINARY}'
                WHEN count(DISTINCT {c}) <= 20 THEN '{P.ATTR_NOMINAL_LOW}' ELSE '{P.ATTR_NOMINAL_HIGH}' END"""
        parts.append(f"""SELECT '{c}' AS "column", '{dtype}' AS data_type,
            count(DISTINCT {c}) AS "unique", {case} AS attribute_type FROM {table}""")
    return union_sql(parts)


LINEITEM_ATTR = [("l_orderkey", "int64", "num_int"), ("l_linenumber", "int32", "num_int"),
                 ("l_quantity", "float64", "num"), ("l_discount", "float64", "num"),
                 ("l_returnflag", "object", "text"), ("l_linestatus", "object", "text"),
                 ("l_shipdate", "datetime64[ns]", "ts")]
PART_ATTR = [("p_partkey", "int64", "num_int"), ("p_name", "object", "text"),
             ("p_brand", "object", "text"), ("p_type", "object", "text"),
             ("p_size", "int32", "num_int"), ("p_retailprice", "float64", "num")]


@register("attribute_types", _attr_sql("lineitem", LINEITEM_ATTR))
def q_attribute_types(spark, sf_dir):
    return P.attribute_types(load(spark, sf_dir, "lineitem"), [c for c, _, _ in LINEITEM_ATTR])


@register("attribute_types_part", _attr_sql("part", PART_ATTR))
def q_attribute_types_part(spark, sf_dir):
    return P.attribute_types(load(spark, sf_dir, "part"), [c for c, _, _ in PART_ATTR])


def _stats_parts(src: str, cols: list[str], digits: int = 4) -> list[str]:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count(x) AS "count",
  round(avg(x), {digits}) AS mean, round(quantile_cont(x, 0.5), {digits}) AS median,
  round((SELECT x FROM (SELECT {c} AS x, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)
         ORDER BY n DESC, x ASC LIMIT 1), {digits}) AS mode,
  round(stddev_samp(x), {digits}) AS std, round(var_samp(x), {digits}) AS variance,
  round(min(x) + 0.0, {digits}) AS "min", round(quantile_cont(x, 0.25), {digits}) AS q1,
  round(quantile_cont(x, 0.75), {digits}) AS q3, round(max(x) + 0.0, {digits}) AS "max",
  round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), {digits}) AS iqr,
  round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), {digits}) AS skewness,
  round(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, {digits}) AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {src}
      WHERE {c} IS NOT NULL)""")
    return parts


@register("describe_stats", f"WITH t AS ({LINEITEM_NULLS_SQL})\n" +
          union_sql(_stats_parts("t", LINEITEM_NUM)))
def q_describe_stats(spark, sf_dir):
    return P.describe_stats(lineitem_nulls(spark, sf_dir), LINEITEM_NUM)


def _describe_all_sql():
    num = ["c_custkey", "c_nationkey", "c_acctbal"]
    txt = ["c_name", "c_mktsegment"]
    parts = []
    for c in num:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}) + 0.0, 4) AS "min",
  round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}) + 0.0, 4) AS "max" FROM customer""")
    for c in txt:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique",
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1)
   ORDER BY n DESC, v LIMIT 1) AS top,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY {c})) AS freq,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS "min",
  CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75,
  CAST(NULL AS DOUBLE) AS "max" FROM customer""")
    return union_sql(parts)


@register("describe_all", _describe_all_sql())
def q_describe_all(spark, sf_dir):
    return P.describe_all(load(spark, sf_dir, "customer"))


HIST_COLS = ["l_extendedprice", "l_quantity"]


def _hist_sql(nbins=40):
    parts = []
    for c in HIST_COLS:
        parts.append(f"""SELECT '{c}' AS "column", CAST(b.i AS INTEGER) AS bin,
  round(r.lo + b.i * (r.hi - r.lo) / {nbins}, 6) AS lo, round(r.lo + (b.i + 1) * (r.hi - r.lo) / {nbins}, 6) AS hi,
  CAST(count(x.v) AS BIGINT) AS "count"
FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) r
CROSS JOIN range(0, {nbins}) b(i)
LEFT JOIN (SELECT CAST(least({nbins - 1}, floor(({c} - (SELECT min({c}) FROM lineitem))
            / (((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) / {nbins}))) AS INTEGER) AS bin,
           {c} AS v FROM lineitem) x ON x.bin = b.i
GROUP BY b.i, r.lo, r.hi""")
    return union_sql(parts)


@register("histogram", _hist_sql())
def q_histogram(spark, sf_dir):
    h = P.histogram(load(spark, sf_dir, "lineitem"), HIST_COLS, 40)
    return h.select("column", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


def _box_sql():
    parts = []
    for c in LINEITEM_NUM:
        parts.append(f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median,
  round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  (SELECT min({c}) + 0.0 FROM t WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
  (SELECT max({c}) + 0.0 FROM t WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  (SELECT count(*) FROM t WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outside
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
             quantile_cont({c}, 0.75) AS q3 FROM t)""")
    return f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + union_sql(parts)


@register("box_stats", _box_sql())
def q_box_stats(spark, sf_dir):
    b = P.box_stats(lineitem_nulls(spark, sf_dir), LINEITEM_NUM)
    return b.select("column", *[F.round(c, 6).alias(c) for c in ["q1", "median", "q3", "iqr"]],
                    "lower_whisker", "upper_whisker", "n_outside")


def _pearson_sql(src, cols, ranked=False):
    parts = []
    for a in cols:
        for b in cols:
            a2 = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            b2 = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(covar_samp({a2}, {b2}) / (stddev_samp({a2}) * stddev_samp({b2})), 6) AS corr FROM {src}""")
    return union_sql(parts)


@register("corr_pearson", f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + _pearson_sql("t", LINEITEM_NUM))
def q_corr_pearson(spark, sf_dir):
    c = pearson(lineitem_nulls(spark, sf_dir), LINEITEM_NUM)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


SPEAR_COLS = ["p_size", "p_retailprice", "p_partkey"]


def _spearman_sql(src, cols):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(covar_samp(ra, rb) / (stddev_samp(ra) * stddev_samp(rb)), 6) AS corr
FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
      FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return union_sql(parts)


@register("corr_spearman", _spearman_sql("part", SPEAR_COLS))
def q_corr_spearman(spark, sf_dir):
    c = spearman(load(spark, sf_dir, "part"), SPEAR_COLS)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@register("corr_spearman_nulls", f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + _spearman_sql("t", LINEITEM_NUM))
def q_corr_spearman_nulls(spark, sf_dir):
    c = spearman(lineitem_nulls(spark, sf_dir), LINEITEM_NUM)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


DIST_COLS = ["c_acctbal", "c_nationkey"]
_DIST_SAMPLE = """(SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x1, CAST(c_nationkey AS DOUBLE) AS x2
  FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL
  ORDER BY ((c_custkey % 2147483647) * 1103515245 + 42) % 2147483648, c_custkey LIMIT 50)"""
_DIST_EXPR = {
    "euclidean": "sqrt(power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2))",
    "cityblock": "abs(a.x1 - b.x1) + abs(a.x2 - b.x2)",
    "chebyshev": "greatest(abs(a.x1 - b.x1), abs(a.x2 - b.x2))",
    "minkowski": "power(power(abs(a.x1 - b.x1), 3) + power(abs(a.x2 - b.x2), 3), 1.0 / 3)",
    "cosine": "1.0 - (a.x1 * b.x1 + a.x2 * b.x2) / (sqrt(a.x1 * a.x1 + a.x2 * a.x2) * sqrt(b.x1 * b.x1 + b.x2 * b.x2))",
}


def _make_dist(metric):
    sql = f"""WITH s AS {_DIST_SAMPLE}
SELECT a.id AS id_a, b.id AS id_b, round({_DIST_EXPR[metric]}, 6) AS dist
FROM s a JOIN s b ON a.id < b.id"""

    @register(f"pairwise_{metric}", sql)
    def q(spark, sf_dir):
        d = pairwise_distance(load(spark, sf_dir, "customer"), "c_custkey", DIST_COLS, metric,
                              n=50, seed=42, p=3.0, sample_method="portable")
        return d.select("id_a", "id_b", F.round("dist", 6).alias("dist"))
    return q


for _m in _DIST_EXPR:
    _make_dist(_m)


KENDALL_COLS = ["c_acctbal", "c_nationkey", "c_custkey"]


def _kendall_sql():
    parts = []
    for a in KENDALL_COLS:
        for b in KENDALL_COLS:
            if a == b:
                parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  CASE WHEN count(DISTINCT {a}) > 1 THEN 1.0 END AS corr FROM customer""")
            else:
                parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}))
        / sqrt(count(*) FILTER (WHERE p.{a} <> q.{a}) * count(*) FILTER (WHERE p.{b} <> q.{b})), 6) AS corr
FROM customer p JOIN customer q ON p.c_custkey < q.c_custkey""")
    return union_sql(parts)


@register("corr_kendall", _kendall_sql())
def q_corr_kendall(spark, sf_dir):
    from tessera.operators.kendall import kendall
    c = kendall(load(spark, sf_dir, "customer"), KENDALL_COLS)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


# ---- previews, sampling, unpivot, compact describe
from tessera.operators import core as CORE  # noqa: E402


@register("head_rows", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_orderkey, l_linenumber LIMIT 20""")
def q_head_rows(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return CORE.head(li, 20, ["l_orderkey", "l_linenumber"])


@register("tail_rows", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 20""")
def q_tail_rows(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return CORE.tail(li, 20, ["l_orderkey", "l_linenumber"])


@register("sample_n", """
SELECT c_custkey, c_acctbal FROM customer
ORDER BY ((c_custkey % 2147483647) * 1103515245 + 7) % 2147483648, c_custkey LIMIT 100""")
def q_sample_n(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return CORE.sample_n(c, 100, 7, "c_custkey", method="portable")


@register("melt", f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + union_sql([
    f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM t"
    for c in LINEITEM_NUM]))
def q_melt(spark, sf_dir):
    return CORE.melt(lineitem_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", *LINEITEM_NUM),
                     ["l_orderkey", "l_linenumber"], LINEITEM_NUM)


def _describe_numeric_sql():
    parts = []
    for c in LINEITEM_NUM:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}) + 0.0, 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(max({c}) + 0.0, 6) AS "max" FROM t""")
    return f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + union_sql(parts)


@register("describe_numeric", _describe_numeric_sql())
def q_describe_numeric(spark, sf_dir):
    return P.describe_numeric(lineitem_nulls(spark, sf_dir), LINEITEM_NUM, digits=6)


def _box_by_sql():
    parts = []
    for c in ["l_extendedprice", "l_quantity"]:
        parts.append(f"""SELECT f AS l_returnflag, '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median,
  round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  (SELECT min({c}) + 0.0 FROM t WHERE l_returnflag = f AND {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
  (SELECT max({c}) + 0.0 FROM t WHERE l_returnflag = f AND {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  (SELECT count(*) FROM t WHERE l_returnflag = f AND {c} IS NOT NULL
     AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS n_outside
FROM (SELECT l_returnflag AS f, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
             quantile_cont({c}, 0.75) AS q3 FROM t GROUP BY l_returnflag)""")
    return f"WITH t AS ({LINEITEM_NULLS_SQL})\n" + union_sql(parts)


@register("box_stats_by_flag", _box_by_sql())
def q_box_stats_by_flag(spark, sf_dir):
    b = P.box_stats(lineitem_nulls(spark, sf_dir), ["l_extendedprice", "l_quantity"], by="l_returnflag")
    return b.select("l_returnflag", "column", *[F.round(c, 6).alias(c) for c in ["q1", "median", "q3", "iqr"]],
                    "lower_whisker", "upper_whisker", "n_outside")


_EVENT_SECONDS = "epoch_us(ts) / 1e6"


def _describe_events_sql():
    parts = []
    for c, e in [("event_id", "event_id"), ("user_id", "user_id"), ("value", "value"), ("ts", _EVENT_SECONDS)]:
        parts.append(f"""SELECT '{c}' AS "column", count({e}) AS "count", CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({e}), 3) AS mean,
  round(stddev_samp({e}), 3) AS std, round(min({e}) + 0.0, 3) AS "min",
  round(quantile_cont({e}, 0.25), 3) AS p25, round(quantile_cont({e}, 0.5), 3) AS p50,
  round(quantile_cont({e}, 0.75), 3) AS p75, round(max({e}) + 0.0, 3) AS "max" FROM events""")
    for c in ["event_type", "props"]:
        parts.append(f"""SELECT '{c}', count({c}), count(DISTINCT {c}),
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1),
  (SELECT max(n) FROM (SELECT count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY {c})),
  NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events""")
    return union_sql(parts)


@register("describe_all_events", _describe_events_sql())
def q_describe_all_events(spark, sf_dir):
    """A table with a timestamp column."""
    return P.describe_all(load(spark, sf_dir, "events"), digits=3)


@register("corr_pearson_nan", """
SELECT 'l_quantity' AS col_a, 'l_tax' AS col_b, round(corr(q, t), 6) AS corr FROM (
  SELECT CASE WHEN l_linenumber <> 7 THEN l_quantity END AS q, l_tax AS t FROM lineitem)""")
def q_corr_pearson_nan(spark, sf_dir):
    """NaN planted in one column counts as missing."""
    from tessera.operators.correlation import pearson
    li = load(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_tax")
    r = pearson(li, ["l_quantity", "l_tax"]).where("col_a = 'l_quantity' and col_b = 'l_tax'")
    return r.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@register("missing_only", f"""WITH t AS ({LINEITEM_NULLS_SQL})
SELECT c AS "column", n AS missing, round(n * 100.0 / (SELECT count(*) FROM t), 2) AS missing_pct FROM (
  SELECT 'l_quantity' AS c, count(*) FILTER (WHERE l_quantity IS NULL) AS n FROM t
  UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE l_discount IS NULL) FROM t
  UNION ALL SELECT 'l_tax', count(*) FILTER (WHERE l_tax IS NULL) FROM t) WHERE n > 0""")
def q_missing_only(spark, sf_dir):
    from tessera.operators.core import missing_only
    return missing_only(P.missing_report(lineitem_nulls(spark, sf_dir)))


@register("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_csv_roundtrip(spark, sf_dir):
    """A table written as CSV into the shared folder and read back."""
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.csv import scan_csv, write_csv
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    o = load(spark, sf_dir, "orders").select(*cols)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-csv-{uuid.uuid4().hex}"
    write_csv(o, path)
    return scan_csv(spark, path, encoding="latin-1", schema=o.schema)


_CSV_CELLS = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 2 = 0 AS even,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL
            WHEN o_orderkey % 3 = 1 THEN 'says "' || o_orderpriority || '",' || chr(10) || 'then more' ELSE o_orderstatus END AS note
FROM orders"""


@register("csv_infer", _CSV_CELLS)
def q_csv_infer(spark, sf_dir):
    """A CSV file with missing-value words, quotes and line breaks, its types inferred."""
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.csv import scan_csv, write_csv
    k = F.col("o_orderkey")
    note = F.concat(F.lit('says "'), "o_orderpriority", F.lit('",\nthen more'))
    cells = load(spark, sf_dir, "orders").select(
        k.alias("key"), F.when(k % 7 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, "nan").otherwise("#N/A")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("even"),
        F.when(k % 3 == 0, "N/A").when(k % 3 == 1, note).otherwise(F.col("o_orderstatus")).alias("note"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-csv-{uuid.uuid4().hex}"
    write_csv(cells, path)
    return scan_csv(spark, path)


_DEFAULT3 = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("corr_default", union_sql([f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM customer"""
                                     for a in _DEFAULT3 for b in _DEFAULT3]))
def q_corr_default(spark, sf_dir):
    """Correlations of the columns chosen by default."""
    from tessera.operators.core import default_features
    c = load(spark, sf_dir, "customer")
    r = pearson(c, default_features(c, 3))
    return r.select("col_a", "col_b", F.round("corr", 6).alias("corr"))
