"""Basket and association-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.registry import register
from tessera.sources.tables import RETAIL_SQL, load, retail_view


def type_rows(spark, sf_dir):
    """(order, part type) rows: 6 item values, dense baskets."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "p_type")


TYPE_ROWS_SQL = "SELECT l_orderkey AS t, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey"
BRAND_ROWS_SQL = f"SELECT InvoiceNo AS t, trim(Description) AS i FROM ({RETAIL_SQL}) WHERE Description IS NOT NULL AND trim(Description) <> ''"


@register("top_items", f"""
SELECT Description, count(*) AS "count" FROM ({RETAIL_SQL}) WHERE Description IS NOT NULL
GROUP BY Description ORDER BY "count" DESC, Description LIMIT 200""")
def q_top_items(spark, sf_dir):
    r = R.clean_items(retail_view(spark, sf_dir), "InvoiceNo", "Description")
    return R.top_items(r, "Description", 200)


@register("keep_top_items", f"""
WITH r AS ({BRAND_ROWS_SQL}),
top AS (SELECT i FROM r GROUP BY i ORDER BY count(*) DESC, i LIMIT 10)
SELECT t AS InvoiceNo, i AS Description FROM r WHERE i IN (SELECT i FROM top)""")
def q_keep_top_items(spark, sf_dir):
    r = R.clean_items(retail_view(spark, sf_dir), "InvoiceNo", "Description")
    return R.keep_top_items(r, "Description", 10)


_PADDED = """CASE WHEN l_linenumber = 5 THEN '   ' WHEN l_linenumber = 3 THEN '  ' || p_brand || ' '
                  WHEN l_linenumber = 7 THEN NULL ELSE p_brand END"""


@register("clean_items", f"""
SELECT l_orderkey AS t, trim(i) AS i FROM (
  SELECT l_orderkey, {_PADDED} AS i FROM lineitem JOIN part ON l_partkey = p_partkey)
WHERE i IS NOT NULL AND trim(i) <> ''""")
def q_clean_items(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("t"), F.expr(_PADDED).alias("i"))
    return R.clean_items(rows, "t", "i")


@register("baskets", f"""
SELECT t AS InvoiceNo, string_agg(i, ', ' ORDER BY i) AS items
FROM (SELECT DISTINCT t, i FROM ({BRAND_ROWS_SQL})) GROUP BY t""")
def q_baskets(spark, sf_dir):
    b = R.build_baskets(retail_view(spark, sf_dir), "InvoiceNo", "Description")
    return b.select("InvoiceNo", F.array_join("items", ", ").alias("items"))


@register("basket_stats", f"""
WITH bi AS (SELECT DISTINCT t, i FROM ({BRAND_ROWS_SQL}))
SELECT count(DISTINCT t) AS transactions, count(DISTINCT i) AS unique_items,
       round(count(*) * 100.0 / (count(DISTINCT t) * count(DISTINCT i)), 6) AS density_pct FROM bi""")
def q_basket_stats(spark, sf_dir):
    b = R.build_baskets(retail_view(spark, sf_dir), "InvoiceNo", "Description")
    return R.basket_stats(b).select("transactions", "unique_items",
                                    F.round("density_pct", 6).alias("density_pct"))


def _itemsets_cte(rows_sql: str, s: float) -> str:
    """Frequent itemsets up to length 3 by self-joins (the oracle's method)."""
    return f"""
bi AS (SELECT DISTINCT t, i FROM ({rows_sql})),
n AS (SELECT count(DISTINCT t) AS n FROM bi),
l1 AS (SELECT i AS a, count(*) AS c FROM bi GROUP BY 1),
l2 AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM bi x JOIN bi y ON x.t = y.t AND x.i < y.i GROUP BY 1, 2),
l3 AS (SELECT x.i AS a, y.i AS b, z.i AS d, count(*) AS c FROM bi x JOIN bi y ON x.t = y.t AND x.i < y.i
       JOIN bi z ON z.t = x.t AND y.i < z.i GROUP BY 1, 2, 3),
fi AS (SELECT a AS items, c * 1.0 / n AS support, 1 AS length FROM l1, n WHERE c * 1.0 / n >= {s}
       UNION ALL SELECT a || ', ' || b, c * 1.0 / n, 2 FROM l2, n WHERE c * 1.0 / n >= {s}
       UNION ALL SELECT a || ', ' || b || ', ' || d, c * 1.0 / n, 3 FROM l3, n WHERE c * 1.0 / n >= {s})"""


def _itemsets_sql(rows_sql, s):
    return f"WITH {_itemsets_cte(rows_sql, s)}\nSELECT items, round(support, 6) AS support, length FROM fi"


def _rules_sql(rows_sql, s, conf, lift):
    # antecedent / consequent split patterns for itemsets of length 2 and 3
    splits = """
sp AS (
  SELECT a AS ant, b AS con, c, 2 AS k FROM l2 UNION ALL SELECT b, a, c, 2 FROM l2
  UNION ALL SELECT a, b || ', ' || d, c, 3 FROM l3 UNION ALL SELECT b, a || ', ' || d, c, 3 FROM l3
  UNION ALL SELECT d, a || ', ' || b, c, 3 FROM l3 UNION ALL SELECT a || ', ' || b, d, c, 3 FROM l3
  UNION ALL SELECT a || ', ' || d, b, c, 3 FROM l3 UNION ALL SELECT b || ', ' || d, a, c, 3 FROM l3),
r AS (SELECT sp.ant, sp.con, fa.support AS antecedent_support, fc.support AS consequent_support,
             sp.c * 1.0 / n.n AS support
      FROM sp, n, fi fa, fi fc
      WHERE fa.items = sp.ant AND fc.items = sp.con AND sp.c * 1.0 / n.n >= """ + str(s) + ")"
    return f"""WITH {_itemsets_cte(rows_sql, s)}, {splits}
SELECT ant AS antecedents, con AS consequents, round(antecedent_support, 6) AS antecedent_support,
       round(consequent_support, 6) AS consequent_support, round(support, 6) AS support,
       round(support / antecedent_support, 6) AS confidence,
       round(support / (antecedent_support * consequent_support), 6) AS lift,
       round(support - antecedent_support * consequent_support, 6) AS leverage,
       CASE WHEN support / antecedent_support >= 1 THEN 'inf'::DOUBLE
            ELSE round((1 - consequent_support) / (1 - support / antecedent_support), 6) END AS conviction
FROM r WHERE support / antecedent_support >= {conf} AND support / (antecedent_support * consequent_support) >= {lift}"""


def _round_rules(r):
    num = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
           "conviction"]
    return R.as_text(r, ["antecedents", "consequents"]).select(
        "antecedents", "consequents", *[F.round(c, 6).alias(c) for c in num])


def type_itemsets(spark, sf_dir):
    b = R.build_baskets(type_rows(spark, sf_dir), "l_orderkey", "p_type")
    return R.frequent_itemsets(b, 0.02, 3)


def brand_itemsets(spark, sf_dir):
    b = R.build_baskets(retail_view(spark, sf_dir), "InvoiceNo", "Description")
    return R.frequent_itemsets(b, 0.02, 3)


@register("itemsets_type", _itemsets_sql(TYPE_ROWS_SQL, 0.02))
def q_itemsets_type(spark, sf_dir):
    fi = type_itemsets(spark, sf_dir)
    return R.as_text(fi, ["items"]).select("items", F.round("support", 6).alias("support"), "length")


@register("itemsets_brand", _itemsets_sql(BRAND_ROWS_SQL, 0.02))
def q_itemsets_brand(spark, sf_dir):
    fi = brand_itemsets(spark, sf_dir)
    return R.as_text(fi, ["items"]).select("items", F.round("support", 6).alias("support"), "length")


@register("itemsets_by_length", f"WITH {_itemsets_cte(TYPE_ROWS_SQL, 0.02)}\n"
          "SELECT length, count(*) AS \"count\" FROM fi GROUP BY length")
def q_itemsets_by_length(spark, sf_dir):
    return R.itemsets_by_length(type_itemsets(spark, sf_dir))


@register("top_itemsets", f"WITH {_itemsets_cte(TYPE_ROWS_SQL, 0.02)}\n"
          "SELECT items, round(support, 6) AS support, length FROM fi ORDER BY support DESC, items LIMIT 50")
def q_top_itemsets(spark, sf_dir):
    t = R.top_itemsets(type_itemsets(spark, sf_dir), 50)
    return R.as_text(t, ["items"]).select("items", F.round("support", 6).alias("support"), "length")


@register("rules_type", _rules_sql(TYPE_ROWS_SQL, 0.02, 0.3, 1.0))
def q_rules_type(spark, sf_dir):
    r = R.filter_rules(R.association_rules(type_itemsets(spark, sf_dir), 0.3), 1.0)
    return _round_rules(r)


@register("rules_brand", _rules_sql(BRAND_ROWS_SQL, 0.02, 0.1, 0.5))
def q_rules_brand(spark, sf_dir):
    r = R.filter_rules(R.association_rules(brand_itemsets(spark, sf_dir), 0.1), 0.5)
    return _round_rules(r)


@register("top_rules", f"SELECT * FROM ({_rules_sql(TYPE_ROWS_SQL, 0.02, 0.1, 0.0)}) "
          "ORDER BY lift DESC, antecedents, consequents LIMIT 15")
def q_top_rules(spark, sf_dir):
    r = R.association_rules(type_itemsets(spark, sf_dir), 0.1)
    return _round_rules(R.top_rules(r, "lift", 15))


_KEYS_SQL = _rules_sql(TYPE_ROWS_SQL, 0.02, 0.1, 0.0)


@register("top_rules_by_key", "\nUNION ALL\n".join(
    f"""SELECT '{k}' AS sorted_by, antecedents, consequents, round({k}, 4) AS value FROM (
SELECT * FROM ({_KEYS_SQL}) ORDER BY round({k}, 4) DESC, antecedents, consequents LIMIT 15)""" for k in R.SORT_KEYS))
def q_top_rules_by_key(spark, sf_dir):
    """The best rules by each of the five keys (values rounded before the sort,
    so that both engines break the same ties)."""
    from functools import reduce
    r = _round_rules(R.association_rules(type_itemsets(spark, sf_dir), 0.1))
    arrays = r.select(F.split("antecedents", ", ").alias("antecedents"), F.split("consequents", ", ").alias("consequents"),
                      *[F.round(k, 4).alias(k) for k in R.SORT_KEYS])
    tops = [R.as_text(R.top_rules(arrays, k, 15), ["antecedents", "consequents"]).select(
        F.lit(k).alias("sorted_by"), "antecedents", "consequents", F.col(k).alias("value")) for k in R.SORT_KEYS]
    return reduce(lambda a, b: a.unionByName(b), tops)


@register("rules_end_to_end", f"""SELECT antecedents || ' → ' || consequents AS rule, support, confidence, lift
FROM ({_rules_sql(BRAND_ROWS_SQL, 0.02, 0.1, 0.5)})""")
def q_rules_end_to_end(spark, sf_dir):
    """From retail rows to sorted rule texts with the default columns."""
    _, rules = R.mine_rules(retail_view(spark, sf_dir), min_support=0.02, max_len=3, min_confidence=0.1, min_lift=0.5)
    return R.rule_text(rules).select("rule", *[F.round(c, 6).alias(c) for c in ["support", "confidence", "lift"]])
