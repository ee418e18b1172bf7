"""Association rules (A-18..A-20, A-23, J-01, J-08, R-01..R-06, T-01..T-03).

Baskets are sparse ``array<string>`` per transaction (never a one-hot
matrix).  Frequent itemsets are mined level by level; rules with
multi-item consequents are generated in Spark by exploding subset bit masks
and looking the subsets up with equi-joins on the sorted item array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

SORT_KEYS = ("lift", "confidence", "support", "leverage", "conviction")


def clean_items(df: DataFrame, t: str, i: str) -> DataFrame:
    """(transaction, item) with item as trimmed text; blanks and nulls dropped."""
    return (df.select(F.col(t).alias(t), F.trim(F.col(i).cast("string")).alias(i))
              .where(F.col(t).isNotNull() & F.col(i).isNotNull() & (F.col(i) != "")))


def top_items(df: DataFrame, i: str, n: int = 200) -> DataFrame:
    """Most frequent items by row count (ties by item text), ``(item, count)``."""
    return (df.groupBy(i).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.col(i)).limit(n))


def keep_top_items(df: DataFrame, i: str, n: int = 200) -> DataFrame:
    """Rows whose item is among the ``n`` most frequent (a semi join with ``n``
    rows, which Spark broadcasts if they are small)."""
    return df.join(top_items(df, i, n).select(i), i, "left_semi")


def build_baskets(df: DataFrame, t: str, i: str, top: int | None = None) -> DataFrame:
    """``(transaction, items)`` with ``items`` the sorted distinct item list.

    ``top`` keeps only the ``top`` most frequent items first (the support
    denominator then counts transactions holding at least one of them).
    ``None`` keeps every item.
    """
    rows = clean_items(df, t, i)
    if top is not None:
        rows = keep_top_items(rows, i, top)
    # one shuffle by transaction; collect_set's partial aggregation drops
    # duplicate (transaction, item) rows map-side
    return rows.groupBy(t).agg(F.array_sort(F.collect_set(i)).alias("items"))


def basket_stats(baskets: DataFrame) -> DataFrame:
    """transactions, unique items, density % (filled cells of the one-hot
    matrix), in one pass: a null item stands for the transaction itself."""
    cells = baskets.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("items"))).alias("i"))
    per = cells.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    s = per.agg(F.max(F.when(F.col("i").isNull(), F.col("c"))).alias("t"), F.count("i").alias("u"),
                F.sum(F.when(F.col("i").isNotNull(), F.col("c"))).alias("c"))
    t, u = F.coalesce("t", F.lit(0)), F.col("u")
    return s.select(t.alias("transactions"), u.alias("unique_items"),
                    F.try_divide(F.coalesce("c", F.lit(0)) * 100.0, t * u).alias("density_pct"))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.02, max_len: int | None = 3,
                      items_col: str = "items") -> DataFrame:
    """``(items array<string>, support double, length int)`` with support >= min_support.

    Level by level, up to ``max_len`` and no further: occurrences of frequent
    itemsets of one length, joined within their transaction where they share
    all but the last item, give the candidates of the next.  Infrequent items
    and itemsets leave before each join.  The levels found are written, so
    rules read them without mining again.
    """
    spark = baskets.sparkSession
    cells = materialize(baskets.select(F.monotonically_increasing_id().alias("t"), F.col(items_col).alias("items")),
                        "baskets")
    n = float(cells.count())

    def frequent(occ: DataFrame, name: str) -> DataFrame:
        c = occ.groupBy("items").agg(F.count(F.lit(1)).alias("c"))
        return materialize(c.select("items", (F.col("c") / F.lit(n)).alias("support"))
                           .where(F.col("support") >= F.lit(min_support)), name)

    levels, k = [], 1
    occ = cells.select("t", F.explode("items").alias("i")).select("t", F.array("i").alias("items"))
    while n and (max_len is None or k <= max_len):
        if k > 1:
            head, last = F.slice("items", 1, k - 2) if k > 2 else F.array().cast("array<string>"), F.element_at("items", -1)
            kept = occ.join(levels[-1].select("items"), "items", "left_semi").select("t", "items", head.alias("p"), last.alias("l"))
            other = kept.select("t", "p", F.col("l").alias("l2"))
            occ = kept.join(other, ["t", "p"]).where(F.col("l") < F.col("l2")) \
                .select("t", F.concat("items", F.array("l2")).alias("items"))
            if max_len is None or k < max_len:
                occ = materialize(occ, "occurrences")
        level = frequent(occ, "itemsets")
        if level.limit(1).count() == 0:
            break
        levels.append(level)
        k += 1
    if not levels:
        return spark.createDataFrame([], "items array<string>, support double, length int")
    return reduce(DataFrame.unionByName, levels).withColumn("length", F.size("items"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Every split of each itemset (size >= 2) into non-empty antecedent and
    consequent, with antecedent/consequent support, support, confidence,
    lift, leverage and conviction (infinite when confidence is 1).

    Subsets are produced by exploding the bit masks 1 .. 2^k-2; their
    supports come from two equi-joins against the itemset table (every
    subset of a frequent itemset is frequent, so the lookups always hit).
    """
    big = itemsets.where(F.col("length") >= 2)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.col("length")).cast("int") - 2)
    ex = big.select("items", F.col("support"), F.explode(masks).alias("_m"))
    idx = F.sequence(F.lit(0), F.size("items") - 1)
    pick = lambda want: F.transform(
        F.filter(idx, lambda j: (F.floor(F.col("_m") / F.pow(F.lit(2), j)) % 2) == want),
        lambda j: F.element_at(F.col("items"), j + 1))
    rules = ex.select(pick(1).alias("antecedents"), pick(0).alias("consequents"), "support")
    sup = itemsets.select("items", "support")
    rules = (rules
             .join(sup.select(F.col("items").alias("antecedents"),
                              F.col("support").alias("antecedent_support")), "antecedents")
             .join(sup.select(F.col("items").alias("consequents"),
                              F.col("support").alias("consequent_support")), "consequents"))
    conf = F.col("support") / F.col("antecedent_support")
    rules = rules.withColumn("confidence", conf).where(F.col("confidence") >= F.lit(min_confidence))
    return rules.select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support",
        "confidence",
        # support / (sA * sC): symmetric in A and C, so A->C and C->A tie exactly
        (F.col("support") / (F.col("antecedent_support") * F.col("consequent_support"))).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") >= 1.0, F.lit(float("inf")))
         .otherwise((1 - F.col("consequent_support")) / (1 - F.col("confidence"))).alias("conviction"))


def filter_rules(rules: DataFrame, min_lift: float = 1.0) -> DataFrame:
    return rules.where(F.col("lift") >= F.lit(min_lift))


def sort_rules(rules: DataFrame, by: str = "lift") -> DataFrame:
    if by not in SORT_KEYS:
        raise ValueError(f"sort key must be one of {SORT_KEYS}")
    return rules.orderBy(F.desc(by), F.array_join("antecedents", ", "), F.array_join("consequents", ", "))


def top_rules(rules: DataFrame, by: str = "lift", n: int = 15) -> DataFrame:
    """The ``n`` best rules by ``by`` (TakeOrderedAndProject, no full sort)."""
    return sort_rules(rules, by).limit(n)


def top_itemsets(itemsets: DataFrame, n: int = 50) -> DataFrame:
    return itemsets.orderBy(F.desc("support"), F.array_join("items", ", ")).limit(n)


def itemsets_by_length(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("length").agg(F.count(F.lit(1)).alias("count"))


def as_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Item arrays as ", "-joined text (display form)."""
    return df.select(*[F.array_join(F.col(c), ", ").alias(c) if c in cols else F.col(c) for c in df.columns])


def rule_text(rules: DataFrame) -> DataFrame:
    """Adds ``rule`` = "A, B → C" (display form of a rule)."""
    return rules.withColumn("rule", F.concat(F.array_join("antecedents", ", "), F.lit(" → "),
                                             F.array_join("consequents", ", ")))


def mine_rules(df: DataFrame, t: str | None = None, i: str | None = None, min_support: float = 0.02,
               max_len: int = 3, min_confidence: float = 0.3, min_lift: float = 1.0,
               sort_by: str = "lift", top: int | None = None):
    """End to end: clean items -> baskets -> itemsets -> rules -> lift filter -> sorted.

    Column defaults: InvoiceNo / Description when both exist.
    Returns ``(itemsets, rules)``.
    """
    if t is None or i is None:
        if {"InvoiceNo", "Description"} <= set(df.columns):
            t, i = t or "InvoiceNo", i or "Description"
        else:
            raise ValueError("transaction and item columns are required")
    baskets = build_baskets(df, t, i, top)
    fi = frequent_itemsets(baskets, min_support, max_len)
    rules = filter_rules(association_rules(fi, min_confidence), min_lift)
    return fi, sort_rules(rules, sort_by)
