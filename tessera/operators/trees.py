"""Decision trees and forests that split between any two values (C-04, C-07,
M-07, M-08), grown level by level over all trees at once.

A level is a few jobs over the rows of its open nodes: class weights per
(tree, node, feature, value), their running totals over range partitions
(``functions/rank.py``), and the best cut of each node as a grouped minimum.
No value is binned, no node is collected into one task, and the number of
jobs depends on the depth alone.  Among equally good cuts the smaller feature
position, then the smaller value, wins (gains are compared at 9 decimals).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rank import running_totals
from tessera.session import discard, materialize

#: Node numbers are those of a heap (children 2i and 2i + 1) in a long.
MAX_DEPTH = 60


def _goodness(weights: list[Column], n: Column, criterion: str) -> Column:
    """The part of n * (1 - impurity) that a side with these class weights adds."""
    if criterion == "gini":
        parts = [w * w / n for w in weights]
    else:
        parts = [F.when(w > 0, w * F.log2(w / n)).otherwise(F.lit(0.0)) for w in weights]
    return sum(parts[1:], parts[0])


def _grow(rows: DataFrame, n_features: int, k: int, max_depth: int, criterion: str, per_node: int | None,
          seed: int) -> DataFrame:
    """``rows`` (tree, label, w, x) -> nodes (tree, node, depth, feature, cut,
    gain, t0..): ``feature`` is null at a leaf, ``t`` are class weights."""
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"unknown criterion {criterion}")
    if not 0 < max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")
    t, key = [f"t{c}" for c in range(k)], ["tree", "node"]

    def sums(frame, by):
        return frame.groupBy(*by).agg(*[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)).alias(f"t{c}") for c in range(k)])

    cur = materialize(rows.withColumn("node", F.lit(1).cast("long")), "rows")
    levels, n = [], sum([F.col(x) for x in t[1:]], F.col(t[0]))
    for depth in range(max_depth + 1):
        tot = materialize(sums(cur, key).withColumn("n", n), "tree")
        best = None
        if depth < max_depth:
            live = tot.where(F.greatest(*[F.col(x) for x in t]) < F.col("n")) if k > 1 else tot.limit(0)
            tries = F.sequence(F.lit(0), F.lit(n_features - 1))
            if per_node is not None and per_node < n_features:
                tries = F.transform(F.slice(F.array_sort(F.transform(
                    tries, lambda f: F.struct(F.xxhash64("tree", "node", f, F.lit(seed)).alias("h"), f.alias("f")))), 1, per_node),
                    lambda s: s["f"])
            long = cur.join(live.select(*key), key).withColumn("feature", F.explode(tries)) \
                .withColumn("value", F.get("x", F.col("feature")))
            counts = materialize(sums(long, [*key, "feature", "value"]), "tree")
            cum = running_totals(counts, [*key, "feature"], "value", t)
            cum = cum.join(tot.select(*key, "n", *[F.col(x).alias(f"all_{x}") for x in t]), key)
            left = [F.col(f"cum_{x}") for x in t]
            n_left = sum(left[1:], left[0])
            right = [F.col(f"all_{x}") - F.col(f"cum_{x}") for x in t]
            n_right = F.col("n") - n_left
            whole = _goodness([F.col(f"all_{x}") for x in t], F.col("n"), criterion)
            gain = F.round(_goodness(left, n_left, criterion) + _goodness(right, n_right, criterion) - whole, 9)
            # n_right is a difference of sums of weights: what is left after the last value is rounding only
            best = cum.where(n_right > F.col("n") * 1e-12).groupBy(*key) \
                .agg(F.min(F.struct((-gain).alias("g"), "feature", "value")).alias("b")) \
                .select(*key, "b.feature", "b.value", (-F.col("b.g")).alias("gain"))
            after = counts.select(*key, "feature", F.col("value").alias("_v")).join(best, [*key, "feature"]) \
                .where(F.col("_v") > F.col("value")).groupBy(*key, "feature", "value", "gain").agg(F.min("_v").alias("_v"))
            cut = (F.col("value") + F.col("_v")) / 2
            best = after.select(*key, "feature", F.when(cut < F.col("_v"), cut).otherwise(F.col("value")).alias("cut"), "gain")
            level = tot.join(best, key, "left")
        else:
            level = tot.withColumn("feature", F.lit(None).cast("int")).withColumn("cut", F.lit(None).cast("double")) \
                .withColumn("gain", F.lit(None).cast("double"))
        level = materialize(level.select(*key, F.lit(depth).alias("depth"), "feature", "cut", "gain", *t), "tree")
        levels.append(level)
        discard(tot)
        if best is None:
            break
        discard(counts)
        split = level.where(F.col("feature").isNotNull())
        if not split.limit(1).count():
            break
        new = materialize(cur.join(split.select(*key, "feature", "cut"), key)
                          .withColumn("node", 2 * F.col("node") + (F.get("x", F.col("feature")) > F.col("cut")).cast("long"))
                          .select("tree", "node", "label", "w", "x"), "rows")
        discard(cur)
        cur = new
    discard(cur)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = materialize(out, "tree")
    for x in levels:
        discard(x)
    return out


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def tree_fit(train: DataFrame, features: list[str], label: str = "label", n_classes: int | None = None, max_depth: int = 5,
             criterion: str = "gini", weight: str | None = None) -> dict:
    """One tree.  ``label`` holds 0..n_classes-1; rows with a missing feature
    or label are left out; ``weight`` (> 0) counts a row so many times."""
    d = train.select(F.col(label).cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
                     _vector(features).alias("x"), F.lit(0).alias("tree"))
    return _fit(d, features, n_classes, max_depth, criterion, None, 0, 1)


def forest_fit(train: DataFrame, features: list[str], label: str = "label", n_classes: int | None = None, n_trees: int = 100,
               max_depth: int = 10, criterion: str = "gini", per_node: int | None = None, row_id: str | None = None,
               seed: int = 42) -> dict:
    """A forest: every tree sees every row Poisson(1) times, every node tries
    ``per_node`` features (the square root of their number).  Both choices are
    hashes, of (row, tree) and (tree, node), so a repeated task grows the same
    trees.  ``row_id`` names the rows; without it equal rows are drawn alike."""
    key = [F.col(row_id)] if row_id else [F.col(c) for c in [*features, label]]
    u = F.pmod(F.xxhash64(*key, "tree", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    steps, p = [], 0.0
    for i in range(12):  # Poisson(1) distribution; beyond 12 lies less than 1e-9
        p += math.exp(-1) / math.factorial(i)
        steps.append(p)
    w = sum([(u >= s).cast("double") for s in steps[1:]], (u >= steps[0]).cast("double"))
    d = train.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("w", w).where("w > 0")
    d = d.select(F.col(label).cast("int").alias("label"), "w", _vector(features).alias("x"), "tree")
    per = per_node or max(1, int(math.sqrt(len(features))))
    return _fit(d, features, n_classes, max_depth, criterion, per, seed, n_trees)


def _fit(d: DataFrame, features: list[str], n_classes: int | None, max_depth: int, criterion: str, per_node: int | None,
         seed: int, n_trees: int) -> dict:
    d = d.where(F.col("label").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    k = n_classes or (d.agg(F.max("label")).first()[0] or 0) + 1
    nodes = _grow(d, len(features), k, max_depth, criterion, per_node, seed)
    t = [F.col(f"t{c}") for c in range(k)]
    nodes = nodes.withColumn("proba", F.array(*[x / sum(t[1:], t[0]) for x in t]))
    return {"nodes": nodes, "features": features, "k": k, "depth": max_depth, "n_trees": n_trees}


def tree_predict(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``prediction`` (smallest of the likeliest classes) and
    ``probability`` (mean over the trees).  Rows with a missing feature are
    left out.  A row meets the splits of one level per join, left to Spark's
    own size check."""
    nodes = model["nodes"]
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    d = df.withColumn("_x", _vector(model["features"])).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    many = model["n_trees"] > 1
    if many:
        d = materialize(d.withColumn("_row", F.monotonically_increasing_id()), "rows")
    walk = (d.select("_row", "_x") if many else d) \
        .withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(model["n_trees"] - 1)))).withColumn("_node", F.lit(1).cast("long"))
    for at in range(depth):
        s = nodes.where((F.col("depth") == at) & F.col("feature").isNotNull()) \
            .select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("feature").alias("_f"), F.col("cut").alias("_c"))
        walk = walk.join(s, ["_tree", "_node"], "left").withColumn("_node", F.when(F.col("_f").isNull(), F.col("_node")).otherwise(
            2 * F.col("_node") + (F.get("_x", F.col("_f")) > F.col("_c")).cast("long"))).drop("_f", "_c")
    leaf = nodes.where(F.col("feature").isNull()).select(F.col("tree").alias("_tree"), F.col("node").alias("_node"),
                                                         F.col("proba").alias("probability"))
    out = walk.join(leaf, ["_tree", "_node"])
    if many:
        mean = out.groupBy("_row").agg(*[F.avg(F.get("probability", F.lit(c))).alias(f"_p{c}") for c in range(model["k"])])
        out = d.join(mean, "_row").withColumn("probability", F.array(*[f"_p{c}" for c in range(model["k"])]))
    best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    return out.withColumn("prediction", best).select(*df.columns, "prediction", "probability")


def tree_importances(model: dict) -> DataFrame:
    """``(feature, importance)``: impurity taken away by a feature's cuts as a
    share of its tree's, mean over the trees; features without a cut have 0."""
    names = F.array(*[F.lit(f) for f in model["features"]])
    g = model["nodes"].where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    per_tree = g.groupBy("tree").agg(F.sum("g").alias("all"))
    got = g.join(per_tree, "tree").where("all > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("s"))
    grown = per_tree.where("all > 0").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    every = model["nodes"].sparkSession.range(len(model["features"])).select(F.col("id").cast("int").alias("feature"))
    return every.join(got, "feature", "left").select(
        names[F.col("feature")].alias("feature"), (F.coalesce("s", F.lit(0.0)) / max(1, grown)).alias("importance"))


def tree_lines(model: dict, max_depth: int = 5, class_names: list[str] | None = None) -> DataFrame:
    """``(place, line)``: the first tree as text, in order of ``place``: one
    line per branch, ``class`` at a leaf, what lies below ``max_depth`` cut off."""
    feature = F.array(*[F.lit(f) for f in model["features"]])[F.col("feature")]
    names = F.array(*[F.lit(x) for x in class_names or [str(c) for c in range(model["k"])]])
    path = F.expr("substring(bin(node), 2)")  # 0 and 1 per level: left and right
    bar = F.expr("repeat('|   ', depth)")
    cut = F.format_string("%.2f", "cut")
    at_leaf = F.array_position("proba", F.array_max("proba")).cast("int") - 1
    below = F.concat(bar, F.lit("|--- truncated branch"))
    n = model["nodes"].where((F.col("tree") == 0) & (F.col("depth") <= max_depth + 1))
    lines = F.when(F.col("feature").isNull() & (F.col("depth") <= max_depth),
                   F.array(F.struct(F.concat(path, F.lit("x")).alias("place"), F.concat(bar, F.lit("|--- class: "), names[at_leaf]).alias("line")))) \
        .when(F.col("depth") > max_depth, F.array(F.struct(F.concat(path, F.lit("x")).alias("place"), below.alias("line")))) \
        .otherwise(F.array(F.struct(F.concat(path, F.lit("0")).alias("place"), F.concat(bar, F.lit("|--- "), feature, F.lit(" <= "), cut).alias("line")),
                           F.struct(F.concat(path, F.lit("1")).alias("place"), F.concat(bar, F.lit("|--- "), feature, F.lit(" > "), cut).alias("line"))))
    return n.select(F.explode(lines).alias("l")).select("l.place", "l.line")
