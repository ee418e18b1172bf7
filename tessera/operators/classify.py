"""Classification (C-01..C-13): split, label encoding, scaling, models,
batteries of models, grid scoring.

Decision trees split between any two values (``trees.py``).  Other models are
MLlib estimators where MLlib has the algorithm (binned trees and random
forests, gradient-boosted trees, linear SVM, logistic regression);
Gaussian naive Bayes is closed-form aggregates; AdaBoost (SAMME) is a loop
of weighted MLlib stumps; kernel SVMs use explicit feature maps (random
Fourier features / polynomial expansion) in front of ``LinearSVC``.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.beside import BLOCK, beside
from tessera.functions.rank import avg_rank, running_totals
from tessera.functions.sqltext import dlit, ident
from tessera.operators import boosting, trees
from tessera.operators.core import default_features, portable_hash, require_rows
from tessera.operators.preprocess import scale, scale_params
from tessera.session import discard, materialize


# ----------------------------------------------------------------- splitting
def train_test_split(df: DataFrame, id_col: str, test_ratio: float = 0.25, seed: int = 42,
                     method: str = "xxhash64", stratify: str | None = None) -> DataFrame:
    """Adds ``is_test`` by a seeded hash of the id.

    Without ``stratify`` every row decides alone (hash below ``test_ratio``),
    so the split is the same for any partitioning and after a retry.  With it,
    each class gives exactly its ``test_ratio`` share, rounded: the rows whose
    hash ranks first in their class (running totals over range partitions, so
    a class of any size is ranked by many tasks).  Rows of a null class train.
    """
    if method == "portable":
        h = portable_hash(id_col, seed)
    else:
        h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed).cast("bigint")), F.lit(2147483648))
    if stratify is None:
        return df.withColumn("is_test", h / F.lit(2147483648.0) < F.lit(test_ratio))
    d = df.withColumn("_h", h)
    c = d.where(F.col(stratify).isNotNull()).groupBy(F.col(stratify).alias("_y"), "_h").agg(F.count(F.lit(1)).alias("_n"))
    r = running_totals(c, ["_y"], "_h", ["_n"])
    size = c.groupBy("_y").agg(F.sum("_n").alias("_all"))
    first = r.join(size, "_y").where(F.col("cum__n") <= F.round(F.col("_all") * F.lit(test_ratio))) \
        .select(F.col("_y").alias(stratify), "_h", F.lit(True).alias("_t"))
    return d.join(first, [stratify, "_h"], "left").withColumn("is_test", F.coalesce("_t", F.lit(False))) \
        .select(*df.columns, "is_test")


# ------------------------------------------------------------------ labels
def encode_label(df: DataFrame, y: str, out: str = "label"):
    """Classes sorted ascending -> 0..k-1 (text sorts alphabetically), any
    number of them.

    Rows with a missing target are dropped.  Returns ``(DataFrame, number of
    classes)``.
    """
    d = df.where(F.col(y).isNotNull())
    codes = avg_rank(d.select(F.col(y).alias("value")).distinct(), [], "value") \
        .select(F.col("value").alias(y), (F.col("rank") - 1).cast("double").alias(out))
    codes = materialize(codes, "classes")
    return d.join(codes, y).select(*df.columns, out), codes.count()


def prepare_xy(df: DataFrame, features: list[str], y: str, id_col: str | None = None):
    """Complete feature rows with an encoded target."""
    d = df.na.drop(subset=features)
    return encode_label(d, y)


# ---------------------------------------------------------------- Gaussian NB
def gaussian_nb_fit(train: DataFrame, features: list[str], label: str = "label",
                    var_smoothing: float = 1e-9) -> dict:
    """Class priors, per-class means and population variances (+ epsilon =
    var_smoothing x the largest feature variance).  ``classes`` is a table with
    a row per class, ``k`` their number."""
    x = [F.col(c).cast("double") for c in features]
    d = range(len(features))
    g = materialize(train.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
        *[F.coalesce(F.var_pop(v), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(x)]), "nb_stats")
    k, n, *mean = g.agg(F.count(F.lit(1)), F.sum("n"), *[F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n") for i in d]).first()
    if not k:
        raise ValueError("no training rows")
    # the variance of all rows from the classes' sizes, means and variances
    overall = g.agg(*[F.sum(F.col("n") * (F.col(f"v{i}") + (F.col(f"m{i}") - F.lit(mean[i])) ** 2)) / n for i in d]).first()
    eps = var_smoothing * max(overall)
    var = [F.col(f"v{i}") + F.lit(eps) for i in d]
    const = F.ln(F.col("n") / n) - F.aggregate(F.array(*[0.5 * F.ln(2 * math.pi * v) for v in var]), F.lit(0.0), lambda s, t: s + t)
    classes = materialize(g.select("label", const.alias("const"), F.array(*[f"m{i}" for i in d]).alias("mean"),
                                   F.array(*[2.0 * v for v in var]).alias("var2")), "nb")
    discard(g)
    return {"features": features, "classes": classes, "k": k}


def gaussian_nb_predict(df: DataFrame, model: dict, out: str = "prediction") -> DataFrame:
    """Adds ``prediction`` (largest joint log-likelihood, smallest label on
    ties) and ``probability`` (array, classes in label order).  A row meets
    the classes in blocks; the blocks' likelihoods are put together per row."""
    many = model["k"] > BLOCK
    d = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "nb_rows") if many else df
    x = F.array(*[F.col(c).cast("double") for c in model["features"]])
    d = d.withColumn("_x", x)
    each = beside(d.select("_row", "_x") if many else d, model["classes"], "label", F.xxhash64("_x"), "_cl")

    def total_of(terms: list[Column]) -> Column:  # a shallow tree, however many features
        at = len(terms) // 2
        return total_of(terms[:at]) + total_of(terms[at:]) if at else terms[0]

    def likelihood(c: Column) -> Column:
        gap = [F.get("_x", F.lit(i)) - F.get(c["mean"], F.lit(i)) for i in range(len(model["features"]))]
        return c["const"] - total_of([g * g / F.get(c["var2"], F.lit(i)) for i, g in enumerate(gap)])

    each = each.withColumn("_jll", F.transform("_cl", likelihood))
    top = F.array_max("_jll")
    each = each.withColumn("_best", F.struct(top.alias("top"), F.get("_cl", F.array_position("_jll", top).cast("int") - 1)["label"]
                                             .cast("double").alias("label")))
    if many:
        first = F.get("_cl", F.lit(0))["label"].alias("at")
        got = each.groupBy("_row").agg(
            F.max(F.struct(F.col("_best.top").alias("top"), (-F.col("_best.label")).alias("o"))).alias("_b"),
            F.sort_array(F.collect_list(F.struct(first, "_jll"))).alias("_all"))
        each = d.join(got.select("_row", F.struct(F.col("_b.top").alias("top"), (-F.col("_b.o")).alias("label")).alias("_best"),
                                 F.flatten(F.col("_all._jll")).alias("_jll")), "_row")
    ex = each.withColumn("_ex", F.transform("_jll", lambda v: F.exp(v - F.col("_best.top"))))
    total = F.aggregate("_ex", F.lit(0.0), lambda s, t: s + t)
    return ex.withColumn("_t", total).withColumn(out, F.col("_best.label")) \
        .withColumn("probability", F.transform("_ex", lambda v: v / F.col("_t"))).select(*[c for c in df.columns if c != out], out, "probability")


# -------------------------------------------------------------- MLlib models
def _assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def make_estimator(kind: str, params: dict | None = None, n_classes: int = 2, seed: int = 42):
    """MLlib estimator for ``dt | rf | gbt | logreg``."""
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    p = dict(params or {})
    if (p.get("max_depth") or 0) > 30:
        raise ValueError("trees deeper than 30 levels are not supported")
    if kind == "dt":
        return DecisionTreeClassifier(maxDepth=p.get("max_depth", 5), impurity=p.get("criterion", "gini"), seed=seed,
                                      maxBins=p.get("max_bins", 64))
    if kind == "rf":
        depth = p.get("max_depth", 10)
        return RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=30 if depth is None else depth,
                                      featureSubsetStrategy="sqrt", seed=seed, maxBins=p.get("max_bins", 64))
    if kind == "gbt":
        if n_classes > 2:
            raise ValueError("several classes are boosted by boosting.boost_fit")
        return GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1),
                             maxDepth=p.get("max_depth", 3), seed=seed, maxBins=p.get("max_bins", 64))
    if kind == "logreg":
        return LogisticRegression(maxIter=p.get("max_iter", 100))
    raise ValueError(f"unknown model {kind}")


def fit_predict(kind: str, train: DataFrame, test: DataFrame, features: list[str],
                label: str = "label", params: dict | None = None, keep: list[str] | None = None,
                n_classes: int = 2, seed: int = 42):
    """Fit on ``train``, score ``test``; returns ``(model, predictions)`` with
    ``keep`` columns, ``label``, ``prediction`` and ``score`` (P(class 1); null
    where a model of several classes has no probability)."""
    keep = keep or []
    if kind == "nb":
        m = gaussian_nb_fit(train, features, label)
        pr = gaussian_nb_predict(test, m)
        sc = F.element_at("probability", 2) if m["k"] == 2 else F.lit(None).cast("double")
        return m, pr.select(*keep, label, "prediction", sc.alias("score"))
    if kind == "ada":
        m = adaboost_fit(train, features, label, **(params or {}))
        pr = adaboost_predict(test, m)
        return m, pr.select(*keep, label, "prediction", "score")
    if kind == "dt" and "max_bins" not in (params or {}):  # cuts between any two values; max_bins asks for binned ones
        m = trees.tree_fit(train, features, label, n_classes, **(params or {}))
        pr = trees.tree_predict(test, m)
        return m, pr.select(*keep, label, "prediction", F.get("probability", F.lit(1)).alias("score"))
    if kind == "gbt" and n_classes > 2:  # softmax: probabilities for all classes
        q = {"bins" if a == "max_bins" else a: v for a, v in (params or {}).items()}
        m = boosting.boost_fit(train, features, label, n_classes, **q)
        pr = boosting.boost_predict(test, m)
        return m, pr.select(*keep, label, "prediction", F.get("probability", F.lit(1)).alias("score"))
    if kind in ("svm_linear", "svm_rbf", "svm_poly"):
        m = kernel_svm_fit(train, features, label, kind=kind[4:], **(params or {}))
        pr = kernel_svm_predict(test, m)
        return m, pr.select(*keep, label, "prediction", "score")
    from pyspark.ml.functions import vector_to_array
    est = make_estimator(kind, params, n_classes, seed).setLabelCol(label).setFeaturesCol("features")
    model = est.fit(_assemble(train, features))
    out = model.transform(_assemble(test, features))
    if "probability" in out.columns:
        sc = F.element_at(vector_to_array("probability"), 2)
    elif "rawPrediction" in out.columns:
        sc = F.element_at(vector_to_array("rawPrediction"), 2)
    else:
        sc = F.lit(None).cast("double")
    return model, out.select(*keep, label, "prediction", sc.alias("score"))


# ---------------------------------------------------------------- AdaBoost
def _stump_votes(stump, df: DataFrame, out: str) -> DataFrame:
    """The stump's class for every row, without raw votes and probabilities."""
    return stump.transform(df, {stump.predictionCol: out, stump.rawPredictionCol: "", stump.probabilityCol: ""})


def adaboost_fit(train: DataFrame, features: list[str], label: str = "label", n_estimators: int = 50,
                 learning_rate: float = 1.0, seed: int = 42, checkpoint_every: int = 5) -> dict:
    """SAMME with depth-1 trees: each round fits a weighted MLlib stump,
    err = weighted miss rate, alpha = lr·(ln((1-err)/err) + ln(K-1)),
    weights *= exp(alpha·miss) and are renormalised.  Stops early when a
    stump is perfect or no better than chance.  Lineage is cut every
    ``checkpoint_every`` rounds by writing the table (survives executor loss).

    A fit and the error read a round's rows five times, so these are kept
    until the next round has its own (spilled to disk where memory ends);
    else each pass would score the rows again with all stumps since the last
    written table.  The number of classes goes along with the label column,
    which spares every fit a pass for it."""
    from pyspark.ml.classification import DecisionTreeClassifier
    k, top = train.agg(F.count_distinct(label), F.max(label)).first()
    coded = F.col(label).alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": int(top or 0) + 1}})
    d = _assemble(train.select(*features, label), features).select("features", label)
    n = d.count()
    d = written = materialize(d.withColumn("_w", F.lit(1.0 / n)), "adaboost")
    d = d.select("features", coded, "_w").persist(StorageLevel.MEMORY_AND_DISK)
    kept = [d]
    stumps, alphas = [], []
    for t in range(n_estimators):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="_w", labelCol=label, seed=seed + t,
                                       maxBins=64).fit(d)
        pr = _stump_votes(stump, d, "prediction").withColumn("_miss", (F.col("prediction") != F.col(label)).cast("double"))
        r = pr.agg(F.sum(F.col("_w") * F.col("_miss")).alias("e"), F.sum("_w").alias("w")).first()
        while len(kept) > 1:  # this round's rows are there now
            kept.pop(0).unpersist()
        err = r["e"] / r["w"]
        if err <= 0:
            stumps.append(stump)
            alphas.append(1.0)
            break
        if err >= 1 - 1.0 / k:
            if not stumps:
                stumps.append(stump)
                alphas.append(1.0)
            break
        alpha = learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
        stumps.append(stump)
        alphas.append(alpha)
        # the new total follows from the error: no pass for it
        total = r["w"] - r["e"] + r["e"] * math.exp(alpha)
        d = pr.select("features", label, (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(total)).alias("_w"))
        if (t + 1) % checkpoint_every == 0:
            new = materialize(d, "adaboost")
            discard(written)
            d = written = new
        d = d.select("features", coded, "_w").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(d)
    for x in kept:
        x.unpersist()
    return {"features": features, "stumps": stumps, "alphas": alphas, "k": k, "label": label}


def adaboost_predict(df: DataFrame, model: dict) -> DataFrame:
    """Vote = argmax over classes of the alpha-weighted stump votes; score =
    share of the vote for class 1 (binary)."""
    k = model["k"]
    d = _assemble(df, model["features"], "features")
    votes = [F.lit(0.0)] * k
    for i, (st, a) in enumerate(zip(model["stumps"], model["alphas"])):
        d = _stump_votes(st, d, f"_p{i}")
        votes = [v + F.when(F.col(f"_p{i}") == float(c), F.lit(a)).otherwise(F.lit(0.0))
                 for c, v in enumerate(votes)]
    arr = F.array(*votes)
    pred = (F.array_position(arr, F.array_max(arr)) - 1).cast("double")
    tot = sum(model["alphas"]) or 1.0
    score = votes[1] / F.lit(tot) if k >= 2 else F.lit(None).cast("double")
    return d.withColumn("prediction", pred).withColumn("score", score) \
        .drop("features", *[f"_p{i}" for i in range(len(model["stumps"]))])


def adaboost_importances(model: dict) -> list[float]:
    imp = np.zeros(len(model["features"]))
    tot = sum(model["alphas"]) or 1.0
    for st, a in zip(model["stumps"], model["alphas"]):
        imp += a * st.featureImportances.toArray()
    return list(imp / tot)


# -------------------------------------------------------------- kernel SVM
def kernel_svm_fit(train: DataFrame, features: list[str], label: str = "label", kind: str = "rbf",
                   C: float = 1.0, gamma: float | None = None, n_components: int = 200,
                   degree: int = 3, coef0: float = 0.0, seed: int = 42) -> dict:
    """SVM with penalty C: an explicit feature map, then ``LinearSVC``.

    linear: the features.  poly: (gamma <x, y> + coef0)^degree exactly, as
    weighted monomials.  rbf: random Fourier features sqrt(2/D) cos(Wx + b),
    W ~ N(0, 2 gamma).  gamma defaults to 1/(d var).  The map is a plain column
    expression (no Python in the scoring path).  With two classes a logistic
    fit on the training margins turns margins into probabilities.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.functions import vector_to_array
    d = len(features)
    n = train.count()
    if kind != "linear" and gamma is None:
        v = train.select(F.explode(F.array(*[F.col(c).cast("double") for c in features])).alias("x")) \
            .agg(F.var_pop("x")).first()[0] or 1.0
        gamma = 1.0 / (d * v)
    fmap = {"kind": kind}
    if kind == "rbf":
        rng = np.random.default_rng(seed)
        fmap |= {"W": rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, d)),
                 "b": rng.uniform(0, 2 * math.pi, size=n_components)}
    elif kind == "poly":
        fmap |= {"degree": degree, "gamma": gamma, "coef0": coef0}
    k = train.select(label).distinct().count()
    # the mapped features are read once per optimiser iteration: write them once
    z = materialize(_feature_map(train.select(*features, label), features, fmap), "svm_features")
    svc = LinearSVC(regParam=1.0 / (max(n, 1) * C), maxIter=100, labelCol=label, featuresCol="_z")
    est = svc if k <= 2 else OneVsRest(classifier=svc, labelCol=label, featuresCol="_z")
    model = est.fit(z)
    platt = None
    if k == 2:
        from pyspark.ml.feature import VectorAssembler
        m = model.transform(z).select(label, F.element_at(vector_to_array("rawPrediction"), 2).alias("_margin"))
        m = VectorAssembler(inputCols=["_margin"], outputCol="_mv").transform(m)
        lr = LogisticRegression(labelCol=label, featuresCol="_mv", maxIter=100).fit(m)
        platt = (float(lr.coefficients[0]), float(lr.intercept))
    return {"features": features, "fmap": fmap, "model": model, "label": label, "platt": platt}


def _feature_map(df: DataFrame, features: list[str], fmap: dict) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    xs = [f"CAST({ident(c)} AS DOUBLE)" for c in features]
    if fmap["kind"] == "linear":
        comps = xs
    elif fmap["kind"] == "rbf":
        W, b = fmap["W"], fmap["b"]
        D = W.shape[0]
        comps = [f"{dlit(math.sqrt(2.0 / D))} * cos(" +
                 " + ".join(f"{x} * {dlit(W[i, j])}" for j, x in enumerate(xs)) + f" + {dlit(b[i])})"
                 for i in range(D)]
    else:
        # (gamma <x, y> + coef0)^p = sum over monomials m of p, weight = multinomial coefficient of m
        p, root = fmap["degree"], dlit(math.sqrt(fmap["gamma"]))
        terms = [f"({x} * {root})" for x in xs] + ([dlit(math.sqrt(fmap["coef0"]))] if fmap["coef0"] else [])
        comps = []
        for m in combinations_with_replacement(range(len(terms)), p):
            weight = math.factorial(p) / math.prod(math.factorial(m.count(i)) for i in set(m))
            comps.append(f"{dlit(math.sqrt(weight))} * " + " * ".join(terms[i] for i in m))
    return df.withColumn("_z", array_to_vector(F.expr("array(" + ", ".join(comps) + ")")))


def kernel_svm_predict(df: DataFrame, model: dict) -> DataFrame:
    """``prediction`` and, with two classes, ``score`` = P(class 1)."""
    from pyspark.ml.functions import vector_to_array
    out = model["model"].transform(_feature_map(df, model["features"], model["fmap"]))
    sc = F.lit(None).cast("double")
    if model["platt"]:
        a, b = model["platt"]
        sc = 1.0 / (1.0 + F.exp(-(F.element_at(vector_to_array("rawPrediction"), 2) * F.lit(a) + F.lit(b))))
    return out.withColumn("score", sc).drop("_z", "rawPrediction")


# ------------------------------------------------------------------ battery
def fit_scaler(train: DataFrame, features: list[str]) -> dict:
    """Standardisation parameters from the training rows only."""
    return scale_params(train, features, "standard")


MODELS = ["dt", "nb", "rf", "gbt", "svm_linear", "ada"]


def compare_models(df: DataFrame, id_col: str, features: list[str] | None, y: str,
                   models: list[str] | None = None, test_ratio: float = 0.25, seed: int = 42,
                   params: dict | None = None, method: str = "xxhash64"):
    """Split once (stratified), scale on train, fit each model, score the test rows.

    Without ``features`` the first four numeric columns are used.  Needs 20
    complete rows.  Returns ``(leaderboard DataFrame, {model: predictions})``.
    """
    from tessera.operators.metrics import classification_metrics
    features = features or default_features(df.drop(id_col, y), 4)
    complete = df.na.drop(subset=[*features, y])
    require_rows(complete, 20, "classification")
    data, n_classes = encode_label(complete, y)
    data = train_test_split(data, id_col, test_ratio, seed, method, stratify="label")
    data = materialize(data.select(id_col, *features, "label", "is_test"), "split")
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    sp = fit_scaler(train, features)
    train_s = materialize(scale(train, features, params=sp), "train")
    test_s = scale(test, features, params=sp)
    rows, preds = [], {}
    for m in models or MODELS:
        _, pr = fit_predict(m, train_s, test_s, features, "label", (params or {}).get(m),
                            keep=[id_col], n_classes=n_classes, seed=seed)
        met = classification_metrics(pr, "label", "prediction").first()
        rows.append((m, met["accuracy"], met["precision"], met["recall"], met["f1"]))
        preds[m] = pr
    board = df.sparkSession.createDataFrame(
        rows, "model string, accuracy double, precision double, recall double, f1 double")
    return board.orderBy(F.desc("f1"), "model"), preds


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Feature importances of a tree model (or AdaBoost dict), ascending."""
    if isinstance(model, dict) and "nodes" in model:
        by = {r["feature"]: r["importance"] for r in trees.tree_importances(model).collect()}
        vals = [by[f] for f in model["features"]]
    elif isinstance(model, dict):
        vals = adaboost_importances(model)
    else:
        vals = list(model.featureImportances.toArray())
    return sorted(((f, float(v)) for f, v in zip(features, vals)), key=lambda t: (t[1], t[0]))


def tree_text(model, max_depth: int = 5) -> str:
    """Text rendering of a fitted decision tree (binned ones: MLlib debug string).
    At most 2^max_depth branches come to the driver."""
    if isinstance(model, dict):
        return "\n".join(r["line"] for r in trees.tree_lines(model, max_depth).orderBy("place").collect())
    lines = model.toDebugString.splitlines()
    keep = [ln for ln in lines if (len(ln) - len(ln.lstrip())) // 1 <= 1 + 2 * max_depth]
    return "\n".join(keep)


def score_grid(model_fn, bounds: tuple[float, float, float, float], step: float = 0.3,
               spark=None, names=("f1", "f2")) -> DataFrame:
    """Regular 2-D grid (for decision surfaces) scored by ``model_fn``:
    ``spark.range`` rows x ``spark.range`` columns via an equi-join on the
    grid row (each x-step row is expanded with ``sequence``)."""
    x0, x1, y0, y1 = bounds
    nx = int(math.floor((x1 - x0) / step)) + 1
    ny = int(math.floor((y1 - y0) / step)) + 1
    g = spark.range(nx).select(
        (F.lit(x0) + F.col("id") * F.lit(step)).alias(names[0]),
        F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("_j")) \
        .select(names[0], (F.lit(y0) + F.col("_j") * F.lit(step)).alias(names[1]))
    return model_fn(g)
