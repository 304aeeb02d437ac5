"""Two-stage models on Spark ML, their cross-validation, projections and explanations."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stages import kept
from .portfolio import bet_size
from .splits import early_stop_carve, expanding_folds, purged_folds, three_way


def primary_model(features: list[str], label: str = "label_binary", rounds: int = 20, depth: int = 4, seed: int = 42, monitor: str | None = None, step: float = 0.1) -> Pipeline:
    """Gradient-boosted trees for the direction. With ``monitor``, a boolean column, boosting stops when the rows
    that it marks get no better."""
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.7, featureSubsetStrategy="0.6", minInstancesPerNode=20, seed=seed)
    if monitor:
        trees.setValidationIndicatorCol(monitor)
        trees.set(trees.validationTol, 0.001)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])


def meta_model(features: list[str], label: str = "meta_label", trees: int = 50, depth: int = 6, seed: int = 42) -> Pipeline:
    """A random forest for the conviction."""
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest])


def matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls of the features as 0."""
    return df.na.fill(0.0, features)


def probability() -> Column:
    return vector_to_array("probability")[1]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with weight: rows / (classes * rows of the class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row a class
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def scored(model, df: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(df).withColumn(out, probability()).drop("features", "rawPrediction", "probability", "prediction")


def evaluate_folds(rows: DataFrame, features: list[str], cfg: dict, rounds: int = 5, depth: int = 4) -> DataFrame:
    """(fold, n_train, n_test, accuracy, logloss, auc) of the purged folds. Training rows depend on the first
    test group alone, so folds that share them share a fit: eight fits for 36 folds of ten groups."""
    c = cfg["validation"]
    data = kept(matrix(rows, features), "rows")
    folds = kept(purged_folds(data, c["groups"], c["test_groups"], c["embargo_days"]), "folds")
    sets = folds.filter("role = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.xxhash64("ticker", "entry_date").cast("decimal(38,0)")).alias("h")).collect()
    by: dict = {}
    for r in sets:
        by.setdefault((r["n"], r["h"]), []).append(r["fold"])
    keys, out = ["ticker", "entry_date"], None
    for (n_train, _), members in sorted(by.items(), key=lambda x: min(x[1])):
        train = data.join(folds.filter((F.col("fold") == members[0]) & (F.col("role") == "train")).select(*keys), keys)
        if train.select("label_binary").distinct().count() < 2:
            continue
        model = primary_model(features, rounds=rounds, depth=depth).fit(train)
        test = data.join(folds.filter(F.col("fold").isin(members) & (F.col("role") == "test")).select("fold", *keys), keys)
        one = scored(model, test).select("fold", F.lit(n_train).cast("long").alias("n_train"), "p", "label_binary")
        out = one if out is None else out.union(one)
    if out is None:
        return data.sparkSession.createDataFrame([], "fold int, n_train long, n_test long, accuracy double, logloss double, auc double")
    return fold_figures(kept(out, "scores"), "label_binary")


def fold_figures(scores: DataFrame, y: str, p: str = "p") -> DataFrame:
    """(fold, n_train, n_test, accuracy, logloss, auc) of the scored test rows of all folds, in one pass. Ranks come
    from totals of stretches of the probabilities, so no fold is ordered in one task."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    plain = scores.groupBy("fold", "n_train").agg(F.count("*").alias("n_test"), F.avg(((F.col(p) > 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), (-F.avg(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))).alias("logloss"))
    values = scores.groupBy("fold", p, F.floor(F.col(p) * 4096).alias("_s")).agg(F.sum(y).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = values.groupBy("fold", "_s").agg(F.sum("_neg").alias("_n")).withColumn("_before", before(W.partitionBy("fold").orderBy("_s"))).drop("_n")
    ranked = values.withColumn("_n", F.col("_neg")).withColumn("_inside", before(W.partitionBy("fold", "_s").orderBy(p))).join(totals, ["fold", "_s"])
    auc = ranked.groupBy("fold").agg(F.try_divide(F.sum(F.col("_pos") * (F.col("_before") + F.col("_inside") + F.col("_neg") / 2)), F.sum("_pos") * F.sum("_neg")).alias("auc"))
    return plain.join(auc, "fold").select("fold", "n_train", "n_test", "accuracy", "logloss", "auc")


def two_stage(rows: DataFrame, features: list[str], cfg: dict) -> DataFrame:
    """Test rows with direction, meta_probability and bet: a first model for the direction, a second one,
    trained on whether out-of-fold directions were right, for the conviction."""
    data = kept(three_way(kept(matrix(rows, features), "rows"), 0.8, 0.85), "split")
    train = data.filter("part = 'train'")
    # the last tenth of the training rows watches the fit
    primary = primary_model(features, monitor="monitor").fit(early_stop_carve(train))
    numbered = kept(expanding_folds(train, cfg["validation"]["folds"]), "numbered")
    parts = None
    for k in range(1, cfg["validation"]["folds"]):
        past = numbered.filter(F.col("oof_fold") < k)
        if past.select("label_binary").distinct().count() < 2:
            continue
        part = scored(primary_model(features, rounds=5).fit(past), numbered.filter(F.col("oof_fold") == k))
        parts = part if parts is None else parts.union(part)
    known = balanced(parts.withColumn("meta_label", ((F.col("p") > 0.5).cast("int") == F.col("label_binary")).cast("int")), "meta_label")
    meta = meta_model([*features, "p"]).fit(known)
    test = scored(meta, scored(primary, data.filter("part = 'test'")), "meta_probability")
    direction = F.when(F.col("p") > 0.5, 1).otherwise(-1)
    c = cfg["bets"]
    return test.withColumn("direction", direction).withColumn("bet", bet_size(F.col("direction"), F.col("meta_probability"), c["method"], c["min_probability"], c["cap"]))


def supervised_pca(df: DataFrame, features: list[str], target: str, n: int) -> DataFrame:
    """``df`` with components: PCA of standardised features, each weighted by its share of the absolute
    univariate slopes on the target."""
    data = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True)]).fit(df).transform(df).withColumn("_a", vector_to_array("_std"))
    slopes = data.agg(*[F.abs(F.regr_slope(F.col(target).cast("double"), F.col("_a")[i])).alias(f"s{i}") for i in range(len(features))]).first()
    slopes = [s or 0.0 for s in slopes]
    weight = Vectors.dense([s / (sum(slopes) + 1e-12) for s in slopes])
    weighted = ElementwiseProduct(scalingVec=weight, inputCol="_std", outputCol="_w").transform(data)
    return PCA(k=min(n, len(features)), inputCol="_w", outputCol="_c").fit(weighted).transform(weighted).withColumn("components", vector_to_array("_c")).drop("_raw", "_std", "_a", "_w", "_c")


def fractional_difference(df: DataFrame, x: str, d: float, out: str, tolerance: float = 1e-4, key: str = "ticker", order: str = "date") -> DataFrame:
    """``df`` with the fixed-width fractional difference of order d of each entity: weights
    w_k = -w_(k-1) (d - k + 1) / k down to ``tolerance``; null until the window is full."""
    weights = [1.0]
    while abs(w := -weights[-1] * (d - len(weights) + 1) / len(weights)) >= tolerance and len(weights) < 2000:
        weights.append(w)
    window = W.partitionBy(key).orderBy(order).rowsBetween(-(len(weights) - 1), 0)
    listed = F.collect_list(x).over(window)
    dot = F.aggregate(F.zip_with(listed, F.array(*[F.lit(w) for w in reversed(weights)]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(out, F.when(F.size(listed) == len(weights), dot))


def trees_of(model) -> list[tuple[float, dict]]:
    """(weight, root) of an ensemble's trees; a node has value and cover, an inner one feature, cut, left, right."""

    def node(j) -> dict:
        out = {"cover": float(j.impurityStats().count()), "value": float(j.prediction())}
        if j.subtreeDepth() > 0:
            out |= {"feature": int(j.split().featureIndex()), "cut": float(j.split().threshold()), "left": node(j.leftChild()), "right": node(j.rightChild())}
        return out

    return [(float(w), node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"))) for t, w in zip(model.trees, model.treeWeights, strict=True)]


def shapley(tree: dict, x: list[float]) -> dict[int, float]:
    """Exact Shapley values of one tree at x, the expectation of unknown features following the cover of the
    branches: each leaf is a product over its path's features, whose values are found from polynomials of
    subset sizes. The sum of the values is the prediction less the expectation."""
    out: dict[int, float] = {}

    def walk(n: dict, path: dict[int, tuple[float, float]]) -> None:
        if "feature" not in n:
            features = list(path)
            m = len(features)
            for f in features:
                # coefficients by subset size of the product of the other features' (absent + present z)
                poly = [1.0]
                for g in features:
                    if g != f:
                        present, absent = path[g]
                        poly = [(poly[i] * absent if i < len(poly) else 0.0) + (poly[i - 1] * present if i else 0.0) for i in range(len(poly) + 1)]
                weight = sum(c * math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s, c in enumerate(poly))
                present, absent = path[f]
                out[f] = out.get(f, 0.0) + weight * (present - absent) * n["value"]
            return
        f = n["feature"]
        for side, goes in (("left", x[f] <= n["cut"]), ("right", x[f] > n["cut"])):
            present, absent = path.get(f, (1.0, 1.0))
            share = n[side]["cover"] / n["cover"] if n["cover"] else 0.0
            walk(n[side], path | {f: (present * goes, absent * share)})

    walk(tree, {})
    return out


def tree_shap(df: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """(key, contributions): Shapley values of the ensemble's margin by feature, in Arrow batches."""
    import pandas as pd

    trees = trees_of(model)

    def explain(batches):
        for b in batches:
            rows = []
            for x in b[features].to_numpy().tolist():
                total = [0.0] * len(features)
                for w, t in trees:
                    for f, v in shapley(t, x).items():
                        total[f] += w * v
                rows.append(total)
            yield pd.DataFrame({key: b[key], "contributions": rows})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *features).mapInPandas(explain, f"{key} {kind}, contributions array<double>")


def global_importance(explained: DataFrame, features: list[str], n: int = 15) -> DataFrame:
    """(feature, importance): mean size of the contributions, the n largest."""
    means = explained.select(F.posexplode("contributions").alias("i", "x")).groupBy("i").agg(F.avg(F.abs("x")).alias("importance"))
    names = F.array(*[F.lit(f) for f in features])
    return means.select(F.element_at(names, F.col("i") + 1).alias("feature"), "importance").orderBy(F.desc("importance"), "feature").limit(n)
