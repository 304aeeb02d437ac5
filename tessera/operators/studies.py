"""Studies of scores and settings: rank correlations, ROC points, sweeps through the replay, model comparison, loadings."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import correlation, pct_rank
from ..sources.stages import kept
from .backtest import performance, replay
from .modeling import balanced, evaluate_folds, fold_figures, fractional_difference, matrix, meta_model, primary_model, scored
from .portfolio import bet_size, neutralise, rank_portfolio
from .reports import STRETCHES
from .splits import expanding_folds

#: Critical values of the Dickey-Fuller statistic with a constant, by confidence.
CRITICAL = {0.90: -2.5671, 0.95: -2.8615, 0.99: -3.4304}


def information_coefficient(df: DataFrame, score: str, outcome: str, date: str = "date") -> DataFrame:
    """(date, ic, n): Spearman's correlation of score and outcome over the rows of a date that have both; null
    where either has no spread."""
    known = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = known.withColumns({"_a": pct_rank(score, date), "_b": pct_rank(outcome, date)})
    return ranked.groupBy(date).agg(correlation(F.col("_a"), F.col("_b")).alias("ic"), F.count("*").alias("n"))


def coefficient_summary(ic: DataFrame) -> DataFrame:
    """(dates, mean, std, ratio, positive) of ``information_coefficient`` over the dates that have one."""
    return ic.agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ratio"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


def heatmap(df: DataFrame, down: str, across: str, levels: list, value: str) -> DataFrame:
    """``down`` and a column for each given level of ``across``: the largest value of each cell."""
    return df.groupBy(down).pivot(across, levels).agg(F.max(value))


def roc_points(df: DataFrame, p: str, y: str) -> DataFrame:
    """(threshold, tpr, fpr) of calling 1 at each distinct probability or above. Counts above come from totals of
    stretches of the range and a window within a stretch, so no task orders all values."""
    base = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    ends = base.agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.sum(y).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg"))
    place = F.coalesce(F.floor(F.try_divide(F.col(p) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * STRETCHES), F.lit(0))
    values = base.groupBy(p).agg(F.sum(y).alias("_t"), F.sum(1 - F.col(y)).alias("_f")).crossJoin(F.broadcast(ends)).withColumn("_s", place)  # one row
    above = W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)  # a row a stretch
    so_far = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    totals = values.groupBy("_s").agg(F.sum("_t").alias("_st"), F.sum("_f").alias("_sf")).select("_s", so_far("_st").alias("_bt"), so_far("_sf").alias("_bf"))
    inside = W.partitionBy("_s").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    each = values.withColumns({"_it": F.sum("_t").over(inside), "_if": F.sum("_f").over(inside)}).join(F.broadcast(totals), "_s")  # at most STRETCHES + 1 rows
    return each.select(F.col(p).alias("threshold"), F.try_divide(F.col("_bt") + F.col("_it"), "_pos").alias("tpr"), F.try_divide(F.col("_bf") + F.col("_if"), "_neg").alias("fpr"))


def stratified_dummy(df: DataFrame, y: str) -> DataFrame:
    """(rate, accuracy, brier): what calling labels at random by their share is expected to score."""
    r = F.avg(y)
    return df.filter(F.col(y).isNotNull()).agg(r.alias("rate"), (r * r + (1 - r) * (1 - r)).alias("accuracy"), (2 * r * (1 - r)).alias("brier"))


def valuation(df: DataFrame, price: str, shares: str) -> DataFrame:
    """``df`` with eps, price_earnings, price_book and price_sales; a missing or zero part gives a null."""
    value = F.col(price) * F.col(shares)
    return df.withColumns({
        "eps": F.try_divide("net_income", shares), "price_earnings": F.try_divide(value, "net_income"),
        "price_book": F.try_divide(value, "stockholders_equity"), "price_sales": F.try_divide(value, "revenue"),
    })


def dickey_fuller(df: DataFrame, x: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """(key, statistic, n): the Dickey-Fuller statistic with a constant and without lags of each entity, the t value
    of the level in the regression of its changes. Null below four changes or without spread."""
    known = df.filter(F.col(x).isNotNull())
    before = F.lag(x).over(W.partitionBy(key).orderBy(order))
    steps = known.withColumn("_l", before).filter("_l IS NOT NULL").withColumn("_d", F.col(x) - F.col("_l"))
    left = F.regr_syy("_d", "_l") * (1 - F.regr_r2("_d", "_l"))
    error = F.sqrt(F.try_divide(F.greatest(left, F.lit(0.0)), (F.count("*") - 2) * F.regr_sxx("_d", "_l")))
    return steps.groupBy(key).agg(F.when(F.count("*") >= 4, F.try_divide(F.regr_slope("_d", "_l"), error)).alias("statistic"), F.count("*").alias("n"))


def least_order(df: DataFrame, x: str, orders: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), confidence: float = 0.95, tolerance: float = 1e-2, key: str = "ticker", order: str = "date") -> DataFrame:
    """(key, d, statistic): the least order of fractional differencing that makes an entity's series stationary by
    ``dickey_fuller``; both null where none does. Each entity is judged by itself."""
    parts = None
    for d in orders:
        one = dickey_fuller(fractional_difference(df, x, d, "_fd", tolerance, key, order), "_fd", key, order).select(key, F.lit(float(d)).alias("_o"), "statistic")
        parts = one if parts is None else parts.union(one)
    passed = parts.filter(F.col("statistic") < CRITICAL[confidence]).groupBy(key).agg(F.min("_o").alias("d"), F.min_by("statistic", "_o").alias("statistic"))
    return df.select(key).distinct().join(passed, key, "left")


def loadings(df: DataFrame, features: list[str]) -> DataFrame:
    """(component, feature, loading, communality): eigenvectors of the correlation matrix over rows without nulls,
    scaled by the roots of their eigenvalues, the largest entry of each positive; communality is the share of the
    feature that the components with an eigenvalue above 1 explain."""
    import numpy as np

    known = df.select(*features).dropna()
    row = known.agg(*[correlation(F.col(a), F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j]).first()
    m = np.eye(len(features))
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            m[i, j] = m[j, i] = row[f"{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    scaled = vectors * np.sqrt(np.maximum(values, 0.0))
    scaled = scaled * np.where(scaled[np.abs(scaled).argmax(axis=0), np.arange(len(features))] < 0, -1.0, 1.0)
    shared = (scaled[:, values > 1] ** 2).sum(axis=1)
    out = [(k, f, float(scaled[i, k]), float(shared[i])) for k in range(len(features)) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "component int, feature string, loading double, communality double")


def pca_features(df: DataFrame, features: list[str], cfg: dict) -> DataFrame:
    """``df`` with components, an array of the first ``cfg['features']['components']`` principal components of the
    standardised features, nulls counting as 0; ``df`` itself where that setting is missing or 0."""
    n = cfg["features"].get("components") or 0
    if not n:
        return df
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), PCA(k=min(n, len(features)), inputCol="_std", outputCol="_c")]
    data = matrix(df, features)
    return Pipeline(stages=stages).fit(data).transform(data).withColumn("components", vector_to_array("_c")).drop("_raw", "_std", "_c")


def grid_search(rows: DataFrame, features: list[str], cfg: dict, grid: dict[str, list]) -> DataFrame:
    """(setting, folds, accuracy, logloss, auc, one column for each entry of the grid): the purged folds' mean figures
    of each combination of ``rounds`` and ``depth``. The rows are written once; a setting costs its fits only."""
    data = kept(rows, "grid-rows")
    names, parts = sorted(grid), None
    for i, chosen in enumerate(product(*[grid[n] for n in names])):
        figures = evaluate_folds(data, features, cfg, **dict(zip(names, chosen, strict=True)))
        one = figures.agg(F.count("*").alias("folds"), F.avg("accuracy").alias("accuracy"), F.avg("logloss").alias("logloss"), F.avg("auc").alias("auc"))
        one = one.select(F.lit(i).alias("setting"), "*", *[F.lit(v).alias(n) for n, v in zip(names, chosen, strict=True)])
        parts = one if parts is None else parts.union(one)
    return parts


def compare_models(train: DataFrame, test: DataFrame, features: list[str], label: str = "label_binary", rounds: int = 20, trees: int = 50) -> DataFrame:
    """(model, n_train, n_test, accuracy, logloss, auc) of boosted trees, a balanced forest and Gaussian naive Bayes on
    the same rows."""
    fitted, known = kept(matrix(train, features), "train"), kept(matrix(test, features), "test")
    bayes = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), NaiveBayes(featuresCol="features", labelCol=label, modelType="gaussian")])
    models = {"boosted_trees": (primary_model(features, label, rounds), fitted), "forest": (meta_model(features, label, trees), balanced(fitted, label)), "naive_bayes": (bayes, fitted)}
    n, parts = fitted.count(), None
    for name, (model, rows) in models.items():
        one = scored(model.fit(rows), known).select(F.lit(name).alias("fold"), F.lit(n).cast("long").alias("n_train"), "p", label)
        parts = one if parts is None else parts.union(one)
    return fold_figures(kept(parts, "scores"), label).withColumnRenamed("fold", "model")


def out_of_fold(rows: DataFrame, features: list[str], folds: int = 5, rounds: int = 5, least: int = 100, label: str = "label_binary") -> DataFrame:
    """``rows`` with oof_fold and call: every fold is called by a model of the folds before it, and the folds that have
    fewer than ``least`` rows before them by a model of fold 0 itself, or by the commoner label where fold 0 is too small
    as well or holds one label only."""
    numbered = kept(expanding_folds(matrix(rows, features), folds), "numbered")
    counts = {r["oof_fold"]: (r["n"], r["y"]) for r in numbered.groupBy("oof_fold").agg(F.count("*").alias("n"), F.sum(label).alias("y")).collect()}  # a row a fold

    def model(upto: int):
        n, y = (sum(counts.get(k, (0, 0))[i] for k in range(upto)) for i in (0, 1))
        return primary_model(features, label, rounds).fit(numbered.filter(F.col("oof_fold") < upto)) if n >= least and 0 < y < n else None

    total = sum(n for n, _ in counts.values())
    common = int(2 * sum(y for _, y in counts.values()) > total)
    first, parts = model(1), None
    for k in sorted(counts):
        part, own = numbered.filter(F.col("oof_fold") == k), (model(k) if k else None) or first
        called = scored(own, part).withColumn("call", (F.col("p") > 0.5).cast("int")).drop("p") if own else part.withColumn("call", F.lit(common))
        parts = called if parts is None else parts.union(called)
    return (numbered.withColumn("call", F.lit(0)) if parts is None else parts).drop("place")


def sweep(decisions: DataFrame, prices: DataFrame, cfg: dict, methods: list[str], least: list[float], legs: list[str], names: list[float]) -> DataFrame:
    """(config_id, method, least, leg, max_name, n_positions, the figures of ``performance``): every combination of bet
    sizing, portfolio leg and name's cap, from decisions (date, ticker, sector, direction, probability and the numeric
    exposures of ``cfg['neutralization']``) through neutralisation, portfolio and replay. n_positions counts bets that
    aren't 0; bets of 0 stay in the cross-section.

    Sizings are rows, neutralised in one pass; each leg and cap adds a portfolio to the plan, and one replay serves all.
    A setting whose replay has no day has no row."""
    c, e = cfg["neutralization"], cfg["execution"]
    sizings = [(i, m, lo) for i, (m, lo) in enumerate(product(methods, least))]
    places = list(product(legs, names))
    sizing = decisions.sparkSession.createDataFrame(sizings, "sizing int, method string, least double")
    settings = decisions.sparkSession.createDataFrame([(i * len(places) + j, i, m, lo, leg, cap) for i, m, lo in sizings for j, (leg, cap) in enumerate(places)], "config_id int, sizing int, method string, least double, leg string, max_name double")
    bet = bet_size(F.col("direction"), F.col("probability"), F.col("method"), F.col("least"), cfg["bets"]["cap"])
    sized = kept(decisions.crossJoin(F.broadcast(sizing)).withColumn("score", bet), "sized")  # as many rows as sizings
    numeric = [x for x in c["exposures"] if x != "sector"]
    scores = kept(neutralise(sized, numeric, c["proportion"], ("sizing", "date")).withColumn("score", F.col("neutral")), "scores") if c["enabled"] else sized
    parts = None
    for j, (leg, cap) in enumerate(places):
        own = cfg | {"portfolio": cfg["portfolio"] | {"leg": leg, "max_name": cap}}
        one = rank_portfolio(scores.select("sizing", "date", "ticker", "sector", "score"), own, ("sizing", "date"))
        one = one.select((F.col("sizing") * len(places) + j).alias("config_id"), "date", "ticker", "weight")
        parts = one if parts is None else parts.union(one)
    daily = replay(kept(parts, "weights"), kept(prices, "bars"), e["stagger_days"], e["cost_bps"], ("config_id",))
    counts = sized.groupBy("sizing").agg(F.count_if(F.col("score") != 0).alias("n_positions"))
    return performance(kept(daily, "daily"), ("config_id",)).join(F.broadcast(settings.join(counts, "sizing").drop("sizing")), "config_id")
