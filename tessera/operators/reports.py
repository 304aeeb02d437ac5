"""Data behind the reports: coverage, missing values, correlations, histograms, folds, drivers and ledgers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import correlation
from .backtest import growth

#: Stretches of the range of probabilities.
STRETCHES = 65_535


def coverage_by_month(df: DataFrame, features: list[str]) -> DataFrame:
    """(month, feature, share): share of known values of each feature by month."""
    known = df.groupBy(F.last_day("date").alias("month")).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features])
    return known.unpivot(["month"], features, "feature", "share")


def names_by_date(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and ends of the number of entities by date."""
    n = df.groupBy("date").agg(F.countDistinct("ticker").alias("n"))
    return n.agg(F.count("*").alias("dates"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


def missing_rate(df: DataFrame, features: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return row.unpivot([], features, "feature", "missing")


def never_known(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(ticker, metric): metrics that an entity never has."""
    counts = df.groupBy("ticker").agg(*[F.count(c).alias(c) for c in metrics])
    return counts.unpivot(["ticker"], metrics, "metric", "n").filter("n = 0").select("ticker", "metric")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair over rows with both, in one pass."""
    pairs = list(combinations(features, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("r")) for a, b in pairs]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): bin 0 is below ``low``, bin ``bins`` + 1 from ``high`` on."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def fold_report(folds: DataFrame) -> DataFrame:
    """Mean, deviation, ends of each figure of the folds, and the best accuracy over the mean."""
    figures = ["accuracy", "logloss", "auc"]
    long = folds.unpivot(["fold"], figures, "figure", "x")
    return long.groupBy("figure").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.try_divide(F.max("x"), F.avg("x")).alias("best_to_mean"))


def top_drivers(contributions: DataFrame, key: str, array: str, names: list[str], n: int = 3) -> DataFrame:
    """(key, top_drivers): the n largest contributions by size, as name(+0.000), joined by bars."""
    named = F.transform(F.col(array), lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), x.alias("x")))
    label = lambda s: F.concat(F.element_at(F.array(*[F.lit(v) for v in names]), s["i"] + 1), F.lit("("), F.format_string("%+.3f", s["x"].cast("double")), F.lit(")"))
    return contributions.select(key, F.array_join(F.transform(F.slice(F.array_sort(named), 1, n), label), " | ").alias("top_drivers"))


def decision_ledger(bets: DataFrame, drivers: DataFrame | None, key: str, n: int) -> DataFrame:
    """The n bets of the highest conviction (ties by key), ranked from 1, with their drivers by key."""
    top = bets.orderBy(F.desc("meta_conviction"), key).limit(n)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("meta_conviction"), key)))  # of n rows
    return ranked if drivers is None else ranked.join(drivers, key, "left")


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts by outcome, with precision, recall and F1 of label 1."""
    tp, fp, fn, tn = (F.count_if((F.col(predicted) == p) & (F.col(actual) == a)) for p, a in ((1, 1), (1, 0), (0, 1), (0, 0)))
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return c.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def probability_scores(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(brier, climatology, ece, logloss, auc) of probabilities of label 1. The AUC is the exact rank sum."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    base = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    by = base.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    ece = by.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
    # rank sums by distinct probability: the values below come from totals of stretches of the range, and from a
    # window within a stretch, so no task orders all values
    ends = base.agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    place = F.coalesce(F.floor(F.try_divide(F.col(p) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * STRETCHES), F.lit(0))
    values = base.groupBy(p).agg(F.sum(y).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg")).crossJoin(F.broadcast(ends)).withColumn("_s", place)  # one row
    totals = values.groupBy("_s").agg(F.sum("_neg").alias("_n")).select(F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_neg").over(W.partitionBy("_s").orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.col("_before") + F.col("_inside")
    auc = values.withColumn("_inside", inside).join(totals, F.col("_s") == F.col("_t")).withColumn("_below", below).agg(F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)), F.sum("_pos") * F.sum("_neg")).alias("auc"))
    one = base.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("climatology"), (-F.avg(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))).alias("logloss"))
    return one.crossJoin(ece).crossJoin(auc)  # one row each


def strong_pairs(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """The pairs of ``correlations`` whose size is above ``least``, the strongest first."""
    return pairs.filter(F.abs("r") > least).orderBy(F.desc(F.abs("r")), "a", "b")


def waterfall(explained: DataFrame, features: list[str], key: str, n: int = 10) -> DataFrame:
    """(key, place, feature, contribution, start, end): the data of a waterfall plot of each row of
    ``explained`` (key, contributions), its n largest contributions by size and the sum of the others."""
    named = F.transform("contributions", lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), x.alias("x")))
    sorted_ = explained.select(key, F.array_sort(named).alias("_s"))
    top = F.transform(F.slice("_s", 1, n), lambda s: F.struct(F.element_at(F.array(*[F.lit(f) for f in features]), s["i"] + 1).alias("feature"), s["x"].alias("x")))
    rest = F.aggregate(F.slice("_s", n + 1, max(1, len(features))), F.lit(0.0), lambda a, s: a + s["x"])
    each = sorted_.select(key, F.when(F.size("_s") > n, F.concat(top, F.array(F.struct(F.lit("others").alias("feature"), rest.alias("x"))))).otherwise(top).alias("_t"))
    bars = each.select(key, "_t", F.posexplode("_t").alias("place", "b"))
    upto = lambda k: F.aggregate(F.slice("_t", 1, k), F.lit(0.0), lambda a, s: a + s["x"])
    return bars.select(key, "place", F.col("b.feature").alias("feature"), F.col("b.x").alias("contribution"), upto(F.col("place")).alias("start"), upto(F.col("place") + 1).alias("end"))


def interaction(rows: DataFrame, explained: DataFrame, features: list[str], key: str, one: str, other: str) -> DataFrame:
    """(key, x, contribution, other): the data of a dependence plot, a feature's value and contribution and the
    value of another feature."""
    at = features.index(one)
    return rows.select(key, F.col(one).alias("x"), F.col(other).alias("other")).join(explained.select(key, F.col("contributions")[at].alias("contribution")), key).select(key, "x", "contribution", "other")


def split_summary(split: DataFrame, label: str = "label_binary") -> DataFrame:
    """(part, n, first, last, rate): rows, dates and share of label 1 of each part of a split."""
    return split.groupBy("part").agg(F.count("*").alias("n"), F.min("entry_date").alias("first"), F.max("entry_date").alias("last"), F.avg(label).alias("rate"))


def filter_rate(bets: DataFrame, bet: str = "bet") -> DataFrame:
    """(n, kept, rate): how many bets aren't 0."""
    kept = F.count_if(F.col(bet) != 0)
    return bets.agg(F.count("*").alias("n"), kept.alias("kept"), F.try_divide(kept, F.count("*")).alias("rate"))


def side_by_side(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(figure, strategy, benchmark): the figures of ``backtest.performance`` of both."""
    from .backtest import performance

    both = strategy.select(F.lit("strategy").alias("who"), "date", "ret").union(benchmark.select(F.lit("benchmark"), "date", "ret"))
    figures = performance(both, ("who",))
    names = [c for c in figures.columns if c != "who"]
    long = figures.select("who", *[F.col(c).cast("double") for c in names]).unpivot(["who"], names, "figure", "x")
    return long.groupBy("figure").pivot("who", ["strategy", "benchmark"]).agg(F.first("x"))


def against_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, wealth, benchmark_wealth): growth of 1 of both; a day that the benchmark lacks counts as 0."""
    w = W.partitionBy(F.lit("all")).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    both = returns.select("date", "ret").join(benchmark.select("date", F.col("ret").alias("_b")), "date", "left").withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    return both.select("date", growth(w).alias("wealth"), growth(w, "_b").alias("benchmark_wealth"))


def rebalance_listing(weights: DataFrame) -> DataFrame:
    """(date, ticker, direction, weight_pct) of every name of each rebalance; one of weight 0 counts as Short."""
    return weights.select("date", "ticker", F.when(F.col("weight") > 0, "Long").otherwise("Short").alias("direction"), (F.abs("weight") * 100).alias("weight_pct"))


def principal_components(df: DataFrame, features: list[str]) -> DataFrame:
    """(component, eigenvalue, share, cumulative, kaiser) of the correlation matrix over rows without nulls."""
    import numpy as np

    known = df.select(*features).dropna()
    row = known.agg(*[correlation(F.col(a), F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j]).first()
    m = np.eye(len(features))
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            m[i, j] = m[j, i] = row[f"{i}_{j}"] or 0.0
    values = sorted((float(v) for v in np.linalg.eigvalsh(m)), reverse=True)
    total, so_far, out = sum(values), 0.0, []
    for i, v in enumerate(values):
        so_far += v / total
        out.append((i, v, v / total, so_far, v > 1))
    return df.sparkSession.createDataFrame(out, "component int, eigenvalue double, share double, cumulative double, kaiser boolean")
