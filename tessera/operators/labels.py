"""Path-dependent labels: which of three barriers a price touches first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import ewm_mean, lagged


def month_ends(date: Column) -> Column:
    """Whether a date is the calendar's last of its month; a month that ends without a bar has no entry."""
    return date == F.last_day(date)


def fridays(date: Column) -> Column:
    return F.dayofweek(date) == 6


def triple_barrier(prices: DataFrame, cfg: dict, entry=month_ends) -> DataFrame:
    """ticker, entry_date, label, t_barrier, return_at_touch, barrier_type, ewma_vol, upper_barrier,
    lower_barrier, entry_price, label_binary.

    An entry is joined with the bars of its path by their numbers, so bars that enter nothing gather nothing; the
    first bar at or beyond a barrier decides, the upper one first on the same bar, else the sign of the return
    at the last bar.
    """
    c = cfg["labels"]
    bars, span = c["bars"], c["span"]
    by = W.partitionBy("ticker")
    order = by.orderBy("date")
    p = F.col("adj_close")
    base = prices.select("ticker", "date", "adj_close").withColumn("_r", F.abs(F.log(F.try_divide(p, lagged(p, 1)))))
    vol = ewm_mean(base, F.col("_r"), span, "ewma_vol")
    placed = vol.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(by)})
    entries = placed.filter(entry(F.col("date")) & (F.col("_n") >= span + bars + 10) & (F.col("_i") >= span) & (F.col("_i") + bars < F.col("_n")) & (F.col("ewma_vol") > 0))
    reach = F.col("ewma_vol") * math.sqrt(bars)
    walled = entries.withColumns({"upper_barrier": p * (1 + c["upper"] * reach), "lower_barrier": p * (1 - c["lower"] * reach)})
    path = walled.select("ticker", F.col("_i").alias("_entry"), "upper_barrier", "lower_barrier", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + bars)).alias("_i"))
    numbered = prices.select("ticker", F.struct("date", "adj_close").alias("_bar"), (F.row_number().over(order) - 1).alias("_i"))
    beyond = (F.col("_bar.adj_close") >= F.col("upper_barrier")) | (F.col("_bar.adj_close") <= F.col("lower_barrier"))
    met = path.join(numbered, ["ticker", "_i"]).groupBy("ticker", "_entry").agg(F.min_by("_bar", F.when(beyond, F.col("_i"))).alias("_hit"), F.max_by("_bar", "_i").alias("_last"))
    touched = walled.join(met.withColumnRenamed("_entry", "_i"), ["ticker", "_i"]).withColumn("_end", F.coalesce("_hit", "_last"))
    ret = (F.col("_end.adj_close") - p) / p
    kind = F.when(F.col("_hit").isNull(), "vertical").when(F.col("_hit.adj_close") >= F.col("upper_barrier"), "upper").otherwise("lower")
    named = touched.withColumns({"return_at_touch": ret, "barrier_type": kind})
    label = F.when(F.col("barrier_type") == "upper", 1).when(F.col("barrier_type") == "lower", -1).otherwise(F.signum("return_at_touch")).cast("int")
    out = named.select("ticker", F.col("date").alias("entry_date"), label.alias("label"), F.col("_end.date").alias("t_barrier"), "return_at_touch", "barrier_type", "ewma_vol", "upper_barrier", "lower_barrier", p.alias("entry_price"), (label == 1).cast("int").alias("label_binary"))
    vertical = F.col("barrier_type") == "vertical"
    if c["discard_vertical"]:
        out = out.filter(~vertical)
    return out.filter(~(vertical & (F.abs("return_at_touch") < c["min_return"])))


def run_labeling(prices: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(labels, their summary by barrier type): labels at month ends or, if set so, on Fridays."""
    found = triple_barrier(prices, cfg, fridays if cfg["labels"].get("entries") == "weekly" else month_ends)
    return found, label_summary(found)


def label_summary(labels: DataFrame) -> DataFrame:
    """Labels of each barrier type, a column for each label."""
    wide = labels.groupBy("barrier_type").pivot("label", [-1, 0, 1]).count().na.fill(0)
    return wide.select("barrier_type", F.col("-1").alias("down"), F.col("0").alias("flat"), F.col("1").alias("up"))


def holding_stats(labels: DataFrame) -> DataFrame:
    """Calendar days held by barrier type: count, mean, deviation, quartiles and ends."""
    days = F.datediff("t_barrier", "entry_date")
    q = lambda x: F.percentile("d", F.lit(x))
    return labels.withColumn("d", days).groupBy("barrier_type").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.min("d").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("d").alias("max"))


def label_rate_by_year(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.year("entry_date").alias("year")).agg(F.count("*").alias("n"), F.avg("label_binary").alias("rate"))


def meta_labels(predicted: Column, actual: Column) -> Column:
    """1 where the first model was right."""
    return (predicted == actual).cast("int")
