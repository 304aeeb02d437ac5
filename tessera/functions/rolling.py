"""Rolling, cumulative and rank columns over a panel, as built-in window expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spreads below this count as none, so quotients of rounding errors never come out.
TINY = 1e-12


def history(key: str = "ticker", order: str = "date"):
    """All rows of an entity up to the present one."""
    return W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def rolling(x: Column, n: int, how: Callable[[Column], Column], key: str = "ticker", order: str = "date", least: int | None = None) -> Column:
    """``how`` over the last n rows where ``least`` of them (all unless said otherwise) aren't null."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= (n if least is None else least), how(x).over(w))


def lagged(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return F.lag(x, n).over(W.partitionBy(key).orderBy(order))


def forward_fill(x: Column, key: str = "ticker", order: str = "date") -> Column:
    return F.last(x, ignorenulls=True).over(history(key, order))


def pct_change(x: str, key: str = "ticker", order: str = "date") -> Column:
    """The change against the last known value of the row before; null where that is 0."""
    before = F.last(x, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return F.try_divide(forward_fill(F.col(x), key, order), before) - 1


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows with both; null where one has no spread (``corr`` divides by zero there)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def unless_tiny(x: Column) -> Column:
    return F.when(F.abs(x) >= TINY, x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ewm_mean(df: DataFrame, x: Column, span: int, out: str, key: str = "ticker", order: str = "date", block: int = 512) -> DataFrame:
    """Exponentially weighted mean with weights (1 - a)^age, a = 2 / (span + 1), from ``span`` values on.

    The weighted sums are prefix sums with growing weights; rows are numbered in blocks whose totals carry
    over, so the weights never overflow however long a history is.
    """
    keep = 1 - 2 / (span + 1)
    by = W.partitionBy(key).orderBy(order)
    numbered = df.withColumn("_x", x).withColumn("_i", F.row_number().over(by) - 1)
    numbered = numbered.withColumn("_block", F.floor(F.col("_i") / block)).withColumn("_g", F.pow(F.lit(keep), -(F.col("_i") % block).cast("double")))
    inside = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    known = F.col("_x").isNotNull()
    summed = numbered.withColumns({"_s": F.sum(F.when(known, F.col("_x") * F.col("_g"))).over(inside), "_w": F.sum(F.when(known, F.col("_g"))).over(inside)})
    # totals of a block, brought to the weight of its end, fade by keep^block for each block that follows
    fade = keep**block
    ends = summed.groupBy(key, "_block").agg(F.max_by("_s", "_i").alias("_es"), F.max_by("_w", "_i").alias("_ew"))
    past = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    faded = lambda c: F.aggregate(F.collect_list(F.coalesce(c, F.lit(0.0))).over(past), F.lit(0.0), lambda s, v: s * fade + v)
    carried = ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), (faded(F.col("_es")) * fade).alias("_cs"), (faded(F.col("_ew")) * fade).alias("_cw"))
    joined = summed.join(carried, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    mean = F.try_divide(F.coalesce("_s", F.lit(0.0)) + F.col("_cs"), F.coalesce("_w", F.lit(0.0)) + F.col("_cw"))
    enough = F.count("_x").over(history(key, order)) >= span
    return joined.withColumn(out, F.when(enough, mean)).drop("_x", "_i", "_block", "_g", "_s", "_w", "_k", "_b", "_cs", "_cw")


def pct_rank(x: str, *by: str) -> Column:
    """Rank over the non-null values of a group, ties at their mean rank, divided by their number."""
    w = W.partitionBy(*by)
    rank = F.rank().over(w.orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(x).over(W.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(w))


def position(df: DataFrame, out: str, by: str, *ties: str) -> DataFrame:
    """0-based place of each row in the order of (by, ties) over the whole table. Counts by value of ``by``
    are summed up first, so only rows of one value meet in a window, never the table."""
    counts = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    before = counts.select("_by", F.coalesce(F.sum("_n").over(W.orderBy("_by").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(before, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, F.col("_before") + F.row_number().over(W.partitionBy(by).orderBy(*ties)) - 1).drop("_by", "_before")
