"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import forward_fill, history
from ..sources.panels import DURATION, INSTANT


def asof_join(left: DataFrame, right: DataFrame, values: list[str], ties: list[str], key: str = "ticker", left_on: str = "date", right_on: str = "sec_acceptance_date") -> DataFrame:
    """Each left row with the last right row of its key at or before its date, taken as a whole.

    Right rows of one key and date count by the largest ``ties``. Both sides are stacked and the last right
    row is carried forward: one shuffle by key and no join. A right side without a match gives nulls.
    """
    best = right.filter(F.col(right_on).isNotNull()).groupBy(key, F.col(right_on).alias("_at")).agg(F.max_by(F.struct(*values), F.struct(*ties)).alias("_row"))
    kind = best.schema["_row"].dataType
    stacked = left.filter(F.col(left_on).isNotNull()).withColumns({"_at": F.col(left_on), "_row": F.lit(None).cast(kind), "_side": F.lit(1)})
    both = stacked.unionByName(best.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = history(key).orderBy("_at", "_side")
    carried = both.withColumn("_row", F.last("_row", ignorenulls=True).over(order)).filter("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_row.{v}").alias(v) for v in values])


def point_in_time(decisions: DataFrame, filings: DataFrame) -> DataFrame:
    """The decision rows with duration metrics of the last annual filing and instant metrics of the last
    filing of any form, both carried forward over the decision rows of an entity. ``sec_acceptance_date``
    is that of the annual filing."""
    ties = ["fiscal_period_end", "form_type", "filing"]
    annual = asof_join(decisions, filings.filter(F.col("form_type") == "10-K"), ["sec_acceptance_date", *DURATION], ties)
    both = asof_join(annual, filings, INSTANT, ties)
    return both.withColumns({c: forward_fill(F.col(c)) for c in DURATION + INSTANT})


def compliance(merged: DataFrame) -> DataFrame:
    """Lag between acceptance and decision by entity, and how many decisions came before acceptance."""
    lag = F.datediff("date", "sec_acceptance_date")
    known = merged.filter(F.col("sec_acceptance_date").isNotNull()).withColumn("lag", lag)
    return known.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("lag").alias("mean_lag"), F.median("lag").alias("median_lag"), F.min("lag").alias("min_lag"), F.count_if(F.col("lag") < 0).alias("violations"))


def check_compliance(merged: DataFrame) -> DataFrame:
    """``compliance``, raising if any decision used a filing before its acceptance."""
    report = compliance(merged)
    bad = report.agg(F.sum("violations")).first()[0] or 0
    if bad:
        raise ValueError(f"{bad} rows use filings from after their date")
    return report


def with_sector(df: DataFrame, dimension: DataFrame, key: str = "ticker") -> DataFrame:
    """The sector that an entity had first, or Unknown."""
    first = dimension.groupBy(F.col(key).alias("_k")).agg(F.min_by("sector", "date").alias("_sector"))
    named: Column = F.coalesce("_sector", F.lit("Unknown"))
    return df.join(first, F.col(key) == F.col("_k"), "left").withColumn("sector", named).drop("_k", "_sector")
