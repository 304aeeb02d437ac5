"""Canonical panels made of the driver's tables.

Prices: an entity is a nation, its bars are the day's line items. Filings: an order is a filing of its
customer's nation. Cross-sections: suppliers by month. Events: probabilities by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DURATION = ["revenue", "net_income", "operating_cash_flow"]
INSTANT = ["total_assets", "total_liabilities", "stockholders_equity"]
METRICS = DURATION + INSTANT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, sector, open, high, low, close, adj_close, volume; one row an entity and day."""
    line, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("s_suppkey", "n_name", "r_name")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    trade = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = lambda t: F.col(f"{t}.l_extendedprice") / F.col(f"{t}.l_quantity")
    bars = line.join(named, line.l_suppkey == named.s_suppkey).groupBy(F.col("n_name").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
    summed = bars.agg(F.first("r_name").alias("sector"), F.min(trade).alias("_first"), F.max(px).alias("high"), F.min(px).alias("low"), F.max(trade).alias("_last"), F.sum("l_quantity").alias("volume"))
    return summed.select("ticker", "date", "sector", price("_first").alias("open"), "high", "low", price("_last").alias("close"), price("_last").alias("adj_close"), "volume")


def filings(spark: SparkSession, sf_dir: str, entity: str = "n_name") -> DataFrame:
    """ticker (the nation, or another expression), fiscal_period_end, sec_acceptance_date, form_type, six metrics and the key of the filing."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    day, key, price = F.col("o_orderdate").cast("date"), F.col("o_orderkey"), F.col("o_totalprice")
    unless = lambda n, value: F.when(key % n != 0, value)
    return named.select(
        F.expr(entity).alias("ticker"), F.date_sub(day, (key % 60 + 30).cast("int")).alias("fiscal_period_end"), day.alias("sec_acceptance_date"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form_type"), key.alias("filing"),
        unless(7, price).alias("revenue"), unless(7, price * 0.1 - 500).alias("net_income"), F.when(key % 11 != 0, F.col("c_acctbal")).alias("operating_cash_flow"),
        unless(5, price * 3).alias("total_assets"), (price * 1.25).alias("total_liabilities"), unless(13, price * 1.75).alias("stockholders_equity"),
    )


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (month end), ticker (supplier), sector, and three features; px is null for some suppliers."""
    line, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("s_suppkey", "r_name", "s_acctbal")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    by = line.join(named, line.l_suppkey == named.s_suppkey).groupBy(F.col("s_suppkey").alias("ticker"), F.last_day(F.col("l_shipdate").cast("date")).alias("date"))
    out = by.agg(F.first("r_name").alias("sector"), F.first("s_acctbal").alias("size"), F.avg(px).alias("px"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    return out.withColumn("px", F.when(F.col("ticker") % 13 != 0, F.col("px")))


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, prob (a probability from the value), direction (-1 or 1), label (0 or 1)."""
    events = table(spark, sf_dir, "events")
    top = events.select(F.max(F.abs("value")).alias("top"))
    scaled = events.crossJoin(F.broadcast(top))  # one row
    return scaled.select("event_id", "user_id", "event_type", "ts", F.try_divide(F.abs("value"), F.col("top")).alias("prob"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"), (F.col("event_id") % 3 == 0).cast("int").alias("label"))
