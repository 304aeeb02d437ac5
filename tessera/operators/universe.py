"""Membership by change events, survivorship, deduplication of filings, and JSON facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The tags of each metric, by priority.
TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"],
    "net_income": ["NetIncomeLoss"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "stockholders_equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
}


def membership(constituents: DataFrame, changes: DataFrame, start: str, end: str) -> DataFrame:
    """(date, ticker, sector): members at each month end, walking back from today's constituents.

    A name's next event after the month decides: it was a member if that is a removal, or, without one, if it
    is a member today. Within a month the order of the changes decides, an addition being undone before a
    removal of the same row (``seq``). Events after the last month in the range are not undone.
    """
    spark = constituents.sparkSession
    months = spark.sql(f"SELECT explode(sequence(last_day(DATE'{start}'), last_day(DATE'{end}'), interval 1 month)) AS d").select(F.last_day("d").alias("date"))
    name = lambda c: F.regexp_replace(c, r"\.", "-")
    known = changes.filter(F.col("date").isNotNull() & (F.last_day("date") <= F.last_day(F.lit(end).cast("date"))))
    events = known.select(F.last_day("date").alias("month"), "seq", F.explode(F.array(F.struct(name("added").alias("ticker"), F.lit(0).alias("removal")), F.struct(name("removed").alias("ticker"), F.lit(1).alias("removal")))).alias("e")).select("month", "seq", "e.ticker", "e.removal").filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    # the state before a month's events, seen backwards, is set by the month's last one
    undone = events.groupBy("ticker", "month").agg(F.max_by("removal", F.struct("seq", "removal")).alias("was"))
    now = constituents.select(name("ticker").alias("ticker"), "sector").dropDuplicates(["ticker"])
    tickers = now.select("ticker").union(undone.select("ticker")).distinct()
    # validity intervals: a state holds for the months from the event before up to its own
    before = F.lag("month").over(W.partitionBy("ticker").orderBy("month"))
    states = undone.withColumn("_from", before).select("ticker", "_from", F.col("month").alias("_to"), "was")
    latest = undone.groupBy("ticker").agg(F.max("month").alias("_from"))
    today = tickers.join(latest, "ticker", "left").join(now.select("ticker", F.lit(1).alias("_is")), "ticker", "left").select("ticker", "_from", F.lit(None).cast("date").alias("_to"), F.coalesce("_is", F.lit(0)).alias("was"))
    spans = states.unionByName(today).filter("was = 1")
    lo, hi = F.last_day(F.lit(start).cast("date")), F.last_day(F.lit(end).cast("date"))
    first = F.greatest(F.coalesce(F.col("_from"), lo), lo)
    last = F.when(F.col("_to").isNull(), hi).otherwise(F.least(hi, F.last_day(F.add_months("_to", -1))))
    inside = spans.withColumns({"_a": first, "_z": last}).filter("_a <= _z")
    listed = inside.select("ticker", F.explode(F.sequence(F.trunc("_a", "MM"), F.trunc("_z", "MM"), F.expr("interval 1 month"))).alias("d")).select(F.last_day("d").alias("date"), "ticker").distinct()
    return listed.join(months, "date").join(now, "ticker", "left").select("date", "ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


def survivorship(universe: DataFrame, constituents: DataFrame) -> DataFrame:
    """(date, members, gone): members of each date, and how many of them aren't members today."""
    now = constituents.select("ticker", F.lit(1).alias("_now")).distinct()
    return universe.join(now, "ticker", "left").groupBy("date").agg(F.countDistinct("ticker").alias("members"), F.sum(F.col("_now").isNull().cast("int")).alias("gone"))


def best_rows(filings: DataFrame, metrics: list[str], keys: list[str], ties: list[str]) -> DataFrame:
    """The row of each key with the most known metrics, the first by ``ties`` among equals."""
    known = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    order = W.partitionBy(*keys).orderBy(F.desc("n_known"), *ties)
    return filings.withColumn("n_known", known).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def padded_ids(names: DataFrame) -> DataFrame:
    """ticker in upper case and its ten-digit id."""
    return names.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("id").cast("string"), 10, "0").alias("id"))


FACTS = "struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<struct<`end`:string,form:string,filed:string,val:double>>>>>>>"


def flatten_facts(docs: DataFrame, tags: dict[str, list[str]], forms: tuple[str, ...] = ("10-K", "10-Q"), since: str = "1900-01-01", compat_first_seen: bool = False) -> DataFrame:
    """(ticker, fiscal_period_end, form_type, sec_acceptance_date, metrics): nested facts as rows.

    For each metric of a (form, end) the first candidate tag that has a complete fact wins, and of a tag's
    facts the first filed (or the first listed, if ``compat_first_seen``). The acceptance date is the latest
    filing date of the metrics used, so no metric is known too early (or, if ``compat_first_seen``, that of
    the first fact seen).
    """
    spark = docs.sparkSession
    ranked = spark.createDataFrame([(t, m, j, i) for i, (m, ts) in enumerate(tags.items()) for j, t in enumerate(ts)], "tag string, metric string, tag_rank int, metric_rank int")
    parsed = docs.select("ticker", F.from_json("doc", FACTS).alias("j")).select("ticker", F.explode("j.facts.us-gaap").alias("tag", "concept"))
    facts = parsed.select("ticker", "tag", F.posexplode(F.try_element_at("concept.units", F.lit("USD"))).alias("at", "f"))
    flat = facts.select("ticker", "tag", "at", F.col("f.end").cast("date").alias("fiscal_period_end"), F.col("f.form").alias("form_type"), F.col("f.filed").cast("date").alias("filed"), F.col("f.val").alias("val"))
    kept = flat.filter(F.col("form_type").isin(*forms) & F.col("fiscal_period_end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull() & (F.col("filed") >= F.lit(since).cast("date"))).join(F.broadcast(ranked), "tag")
    order = F.struct("tag_rank", "at") if compat_first_seen else F.struct("tag_rank", "filed", "at")
    seen = F.struct("metric_rank", "tag_rank", "at")
    each = kept.groupBy("ticker", "fiscal_period_end", "form_type", "metric").agg(F.min_by("val", order).alias("val"), F.min_by("filed", order).alias("filed"), F.min(seen).alias("_seen"), F.min_by("filed", seen).alias("_first"))
    accepted = F.min_by("_first", "_seen") if compat_first_seen else F.max("filed")
    when = each.groupBy("ticker", "fiscal_period_end", "form_type").agg(accepted.alias("sec_acceptance_date"), *[F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in tags])
    return when


def data_pipeline(constituents: DataFrame, changes: DataFrame, wide_prices: DataFrame, docs: DataFrame, series: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """The data stages by name, lazily: universe (members at month ends), prices (long, of names that were ever
    members), fundamentals (the best row of each period and form), macro (a column for each series, filled forward)."""
    from .features import long_prices, series_panel

    members = membership(constituents, changes, start, end)
    ever = members.select("ticker").distinct()
    facts = flatten_facts(docs.join(ever, "ticker", "left_semi"), TAGS)
    names = sorted(r[0] for r in series.select("series").distinct().collect())  # one for each macro series
    return {
        "universe": members, "prices": long_prices(wide_prices).join(ever, "ticker", "left_semi"),
        "fundamentals": best_rows(facts, list(TAGS), ["ticker", "fiscal_period_end", "form_type"], ["sec_acceptance_date"]),
        "macro": series_panel(series, names),
    }
