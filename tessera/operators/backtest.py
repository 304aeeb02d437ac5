"""Replay of rebalanced portfolios on daily returns, performance, regimes and trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import TINY, lagged, rolling
from .portfolio import turnover


def daily_returns(prices: DataFrame) -> DataFrame:
    """(date, ticker, ret): change against the bar before; a day without a bar has no row and no return."""
    p = F.col("adj_close")
    return prices.select("date", "ticker", (F.try_divide(p, lagged(p, 1)) - 1).alias("ret"))


def replay(weights: DataFrame, prices: DataFrame, stagger: int = 5, cost_bps: float = 7.5, by: tuple[str, ...] = (), compat: bool = True) -> DataFrame:
    """(by, date, gross, cost, ret): daily portfolio returns.

    A portfolio holds from the day after its date to the day before the next one's (or to that one, if not
    ``compat``). In its first ``stagger`` days it is blended with the one before. A rebalance's cost is
    spread over the portfolio days of one calendar month from its date. Dates that the calendar of prices
    lacks are skipped. The calendar and the rebalances, a row a day, are ordered in windows; names meet in
    equi-joins only.
    """
    calendar = prices.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")))
    held = weights.join(calendar, "date")
    group = [F.col(c) for c in by]
    reb = held.select(*by, F.col("date").alias("_reb"), "_i").distinct()
    order = W.partitionBy(*by).orderBy("_i") if by else W.orderBy("_i")
    reb = reb.withColumns({"_k": F.row_number().over(order), "_next": F.lead("_i").over(order)})
    last = calendar.agg(F.max("_i").alias("_end"))
    # a rebalance's days as a sequence of calendar places: an explode instead of a range join
    until = F.coalesce(F.col("_next") - (1 if compat else 0), F.col("_end"))
    spans = reb.crossJoin(F.broadcast(last)).filter(until > F.col("_i")).select(*by, "_reb", "_k", F.col("_i").alias("_from"), F.explode(F.sequence(F.col("_i") + 1, until)).alias("_i"))
    days = spans.join(calendar, "_i").withColumn("_d", F.col("_i") - F.col("_from") - 1)
    blend = F.when((F.col("_d") < stagger) & (F.col("_k") > 1), (F.col("_d") + 1) / stagger).otherwise(1.0)
    named = held.join(reb.select(*by, F.col("_reb").alias("date"), "_k"), [*by, "date"]).select(*by, "_k", "ticker", "weight")
    new = days.withColumn("_f", blend)
    old = new.filter("_f < 1").select(*by, "_reb", (F.col("_k") - 1).alias("_k"), "date", (1 - F.col("_f")).alias("_f"))
    active = new.select(*by, "_reb", "_k", "date", "_f").union(old).join(named, [*by, "_k"])
    ret = daily_returns(prices)
    gross = active.join(ret, ["date", "ticker"], "left").groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col("_f") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    # against the portfolio that was held: a skipped rebalance changed nothing
    costs = turnover(held.select(*by, "date", "ticker", "weight"), cost_bps, by).withColumnRenamed("date", "_reb")
    # cost days: dates are few, so each rebalance lists the days of its month
    month = costs.withColumn("date", F.explode(F.sequence("_reb", F.date_sub(F.add_months("_reb", 1), 1))))
    paid = month.join(gross.select(*by, "date"), [*by, "date"])
    shared = paid.withColumn("_c", F.col("cost") / F.count("*").over(W.partitionBy(*by, "_reb"))).groupBy(*by, "date").agg(F.sum("_c").alias("cost"))
    net = F.col("gross") - F.coalesce("cost", F.lit(0.0))
    return gross.join(shared, [*by, "date"], "left").select(*group, "date", "gross", F.coalesce("cost", F.lit(0.0)).alias("cost"), net.alias("ret"))


def equity(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``returns`` (date, ret) with wealth (growth of 1) and drawdown from its highest value so far. After a loss
    of all there is no wealth; a null return changes nothing."""
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit("all"))).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    grown = returns.withColumn("wealth", growth(w))
    return grown.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def growth(w=None, ret: str = "ret") -> Column:
    """The product of 1 + ret over a window, or over a group: 0 from a return of -1 or below on."""
    over = (lambda x: x) if w is None else (lambda x: x.over(w))
    r = F.col(ret)
    lost = over(F.max(F.when(r <= -1, 1).otherwise(0)))
    return F.when(lost == 1, 0.0).otherwise(F.exp(F.coalesce(over(F.sum(F.when(r > -1, F.log1p(r)))), F.lit(0.0))))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > TINY, a / b).otherwise(0.0)


def performance(returns: DataFrame, by: tuple[str, ...] = (), risk_free: float = 0.0) -> DataFrame:
    """Ten figures of a return stream (date, ret), or of each of several."""
    r = F.col("ret")
    month = F.expr("year(date) * 12 + month(date)")
    months = returns.groupBy(*by, month.alias("_m")).agg(F.sum("ret").alias("_r")).groupBy(*by).agg((F.count_if(F.col("_r") > 0) / (F.max("_m") - F.min("_m") + 1)).alias("monthly_positive_pct"))
    base = equity(returns, by).groupBy(*by).agg(growth().alias("_grown"), (F.stddev_samp(r) * math.sqrt(252)).alias("annualized_volatility"), (F.stddev_samp(F.when(r < 0, r)) * math.sqrt(252)).alias("_down"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("daily_hit_rate"), F.count("*").alias("n_days"))
    annual = F.pow("_grown", 252 / F.col("n_days")) - 1
    full = base.withColumn("annualized_return", annual)
    excess = F.col("annualized_return") - risk_free
    joined = full.join(months, list(by)) if by else full.crossJoin(months)  # one row each
    return joined.select(
        *by, (F.col("_grown") - 1).alias("total_return"), "annualized_return", "annualized_volatility", _ratio(excess, F.coalesce("annualized_volatility", F.lit(0.0))).alias("sharpe_ratio"), _ratio(excess, F.coalesce("_down", F.lit(0.0))).alias("sortino_ratio"),
        "max_drawdown", _ratio(F.col("annualized_return"), F.abs("max_drawdown")).alias("calmar_ratio"), "daily_hit_rate", "monthly_positive_pct", "n_days",
    )


def market(prices: DataFrame) -> DataFrame:
    """(date, ret) of the volume-weighted price of all entities."""
    level = prices.groupBy("date").agg((F.sum(F.col("adj_close") * F.col("volume")) / F.sum("volume")).alias("adj_close"))
    return daily_returns(level.withColumn("ticker", F.lit("market"))).filter(F.col("ret").isNotNull()).select("date", "ret")


def regimes(returns: DataFrame, market_returns: DataFrame, bull: float, bear: float, window: int = 126, least: int = 10) -> DataFrame:
    """Performance in bear, sideways and bull days, by the market's sum of returns over ``window`` days;
    intervals are closed above. Regimes of fewer than ``least`` days are left out."""
    total = market_returns.withColumn("_all", F.lit("market")).select("date", rolling(F.col("ret"), window, F.sum, "_all").alias("total")).filter(F.col("total").isNotNull())
    named = returns.join(total, "date").withColumn("regime", F.when(F.col("total") <= bear, "bear").when(F.col("total") <= bull, "sideways").otherwise("bull"))
    return performance(named.select("regime", "date", "ret"), ("regime",)).filter(F.col("n_days") >= least)


def monthly_returns(returns: DataFrame) -> DataFrame:
    """(month, ret): sums by month, with 0 in months without a row."""
    sums = returns.groupBy(F.last_day("date").alias("month")).agg(F.sum("ret").alias("_r"))
    spine = returns.agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.explode(F.expr("sequence(trunc(a, 'MM'), trunc(z, 'MM'), interval 1 month)")).alias("d")).select(F.last_day("d").alias("month"))
    return spine.join(sums, "month", "left").select("month", F.coalesce("_r", F.lit(0.0)).alias("ret"))


def rolling_sharpe(returns: DataFrame, window: int = 63) -> DataFrame:
    one = returns.withColumn("_all", F.lit("series"))
    r = F.col("ret")
    spread = rolling(r, window, F.stddev_samp, "_all")
    return one.select("date", F.when(spread >= TINY, rolling(r, window, F.avg, "_all") / spread * math.sqrt(252)).alias("sharpe"))


def trades(weights: DataFrame, prices: DataFrame, held_only: bool = False) -> DataFrame:
    """(reb_date, entry_date, exit_date, ticker, direction, weight, entry_price, exit_price, ret, won).

    A name of a rebalance is entered at its first bar after that date and left at its last bar up to the next
    rebalance (the last one: to the end of the prices); names without a bar in between have no trade.
    Names of weight 0 are listed as Short, with the price's own return, unless ``held_only``.
    """
    dates = weights.select("date").distinct()
    until = prices.agg(F.max("date").alias("_until"))
    reb = dates.crossJoin(F.broadcast(until)).withColumn("_exit", F.coalesce(F.lead("date").over(W.orderBy("date")), F.col("_until"))).drop("_until").filter(F.col("_exit") > F.col("date"))
    # each day belongs to the rebalance that it follows: an equi-join instead of a range join
    days = reb.select(F.col("date").alias("_reb"), F.explode(F.sequence(F.date_add("date", 1), F.col("_exit"))).alias("date"))
    bars = prices.select("ticker", "date", "adj_close").join(days, "date")
    of = bars.groupBy("ticker", "_reb").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), F.min_by("adj_close", "date").alias("entry_price"), F.max_by("adj_close", "date").alias("exit_price"))
    held = weights.filter(F.abs("weight") > TINY) if held_only else weights
    joined = held.select(F.col("date").alias("_reb"), "ticker", "weight").join(of, ["ticker", "_reb"])
    ret = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * F.when(F.col("weight") < 0, -1.0).otherwise(1.0)
    return joined.select(F.col("_reb").alias("reb_date"), "entry_date", "exit_date", "ticker", F.when(F.col("weight") > 0, "Long").otherwise("Short").alias("direction"), F.abs("weight").alias("weight"), "entry_price", "exit_price", ret.alias("ret"), (ret > 0).alias("won"))


def trade_stats(ledger: DataFrame) -> DataFrame:
    r = F.col("ret")
    gains, losses = F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))
    best, worst = F.struct("ret", "ticker", "reb_date"), F.struct(-r, "ticker", "reb_date")
    return ledger.agg(F.count("*").alias("n"), F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg(r).alias("mean_ret"), F.median(r).alias("median_ret"), F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r < 0, r)).alias("mean_loss"), F.try_divide(gains, losses).alias("profit_factor"), F.max_by("ticker", best).alias("best"), F.max_by("ticker", worst).alias("worst"))
