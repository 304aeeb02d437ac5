"""Technical factors and fundamental ratios, and their standardisation by date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import TINY, clip, history, lagged, pct_change, rolling, safe_sqrt, unless_tiny

YEAR = math.sqrt(252)
RATIOS = ["earnings_yield", "book_to_assets", "roe", "roa", "debt_equity", "net_margin", "ocf_to_assets", "ocf_to_debt", "leverage", "revenue_growth_yoy", "net_income_growth_yoy"]


def technical(prices: DataFrame, cfg: dict) -> DataFrame:
    """date, ticker and the technical factors. All windows are of one partitioning and order, so the
    prices are shuffled by entity once."""
    c = cfg["features"]
    p, v = F.col("adj_close"), F.col("volume")
    back = lambda n: F.log(F.try_divide(p, lagged(p, n)))
    base = prices.withColumns({"_ret": back(1), "_delta": p - lagged(p, 1)})
    ret, delta = F.col("_ret"), F.col("_delta")
    out: dict[str, Column] = {}
    for w in c["momentum_windows"]:
        out[f"ret_{w}d"] = back(w) - back(c["skip_recent"]) if w == max(c["momentum_windows"]) and c["skip_recent"] else back(w)
    for w in c["volatility_windows"]:
        out[f"vol_{w}d"] = rolling(ret, w, F.stddev_samp) * YEAR
    n = c["drawdown_window"]
    peak = rolling(p, n, F.max, least=1)
    out[f"mdd_{n}d"] = F.try_divide(p - peak, peak)
    spread, body = F.log(F.try_divide(F.col("high"), F.col("low"))), F.log(F.try_divide(F.col("close"), F.col("open")))
    out["gk_vol_20d"] = safe_sqrt(rolling(0.5 * spread * spread - (2 * math.log(2) - 1) * body * body, 20, F.avg)) * YEAR
    n = c["volume_window"]
    out["volume_zscore"] = F.try_divide(v - rolling(v, n, F.avg), unless_tiny(rolling(v, n, F.stddev_samp)))
    out["amihud"] = rolling(F.try_divide(F.abs(ret), p * v), n, F.avg)
    for w in c["ma_windows"]:
        out[f"ma_gap_{w}d"] = F.try_divide(p - rolling(p, w, F.avg), unless_tiny(rolling(ret, 20, F.stddev_samp) * p))
    n = c["rsi_window"]
    gain, loss = rolling(F.greatest(delta, F.lit(0.0)), n, F.avg), rolling(F.greatest(-delta, F.lit(0.0)), n, F.avg)
    # the first bar has no change; greatest() would skip its null
    gain, loss = (F.when(F.count(delta).over(W.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)) == n, x) for x in (gain, loss))
    out[f"rsi_{n}"] = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, unless_tiny(loss)))
    n, k = c["band_window"], c["band_width"]
    middle, width = rolling(p, n, F.avg), rolling(p, n, F.stddev_samp)
    out["bb_pctb"] = F.try_divide(p - (middle - k * width), unless_tiny(2 * k * width))
    flow = F.sum(F.signum(delta) * v).over(history())
    made = base.withColumns(out | {"obv": F.when(delta.isNotNull(), flow)})
    obv = F.col("obv")
    made = made.withColumn("obv_zscore", F.try_divide(obv - rolling(obv, 60, F.avg), unless_tiny(rolling(obv, 60, F.stddev_samp))))
    return made.select("date", "ticker", *out, "obv", "obv_zscore")


def fundamental(merged: DataFrame) -> DataFrame:
    """``merged`` with the ratios; a missing metric or a zero denominator gives a null."""
    d = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return merged.withColumns({
        "earnings_yield": d("net_income", "total_assets"), "book_to_assets": d("stockholders_equity", "total_assets"), "roe": d("net_income", "stockholders_equity"), "roa": d("net_income", "total_assets"),
        "debt_equity": d("total_liabilities", "stockholders_equity"), "net_margin": d("net_income", "revenue"), "ocf_to_assets": d("operating_cash_flow", "total_assets"), "ocf_to_debt": d("operating_cash_flow", "total_liabilities"),
        "leverage": d("total_assets", "stockholders_equity"), "revenue_growth_yoy": pct_change("revenue"), "net_income_growth_yoy": pct_change("net_income"),
    })


def coerced(df: DataFrame, numbers: list[str] = (), dates: list[str] = ()) -> DataFrame:
    """``df`` with text columns as numbers and dates; what isn't one is null, and so is NaN. A missing column is
    added as null."""
    have = set(df.columns)
    number = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) if c in have else F.lit(None).cast("double") for c in numbers}
    date = {c: F.col(c).try_cast("date") if c in have else F.lit(None).cast("date") for c in dates}
    return df.withColumns(number | date)


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """The names of the numeric columns, by their types."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in leave]


def long_prices(wide: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "adj_close", "volume"), by: str = "date", between: str = "|") -> DataFrame:
    """date, ticker and a column for each field, from a column for each field and ticker (``open|ABC``). Rows of
    which nothing is known are left out."""
    pairs: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        field, _, ticker = c.partition(between)
        if ticker and field in fields:
            pairs.setdefault(ticker, {})[field] = c
    row = [F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{cs[f]}`") if f in cs else F.lit(None)).cast("double").alias(f) for f in fields]) for t, cs in sorted(pairs.items())]
    return wide.select(by, F.explode(F.array(*row)).alias("r")).select(by, "r.*").dropna(how="all", subset=list(fields))


def feature_pipeline(prices: DataFrame, merged: DataFrame | None, cfg: dict, raw: tuple[str, ...] = ()) -> DataFrame:
    """date, ticker and all features standardised by date: technical factors, and ratios (with the ``raw``
    columns) of the point-in-time panel ``merged`` where one is given. The columns are found by their types."""
    made = technical(prices, cfg)
    if merged is not None:
        made = made.join(fundamental(merged).select("date", "ticker", *raw, *RATIOS), ["date", "ticker"], "left")
    c = cfg["preprocessing"]
    return zscore_columns(made, numeric_columns(made), c["limit"], c["tail"])


def zscores(df: DataFrame, columns: list[str], limit: float = 3.0, tail: float = 0.01, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """(date, ticker, feature, z): values standardised by the mean and population deviation of the date's
    winsorised values, cut at ±limit. A date without spread has 0 everywhere, also where the value is null.

    Columns become rows first, so one shuffle by (date, feature) serves all of them.
    """
    long = df.select(*keys, *[F.col(c).cast("double") for c in columns]).unpivot(list(keys), columns, "feature", "x")
    day = W.partitionBy(keys[0], "feature")
    n = F.count("x").over(day)
    place = F.row_number().over(day.orderBy(F.col("x").asc_nulls_last(), keys[1]))
    ranked = long.withColumns({"_n": n, "_i": place, "_k": F.floor(n * tail)})
    ends = ranked.withColumns({"_lo": F.min(F.when(F.col("_i") == F.col("_k") + 1, F.col("x"))).over(day), "_hi": F.min(F.when(F.col("_i") == F.col("_n") - F.col("_k"), F.col("x"))).over(day)})
    cut = F.when(F.col("x").isNotNull(), F.greatest("_lo", F.least("_hi", "x")))
    moments = ends.withColumn("_c", cut).withColumns({"_m": F.avg("_c").over(day), "_s": F.stddev_pop("_c").over(day)})
    flat = F.col("_s").isNull() | (F.col("_s") < TINY)
    return moments.select(*keys, "feature", F.when(flat, 0.0).otherwise(clip((F.col("x") - F.col("_m")) / F.col("_s"), -limit, limit)).alias("z"))


def zscore_columns(df: DataFrame, columns: list[str], limit: float = 3.0, tail: float = 0.01, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """``zscores`` with a column for each feature again."""
    return zscores(df, columns, limit, tail, keys).groupBy(*keys).pivot("feature", columns).agg(F.first("z"))


def bands(prices: DataFrame, window: int = 20, width: float = 2.0, population: bool = False) -> DataFrame:
    """date, ticker, pctb: the place of the price between its bands, by the sample or population deviation."""
    p = F.col("adj_close")
    spread = rolling(p, window, F.stddev_pop if population else F.stddev_samp)
    return prices.select("date", "ticker", F.try_divide(p - (rolling(p, window, F.avg) - width * spread), unless_tiny(2 * width * spread)).alias("pctb"))


def wilder_rsi(prices: DataFrame, window: int = 14, block: int = 512) -> DataFrame:
    """date, ticker, rsi by Wilder's smoothing: the first value is a simple mean of ``window`` changes, each
    later one keeps (window - 1) / window of the one before. In closed form, as in ``ewm_mean``: prefix sums
    with growing weights in blocks of changes whose totals carry over, so no row holds its entity's history."""
    p = F.col("adj_close")
    keep = (window - 1) / window
    by = history()
    base = prices.select("date", "ticker", (p - lagged(p, 1)).alias("_d")).withColumn("_j", F.count("_d").over(by))
    # changes of the seed weigh the same
    base = base.withColumn("_m", F.greatest(F.col("_j"), F.lit(window)) - window)
    base = base.withColumn("_block", F.floor(F.col("_m") / block)).withColumn("_g", F.pow(F.lit(keep), -(F.col("_m") % block).cast("double")))
    inside = W.partitionBy("ticker", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    part = lambda x: F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.greatest(x, F.lit(0.0)) * F.col("_g"))).over(inside), F.lit(0.0)) / F.pow(F.lit(keep), -(F.col("_m") % block).cast("double"))
    summed = base.withColumns({"_up": part(F.col("_d")), "_down": part(-F.col("_d"))})
    # a block's totals at its last change fade by one change to the next block's first, and by keep^block for each later one
    ends = summed.groupBy("ticker", "_block").agg(F.max_by("_up", "_j").alias("_eu"), F.max_by("_down", "_j").alias("_ed"))
    past = W.partitionBy("ticker").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    faded = lambda c: F.aggregate(F.collect_list(c).over(past), F.lit(0.0), lambda s, v: s * keep**block + v)
    carried = ends.select(F.col("ticker").alias("_k"), F.col("_block").alias("_b"), faded(F.col("_eu")).alias("_cu"), faded(F.col("_ed")).alias("_cd"))
    fade = F.pow(F.lit(keep), (F.col("_m") % block + 1).cast("double"))
    joined = summed.join(carried, (F.col("ticker") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    up, down = (F.col("_up") + F.col("_cu") * fade) / window, (F.col("_down") + F.col("_cd") * fade) / window
    return joined.select("date", "ticker", F.when(F.col("_j") >= window, F.try_divide(100 * up, unless_tiny(up + down))).alias("rsi"))


def exposures(tech: DataFrame, prices: DataFrame) -> DataFrame:
    """date, ticker, beta (the short volatility as a proxy) and log_market_cap (of the traded value, 0 where
    it is unknown)."""
    size = F.coalesce(F.log1p(F.col("adj_close") * F.col("volume")), F.lit(0.0))
    return tech.select("date", "ticker", F.col("vol_20d").alias("beta")).join(prices.select("date", "ticker", size.alias("log_market_cap")), ["date", "ticker"], "left")


def series_panel(long: DataFrame, series: list[str], date: str = "date", name: str = "series", value: str = "value") -> DataFrame:
    """A column for each series by date, each carried forward. Dates are few, so one window orders them."""
    wide = long.groupBy(date).pivot(name, series).agg(F.avg(value))
    order = W.partitionBy(F.lit("all")).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return wide.select(date, *[F.last(s, ignorenulls=True).over(order).alias(s) for s in series])
