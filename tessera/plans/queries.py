"""The panel queries by name: each operator on the driver's tables, doubles rounded to six places."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import load_config
from ..functions.rolling import ewm_mean, lagged, pct_rank
from ..operators import asof, backtest, features, labels, modeling, portfolio, reports, splits, studies, universe
from ..sources import html, panels
from ..sources.stages import kept

CFG = load_config()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Labels over shorter paths than the defaults: the driver's smaller tables hold short histories.
LABELS = CFG | {"labels": CFG["labels"] | {"bars": 20, "span": 30}}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with one zero."""
    return df.select(*[(F.round(f.name, places) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


# --- scans, filters, lookups ---


@query
def scan_filter_project(spark, d):
    line = panels.table(spark, d, "lineitem")
    return line.filter((F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query
def blacklist_anti(spark, d):
    nation = panels.table(spark, d, "nation")
    banned = panels.table(spark, d, "region").filter(F.col("r_regionkey") < 2)
    return nation.join(banned, nation.n_regionkey == banned.r_regionkey, "left_anti").select("n_nationkey", "n_name")


@query
def dim_lookup_default(spark, d):
    left = panels.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return asof.with_sector(left, panels.cross_section(spark, d).filter(F.col("ticker") % 7 != 0))


# --- technical factors ---


def _technical(spark, d, columns):
    return features.technical(panels.prices(spark, d), CFG).select("date", "ticker", *columns)


FACTORS = {
    "log_returns_multi": ["ret_21d", "ret_63d", "ret_126d"], "skip_month_momentum": ["ret_252d"], "realized_vol": ["vol_20d", "vol_60d"], "trailing_drawdown": ["mdd_126d"], "garman_klass": ["gk_vol_20d"], "volume_zscore": ["volume_zscore"],
    "obv": ["obv", "obv_zscore"], "ma_gap": ["ma_gap_50d", "ma_gap_200d"], "rsi_simple": ["rsi_14"], "bollinger_pctb": ["bb_pctb"],
}
for _name, _columns in FACTORS.items():
    QUERIES[_name] = partial(lambda spark, d, columns: rounded(_technical(spark, d, columns)), columns=_columns)


@query
def amihud(spark, d):
    return _technical(spark, d, ["amihud"]).withColumn("amihud", F.col("amihud") * 1e6)


@query
def ewma_abs_return(spark, d):
    p = F.col("adj_close")
    return ewm_mean(panels.prices(spark, d), F.abs(F.log(F.try_divide(p, lagged(p, 1)))), 50, "ewma").select("date", "ticker", "ewma")


# --- point in time ---


def _decisions(spark, d):
    return panels.prices(spark, d).select("date", "ticker")


@query
def asof_backward(spark, d):
    return asof.asof_join(_decisions(spark, d), panels.filings(spark, d), ["sec_acceptance_date", "form_type", "revenue", "total_assets"], ["fiscal_period_end", "form_type", "filing"])


@query
def pit_two_leg_join(spark, d):
    return asof.point_in_time(_decisions(spark, d), panels.filings(spark, d))


@query
def pit_compliance(spark, d):
    return asof.check_compliance(asof.point_in_time(_decisions(spark, d), panels.filings(spark, d)))


@query
def ffill_metrics(spark, d):
    one = panels.filings(spark, d).groupBy("ticker", F.col("sec_acceptance_date").alias("date")).agg(F.max_by("revenue", "filing").alias("revenue"))
    from ..functions.rolling import forward_fill

    return one.withColumn("filled", forward_fill(F.col("revenue")))


def _ratios(spark, d):
    return features.fundamental(asof.point_in_time(_decisions(spark, d), panels.filings(spark, d)))


@query
def fundamental_ratios(spark, d):
    return _ratios(spark, d).select("date", "ticker", *features.RATIOS[:9])


@query
def growth_pct_change(spark, d):
    return _ratios(spark, d).select("date", "ticker", "revenue_growth_yoy", "net_income_growth_yoy")


# --- cross-sections ---

XS = ["px", "qty", "disc"]


@query
def xs_zscore_winsor(spark, d):
    return features.zscores(panels.cross_section(spark, d), XS)


def _scores(spark, d):
    """date, ticker, sector, size, disc, score: the standardised price of suppliers by month."""
    xs = panels.cross_section(spark, d)
    z = features.zscore_columns(xs, XS).select("date", "ticker", F.col("px").alias("score"))
    return xs.select("date", "ticker", "sector", "size", "disc").join(z, ["date", "ticker"])


@query
def pct_rank_avg_ties(spark, d):
    xs = panels.cross_section(spark, d).withColumn("coarse", F.round("px", -2))
    return xs.select("date", "ticker", pct_rank("coarse", "date").alias("pct"))


@query
def flagship_decile_portfolio(spark, d):
    prices = kept(panels.prices(spark, d), "prices")
    tech = features.technical(prices, CFG).select("date", "ticker", "ret_21d", "vol_20d")
    z = features.zscore_columns(tech, ["ret_21d", "vol_20d"])
    scored = z.join(prices.select("date", "ticker", "sector"), ["date", "ticker"]).withColumn("score", F.round(F.col("ret_21d") - 0.5 * F.col("vol_20d"), 9))
    return portfolio.rank_portfolio(scored.select("date", "ticker", "sector", "score"), CFG).filter("weight <> 0")


# --- labels ---


@query
def month_end_entries(spark, d):
    return _decisions(spark, d).filter(labels.month_ends(F.col("date")))


def _labels(spark, d):
    return labels.triple_barrier(panels.prices(spark, d), LABELS)


@query
def triple_barrier(spark, d):
    return _labels(spark, d)


@query
def weekly_entries(spark, d):
    return labels.triple_barrier(panels.prices(spark, d), LABELS, labels.fridays).groupBy("ticker", "barrier_type").agg(F.count("*").alias("n"))


@query
def label_summary(spark, d):
    return labels.label_summary(_labels(spark, d))


@query
def holding_stats(spark, d):
    return labels.holding_stats(_labels(spark, d))


@query
def label_rate_by_year(spark, d):
    return labels.label_rate_by_year(_labels(spark, d))


@query
def meta_label_target(spark, d):
    return panels.bets(spark, d).select("event_id", labels.meta_labels((F.col("direction") > 0).cast("int"), F.col("label")).alias("meta_label"))


# --- universe ---


def _changes(spark, d):
    """Suppliers as names: those of an odd key are members today; each key's first and last active month
    gives a change, a removal of even keys and an addition of odd ones."""
    xs = panels.cross_section(spark, d).groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.min_by("sector", "date").alias("sector"))
    named = xs.select((F.concat(F.lit("S."), F.col("ticker"))).alias("name"), "ticker", "a", "z", "sector")
    today = named.filter("ticker % 2 = 1").select(F.col("name").alias("ticker"), "sector")
    middle = F.add_months("a", (F.col("ticker") % 24 + 6).cast("int"))
    changes = named.select(middle.alias("date"), F.when(F.col("ticker") % 2 == 1, F.col("name")).alias("added"), F.when(F.col("ticker") % 2 == 0, F.col("name")).alias("removed"), F.col("ticker").cast("long").alias("seq"))
    return today, changes


@query
def universe_rebuild(spark, d):
    return universe.membership(*_changes(spark, d), *_months(spark, d))


@query
def survivorship(spark, d):
    today, changes = _changes(spark, d)
    return universe.survivorship(universe.membership(today, changes, *_months(spark, d)), today.select(F.regexp_replace("ticker", r"\.", "-").alias("ticker")))


def _months(spark, d):
    """The first and last month end of the data, as text."""
    first, last = panels.cross_section(spark, d).agg(F.last_day(F.min("date")), F.last_day(F.max("date"))).first()
    return str(first), str(last)


@query
def dedup_best_row(spark, d):
    best = universe.best_rows(panels.filings(spark, d), panels.METRICS, ["ticker", "sec_acceptance_date", "form_type"], ["filing"])
    return best.select("ticker", "sec_acceptance_date", "form_type", "filing", "n_known")


@query
def facts_flatten(spark, d):
    """Filings turned into nested JSON by nation, and flattened again."""
    f = panels.filings(spark, d).select("ticker", F.col("fiscal_period_end").cast("string").alias("end"), F.col("form_type").alias("form"), F.col("sec_acceptance_date").cast("string").alias("filed"), "filing", "revenue", "total_assets")
    fact = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("filing", F.struct("end", "form", "filed", F.col(c).alias("val")).alias("f")))))
    by = f.groupBy("ticker").agg(fact("revenue").alias("r"), fact("total_assets").alias("a"))
    usd = lambda c: F.struct(F.struct(F.transform(c, lambda x: x["f"]).alias("USD")).alias("units"))
    doc = F.to_json(F.struct(F.struct(F.struct(usd("r").alias("SalesRevenueNet"), usd("a").alias("Assets")).alias("us-gaap")).alias("facts")))
    return universe.flatten_facts(by.select("ticker", doc.alias("doc")), {k: universe.TAGS[k] for k in ("revenue", "total_assets")})


# --- splits ---


@query
def cpcv_groups(spark, d):
    return splits.time_groups(_labels(spark, d).select("ticker", "entry_date", "t_barrier"), 10)


@query
def cpcv_folds(spark, d):
    return splits.purged_folds(_labels(spark, d), 10, 2, 5)


@query
def cpcv_fold_counts(spark, d):
    return splits.fold_counts(splits.purged_folds(_labels(spark, d), 10, 2, 5))


@query
def oof_folds(spark, d):
    return splits.expanding_folds(_labels(spark, d).select("ticker", "entry_date"), 5)


@query
def three_way_split(spark, d):
    return splits.three_way(_labels(spark, d).select("ticker", "entry_date"))


# --- bets, neutral scores, portfolios ---


def _bet(spark, d, method):
    return panels.bets(spark, d).select("event_id", portfolio.bet_size(F.col("direction"), F.col("prob"), method, 0.3, 0.05).alias("bet"))


for _method in ("meta_prob", "half_kelly", "equal"):
    QUERIES[f"bet_size_{_method}"] = partial(lambda spark, d, method: rounded(_bet(spark, d, method)), method=_method)


@query
def neutralize_sector(spark, d):
    return portfolio.neutral_to_sector(_scores(spark, d)).select("date", "ticker", "neutral")


@query
def neutralize_single_factor(spark, d):
    return portfolio.neutral_to_factor(_scores(spark, d), "disc").select("date", "ticker", "neutral")


@query
def neutralize_general(spark, d):
    scores = _scores(spark, d).withColumn("size", F.col("size") / 1e4)
    return portfolio.neutralise(scores, ["size", "disc"]).select("date", "ticker", "neutral")


@query
def validate_slopes(spark, d):
    return portfolio.exposure_slopes(portfolio.neutral_to_factor(_scores(spark, d), "disc"), ["disc", "size"])


@query
def slope_p_values(spark, d):
    return portfolio.slope_p_values(portfolio.exposure_slopes(portfolio.neutral_to_factor(_scores(spark, d), "disc"), ["disc", "size"]))


def _portfolio(spark, d, **changed):
    cfg = CFG | {"portfolio": CFG["portfolio"] | changed}
    scores = _scores(spark, d).withColumn("score", F.round("score", 9))
    return portfolio.rank_portfolio(scores, cfg).select("date", "ticker", "weight")


@query
def portfolio_equal(spark, d):
    return _portfolio(spark, d, weighting="equal")


@query
def portfolio_conviction_capped(spark, d):
    return _portfolio(spark, d, max_name=0.2, max_sector=0.3)


@query
def portfolio_long_short(spark, d):
    return _portfolio(spark, d, weighting="equal", long_only=False, max_name=0.2)


@query
def turnover_costs(spark, d):
    return portfolio.turnover(_portfolio(spark, d, weighting="equal"), 7.5)


@query
def market_impact(spark, d):
    scores = panels.cross_section(spark, d).select("date", "ticker", (F.col("disc") / 10).alias("weight"), (F.col("qty") * F.col("px")).alias("adv"), F.col("disc").alias("vol"))
    return portfolio.market_impact(scores)


# --- replay ---


def _weights(spark, d):
    """Equal weights of the top quintile of ret_21d at month ends."""
    return _weights_of(panels.prices(spark, d))


def _weights_of(prices):
    tech = features.technical(prices, CFG).select("date", "ticker", "ret_21d").filter(labels.month_ends(F.col("date")))
    scored = tech.join(prices.select("date", "ticker", "sector"), ["date", "ticker"]).withColumn("score", F.round("ret_21d", 9))
    cfg = CFG | {"portfolio": CFG["portfolio"] | {"weighting": "equal", "leg": "top_quintile", "max_name": 0.5, "max_sector": 1.0}}
    return portfolio.rank_portfolio(scored.select("date", "ticker", "sector", "score"), cfg).select("date", "ticker", "weight")


def _replay(spark, d):
    prices = kept(panels.prices(spark, d), "prices")
    return backtest.replay(kept(_weights_of(prices), "weights"), prices)


def _trades(spark, d, held_only):
    prices = kept(panels.prices(spark, d), "prices")
    return backtest.trades(kept(_weights_of(prices), "weights"), prices, held_only)


def _returns(spark, d):
    """Daily market returns, a fiftieth of them on a logarithmic scale, so that wealth is the fiftieth root of the
    price's change and stays in range."""
    return backtest.market(panels.prices(spark, d)).withColumn("ret", F.pow(1 + F.col("ret"), F.lit(0.02)) - 1)


@query
def backtest_daily(spark, d):
    return _replay(spark, d)


@query
def performance_metrics(spark, d):
    return backtest.performance(_returns(spark, d))


@query
def regime_metrics(spark, d):
    r = _returns(spark, d)
    return backtest.regimes(r, r, 0.02, 0.005)


@query
def monthly_returns_spine(spark, d):
    return backtest.monthly_returns(_returns(spark, d).filter(F.month("date") != 5))


@query
def rolling_sharpe(spark, d):
    return backtest.rolling_sharpe(_returns(spark, d))


@query
def equity_drawdown(spark, d):
    return backtest.equity(_returns(spark, d))


@query
def trade_ledger(spark, d):
    return _trades(spark, d, False)


@query
def trade_stats(spark, d):
    return backtest.trade_stats(_trades(spark, d, True))


@query
def trades_by_month(spark, d):
    t = _trades(spark, d, True)
    return t.groupBy(F.last_day("reb_date").alias("month")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg(F.col("won").cast("double")).alias("win_rate"))


@query
def trades_by_ticker(spark, d):
    t = _trades(spark, d, True)
    return t.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("ret").alias("total_ret"), F.avg(F.col("won").cast("double")).alias("win_rate"))


# --- sweeps ---

GRID = [(i, m, lo, cap) for i, (m, lo, cap) in enumerate((m, lo, cap) for m in ("meta_prob", "half_kelly", "equal") for lo in (0.1, 0.2, 0.3) for cap in (0.02, 0.05))]


def _sweep(spark, d):
    """All settings in one plan: bets by setting and day, and the mean over the deviation of a day's gain."""
    grid = spark.createDataFrame(GRID, "config_id int, method string, least double, cap double")
    bets = panels.bets(spark, d).crossJoin(F.broadcast(grid))  # as many rows as settings
    sized = bets.withColumn("bet", portfolio.bet_size(F.col("direction"), F.col("prob"), F.col("method"), F.col("least"), F.col("cap")))
    gain = F.sum(F.col("bet") * F.when(F.col("label") == 1, 1.0).otherwise(-0.5))
    by_day = sized.groupBy("config_id", "method", "least", "cap", F.col("ts").cast("date").alias("date")).agg(gain.alias("gain"))
    return by_day.groupBy("config_id", "method", "least", "cap").agg(F.sum("gain").alias("total"), F.coalesce(F.try_divide(F.avg("gain"), F.stddev_samp("gain")), F.lit(0.0)).alias("sharpe"), F.count("*").alias("days"))


@query
def sweep_grid(spark, d):
    return _sweep(spark, d)


@query
def sweep_param_means(spark, d):
    swept = _sweep(spark, d)
    sets = swept.groupingSets([["method"], ["least"], ["cap"]], "method", "least", "cap")
    return sets.agg(F.avg("sharpe").alias("mean_sharpe"), F.count("*").alias("n"))


@query
def sweep_top10(spark, d):
    return _sweep(spark, d).withColumn("sharpe", F.round("sharpe", 9)).orderBy(F.desc("sharpe"), "config_id").limit(10).select("config_id", "sharpe")


# --- reports ---

CUSTOMER_YEAR = "concat_ws(':', c_custkey, year(o_orderdate))"
REPORTED = ["ret_21d", "vol_20d", "ma_gap_50d", "rsi_14", "bb_pctb"]


@query
def corr_pairs(spark, d):
    return reports.correlations(_technical(spark, d, REPORTED), REPORTED)


@query
def missing_rate(spark, d):
    return reports.missing_rate(_technical(spark, d, REPORTED), REPORTED)


@query
def coverage_by_month(spark, d):
    return reports.coverage_by_month(_technical(spark, d, REPORTED), REPORTED)


@query
def never_known(spark, d):
    """Customers by year, and the metrics that none of their filings of the year has."""
    return reports.never_known(panels.filings(spark, d, entity=CUSTOMER_YEAR), panels.METRICS)


@query
def histogram_bins(spark, d):
    return reports.histogram(_technical(spark, d, ["rsi_14"]), "rsi_14", 20, 0.0, 100.0)


@query
def integrity_describe(spark, d):
    return reports.names_by_date(panels.prices(spark, d))


@query
def zscore_sanity(spark, d):
    z = features.zscores(panels.cross_section(spark, d), XS)
    return z.groupBy("date", "feature").agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("n"))


@query
def label_entries_joined(spark, d):
    """Features of a label's entry date: an inner join on unlike key names."""
    tech = _technical(spark, d, ["ret_21d", "vol_20d"])
    y = _labels(spark, d).select(F.col("ticker").alias("_t"), "entry_date", "label_binary")
    return tech.join(y, (F.col("ticker") == F.col("_t")) & (F.col("date") == F.col("entry_date"))).drop("_t", "entry_date")


@query
def top_k_drivers(spark, d):
    e = panels.table(spark, d, "embeddings")
    return reports.top_drivers(e, "vec_id", "embedding", [f"f{i}" for i in range(64)], 3)


@query
def pm_ledger(spark, d):
    bets = panels.bets(spark, d).select("event_id", F.col("prob").alias("meta_conviction"), F.when(F.col("direction") > 0, "Long").otherwise("Short").alias("direction"))
    return reports.decision_ledger(bets, None, "event_id", 20)


@query
def confusion_matrix(spark, d):
    return reports.confusion(panels.bets(spark, d).withColumn("call", (F.col("prob") > 0.2).cast("int")), "call", "label")


@query
def probability_scores(spark, d):
    return reports.probability_scores(panels.bets(spark, d), "prob", "label")


@query
def stratified_sample(spark, d):
    """The 50 rows that a seeded hash of the key puts first."""
    o = panels.table(spark, d, "orders").select("o_orderkey", F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))).alias("h"))
    return o.orderBy("h").limit(50).select("o_orderkey")


@query
def union_intersect(spark, d):
    a = panels.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = panels.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.union(b).distinct().withColumn("part", F.lit("any")))


@query
def bollinger_population(spark, d):
    return features.bands(panels.prices(spark, d), population=True)


@query
def rsi_wilder(spark, d):
    return features.wilder_rsi(panels.prices(spark, d))


@query
def beta_size_exposures(spark, d):
    p = panels.prices(spark, d)
    return features.exposures(features.technical(p, CFG), p)


@query
def macro_panel(spark, d):
    e = panels.table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("series"), "value")
    return features.series_panel(e, ["click", "error", "purchase", "signup", "view"])


@query
def id_lookup(spark, d):
    """Names with their padded id, and the names that have none."""
    names = panels.table(spark, d, "nation").select(F.lower("n_name").alias("ticker"), F.col("n_nationkey").alias("id"))
    ids = universe.padded_ids(names.filter("id % 6 <> 0"))
    left = names.select(F.upper("ticker").alias("ticker"))
    return left.join(ids, "ticker").union(left.join(ids, "ticker", "left_anti").withColumn("id", F.lit(None).cast("string")))


@query
def equity_vs_benchmark(spark, d):
    r = _returns(spark, d)
    return reports.against_benchmark(r, r.filter(F.month("date") != 3).withColumn("ret", F.col("ret") / 2))


@query
def strategy_and_benchmark(spark, d):
    r = kept(_returns(spark, d), "returns")
    return reports.side_by_side(r, r.withColumn("ret", F.col("ret") / 2))


@query
def strong_correlations(spark, d):
    return reports.strong_pairs(reports.correlations(_technical(spark, d, REPORTED), REPORTED), 0.3)


@query
def split_summary(spark, d):
    y = kept(_labels(spark, d).select("ticker", "entry_date", "label_binary"), "labels")
    return reports.split_summary(splits.three_way(y))


@query
def early_stop_rows(spark, d):
    y = kept(_labels(spark, d).select("ticker", "entry_date"), "labels")
    return splits.early_stop_carve(y).groupBy("monitor").agg(F.count("*").alias("n"), F.max("entry_date").alias("last"))


@query
def bet_filter_rate(spark, d):
    return reports.filter_rate(_bet(spark, d, "half_kelly"))


@query
def fold_report(spark, d):
    """The report on folds of the bets by key: accuracy, log loss and AUC of each."""
    b = panels.bets(spark, d).withColumn("fold", F.col("event_id") % 8)
    parts = None
    for k in range(8):
        own = b.filter(F.col("fold") == k)
        hits = own.agg(F.avg(((F.col("prob") > 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
        one = reports.probability_scores(own, "prob", "label").crossJoin(hits).select(F.lit(k).alias("fold"), "accuracy", "logloss", "auc")  # one row each
        parts = one if parts is None else parts.union(one)
    return reports.fold_report(parts)


@query
def rebalance_listing(spark, d):
    return reports.rebalance_listing(_weights(spark, d))


@query
def pca_study(spark, d):
    return reports.principal_components(_technical(spark, d, REPORTED), REPORTED)


# --- studies ---


@query
def information_coefficient(spark, d):
    return studies.information_coefficient(panels.cross_section(spark, d).withColumn("px", F.round("px", -2)), "px", "qty")


@query
def coefficient_summary(spark, d):
    """Averages are rounded first: their last digits, and so ties between them, hang on the order of addition."""
    return studies.coefficient_summary(studies.information_coefficient(panels.cross_section(spark, d).withColumn("disc", F.round("disc", 9)), "disc", "qty"))


@query
def sweep_heatmap(spark, d):
    wide = studies.heatmap(_sweep(spark, d), "least", "cap", [0.02, 0.05], "sharpe")
    return wide.select("least", F.col("`0.02`").alias("cap_2"), F.col("`0.05`").alias("cap_5"))


@query
def roc_points(spark, d):
    return studies.roc_points(panels.bets(spark, d), "prob", "label")


@query
def stratified_dummy(spark, d):
    return studies.stratified_dummy(panels.bets(spark, d), "label")


@query
def valuation_ratios(spark, d):
    f = panels.filings(spark, d).withColumns({"price": F.lit(20.0), "shares": F.col("total_assets") / 100})
    return studies.valuation(f, "price", "shares").select("filing", "eps", "price_earnings", "price_book", "price_sales")


def _log_prices(spark, d):
    return panels.prices(spark, d).select("date", "ticker", F.log("adj_close").alias("x"))


@query
def dickey_fuller(spark, d):
    return studies.dickey_fuller(_log_prices(spark, d), "x")


@query
def least_order(spark, d):
    return studies.least_order(kept(_log_prices(spark, d), "log-prices"), "x", (0.0, 0.2, 0.4), tolerance=1e-2)


@query
def except_all(spark, d):
    """Nations of customers less those of suppliers, each as often as it occurs more, and distinct ones."""
    a = panels.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = panels.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).withColumn("part", F.lit("all")).union(a.filter("k % 2 = 0").subtract(b.filter("k % 3 = 0")).withColumn("part", F.lit("distinct")))


@query
def html_tables(spark, d):
    """A page for each region with a table of its nations, read back."""
    n = panels.table(spark, d, "nation")
    line = F.concat(F.lit("<tr><td>"), F.col("n_nationkey"), F.lit("<td><b>"), F.col("n_name"), F.lit("</b> &amp; co</td></tr>"))
    page = F.concat(F.lit("<p>x</p><table><tr><th>Key</th><th>Name</th></tr>"), F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit("</table>"))
    rows = html.html_tables(n.groupBy("n_regionkey").agg(page.alias("page")), "n_regionkey", "page")
    return html.named_cells(rows, 0, {"name": "Name", "id": "Key"}, "n_regionkey").drop("row")


@query
def pca_loadings(spark, d):
    return studies.loadings(_technical(spark, d, REPORTED), REPORTED)


# --- models (no SQL counterpart) ---


def _model_rows(spark, d):
    return _technical(spark, d, REPORTED).join(_labels(spark, d).select(F.col("ticker"), F.col("entry_date"), F.col("entry_date").alias("date"), "t_barrier", "label_binary"), ["ticker", "date"])


@query
def gbt_primary(spark, d):
    rows = modeling.matrix(_model_rows(spark, d), REPORTED)
    return modeling.scored(modeling.primary_model(REPORTED).fit(rows), rows).select("ticker", "date", "p", "label_binary")


@query
def rf_meta(spark, d):
    rows = modeling.balanced(modeling.matrix(_model_rows(spark, d), REPORTED).withColumn("meta_label", F.col("label_binary")), "meta_label")
    return modeling.scored(modeling.meta_model(REPORTED).fit(rows), rows).select("ticker", "date", "p", "meta_label")


@query
def two_stage(spark, d):
    return modeling.two_stage(_model_rows(spark, d), REPORTED, CFG).select("ticker", "date", "direction", "meta_probability", "bet")


@query
def cpcv_evaluate(spark, d):
    return modeling.evaluate_folds(_model_rows(spark, d), REPORTED, CFG, rounds=10)


@query
def supervised_pca(spark, d):
    rows = modeling.matrix(_model_rows(spark, d), REPORTED)
    return modeling.supervised_pca(rows, REPORTED, "label_binary", 3).select("ticker", "date", "components")


@query
def tree_shap(spark, d):
    rows = modeling.matrix(_model_rows(spark, d), REPORTED).withColumn("key", F.concat_ws(":", "ticker", "date"))
    model = modeling.primary_model(REPORTED, rounds=5).fit(rows).stages[-1]
    return modeling.global_importance(modeling.tree_shap(rows, model, REPORTED, "key"), REPORTED)


@query
def fractional_difference(spark, d):
    p = panels.prices(spark, d).select("date", "ticker", F.log("adj_close").alias("x"))
    return modeling.fractional_difference(p, "x", 0.4, "fd", 1e-2)


@query
def cpcv_grid_search(spark, d):
    return studies.grid_search(_model_rows(spark, d), REPORTED, CFG, {"depth": [2, 4], "rounds": [5]})


@query
def model_comparison(spark, d):
    split = kept(splits.three_way(kept(_model_rows(spark, d), "rows")), "split")
    return studies.compare_models(split.filter("part = 'train'"), split.filter("part = 'test'"), REPORTED)


@query
def out_of_fold_calls(spark, d):
    return studies.out_of_fold(_model_rows(spark, d), REPORTED).select("ticker", "date", "oof_fold", "call", "label_binary")


@query
def pca_features(spark, d):
    cfg = CFG | {"features": CFG["features"] | {"components": 3}}
    return studies.pca_features(_technical(spark, d, REPORTED), REPORTED, cfg).select("date", "ticker", "components")


@query
def sweep_replay(spark, d):
    """90 settings of bets and portfolios over momentum's decisions at month ends, through the replay."""
    prices = kept(panels.prices(spark, d), "prices")
    tech = features.technical(prices, CFG)
    exposed = features.exposures(tech, prices).select("date", "ticker", F.col("log_market_cap").alias("size"), "beta")
    ranked = tech.filter(labels.month_ends(F.col("date")) & F.col("ret_21d").isNotNull()).withColumn("probability", pct_rank("ret_21d", "date"))
    entries = ranked.select("date", "ticker", "probability", F.when(F.col("ret_21d") > 0, 1).otherwise(-1).alias("direction"))
    decisions = entries.join(prices.select("date", "ticker", "sector"), ["date", "ticker"]).join(exposed, ["date", "ticker"])
    return studies.sweep(decisions, prices, CFG, ["meta_prob", "half_kelly", "equal"], [0.1, 0.3, 0.5, 0.7, 0.9], list(portfolio.LEGS), [0.05, 0.5])
