"""Hand-made cases and brute force for the panel operators."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import load_config
from tessera.functions.rolling import ewm_mean, pct_change, pct_rank, position
from tessera.functions.special import incomplete_beta, t_test_p
from tessera.operators import asof, backtest, features, labels, modeling, portfolio, reports, splits, universe

CFG = load_config()
D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def test_asof_takes_the_whole_last_row_and_breaks_ties(spark):
    left = spark.createDataFrame([(D(2024, 1, 5), "a"), (D(2024, 1, 9), "a"), (D(2024, 1, 1), "a"), (D(2024, 1, 9), "b")], "date date, ticker string")
    right = spark.createDataFrame([("a", D(2024, 1, 5), 1, 1.0, None), ("a", D(2024, 1, 5), 2, None, 2.0), ("a", D(2024, 1, 8), 1, 3.0, None)], "ticker string, sec_acceptance_date date, tie int, x double, y double")
    got = {(r["date"], r["ticker"]): (r["x"], r["y"]) for r in asof.asof_join(left, right, ["x", "y"], ["tie"]).collect()}
    assert got == {(D(2024, 1, 5), "a"): (None, 2.0), (D(2024, 1, 9), "a"): (3.0, None), (D(2024, 1, 1), "a"): (None, None), (D(2024, 1, 9), "b"): (None, None)}


def test_later_filings_never_change_earlier_rows(spark):
    left = spark.createDataFrame([(d, "a") for d in days(20)], "date date, ticker string")
    schema = "ticker string, sec_acceptance_date date, fiscal_period_end date, form_type string, filing long, revenue double, net_income double, operating_cash_flow double, total_assets double, total_liabilities double, stockholders_equity double"
    row = lambda day, form, k: ("a", day, D(2023, 1, 1), form, k, float(k), None, 1.0, 2.0 * k, None, 3.0)
    first = [row(D(2024, 1, 3), "10-Q", 1), row(D(2024, 1, 6), "10-K", 2)]
    a = asof.point_in_time(left, spark.createDataFrame(first, schema)).orderBy("date").collect()
    b = asof.point_in_time(left, spark.createDataFrame([*first, row(D(2024, 1, 15), "10-K", 9)], schema)).orderBy("date").collect()
    assert a[:14] == b[:14] and a[14:] != b[14:]
    assert a[3]["revenue"] is None and a[3]["total_assets"] == 2.0  # only the quarterly filing so far
    assert asof.check_compliance(asof.point_in_time(left, spark.createDataFrame(first, schema))).first()["violations"] == 0


def test_ewm_mean_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.random(1500)]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(x)], "date int, ticker string, x double")
    got = [r["e"] for r in ewm_mean(df, F.col("x"), 50, "e", block=128).orderBy("date").collect()]
    s = pd.Series([np.nan if v is None else v for v in x])
    want = s.ewm(span=50, min_periods=50).mean()
    # before a null the mean of pandas stays; both hold from the 50th value on
    for g, w in zip(got, want, strict=True):
        assert (g is None) == math.isnan(w)
        assert g is None or abs(g - w) < 1e-9


def test_pct_rank_and_change(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 7.0), (4, "a", None)], "date int, ticker string, x double")
    got = df.select("date", pct_rank("x", "ticker").alias("p"), pct_change("x").alias("c")).orderBy("date").collect()
    assert [r["p"] for r in got] == [0.5, 0.5, 1.0, None]
    assert [r["c"] for r in got] == [None, 0.0, pytest.approx(0.4), 0.0]


def test_position_is_the_sorted_place(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(50)], "a int, b int")
    got = position(df, "p", "a", "b").collect()
    assert [r["b"] for r in sorted(got, key=lambda r: r["p"])] == [b for _, b in sorted((k % 7, k) for k in range(50))]


def test_zscores_of_flat_and_single_dates(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "a", 1.0), (D(2024, 1, 2), "a", 2.0), (D(2024, 1, 2), "b", 2.0), (D(2024, 1, 3), "a", 0.0), (D(2024, 1, 3), "b", 2.0), (D(2024, 1, 3), "c", None), (D(2024, 1, 4), "a", None)], "date date, ticker string, x double")
    got = {(r["date"].day, r["ticker"]): r["z"] for r in features.zscores(df, ["x"]).collect()}
    assert got == {(1, "a"): 0.0, (2, "a"): 0.0, (2, "b"): 0.0, (3, "a"): -1.0, (3, "b"): 1.0, (3, "c"): None, (4, "a"): 0.0}


@pytest.mark.parametrize("n", [99, 100, 101])
def test_winsorised_moments(spark, n):
    x = [float(v) for v in range(n - 1)] + [1e6]
    df = spark.createDataFrame([(D(2024, 1, 1), f"{i:03}", v) for i, v in enumerate(x)], "date date, ticker string, x double")
    got = {r["ticker"]: r["z"] for r in features.zscores(df, ["x"]).collect()}
    k = int(0.01 * n)
    cut = np.clip(x, sorted(x)[k], sorted(x)[n - 1 - k])
    for i, v in enumerate(x):
        assert got[f"{i:03}"] == pytest.approx(np.clip((v - cut.mean()) / cut.std(), -3, 3))


def test_triple_barrier_by_walking_each_path(spark):
    rng = np.random.default_rng(3)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))
    dates = days(400)
    df = spark.createDataFrame([(d, "a", float(p)) for d, p in zip(dates, price, strict=True)], "date date, ticker string, adj_close double")
    cfg = CFG | {"labels": CFG["labels"] | {"bars": 20, "span": 30}}
    got = {r["entry_date"]: r for r in labels.triple_barrier(df, cfg).collect()}
    vol = np.abs(np.log(pd.Series(price) / pd.Series(price).shift(1))).ewm(span=30, min_periods=30).mean()
    want = [i for i, d in enumerate(dates) if (d + dt.timedelta(1)).day == 1 and i >= 30 and i + 20 < 400]
    assert sorted(got) == [dates[i] for i in want]
    for i in want:
        up, down = price[i] * (1 + 2 * vol[i] * math.sqrt(20)), price[i] * (1 - 2 * vol[i] * math.sqrt(20))
        hit = next((t for t in range(i + 1, i + 21) if price[t] >= up or price[t] <= down), None)
        kind = "vertical" if hit is None else "upper" if price[hit] >= up else "lower"
        r = got[dates[i]]
        assert (r["barrier_type"], r["t_barrier"]) == (kind, dates[hit or i + 20])


def test_short_histories_have_no_labels(spark):
    df = spark.createDataFrame([(d, "a", 100.0 + i % 7) for i, d in enumerate(days(100))], "date date, ticker string, adj_close double")
    assert labels.triple_barrier(df, CFG).count() == 0


def _labels(spark, n=60):
    rows = [(f"t{i % 3}", D(2024, 1, 1) + dt.timedelta(i // 3), None if i % 11 == 0 else D(2024, 1, 1) + dt.timedelta(i // 3 + 4)) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, entry_date date, t_barrier date")


def test_folds_are_purged_and_apart(spark):
    folds = splits.purged_folds(_labels(spark), 6, 2, 2).collect()
    # rows without a touch are never purged, so folds with the first group keep some; without such rows they go
    assert sorted({r["fold"] for r in folds}) == list(range(15))
    known = splits.purged_folds(_labels(spark).filter("t_barrier is not null"), 6, 2, 2)
    # a path of four days crosses a group of three, so folds that test the second group go as well
    assert splits.fold_counts(known).count() == len(list(combinations(range(2, 6), 2)))
    for f in {r["fold"] for r in folds}:
        train = [r for r in folds if r["fold"] == f and r["role"] == "train"]
        test = {(r["ticker"], r["entry_date"]) for r in folds if r["fold"] == f and r["role"] == "test"}
        assert not test & {(r["ticker"], r["entry_date"]) for r in train}
        assert all(r["t_barrier"] < min(d for _, d in test) for r in train if r["t_barrier"])


def test_groups_cut_at_floors(spark):
    for n in (7, 23, 60):
        got = [r["g"] for r in splits.time_groups(_labels(spark, n), 5).orderBy("place").collect()]
        edges = [i * n // 5 for i in range(6)]
        assert got == [g for g in range(5) for _ in range(edges[g], edges[g + 1])]


def test_portfolio_weights(spark):
    rows = [(D(2024, 1, 1), f"t{i:02}", f"s{i % 3}", float(i)) for i in range(40)] + [(D(2024, 1, 1), "x", "s0", None)]
    scores = spark.createDataFrame(rows, "date date, ticker string, sector string, score double")
    long = portfolio.rank_portfolio(scores, CFG).collect()
    assert sum(r["weight"] for r in long) == pytest.approx(1) and min(r["weight"] for r in long) == 0 and len(long) == 40
    both = CFG | {"portfolio": CFG["portfolio"] | {"long_only": False, "weighting": "equal", "max_name": 1.0, "max_sector": 9.0}}
    w = [r["weight"] for r in portfolio.rank_portfolio(scores, both).collect()]
    assert sum(x for x in w if x > 0) == pytest.approx(1) and sum(x for x in w if x < 0) == pytest.approx(-1)
    flipped = [r["weight"] for r in portfolio.rank_portfolio(scores, both, compat=True).collect()]
    assert min(flipped) == 0


def test_neutral_scores_agree_with_the_general_form(spark):
    rng = np.random.default_rng(5)
    rows = [(D(2024, 1, 1 + k), f"t{i}", f"s{i % 4}", float(rng.normal()), float(rng.normal())) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, score double, e double")
    key = lambda f: {(r["date"], r["ticker"]): r["neutral"] for r in f.collect()}
    sector, general = key(portfolio.neutral_to_sector(df)), key(portfolio.neutralise(df, []))
    assert all(sector[k] == pytest.approx(general[k]) for k in sector)
    one = df.withColumn("sector", F.lit("s"))
    factor, general = key(portfolio.neutral_to_factor(one, "e")), key(portfolio.neutralise(one, ["e"]))
    assert all(factor[k] == pytest.approx(general[k]) for k in factor)


def test_replay_by_hand(spark):
    dates = days(12)
    prices = spark.createDataFrame([(d, t, 100.0 * (1 + 0.01 * (t == "a")) ** i) for i, d in enumerate(dates) for t in ("a", "b")], "date date, ticker string, adj_close double")
    weights = spark.createDataFrame([(dates[1], "a", 1.0), (dates[6], "b", 1.0), (D(2030, 1, 1), "a", 1.0)], "date date, ticker string, weight double")
    got = {r["date"]: r["gross"] for r in backtest.replay(weights, prices, stagger=2, cost_bps=0).collect()}
    # the second rebalance's own day earns nothing; its first day is half the old portfolio
    assert got == {dates[i]: pytest.approx(0.01 if i < 6 else 0.005 if i == 7 else 0.0) for i in (2, 3, 4, 5, 7, 8, 9, 10, 11)}


def test_performance_of_few_returns(spark):
    r = [0.01, -0.02, 0.03, 0.0]
    df = spark.createDataFrame(list(zip(days(4, D(2024, 1, 30)), r, strict=True)), "date date, ret double")
    got = backtest.performance(df).first()
    wealth = np.cumprod(1 + np.array(r))
    assert got["total_return"] == pytest.approx(wealth[-1] - 1)
    assert got["max_drawdown"] == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min())
    assert (got["daily_hit_rate"], got["sortino_ratio"], got["n_days"]) == (0.5, 0.0, 4)


def test_membership_walks_back(spark):
    today = spark.createDataFrame([("A", "x"), ("B.C", "y")], "ticker string, sector string")
    changes = spark.createDataFrame([(D(2024, 3, 10), "A", "Z", 1), (None, "A", "Q", 2), (D(2025, 1, 1), None, "late", 3)], "date date, added string, removed string, seq int")
    got = {(r["date"].month, r["ticker"], r["sector"]) for r in universe.membership(today, changes, "2024-01-31", "2024-04-30").collect()}
    assert got == {(m, "B-C", "y") for m in (1, 2, 3, 4)} | {(m, "A", "x") for m in (3, 4)} | {(m, "Z", "Unknown") for m in (1, 2)}


def test_facts_by_tag_priority(spark):
    doc = '{"facts": {"us-gaap": {"SalesRevenueNet": {"units": {"USD": [{"end": "2023-12-31", "form": "10-K", "filed": "2024-02-01", "val": 5}]}}, "Revenues": {"units": {"USD": [{"end": "2023-12-31", "form": "10-K", "filed": "2024-03-01", "val": 7}, {"end": "2023-12-31", "form": "10-K/A", "filed": "2024-01-01", "val": 9}, {"end": "2022-12-31", "form": "10-K", "filed": "2023-03-01"}]}}}}}'
    df = spark.createDataFrame([("a", doc), ("b", "{}"), ("c", None)], "ticker string, doc string")
    got = universe.flatten_facts(df, universe.TAGS).collect()
    assert [(r["ticker"], r["revenue"], r["sec_acceptance_date"], r["net_income"]) for r in got] == [("a", 7.0, D(2024, 3, 1), None)]


def test_drivers_and_ledger(spark):
    df = spark.createDataFrame([("k", [0.1, -0.5, 0.25])], "id string, c array<double>")
    assert reports.top_drivers(df, "id", "c", ["a", "b", "c"], 2).first()["top_drivers"] == "b(-0.500) | c(+0.250)"


def test_special_functions():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert t_test_p(0.0, 10) == pytest.approx(1.0) and t_test_p(1.0, 10) == 0.0 and t_test_p(None, 0) == 1.0
    assert t_test_p(0.5, 10) == pytest.approx(0.0221, abs=1e-3)


def test_shapley_by_enumeration():
    rng = np.random.default_rng(2)

    def grow(depth, cover):
        if depth == 0:
            return {"cover": cover, "value": float(rng.normal())}
        a = max(1.0, round(cover * rng.random()))
        return {"cover": cover, "value": 0.0, "feature": int(rng.integers(0, 3)), "cut": float(rng.normal()), "left": grow(depth - 1, a), "right": grow(depth - 1, max(1.0, cover - a))}

    def expect(n, x, known):
        if "feature" not in n:
            return n["value"]
        if n["feature"] in known:
            return expect(n["left"] if x[n["feature"]] <= n["cut"] else n["right"], x, known)
        return sum(n[s]["cover"] / n["cover"] * expect(n[s], x, known) for s in ("left", "right"))

    for _ in range(5):
        tree, x = grow(4, 100.0), rng.normal(size=3).tolist()
        got = modeling.shapley(tree, x)
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (expect(tree, x, {*s, f}) - expect(tree, x, set(s))) for k in range(3) for s in combinations(others, k))
            assert got.get(f, 0.0) == pytest.approx(want, abs=1e-9)


def test_fractional_difference_weights(spark):
    df = spark.createDataFrame([(i, "a", float(i * i)) for i in range(30)], "date int, ticker string, x double")
    got = [r["fd"] for r in modeling.fractional_difference(df, "x", 1.0, "fd").orderBy("date").collect()]
    assert got[0] is None and got[1:] == [pytest.approx(2 * i - 1) for i in range(1, 30)]


def test_settings_from_a_file(tmp_path):
    (tmp_path / "c.yaml").write_text("bets:\n  cap: 0.5\n")
    assert load_config(str(tmp_path / "c.yaml"))["bets"] == CFG["bets"] | {"cap": 0.5}


def test_cached_stage_follows_the_settings(spark, tmp_path):
    from tessera.sources.stages import cached_stage, to_csv

    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    counts = [cached_stage(spark, str(tmp_path), "s", cfg, make).count() for cfg in ({"a": 1}, {"a": 1}, {"a": 2})]
    assert counts == [1, 1, 2]
    to_csv(spark.range(3), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3


def test_a_total_loss_leaves_nothing(spark):
    import datetime

    rows = [(datetime.date(2020, 1, i + 1), r) for i, r in enumerate([0.1, -1.0, 0.1, None, -1.5])]
    df = spark.createDataFrame(rows, "date date, ret double")
    assert [round(r["wealth"], 9) for r in backtest.equity(df).orderBy("date").collect()] == [1.1, 0.0, 0.0, 0.0, 0.0]
    got = backtest.performance(df).first()
    assert (got["total_return"], got["annualized_return"], got["max_drawdown"]) == (-1.0, -1.0, -1.0)
    both = reports.against_benchmark(df, df.filter("ret > 0")).orderBy("date").collect()
    assert both[-1]["wealth"] == 0 and both[-1]["benchmark_wealth"] == pytest.approx(1.21)


def test_a_skipped_rebalance_costs_nothing(spark):
    import datetime

    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    prices = spark.createDataFrame([(day(i), "a", 1.0) for i in range(90) if i != 40], "date date, ticker string, adj_close double")
    weights = spark.createDataFrame([(day(0), "a", 1.0), (day(40), "a", 0.0), (day(50), "a", 1.0)], "date date, ticker string, weight double")
    cost = {r["date"]: r["cost"] for r in backtest.replay(weights, prices, cost_bps=7.5).collect()}
    assert sum(cost.values()) == pytest.approx(7.5e-4) and all(c == 0 for d, c in cost.items() if d >= day(50))


def test_scores_that_are_not_finite_have_no_weight(spark):
    import datetime

    d = datetime.date(2020, 1, 31)
    rows = [(d, f"t{i}", "s" if i % 2 else "u", float(i)) for i in range(20)] + [(d, "nan", "s", float("nan")), (d, "inf", "s", float("inf")), (d, "none", "s", None)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, score double").withColumn("e", F.lit(float("nan")))
    for out in (portfolio.neutral_to_sector(df), portfolio.neutral_to_factor(df, "e"), portfolio.neutralise(df, ["e"])):
        assert {r["ticker"] for r in out.collect()} == {f"t{i}" for i in range(20)}
    cfg = {"portfolio": {"leg": "top_decile", "short_leg": "bottom_quintile", "weighting": "equal", "max_name": 1.0, "max_sector": 1.0, "long_only": False}}
    w = {r["ticker"]: r["weight"] for r in portfolio.rank_portfolio(df, cfg).collect()}
    assert sum(x > 0 for x in w.values()) == 3 and sum(x < 0 for x in w.values()) == 4 and "nan" not in w


def test_neutralization_can_be_disabled(spark):
    import datetime

    df = spark.createDataFrame([(datetime.date(2020, 1, 31), f"t{i}", "s", float(i), float(i % 3)) for i in range(9)], "date date, ticker string, sector string, score double, size double")
    out, check = portfolio.run_neutralization(df, {"neutralization": {"enabled": False, "exposures": ["size"], "proportion": 1.0}})
    assert check is None and all(r["neutral"] == r["score"] for r in out.collect())
    out, check = portfolio.run_neutralization(df, {"neutralization": {"enabled": True, "exposures": ["size"], "proportion": 1.0}})
    assert abs(sum(r["neutral"] * r["size"] for r in out.collect())) < 1e-9 and check.first()["exposure"] == "size"


def test_coercion_columns_and_wide_prices(spark):
    df = spark.createDataFrame([("1.5", "2020-01-02", 3), ("x", "n/a", 4), (None, None, None)], "a string, d string, n int")
    got = features.coerced(df, ["a", "missing"], ["d"])
    assert [(r["a"], str(r["d"]), r["missing"]) for r in got.collect()] == [(1.5, "2020-01-02", None), (None, "None", None), (None, "None", None)]
    assert features.numeric_columns(got, ("n",)) == ["a", "missing"]
    wide = spark.createDataFrame([("d1", 1.0, 2.0, None), ("d2", None, None, 5.0)], "date string, `open|A` double, `close|A` double, `close|B` double")
    assert sorted((r["date"], r["ticker"], r["open"], r["close"]) for r in features.long_prices(wide).collect()) == [("d1", "A", 1.0, 2.0), ("d2", "B", None, 5.0)]


def test_feature_and_labelling_pipelines(spark):
    import datetime

    from tessera.config import load_config

    cfg = load_config()
    day = lambda i: datetime.date(2019, 1, 1) + datetime.timedelta(i)
    rows = [(day(i), t, "s", *[100 + 10 * math.sin(i / 9 + k)] * 5, 1000.0 + i) for k, t in enumerate("ab") for i in range(400)]
    prices = spark.createDataFrame(rows, "date date, ticker string, sector string, open double, high double, low double, close double, adj_close double, volume double")
    made = features.feature_pipeline(prices, None, cfg)
    assert {"rsi_14", "obv_zscore", "ret_252d"} <= set(made.columns) and made.count() == 800
    found, summary = labels.run_labeling(prices, cfg)
    assert found.count() == sum(r["down"] + r["flat"] + r["up"] for r in summary.collect()) > 0


def test_waterfall_and_interaction(spark):
    e = spark.createDataFrame([("k", [0.5, -2.0, 1.0])], "key string, contributions array<double>")
    got = [(r["feature"], r["contribution"], r["start"], r["end"]) for r in reports.waterfall(e, ["a", "b", "c"], "key", 2).orderBy("place").collect()]
    assert got == [("b", -2.0, 0.0, -2.0), ("c", 1.0, -2.0, -1.0), ("others", 0.5, -1.0, -0.5)]
    rows = spark.createDataFrame([("k", 7.0, 8.0)], "key string, a double, b double")
    assert tuple(reports.interaction(rows, e, ["a", "b", "c"], "key", "a", "b").first()) == ("k", 7.0, 0.5, 8.0)


def test_early_stopping_ends_before_the_last_round(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.random(), i % 2, i > 300) for i in range(400)], "x double, label_binary int, monitor boolean")
    stopped = modeling.primary_model(["x"], rounds=30, monitor="monitor").fit(rows).stages[-1]
    assert stopped.getNumTrees < 30
