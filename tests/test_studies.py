"""Studies, web tables and the data façade, against brute force and hand-made cases."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import load_config
from tessera.operators import portfolio, studies, universe
from tessera.plans.queries import QUERIES, REPORTED, _technical
from tessera.sources import html

CFG = load_config()
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_web_tables_close_what_is_left_open_and_nest(spark):
    page = "<table><tr><th> Symbol <th>Sector</tr><tr><td>A.B<br>C<td><table><tr><td>in</table>x<tr></tr><tr><td>last &lt;1&gt;</td>"
    assert html.table_rows(page) == [(0, 0, ["Symbol", "Sector"]), (0, 1, ["A.B C", "x"]), (0, 2, ["last <1>"]), (1, 0, ["in"])]
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, "<table><tr><th>Sector<th>Symbol<tr><td>s<td>t</table>")], "id int, page string")
    rows = html.html_tables(pages, "id", "page")
    assert rows.filter("id = 1").count() == 4 and rows.filter("id IN (2, 3)").count() == 0
    got = {(r["id"], r["symbol"], r["sector"]) for r in html.named_cells(rows, 0, {"symbol": "Symbol", "sector": "Sector"}, "id").collect()}
    assert got == {(1, "A.B C", "x"), (1, "last <1>", None), (None, "t", "s")}


def test_roc_points_and_dummy_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (None, 1)], "p double, y int")
    assert sorted(tuple(r) for r in studies.roc_points(df, "p", "y").collect()) == [(0.1, 1.0, 1.0), (0.5, 1.0, 0.5), (0.9, 0.5, 0.5)]
    assert studies.roc_points(df.filter("p > 2"), "p", "y").count() == 0
    assert studies.stratified_dummy(df.filter("p IS NOT NULL"), "y").first()["accuracy"] == 0.5


def test_coefficient_is_null_without_spread(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 2.0, 5.0), (2, 1.0, 1.0), (2, 1.0, 3.0), (1, None, 9.0)], "date int, a double, b double")
    got = {r["date"]: r["ic"] for r in studies.information_coefficient(df, "a", "b").collect()}
    assert got[1] == pytest.approx(np.corrcoef([1, 2.5, 2.5], [1, 2, 3])[0, 1]) and got[2] is None


def test_least_order_finds_what_needs_no_differencing(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    rows = [(k, i, float(x)) for k, xs in (("noise", noise), ("walk", walk), ("flat", [1.0] * 50), ("short", [1.0, 2.0])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    got = {r["ticker"]: r["d"] for r in studies.least_order(df, "x").collect()}
    assert got["noise"] == 0.0 and got["walk"] is not None and got["walk"] > 0 and got["flat"] is None and got["short"] is None
    d, level = np.diff(walk), walk[:-1]
    design = np.column_stack([np.ones(len(d)), level])
    beta, rest = np.linalg.lstsq(design, d, rcond=None)[:2]
    want = beta[1] / np.sqrt(rest[0] / (len(d) - 2) * np.linalg.inv(design.T @ design)[1, 1])
    assert studies.dickey_fuller(df.filter("ticker = 'walk'"), "x").first()["statistic"] == pytest.approx(want)


@needs_tables
def test_loadings_rebuild_the_correlations(spark):
    rows = _technical(spark, SF, REPORTED)
    known = np.array([tuple(r) for r in rows.select(*REPORTED).dropna().collect()])
    found = {(r["component"], r["feature"]): r["loading"] for r in studies.loadings(rows, REPORTED).collect()}
    matrix = np.array([[found[k, f] for k in range(len(REPORTED))] for f in REPORTED])
    np.testing.assert_allclose(matrix @ matrix.T, np.corrcoef(known.T), atol=1e-8)


def test_components_only_where_set(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, None)], "a double, b double")
    assert studies.pca_features(df, ["a", "b"], CFG).columns == ["a", "b"]
    assert len(studies.pca_features(df, ["a", "b"], {"features": {"components": 1}}).first()["components"]) == 1


def test_small_folds_take_the_commoner_label(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1 + i), float(i), int(i % 3 > 0)) for i in range(10)], "ticker string, entry_date date, x double, label_binary int")
    got = studies.out_of_fold(rows, ["x"], folds=5).collect()
    assert len(got) == 10 and {r["call"] for r in got} == {1}


def test_sweep_agrees_with_single_settings(spark):
    rng = np.random.default_rng(5)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(90)]
    names = [f"n{i:02d}" for i in range(12)]
    walk = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (90, 12)), axis=0))
    prices = spark.createDataFrame([(d, n, float(walk[i, j])) for i, d in enumerate(dates) for j, n in enumerate(names)], "date date, ticker string, adj_close double")
    decisions = spark.createDataFrame([(d, n, "s" + str(j % 3), 1 if j % 2 else -1, float(rng.uniform(0.3, 1))) for d in (dates[10], dates[40], dates[70]) for j, n in enumerate(names)], "date date, ticker string, sector string, direction int, probability double")
    cfg = CFG | {"neutralization": CFG["neutralization"] | {"exposures": ["sector"]}}
    got = {(r["method"], r["least"], r["leg"], r["max_name"]): r for r in studies.sweep(decisions, prices, cfg, ["meta_prob", "equal"], [0.4, 0.6], ["top_decile", "top_quintile"], [0.05, 0.5]).collect()}
    assert len(got) == 16 and sorted(r["config_id"] for r in got.values()) == list(range(16))
    from tessera.operators import backtest

    for method, least, leg, cap in [("equal", 0.6, "top_quintile", 0.5), ("meta_prob", 0.4, "top_decile", 0.05)]:
        sized = decisions.withColumn("score", portfolio.bet_size(F.col("direction"), F.col("probability"), method, least, cfg["bets"]["cap"]))
        own = cfg | {"portfolio": cfg["portfolio"] | {"leg": leg, "max_name": cap}}
        scores, _ = portfolio.run_neutralization(sized, own)
        weights = portfolio.rank_portfolio(scores.withColumn("score", F.col("neutral")).select("date", "ticker", "sector", "score"), own)
        want = backtest.performance(backtest.replay(weights.select("date", "ticker", "weight"), prices)).first()
        assert got[method, least, leg, cap]["total_return"] == pytest.approx(want["total_return"])
        assert got[method, least, leg, cap]["n_positions"] == sized.filter("score <> 0").count()


def test_data_pipeline_keeps_names_that_were_ever_members(spark):
    now = spark.createDataFrame([("A", "tech")], "ticker string, sector string")
    changes = spark.createDataFrame([(dt.date(2024, 2, 10), 1, "A", "B")], "date date, seq int, added string, removed string")
    wide = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 2.0, 3.0), (dt.date(2024, 1, 3), None, 2.5, 3.0)], "date date, `close|A` double, `close|B` double, `close|C` double")
    fact = lambda v: {"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "form": "10-K", "filed": "2024-02-01", "val": v}]}}}}}
    docs = spark.createDataFrame([(t, json.dumps(fact(v))) for t, v in (("A", 5.0), ("C", 6.0))], "ticker string, doc string")
    series = spark.createDataFrame([(dt.date(2024, 1, 2), "vix", 12.0), (dt.date(2024, 1, 3), "rate", 4.0)], "date date, series string, value double")
    got = universe.data_pipeline(now, changes, wide, docs, series, "2024-01-01", "2024-03-01")
    assert {(str(r["date"]), r["ticker"]) for r in got["universe"].collect()} == {("2024-01-31", "B"), ("2024-02-29", "A"), ("2024-03-31", "A")}
    assert sorted((r["ticker"], r["close"]) for r in got["prices"].collect()) == [("A", 1.0), ("B", 2.0), ("B", 2.5)]
    assert [(r["ticker"], r["total_assets"]) for r in got["fundamentals"].collect()] == [("A", 5.0)]
    assert [(r["rate"], r["vix"]) for r in got["macro"].orderBy("date").collect()] == [(None, 12.0), (4.0, 12.0)]


@needs_tables
@pytest.mark.parametrize("name", ["model_comparison", "out_of_fold_calls", "pca_features"])
def test_studies_of_models_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
