"""Queries over the whole tables, against brute force."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import features, modeling, reports
from tessera.plans.queries import CUSTOMER_YEAR, QUERIES
from tessera.sources import panels

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _wilder(bars, window=14):
    out, g, down, n, last = {}, 0.0, 0.0, 0, None
    for date, p in bars:
        if last is not None and p is not None:
            up, lost, n = max(p - last, 0.0), max(last - p, 0.0), n + 1
            g, down = (g + up / window, down + lost / window) if n <= window else (g * (window - 1) / window + up / window, down * (window - 1) / window + lost / window)
        out[date] = 100 * g / (g + down) if n >= window and g + down >= 1e-12 else None
        last = p
    return out


def test_wilder_over_many_blocks(spark):
    import datetime

    bars = [(datetime.date(1990, 1, 1) + datetime.timedelta(i), 100 + (i * 7919 % 101) / 7 + i % 13) for i in range(1700)]
    bars[40] = (bars[40][0], None)
    rows = [(d, t, p) for t in ("a", "b") for d, p in (bars if t == "a" else bars[:10])]
    df = spark.createDataFrame(rows, "date date, ticker string, adj_close double")
    got = {(r["ticker"], r["date"]): r["rsi"] for r in features.wilder_rsi(df).collect()}
    want = {("a", d): x for d, x in _wilder(bars).items()} | {("b", d): x for d, x in _wilder(bars[:10]).items()}
    assert got == {k: x if x is None else pytest.approx(x) for k, x in want.items()}
    plan = features.wilder_rsi(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_d" not in plan


@needs_tables
def test_wilder_of_all_bars(spark):
    by = {}
    for r in panels.prices(spark, SF).select("ticker", "date", "adj_close").orderBy("date").collect():
        by.setdefault(r["ticker"], []).append((r["date"], r["adj_close"]))
    want = {(t, d): x for t, bars in by.items() for d, x in _wilder(bars).items()}
    got = {(r["ticker"], r["date"]): r["rsi"] for r in QUERIES["rsi_wilder"](spark, SF).collect()}
    assert got == {k: x if x is None else pytest.approx(x, abs=2e-6) for k, x in want.items()}


def test_never_known_of_a_fixture(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", None, 2.0), ("b", None, None), ("c", 1.0, 2.0)], "ticker string, x double, y double")
    assert sorted(map(tuple, reports.never_known(df, ["x", "y"]).collect())) == [("a", "y"), ("b", "x")]


@needs_tables
def test_never_known_of_all_filings(spark):
    known = {}
    for r in panels.filings(spark, SF, entity=CUSTOMER_YEAR).collect():
        for m in panels.METRICS:
            known[r["ticker"], m] = known.get((r["ticker"], m), False) or r[m] is not None
    got = {tuple(r) for r in QUERIES["never_known"](spark, SF).collect()}
    assert got and got == {k for k, v in known.items() if not v}


@needs_tables
def test_cpcv_evaluates_all_folds_of_two_test_groups_of_ten(spark):
    rows = QUERIES["cpcv_evaluate"](spark, SF).collect()
    assert sorted(r["fold"] for r in rows) == list(range(36))
    assert all(r["n_test"] > 0 and r["n_train"] > 0 and 0 <= r["accuracy"] <= 1 for r in rows)


def test_fold_figures_by_counting_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(f, 5, round(rng.random(), 2), rng.randint(0, 1)) for f in (0, 1) for _ in range(60)]
    got = {r["fold"]: r for r in modeling.fold_figures(spark.createDataFrame(rows, "fold int, n_train long, p double, y int"), "y").collect()}
    for f in (0, 1):
        own = [(p, y) for g, _, p, y in rows if g == f]
        pairs = [(a > b) + (a == b) / 2 for a, x in own if x for b, y in own if not y]
        assert got[f]["auc"] == pytest.approx(sum(pairs) / len(pairs)) and got[f]["n_test"] == 60
        assert got[f]["accuracy"] == pytest.approx(sum((p > 0.5) == bool(y) for p, y in own) / 60)


@needs_tables
def test_macro_panel_of_all_events(spark):
    by = {}
    for r in panels.table(spark, SF, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value").collect():
        by.setdefault(r["date"], {}).setdefault(r["event_type"], []).append(r["value"])
    names, last, want = ["click", "error", "purchase", "signup", "view"], {}, {}
    for date in sorted(by):
        last |= {k: sum(known) / len(known) for k, v in by[date].items() if (known := [x for x in v if x is not None])}
        want[date] = [last.get(k) for k in names]
    got = {r["date"]: [r[k] for k in names] for r in QUERIES["macro_panel"](spark, SF).collect()}
    assert got == {d: [x if x is None else pytest.approx(x, abs=2e-6) for x in v] for d, v in want.items()}


@needs_tables
def test_universe_runs_to_the_last_month(spark):
    last = panels.cross_section(spark, SF).agg(F.last_day(F.max("date"))).first()[0]
    assert QUERIES["universe_rebuild"](spark, SF).agg(F.max("date")).first()[0] == last
    assert QUERIES["survivorship"](spark, SF).count() > 0
