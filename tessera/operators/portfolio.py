"""Bet sizes, neutral scores, portfolios, costs and their replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rolling import TINY, clip, pct_rank

#: The least rank of a long leg, and the largest of a short one.
LEGS = {"top_decile": 0.9, "top_vigintile": 0.95, "top_quintile": 0.8}
SHORT_LEGS = {"bottom_decile": 0.1, "bottom_quintile": 0.2}


def finite(x: str) -> Column:
    """Whether a number is neither null nor NaN nor infinite."""
    c = F.col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def bet_size(direction: Column, probability: Column, method: str | Column, least: float | Column, cap: float | Column) -> Column:
    """Size of a bet by ``meta_prob``, ``half_kelly`` or ``equal``, 0 below the least probability."""
    m, lo, c = (x if isinstance(x, Column) else F.lit(x) for x in (method, least, cap))
    raw = F.when(m == "meta_prob", direction * probability).when(m == "half_kelly", direction * 0.5 * F.greatest(2 * probability - 1, F.lit(0.0))).otherwise(direction * 1.0)
    return F.when(probability < lo, 0.0).otherwise(F.greatest(-c, F.least(c, raw)))


def rank_portfolio(scores: DataFrame, cfg: dict, by: tuple[str, ...] = ("date",), compat: bool = False) -> DataFrame:
    """``scores`` (date, ticker, sector, score) with weight, for rows with a finite score. Where all scores of a leg
    are 0, conviction gives no weight (0 / 0 counts as 0).

    The top of the ranks (and the bottom, unless long only) is weighted by score or equally, scaled to a sum
    of 1 a side, cut at the name's cap, scaled to the sector's cap and scaled to 1 again; caps needn't hold
    after that last step. ``compat`` divides short weights by minus their sum, which turns them positive.
    """
    c = cfg["portfolio"]
    top, bottom = LEGS[c["leg"]], SHORT_LEGS[c["short_leg"]]
    day = W.partitionBy(*by)
    ranked = scores.filter(finite("score")).withColumn("_rank", pct_rank("score", *by))
    long, short = F.col("_rank") >= top, (F.col("_rank") <= bottom) & F.lit(not c["long_only"])
    if c["weighting"] == "conviction":
        part = lambda leg: F.try_divide(F.col("score"), F.sum(F.when(leg, F.abs("score"))).over(day))
    else:
        part = lambda leg: F.try_divide(F.lit(1.0) if leg is long else F.lit(-1.0), F.sum(F.when(leg, 1)).over(day))
    weighted = ranked.withColumn("_w", F.coalesce(F.when(short, part(short)).when(long, part(long)), F.lit(0.0)))

    def normalised(df: DataFrame) -> DataFrame:
        up = F.sum(F.when(F.col("_w") > 0, F.col("_w"))).over(day)
        down = F.sum(F.when(F.col("_w") < 0, -F.col("_w"))).over(day)
        scaled = F.when(F.col("_w") > 0, F.col("_w") / up)
        if not c["long_only"]:
            scaled = scaled.when(F.col("_w") < 0, F.col("_w") / (-down if compat else down))
        return df.withColumn("_w", scaled.otherwise(F.col("_w")))

    capped = normalised(weighted).withColumn("_w", clip(F.col("_w"), -c["max_name"], c["max_name"]))
    side = F.when(F.col("_w") > 0, 1).when((F.col("_w") < 0) & F.lit(not c["long_only"]), -1).otherwise(0)
    exposed = capped.withColumn("_side", side).withColumn("_exposure", F.sum(F.abs("_w")).over(W.partitionBy(*by, "_side", "sector")))
    over = (F.col("_side") != 0) & (F.col("_exposure") > c["max_sector"]) & F.col("sector").isNotNull()
    scaled = exposed.withColumn("_w", F.when(over, F.col("_w") * c["max_sector"] / F.col("_exposure")).otherwise(F.col("_w")))
    return normalised(scaled).withColumn("weight", F.col("_w")).drop("_rank", "_w", "_side", "_exposure")


def turnover(weights: DataFrame, cost_bps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(date, turnover, cost) of each rebalance: changes of the names that are in the new portfolio."""
    dates = weights.select(*by, "date").distinct()
    numbered = dates.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("date") if by else W.orderBy("date")))
    now = weights.join(numbered, [*by, "date"])
    before = now.select(*by, F.col("ticker"), (F.col("_k") + 1).alias("_k"), F.col("weight").alias("_old"))
    change = F.sum(F.abs(F.col("weight") - F.coalesce("_old", F.lit(0.0))))
    return now.join(before, [*by, "ticker", "_k"], "left").groupBy(*by, "date").agg(change.alias("turnover")).withColumn("cost", F.col("turnover") * cost_bps / 10_000)


def market_impact(trades: DataFrame, nav: float = 1e8) -> DataFrame:
    """(date, impact) of trades with weight, vol and adv (dollars a day): the sum of |w| vol sqrt(|w| nav / adv);
    an unknown or zero adv counts as 1e12, an unknown vol as 0."""
    w = F.abs("weight")
    adv = F.coalesce(F.when(F.col("adv") != 0, F.col("adv")), F.lit(1e12))
    return trades.groupBy("date").agg(F.sum(w * F.coalesce("vol", F.lit(0.0)) * F.sqrt(w * nav / adv)).alias("impact"))


def neutral_to_sector(scores: DataFrame, proportion: float = 1.0) -> DataFrame:
    """``scores`` with neutral: the residual on sector dummies without the first sector of the date (whose
    rows keep their score), divided by the date's population deviation."""
    scores = scores.filter(finite("score"))
    day = W.partitionBy("date")
    mean = F.avg("score").over(W.partitionBy("date", "sector"))
    first = F.col("sector") == F.min("sector").over(day)
    residual = F.when(first, F.col("score")).otherwise(F.col("score") - proportion * mean)
    return _scaled(scores.withColumn("_e", residual))


def neutral_to_factor(scores: DataFrame, factor: str, proportion: float = 1.0) -> DataFrame:
    """``scores`` with neutral: the residual on one numeric exposure through the origin, a null one counting
    as 0, divided by the date's population deviation."""
    scores = scores.filter(finite("score"))
    day = W.partitionBy("date")
    e = F.when(finite(factor), F.col(factor)).otherwise(0.0)
    beta = F.coalesce(F.try_divide(F.sum(e * F.col("score")).over(day), F.sum(e * e).over(day)), F.lit(0.0))
    return _scaled(scores.withColumn("_e", F.col("score") - proportion * beta * e))


def _scaled(df: DataFrame) -> DataFrame:
    spread = F.stddev_pop("_e").over(W.partitionBy("date"))
    return df.withColumn("neutral", F.when(spread >= TINY, F.col("_e") / spread).otherwise(F.col("_e"))).drop("_e")


def exposure_matrix(rows: pd.DataFrame, levels: list[str], numeric: list[str]):
    """The exposures of a date's rows: dummies of the sector levels and the numeric ones, 0 where they aren't finite."""
    import numpy as np

    columns = [(rows["sector"] == v).to_numpy(float) for v in levels] + [np.nan_to_num(rows[c].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0) for c in numeric]
    return np.column_stack(columns) if columns else np.zeros((len(rows), 0))


def neutralise(scores: DataFrame, numeric: list[str], proportion: float = 1.0, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``scores`` (date, ticker, sector, score, numeric exposures) with neutral, by the pseudo-inverse of the
    date's exposures: dummies of its sectors without the first, and the numeric ones. One date (or group
    of ``by``) is one task's matter, of as many rows as there are names."""
    import numpy as np

    def residual(rows: pd.DataFrame) -> pd.DataFrame:
        s = rows["score"].to_numpy(float)
        levels = sorted(rows["sector"].dropna().unique())[1:]
        e = exposure_matrix(rows, levels, numeric)
        out = s - proportion * (e @ (np.linalg.pinv(e) @ s)) if e.shape[1] else s
        spread = out.std()
        return rows.assign(neutral=out / spread if spread > TINY else out)

    kept = scores.select(*by, "ticker", "sector", "score", *numeric).filter(finite("score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.groupBy(*by).applyInPandas(residual, f"{schema}, neutral double")


def exposure_slopes(neutral: DataFrame, exposures: list[str]) -> DataFrame:
    """(exposure, slope, r2, n): regressions of the neutral score on each exposure over all dates, with an
    intercept. An exposure without spread has slope 0."""
    aggs = []
    for e in exposures:
        x, y = F.col(e).cast("double"), F.col("neutral")
        aggs.append(F.struct(F.lit(e).alias("exposure"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias("r2"), F.regr_count(y, x).alias("n")))
    return neutral.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def run_neutralization(scores: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame | None]:
    """(``scores`` with neutral, the check of the numeric exposures over all dates): each date by itself. Where
    neutralisation is disabled the score passes through, and there is no check; nor is there one without numeric exposures."""
    c = cfg["neutralization"]
    if not c["enabled"]:
        return scores.withColumn("neutral", F.col("score")), None
    numeric = [e for e in c["exposures"] if e != "sector"]
    given = scores if "sector" in c["exposures"] else scores.withColumn("sector", F.lit("all"))
    out = neutralise(given, numeric, c["proportion"])
    return out, slope_p_values(exposure_slopes(out, numeric)) if numeric else None


def slope_p_values(slopes: DataFrame) -> DataFrame:
    """``slopes`` with p: two-sided, from the t statistic, by the regularised incomplete beta function."""
    @F.pandas_udf("double")
    def p(r2: pd.Series, n: pd.Series) -> pd.Series:
        from ..functions.special import t_test_p

        return pd.Series([t_test_p(a, int(b)) for a, b in zip(r2, n, strict=True)])

    return slopes.withColumn("p", p("r2", "n"))
