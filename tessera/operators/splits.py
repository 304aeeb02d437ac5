"""Time splits: combinatorial purged folds, expanding folds and a three-way cut."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import position
from ..sources.stages import kept


def time_groups(labels: DataFrame, groups: int) -> DataFrame:
    """``labels`` with place (0-based, by entry date and ticker), and g: contiguous groups cut at floor(i n / N)."""
    n = labels.count()
    return position(labels, "place", "entry_date", "ticker").withColumn("g", F.expr(f"int(((place + 1) * {groups} - 1) div {max(1, n)})"))


def boundaries(grouped: DataFrame) -> DataFrame:
    """First and last entry date of each group."""
    return grouped.groupBy("g").agg(F.min_by("entry_date", "place").alias("start"), F.max_by("entry_date", "place").alias("end"))


def purged_folds(labels: DataFrame, groups: int = 10, test_groups: int = 2, embargo_days: int = 5) -> DataFrame:
    """(fold, ticker, entry_date, t_barrier, role): for each choice of test groups the test rows, and the
    training rows. Out of training go rows whose barrier is touched at or after a test group's start, and
    rows in the days after a test group's end. Folds without training or test rows are left out, and the
    others numbered from 0 in the order of their groups.
    """
    spark = labels.sparkSession
    # what makes the labels is long, and boundaries, folds and result all need them
    grouped = kept(time_groups(kept(labels.select("ticker", "entry_date", "t_barrier"), "labels"), groups), "groups")
    edge = {r["g"]: (r["start"], r["end"]) for r in boundaries(grouped).collect()}  # one row a group
    rows = [(i, list(c), min(edge[g][0] for g in c), [edge[g][1] for g in c]) for i, c in enumerate(combinations(range(groups), test_groups)) if all(g in edge for g in c)]
    folds = spark.createDataFrame(rows, "combo int, tests array<int>, first date, ends array<date>")
    each = grouped.crossJoin(F.broadcast(folds))  # as many folds as there are choices of groups
    test = F.array_contains("tests", F.col("g"))
    purged = F.coalesce(F.col("t_barrier") >= F.col("first"), F.lit(False))
    embargoed = F.exists("ends", lambda e: (F.col("entry_date") > e) & (F.col("entry_date") <= F.date_add(e, embargo_days)))
    role = F.when(test, "test").when(~purged & ~embargoed, "train")
    split = each.withColumn("role", role).filter(F.col("role").isNotNull())
    full = split.groupBy("combo").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).filter("a > 0 and b > 0").select("combo").collect()
    number = spark.createDataFrame([(c, i) for i, c in enumerate(sorted(r["combo"] for r in full))], "_combo int, fold int")
    return split.join(F.broadcast(number), F.col("combo") == F.col("_combo")).select("fold", "ticker", "entry_date", "t_barrier", "role")


def fold_counts(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


def expanding_folds(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Out-of-fold numbers: fold k is predicted from the folds before it, fold 0 never."""
    n = labels.count()
    return position(labels, "place", "entry_date", "ticker").withColumn("oof_fold", F.expr(f"int(least(place div {max(1, n // folds)}, {folds - 1}))"))


def cutoff(df: DataFrame, by: str, ties: str, share: float):
    """The value of ``by`` at place floor(share n) of the sorted table."""
    n = df.count()
    row = position(df, "place", by, ties).filter(F.col("place") == int(n * share)).select(by).first()
    return row[0] if row else None


def three_way(labels: DataFrame, train: float = 0.8, validation: float = 0.85) -> DataFrame:
    """train up to the first cutoff, validation up to the second, test after it."""
    a, b = cutoff(labels, "entry_date", "ticker", train), cutoff(labels, "entry_date", "ticker", validation)
    return labels.withColumn("part", F.when(F.col("entry_date") <= F.lit(a), "train").when(F.col("entry_date") <= F.lit(b), "validation").otherwise("test"))


def early_stop_carve(train: DataFrame, share: float = 0.9, date: str = "entry_date", ties: str = "ticker") -> DataFrame:
    """``train`` with monitor: true for rows after the date at place floor(share n), which watch a fit."""
    a = cutoff(train, date, ties, share)
    return train.withColumn("monitor", F.coalesce(F.col(date) > F.lit(a), F.lit(False)))
