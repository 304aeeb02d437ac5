"""Quality by regularised quadratic discriminant analysis over document statistics.

Each whole text gives a vector of transformed statistics (logs of counts, shares, entropies). The class
means and covariances of the labelled rows are sums of moments, gathered over all of them; covariances
shrink towards the pooled one and its diagonal. A document's score is the logistic of the difference of the
classes' Gaussian log-densities, whose Mahalanobis terms use Cholesky factors computed once, with a
temperature and offset fitted on a second part of the labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 punctuation, 7 other symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 6 if chr(_c) in ".,;:!?'\"()-" else 7
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
_KIND[128:] = 1  # bytes of other letters
FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "space", "punctuation", "symbol", "sentence_marks", "exclamations", "log_lines",
    "bytes_a_line", "distinct_words", "top_word", "distinct_lines", "repeated_line_bytes", "byte_entropy", "pipes", "capital_starts", "long_words", "short_words", "marks_inside", "compressed",
)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES; the empty text has some too."""
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) if n else np.zeros(8, np.int64)
    counts = np.bincount(data, minlength=256) if n else np.zeros(256, np.int64)
    share = lambda x, of=None: np.sqrt(x / max(1, n if of is None else of))  # noqa: E731  evens out small shares
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split(b"\n")
    unlike = set(lines)
    p = counts[counts > 0] / max(1, n)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), share(kinds[2]), share(kinds[3]), share(kinds[4]), share(kinds[6]), share(kinds[7]),
        share(counts[46] + counts[63], len(words)), share(counts[33], len(words)), np.log1p(len(lines)), np.log1p(n / len(lines)), len(tally) / max(1, len(words)) ** 0.9, share(max(tally.values(), default=0), len(words)),
        len(unlike) / len(lines), share(sum(map(len, lines)) - sum(map(len, unlike))), float(-(p * np.log2(p)).sum()), share(counts[124], len(words)),
        share(sum(65 <= w[0] <= 90 for w in words), len(words)), share(int((lengths > 14).sum()), len(words)), share(int((lengths < 3).sum()), len(words)), share(kinds[7], len(words)), len(zlib.compress(text, 1)) / (n + 20),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each document's text (null: empty), without a shuffle."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in as_bytes(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sum and sum of outer products of each class; one partial row a task and class is gathered."""
    width = len(FEATURES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy())]) if len(b) else np.zeros((0, width + 1))
            for y in (0, 1):
                own = x[b["y"].to_numpy() == y]
                sums[y] = sums.get(y, 0) + own.T @ own
        yield pd.DataFrame([(y, i, float(v)) for y, m in sums.items() for i, v in enumerate(m.ravel())], columns=["y", "i", "v"])

    got = labelled.mapInPandas(partial, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for y in (0, 1):
        m = np.zeros((width + 1) ** 2)
        for r in got:
            if r["y"] == y:
                m[r["i"]] = r["v"]
        m = m.reshape(width + 1, width + 1)
        out[y] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", shrink_pooled: float = 0.1, shrink_diagonal: float = 0.05) -> dict | None:
    """Class means, Cholesky factors and the calibration. All labelled rows take part: those of even hash
    give the moments, those of odd hash the calibration. An id with labels
    that contradict each other is left out. None if a class has no row in either part."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    y = known.agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("_z")).filter("y = _z").drop("_z")
    rows = written(measured.join(y, F.col("doc_id") == F.col("_id")).select("x", "y", (F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)) % 3 == 0).alias("cal")), "quality-labelled")
    moments = _moments(rows.filter(~F.col("cal")))
    if min(moments[y][0] for y in (0, 1)) < 2:
        return None
    mean = {c: s / n for c, (n, s, _) in moments.items()}
    cov = {c: xx / n - np.outer(mean[c], mean[c]) for c, (n, _, xx) in moments.items()}
    total = sum(moments[c][0] for c in (0, 1))
    pooled = sum(cov[c] * moments[c][0] for c in (0, 1)) / total
    model: dict = {"mean": mean, "factor": {}, "constant": {}, "calibration": (1.0, 0.0)}
    for c in (0, 1):
        # few rows lean more on the pooled covariance
        a = max(shrink_pooled, min(0.9, 2 * len(FEATURES) / moments[c][0]))
        s = (1 - a) * cov[c] + a * pooled
        s = (1 - shrink_diagonal) * s + shrink_diagonal * np.diag(np.diag(pooled) + 1e-6) + 1e-9 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        model["factor"][c] = np.linalg.inv(factor)
        model["constant"][c] = np.log(moments[c][0] / total) - np.log(np.diag(factor)).sum()
    model["calibration"] = _calibrated(rows.filter("cal"), model)
    return model


def difference(x: np.ndarray, model: dict) -> np.ndarray:
    """Log-density of class 1 less that of class 0, evened out by a signed root for far outliers."""
    d = {c: model["constant"][c] - 0.5 * (((x - model["mean"][c]) @ model["factor"][c].T) ** 2).sum(axis=1) for c in (0, 1)}
    z = d[1] - d[0]
    return np.sign(z) * np.log1p(np.abs(z))


def _calibrated(rows: DataFrame, model: dict, bins: int = 80) -> tuple[float, float]:
    """Slope and offset of the logistic, from a histogram of the differences by label (of bounded size)."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, bins), np.int64)
        for b in batches:
            if len(b):
                k = np.clip((difference(np.stack(b["x"].to_numpy()), model) * 8 + bins / 2).astype(int), 0, bins - 1)
                np.add.at(total, (b["y"].to_numpy(), k), 1)
        yield pd.DataFrame([(y, k, int(total[y, k])) for y in (0, 1) for k in range(bins) if total[y, k]], columns=["y", "k", "n"])

    got = rows.mapInPandas(binned, "y int, k int, n long").groupBy("y", "k").agg(F.sum("n").alias("n")).collect()
    if len({r["y"] for r in got}) < 2:
        return 1.0, 0.0
    z = np.array([(r["k"] - bins / 2 + 0.5) / 8 for r in got])
    y, n = np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)
    w, x = np.zeros(2), np.column_stack([np.ones(len(z)), z])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (n * (y - p)) - 1e-2 * w)
    return float(w[1]), float(w[0])


def score(measured: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row of ``with_statistics``; 0.5 for all without a model."""
    kind = measured.schema["doc_id"].dataType.simpleString()
    if model is None:
        return measured.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, offset = model["calibration"]
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(len(b), len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(difference(x, model) * slope + offset, -30, 30))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.select("doc_id", "x").mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def held_out() -> Column:
    """Rows whose labels no model may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents. Null and empty texts are scored like any text;
    a null id is never held out and never learnt from. The statistics (200 bytes a document) are written
    once, so every text is read once."""
    measured = written(with_statistics(docs), "quality-statistics")
    model = fit(measured, labels.filter(~held_out()))
    return score(measured, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
