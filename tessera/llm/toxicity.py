"""Toxicity by compression distance: zstandard dictionaries are trained on toxic and on ordinary text, and a
window that the toxic one compresses much better than the ordinary one does speaks for toxicity.

1. The ordinary dictionary is trained on lines of ordinary texts. The toxic one is trained on lines of toxic
   texts without the words that the ordinary dictionary compresses as well as it does others of their length,
   so its few kilobytes go to what is peculiar to toxic text. Labels choose the texts, never the words.
2. A window is a word between its delimiters, between constant runs: the first takes up the frame's overhead,
   so lengths differ by what the word costs, and the last lets matches reach the end of the word (the match
   finder leaves a frame's last 8 bytes alone). Windows of 2 and 4 words were tried and are worse (README).
3. The cell (word length, length under the ordinary dictionary, length under the toxic one) of a window has
   calibrated log-odds. A document's evidence is how many of its windows pass three thresholds of these, how
   many unlike cells do, its strongest window and its number of windows; a logistic fit weighs them.
4. The labelled rows are halved by a hash of the id. Each half trains dictionaries that the other half
   calibrates, so there are two models, and a document's score is the logistic of their mean. The size of
   the toxic dictionary and the excess that lets a word in are those of the least cross-fitted log loss.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

#: Everything in ASCII but digits and letters separates words; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = b"~" * 40
_MEMO = 400_000
#: Tasks that the labelled rows of a fit are dealt to.
TASKS = 32
#: Words in a line that dictionaries are trained on.
LINE = 8
#: A word enters the toxic dictionary's training if it costs so many bytes more than others of its length ...
EXCESS = (0.5, 1.0)
#: ... and the toxic dictionary has so many bytes; all pairs are tried.
TOXIC_BYTES = (2048, 4096)
#: Thresholds of a window's log-odds.
STRONG = (1.0, 2.0, 3.0)
FEATURES = 4 + len(STRONG)


def words(text: bytes) -> list[bytes]:
    """The words of a whole text."""
    return text.translate(_FOLD).split()


def lines(ws: list[bytes]) -> list[bytes]:
    """The words in lines of ``LINE``."""
    return [b" " + b" ".join(ws[i : i + LINE]) + b" " for i in range(0, len(ws), LINE)]


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=15, chain_log=15, search_log=6, target_length=64)


class Lengths:
    """Compressed lengths of windows under a dictionary, over that of the empty one, up to 40."""

    def __init__(self, data: bytes):
        p = _parameters()
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(compression_params=p)
        self.compress = zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress
        self.base = len(self.compress(_RUN + _RUN))

    def of(self, word: bytes) -> int:
        return min(40, len(self.compress(_RUN + b" " + word + b" " + _RUN)) - self.base)


class Memo(dict):
    """A function's values for words seen before, a bounded number of them."""

    def __init__(self, f, most: int = _MEMO):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.f(word)
        return value


def train_dictionary(given: list[bytes], size: int) -> bytes | None:
    """A dictionary trained on lines, of ``size`` bytes or an eighth of theirs; None if they are too few."""
    given = sorted(given)
    random.Random(5).shuffle(given)
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, given)) // 8)), given, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the first is the intercept) of a ridge-regularised logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def cell_odds(toxic: Counter, ordinary: Counter, prior: float = 2.0) -> dict:
    """Log-odds of each cell: its share of the toxic windows over its share of the ordinary ones, drawn to
    no difference by ``prior`` windows. Only those of the lowest threshold on matter, so others are left out."""
    n1, n0 = sum(toxic.values()), sum(ordinary.values())
    r = n1 / max(1, n0)
    found = {c: math.log((toxic[c] + prior * r) / (n1 + 1)) - math.log((ordinary[c] + prior) / (n0 + 1)) for c in toxic}
    return {c: v for c, v in found.items() if v >= STRONG[0]}


def evidence(cells: dict, n: int, odds: dict) -> list[float]:
    """The features of a document of n windows, ``cells`` being the number of windows of each cell (cells
    without odds may be left out)."""
    known = [(odds[c], v) for c, v in cells.items() if c in odds]
    if not known:  # the intercept alone, the log-odds of documents without evidence, however long or short
        return [0.0] * FEATURES
    passing = [math.log1p(sum(v for o, v in known if o >= t)) for t in STRONG]
    return [1.0, math.log1p(n), *passing, math.log1p(sum(o >= STRONG[1] for o, _ in known)), max(o for o, _ in known)]


def _pack(cell: tuple[int, int, int]) -> int:
    return cell[0] << 16 | cell[1] << 8 | cell[2]


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, most_toxic: int, most_ordinary: int) -> DataFrame:
    """(text, y, half, fold): the labelled rows of a fit, equal texts of a label once. An id with labels that
    contradict each other is left out."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("_z")).filter("y = _z")
    keyed = known.select("_id", "y", F.xxhash64(F.col("_id").cast("string"), F.lit(17)).alias("h"))
    # bounded by the two parameters: at most 32,000 rows of 20 bytes reach the driver and the executors
    rows = [r for y, most in ((1, most_toxic), (0, most_ordinary)) for r in keyed.filter(F.col("y") == y).orderBy("h", "_id").limit(most).collect()]
    chosen = spark.createDataFrame([(r["_id"], r["y"], r["h"]) for r in rows], "_id long, y int, h long")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    once = found.groupBy(F.xxhash64("text").alias("_t"), "y").agg(F.min("h").alias("h"), F.first("text").alias("text"))
    # dealt out, so that a task of the fit holds about a thousand texts
    return written(once.repartition(TASKS).select("text", "y", F.expr("int(pmod(h, 2))").alias("half"), F.expr("int(pmod(shiftright(h, 1), 2))").alias("fold")), "toxicity-sample")


def _gathered(sample: DataFrame, y: int, most_bytes: int, keep=None) -> dict[int, list[bytes]]:
    """By half: lines of the texts of a label, about ``most_bytes`` of them at most, chosen by a hash of the
    line, so the driver holds a bounded part of however long texts. ``keep(half, word)`` chooses words."""
    own = sample.filter(F.col("y") == y)
    total = max((r["b"] or 0 for r in own.groupBy("half").agg(F.sum(F.octet_length("text")).alias("b")).collect()), default=0)
    share = min(1.0, most_bytes / max(1, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, half in zip(as_bytes(b["text"]), b["half"], strict=True):
                ws = words(t)
                kept = lines(ws if keep is None else [w for w in ws if keep(half, w)])
                if share < 1:
                    kept = [x for x in kept if int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "big") < share * 2**32]
                out.append(b"\n".join(kept))
            yield pd.DataFrame({"half": b["half"], "lines": out})

    rows = own.mapInPandas(run, "half int, lines binary").collect()
    return {h: [x for r in rows if r["half"] == h for x in bytes(r["lines"]).split(b"\n") if x] for h in (0, 1)}


def _usual(given: list[bytes], cost) -> dict[int, float]:
    """The mean cost of a word of each length, in lines."""
    total, n = Counter(), Counter()
    for w, k in Counter(w for x in given for w in x.split()).items():
        total[min(20, len(w))] += k * cost[w]
        n[min(20, len(w))] += k
    return {k: total[k] / n[k] for k in n}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_toxic: int = 8000, most_ordinary: int = 24000, ordinary_bytes: int = 65536, training_bytes: int = 6_000_000) -> dict:
    """A model from labelled rows: at most ``most_toxic`` and ``most_ordinary`` of them, the first in the
    order of a hash of the id, and at most about ``training_bytes`` of lines for each dictionary. Whole texts
    calibrate. Rows whose label or id is null, and labels without a document, are left out. Without labels of
    both kinds every document scores the share of toxic labels (0 without any). Reruns give the same model.
    """
    sample = _sample(docs, labels, label_col, most_toxic, most_ordinary)
    totals = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    share = sum(n for (y, _), n in totals.items() if y) / max(1, sum(totals.values()))
    model = {"prior": math.log((share + 1e-6) / (1 - share + 1e-6)), "parts": [], "key": ""}
    if not all(totals.get((y, h)) for y in (0, 1) for h in (0, 1)):
        return model
    plain = _gathered(sample, 0, training_bytes)
    ordinary = {h: train_dictionary(plain[h], ordinary_bytes) for h in (0, 1)}
    if None in ordinary.values():
        return model
    usual = {h: _usual(plain[h], Memo(Lengths(ordinary[h]).of)) for h in (0, 1)}
    toxic: dict[tuple[int, int], bytes] = {}
    for e, excess in enumerate(EXCESS):
        own = _gathered(sample, 1, training_bytes, _peculiar(ordinary, usual, excess))
        for s, size in enumerate(TOXIC_BYTES):
            trained = {h: train_dictionary(own[h], size) for h in (0, 1)}
            if None not in trained.values():
                toxic |= {(e * len(TOXIC_BYTES) + s, h): trained[h] for h in (0, 1)}
    tried = sorted({c for c, _ in toxic})
    if not tried:
        return model
    odds, best = _calibrate(sample, ordinary, toxic, tried)
    for half, (choice, weights) in sorted(best.items()):
        model["parts"].append({"toxic": toxic[choice, 1 - half], "ordinary": ordinary[1 - half], "odds": odds[choice, half], "weights": weights})
    model["key"] = hashlib.md5(repr([(p["toxic"], p["ordinary"], sorted(p["odds"].items()), p["weights"]) for p in model["parts"]]).encode()).hexdigest()
    return model


def _peculiar(ordinary: dict[int, bytes], usual: dict[int, dict[int, float]], excess: float):
    """Whether the ordinary dictionary of a half takes ``excess`` bytes more for a word than is usual."""
    costs: dict[int, Memo] = {}

    def keep(half: int, w: bytes) -> bool:
        if half not in costs:
            costs[half] = Memo(Lengths(ordinary[half]).of)
        return len(w) > 2 and costs[half][w] >= usual[half].get(min(20, len(w)), 99) + excess

    return keep


def _calibrate(sample: DataFrame, ordinary: dict, toxic: dict, tried: list[int]) -> tuple[dict, dict]:
    """Odds by (choice, half), and by half the choice of the least cross-fitted log loss with its weights. A
    half is calibrated under the dictionaries of the other one."""

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = {h: Lengths(ordinary[h]) for h in (0, 1)}
        t = {k: Lengths(d) for k, d in toxic.items()}

        def cells_of(h: int):
            def cells(w: bytes) -> list[int]:
                cost = o[h].of(w)
                return [_pack((min(16, len(w)), cost, t[c, h].of(w))) for c in tried]

            return Memo(cells, _MEMO // 8)

        memo = {h: cells_of(h) for h in (0, 1)}
        names = ["choice", "half", "fold", "y", "n", "cells", "counts"]
        for b in batches:
            out: list[tuple] = []
            for text, y, half, fold in zip(b["text"], b["y"], b["half"], b["fold"], strict=True):
                text = (text or "").encode()
                seen = Counter(w for w in words(text) if len(w) > 2)
                each = [Counter() for _ in tried]
                for w, n in seen.items():
                    for c, cell in zip(each, memo[1 - half][w], strict=True):
                        c[cell] += n
                out += [(choice, half, fold, y, sum(seen.values()), list(c), list(c.values())) for choice, c in zip(tried, each, strict=True)]
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    cells = written(sample.mapInPandas(celled, "choice int, half int, fold int, y int, n long, cells array<int>, counts array<long>"), "toxicity-cells")
    each = cells.select("choice", "half", "fold", "y", F.explode(F.arrays_zip("cells", "counts")).alias("c")).groupBy("choice", "half", "fold", "y", "c.cells").agg(F.sum("c.counts").alias("n"))
    counts: dict[tuple, Counter] = {}
    for r in each.collect():  # one row a cell and setting: cells have three small numbers
        counts.setdefault((r["choice"], r["half"], r["fold"], r["y"]), Counter())[r["cells"]] = r["n"]
    of = lambda c, h, folds, y: sum((counts.get((c, h, f, y), Counter()) for f in folds), Counter())
    # each fold's rows get odds from the other fold, so no document's evidence holds its own label
    crossed = {(c, h, f): cell_odds(of(c, h, (1 - f,), 1), of(c, h, (1 - f,), 0)) for c in tried for h in (0, 1) for f in (0, 1)}

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [evidence(dict(zip(cs, vs, strict=True)), n, crossed[c, h, f]) for c, h, f, n, cs, vs in zip(b["choice"], b["half"], b["fold"], b["n"], b["cells"], b["counts"], strict=True)]
            yield pd.DataFrame({"choice": b["choice"], "half": b["half"], "fold": b["fold"], "y": b["y"], "x": x})

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float), rows["fold"].to_numpy()
        order = np.lexsort((*x.T, y, fold))  # sums don't depend on the order of the rows
        x, y, fold = x[order], y[order], fold[order]
        p = np.zeros(len(y))
        for f in (0, 1):
            w = fit_logistic(x[fold != f], y[fold != f])
            p[fold == f] = 1 / (1 + np.exp(-np.clip(w[0] + x[fold == f] @ w[1:], -30, 30)))
        p = np.clip(p, 1e-4, 1 - 1e-4)
        loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        return pd.DataFrame({"choice": [int(rows["choice"].iloc[0])], "half": [int(rows["half"].iloc[0])], "loss": [loss], "weights": [fit_logistic(x, y).tolist()]})

    # a group is half of the bounded sample, six numbers a row
    fits = cells.mapInPandas(featured, "choice int, half int, fold int, y int, x array<double>").groupBy("choice", "half").applyInPandas(fitted, "choice int, half int, loss double, weights array<double>").collect()
    best = {h: min((round(r["loss"], 9), r["choice"], list(r["weights"])) for r in fits if r["half"] == h)[1:] for h in (0, 1)}
    odds = {(c, h): cell_odds(of(c, h, (0, 1), 1), of(c, h, (0, 1), 0)) for h, (c, _) in best.items()}
    return odds, best


class Scorer:
    """Scores texts by a model. A word is looked up once while it is remembered: (cell, log-odds) in each
    part, or nothing if no part has odds for it. The second compression is only done where the first leaves
    room for odds."""

    def __init__(self, model: dict):
        self.model = model
        self.parts = []
        for p in model["parts"]:
            odds = {(c >> 16, c >> 8 & 255, c & 255): v for c, v in p["odds"].items()}
            self.parts.append((Lengths(p["toxic"]), Lengths(p["ordinary"]), odds, {(a, t) for a, _, t in odds}))
        self.memo = Memo(self._look)

    def _look(self, w: bytes) -> tuple | None:
        found = []
        for toxic, ordinary, odds, open_cells in self.parts:
            n, t = min(16, len(w)), toxic.of(w)
            cell = (n, ordinary.of(w), t) if (n, t) in open_cells else None
            found.append(cell if cell in odds else None)
        return tuple(found) if any(found) else None

    def score(self, text: bytes) -> float:
        if not self.parts:
            return 1 / (1 + math.exp(-self.model["prior"]))
        seen = Counter(w for w in words(text) if len(w) > 2)
        n, each = sum(seen.values()), [Counter() for _ in self.parts]
        for w, k in seen.items():
            if (cells := self.memo[w]) is not None:
                for c, cell in zip(each, cells, strict=True):
                    if cell:
                        c[cell] += k
        z = 0.0
        for (*_, odds, _), c, p in zip(self.parts, each, self.model["parts"], strict=True):
            z += p["weights"][0] + sum(a * b for a, b in zip(p["weights"][1:], evidence(c, n, odds), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z / len(self.parts)))))


_LOADED: dict[str, Scorer] = {}


def _scorer(model: dict) -> Scorer:
    key = f"{model['key']}:{model['prior']}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Scorer(model)
    return _LOADED[key]


def score(docs: DataFrame, model: dict, threshold: float = 0.3, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` (doc_id unless said otherwise) with score and predicted, one row a document,
    from the text alone and all of it; null and empty texts have no windows and get the score of no
    evidence. Equal texts score the same. No shuffle; the model is a few hundred kilobytes by its parameters."""
    keep = ["doc_id"] if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{names[0]} double", f"{names[1]} int"])

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            one = _scorer(model).score
            s = [one(b"" if t is None else t.encode()) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=[*keep, *names])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(scored, schema)


def held_out() -> F.Column:
    """Rows whose labels no model may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, learnt from the rows that aren't held out. A row
    without an id isn't held out; repeated rows are scored each; texts that are null or empty score as no
    evidence; an empty table gives no rows. Columns beyond doc_id and text don't matter."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, columns as given; nulls and repeats as in ``classify``."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model, threshold, docs.columns, ("_score", "_toxic")).filter("_toxic = 0").drop("_score", "_toxic")
