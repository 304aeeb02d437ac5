"""Exact top-k inner-product search by block-at-a-time pruning.

1. Order: each vector goes to the nearest of some pivots (a bounded sample of the vectors), and vectors are laid
   out by pivot and nearness. Runs of that order are blocks, runs of blocks are parts; a block is stored as
   a dense matrix, its forward index, beside the largest and smallest value of each term (component).
2. Bound: a block's bound for a query is the sum over the terms of the query's weight times the block's largest
   value there, or its smallest where the weight is negative: no vector of the block can score higher. The
   bound of a part is made of its blocks' ends in the same way.
3. Three waves: each query is scored in the part that it would lie in itself, which gives a first k-th score;
   then in the sixteenth of the parts of the highest bounds; then in all others whose bound reaches the k-th
   score that it has by then. A query is sent to no other part. Within a part, blocks are visited from the
   highest bound on, until no bound reaches the k-th score so far.

What is left out depends on the data: vectors without any clusters have loose bounds, and all pairs are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Up to here sums of products of two vectors are whole numbers in double precision, however they are added.
EXACT = 2.0**52
_LONG = 2**63 - 1
#: A sixteenth of the parts is scored before the others.
EARLY = 16
#: Parts whose bounds a task looks at together, and queries that it looks at.
GROUP, CHUNK = 4096, 4096


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components as floor(scale * x) of x as double. Vectors that are null or hold a
    null or non-finite component are left out, and so are null ids."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows padded with zeros, so vectors of unlike lengths score over the components that both have."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width) if width else np.zeros((0, 0))


def bounds(queries: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """By query and block, what no vector of the block can exceed."""
    zero = queries * 0
    return np.maximum(queries, zero) @ tops.T + np.minimum(queries, zero) @ lows.T


class Blocks:
    """Vectors in blocks, rows of a block by id."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, block: int = 128):
        edges = range(0, len(ids), block)
        order = np.concatenate([e + np.argsort(ids[e : e + block], kind="stable") for e in edges]) if len(ids) else np.zeros(0, int)
        self.ids, self.docs, self.block = ids[order], docs[order], block
        self.tops = np.array([self.docs[e : e + block].max(axis=0) for e in edges])
        self.lows = np.array([self.docs[e : e + block].min(axis=0) for e in edges])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list, list, list, int]:
        """(query index, candidate id, score) of each query's k best, and how many scores were computed.

        A block is left out only if its bound is strictly below the k-th score (or ``floor``, a lower bound of
        it that is known before), so ties at the k-th place are decided by the smaller id as in a full scan.
        """
        if not len(self.ids) or not len(queries):
            return [], [], [], 0
        docs, tops, lows = self.docs, self.tops, self.lows
        if np.abs(docs).max(initial=0) * np.abs(queries).max(initial=0) * max(1, docs.shape[1]) >= EXACT:  # whole numbers of any size
            exact = np.vectorize(int, otypes=[object])
            docs, tops, lows, queries = (exact(x) for x in (docs, tops, lows, queries))
        reach = bounds(queries, tops, lows)
        visit = np.argsort(-reach, axis=1, kind="stable")
        limit: list = [-np.inf] * len(queries) if floor is None else floor.tolist()
        best: list[list[tuple]] = [[] for _ in range(len(queries))]
        scored, active = 0, np.arange(len(queries))
        for step in range(visit.shape[1]):
            b = visit[active, step]
            keep = np.array([x >= limit[q] for x, q in zip(reach[active, b], active, strict=True)], bool)
            active, b = active[keep], b[keep]
            if not len(active):
                break
            for one in np.unique(b):
                who = active[b == one]
                lo, hi = one * self.block, min(len(self.ids), (one + 1) * self.block)
                scores = queries[who] @ docs[lo:hi].T
                scored += scores.size
                for row, q in zip(scores, who, strict=True):
                    good = np.flatnonzero((row >= limit[q]) & (self.ids[lo:hi] != query_ids[q]))
                    if len(good) > k:
                        good = good[np.argsort(-row[good], kind="stable")[:k]]
                    if len(good):
                        best[q] = sorted(best[q] + [(-int(row[i]), int(self.ids[lo + i])) for i in good])[:k]
                        if len(best[q]) == k:
                            limit[q] = max(limit[q], -best[q][-1][0])
        found = [(q, i, -s) for q, b in enumerate(best) for s, i in b]
        return [q for q, _, _ in found], [i for _, i, _ in found], [max(-_LONG - 1, min(_LONG, s)) for _, _, s in found], scored


_PACKED = "part int, kind int, at long, ids binary, data binary, tops binary, lows binary"
_SENT = "part int, kind int, at long, ids binary, data binary, floors binary"
_FOUND = "query_id long, vec_id long, score long, scored long"


class _Index:
    """Candidates in parts, with the queries that lie in them."""

    def __init__(self, candidates: DataFrame, queries: DataFrame, n: int, width: int, rows_per_part: int, block: int, pivots: int):
        self.width, self.block = width, block
        some = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # a bounded sample
        centres = np.zeros((len(some), width))
        for i, r in enumerate(some):
            centres[i, : len(r["v"])] = r["v"]
        centres /= np.maximum(1.0, np.abs(centres).max(axis=1, keepdims=True))
        centres /= np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), width)
                unit = x / np.maximum(1.0, np.abs(x).max(axis=1, initial=0, keepdims=True))
                close = unit / np.maximum(1e-12, np.linalg.norm(unit, axis=1, keepdims=True)) @ centres.T
                at = close.argmax(axis=1)
                columns = [b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2), pa.array(at, pa.int32()), pa.array(-close[np.arange(len(x)), at], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "kind", "pivot", "far"])

        both = candidates.select("vec_id", "v", F.lit(0).alias("kind")).union(queries.select("vec_id", "v", F.lit(1)))
        placed = both.mapInArrow(near, "vec_id long, v binary, kind int, pivot int, far double")
        order = ["pivot", "far", "vec_id"]
        dealt = placed.repartitionByRange(max(1, -(-n // rows_per_part)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {0: [], 1: []}
            part, at = 0, 0

            def out(kind: int, rows: list) -> pa.RecordBatch:
                ids, x = np.array([r[0] for r in rows], np.int64), _of(b"".join(r[1] for r in rows), width)
                made = Blocks(ids, x, len(ids))
                ends = (made.tops.tobytes(), made.lows.tobytes()) if kind == 0 else (None, None)
                row = {"part": part, "kind": kind, "at": at, "ids": made.ids.tobytes(), "data": np.ascontiguousarray(made.docs).tobytes(), "tops": ends[0], "lows": ends[1]}
                return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), *[(c, pa.binary()) for c in ("ids", "data", "tops", "lows")]]))

            for b in batches:
                for i, v, kind, p in zip(*(b.column(c).to_pylist() for c in ("vec_id", "v", "kind", "part")), strict=True):
                    part = p
                    held[kind].append((i, v))
                    if len(held[kind]) == (block if kind == 0 else CHUNK):
                        yield out(kind, held[kind])
                        held[kind], at = [], at + 1
            for kind in (0, 1):
                if held[kind]:
                    yield out(kind, held[kind])
                    at += 1

        packed = written(dealt.select("vec_id", "v", "kind", "part").mapInArrow(pack, _PACKED), "topk-blocks")
        self.blocks, self.queries = packed.filter("kind = 0"), packed.filter("kind = 1")

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.stack([np.frombuffer(t, np.float64), np.frombuffer(w, np.float64)]).tobytes() for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.binary())], names=["part", "ends"])

        def whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: dict[int, np.ndarray] = {}
            for b in rows:
                for p, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    pair = np.frombuffer(e, np.float64).reshape(2, -1)
                    now[p] = np.stack([np.maximum(now[p][0], pair[0]), np.minimum(now[p][1], pair[1])]) if p in now else pair
            yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int32()), pa.array([v.tobytes() for v in now.values()], pa.binary())], names=["part", "ends"])

        schema = "part int, ends binary"
        by_part = self.blocks.select("part", "tops", "lows").mapInArrow(ends, schema).repartition("part").mapInArrow(whole, schema)
        groups = by_part.groupBy(F.expr(f"part div {GROUP}").alias("g")).agg(F.sort_array(F.collect_list(F.struct("part", "ends"))).alias("parts"))  # ``GROUP`` parts at most
        self.groups = written(groups, "topk-bounds")

    def score(self, sent: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score, scored) of queries sent to parts, and a row of how many scores a part took."""
        width, block = self.width, self.block
        rows = self.blocks.select("part", "kind", "at", "ids", "data", F.lit(None).cast("binary").alias("floors")).union(sent.select("part", "kind", "at", "ids", "data", "floors"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, index = None, [], None
            for b in batches:
                for p, kind, _, ids, data, floors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if p != part:
                        part, held, index = p, [], None
                    if kind == 0:
                        held.append((np.frombuffer(ids, np.int64), _of(data, width)))
                        continue
                    if not held:
                        continue
                    if index is None:  # blocks come first; they are whole but for a part's last one
                        index = Blocks(np.concatenate([i for i, _ in held]), np.concatenate([d for _, d in held]), block)
                    own = np.frombuffer(ids, np.int64)
                    who, found, scores, n = index.search(own, _of(data, width), k, np.frombuffer(floors, np.float64) if floors else None)
                    yield pa.RecordBatch.from_arrays([pa.array([*(int(own[q]) for q in who), None], pa.int64()), pa.array([*found, None], pa.int64()), pa.array([*scores, None], pa.int64()), pa.array([None] * len(who) + [n], pa.int64())], names=["query_id", "vec_id", "score", "scored"])

        return written(rows.repartition("part").sortWithinPartitions("part", "kind", "at").mapInArrow(run, _FOUND), "topk-found")

    def send(self, queries: DataFrame, wave: int) -> DataFrame:
        """Queries (part, ids, data, early, floors: the k-th scores before the second wave and now) to the parts
        of a wave: the early ones, or all others, whose bound reaches the k-th score."""
        width = self.width
        count = self.groups.count()
        wide = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 1 else queries.withColumn("g", F.lit(0))
        groups = self.groups.select(F.row_number().over(W.orderBy("g")).alias("_n"), F.col("parts.part").alias("p"), F.col("parts.ends").alias("e"))  # a row for thousands of parts
        joined = wide.join(groups, F.col("g") + 1 == F.col("_n")).select("part", "ids", "data", "early", "floors", "p", "e")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for home, ids, data, early, floors, parts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own, q = np.frombuffer(ids, np.int64), _of(data, width)
                    before, now = np.frombuffer(early, np.float64), np.frombuffer(floors, np.float64)
                    both = np.array([np.frombuffer(e, np.float64).reshape(2, -1) for e in ends])
                    with np.errstate(over="ignore", invalid="ignore"):
                        reach = bounds(q, both[:, 0], both[:, 1])
                    # rounding of the bounds of very large values must not leave out a part
                    reach = np.where(np.isfinite(reach), reach + np.abs(reach) * 1e-9, np.inf)
                    away = np.array(parts) != home
                    first = np.zeros(reach.shape, bool)
                    order = np.argsort(-np.where(away, reach, -np.inf), axis=1, kind="stable")[:, : max(1, len(parts) // EARLY)]
                    np.put_along_axis(first, order, True, axis=1)
                    first &= reach >= before[:, None]
                    chosen = (first if wave == 2 else ~first & (reach >= now[:, None])) & away
                    for j in np.flatnonzero(chosen.any(axis=0)):
                        who = np.flatnonzero(chosen[:, j])
                        row = {"part": int(parts[j]), "kind": 1, "at": int(own[who[0]]), "ids": own[who].tobytes(), "data": q[who].tobytes(), "floors": now[who].tobytes()}
                        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), *[(c, pa.binary()) for c in ("ids", "data", "floors")]]))

        return joined.mapInArrow(run, _SENT)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.filter("query_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, rows_per_part: int = 8192, block: int = 128, pivots: int = 256) -> tuple[DataFrame, DataFrame | None]:
    """The result of ``top_k``, and the rows behind it with ``scored``, whose sum is the number of scores that
    were computed (None for an empty table)."""
    spark = candidates.sparkSession
    candidates, queries = written(candidates, "topk-candidates"), written(queries.distinct(), "topk-queries")
    n, width = candidates.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wide = queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if not n or not queries.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), None
    index = _Index(candidates, queries, n, max(1, width, wide), rows_per_part, block, pivots)
    found = index.score(index.queries.withColumn("floors", F.lit(None).cast("binary")), k)
    before = _kth(found, k)
    asked = _floored(index.queries, before, "early")
    if index.groups.selectExpr("sum(size(parts))").first()[0] > 1:
        found = found.union(index.score(index.send(asked.withColumn("floors", F.col("early")), 2), k))
        found = found.union(index.score(index.send(_floored(asked, _kth(found, k), "floors"), 3), k))
    return _best(found, k), found


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th score of the queries that have one by now."""
    return written(_best(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "topk-kth")


def _floored(queries: DataFrame, kth: DataFrame, out: str) -> DataFrame:
    """Packed queries with ``out``: the k-th scores in the order of their ids, as doubles that are no larger."""
    unpacked = queries.select("part", "at", F.posexplode(_longs("ids")).alias("i", "query_id")).join(kth.select(F.col("query_id").alias("_q"), "kth"), F.col("query_id") == F.col("_q"), "left")
    listed = unpacked.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("i", "kth"))).alias("k")).select(F.col("part").alias("_part"), F.col("at").alias("_at"), F.col("k.kth").alias("_kth"))  # ``CHUNK`` queries

    @F.pandas_udf("binary")
    def packed(values):
        import pandas as pd

        return pd.Series([np.nextafter(np.array([-np.inf if x is None or x != x else float(x) for x in v]), -np.inf).tobytes() for v in values])

    return queries.join(listed, (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at"))).withColumn(out, packed(F.transform("_kth", lambda x: x.cast("string")))).drop("_part", "_at", "_kth")


def _longs(column: str) -> F.Column:
    @F.pandas_udf("array<long>")
    def unpack(values):
        import pandas as pd

        return pd.Series([np.frombuffer(v, np.int64) for v in values])

    return unpack(F.col(column))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, rows_per_part: int = 8192, block: int = 128, pivots: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all candidates but those of its own id, by
    inner product, ties to the smaller id. Inputs as of ``quantised``, ids from the whole 64-bit range;
    repeated rows are candidates of their own, and equal vectors fall into several parts where they are many;
    repeated queries are one. Other columns don't matter.
    Vectors of unlike lengths score over the components that both have. Scores beyond 64 bits become the
    ends of that range. Without candidates or queries there are no rows. No task holds more than a part and
    a batch of queries.
    """
    return search(candidates, queries, k, rows_per_part, block, pivots)[0]
