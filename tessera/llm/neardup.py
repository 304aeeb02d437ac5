"""Near-duplicate documents: MinHash bands propose candidates, a sequential Bayesian test prunes them, and
full shingle sets confirm what is left.

1. Texts of the same word sequence are one class; only classes are compared, so copies cost nothing.
2. A class's signature is the least value of each of ``bands * rows`` hash functions over its shingles.
   Classes that agree in a band share a bucket. At the given similarity the chance that no band agrees
   is below one in a million.
3. Candidates are pairs within a bucket, and only of classes that no confirmed links connect yet: first each
   class with the most central class of its buckets (the one with the most mates in all of its own), then
   with the central classes of its other buckets, then all pairs that are left, each in the bucket of the
   first band that it shares. So many copies of one text are connected by as many pairs as there are copies,
   and candidates that turn out unlike connect nothing.
4. Signatures of candidates are compared batch by batch. After each batch the posterior of the similarity (a
   uniform prior, so a beta distribution) bounds the chance that it reaches the threshold; pairs below
   ``miss`` are dropped. What survives is confirmed on the full sets. Signatures are compared by the low byte of
   each value: unlike values agree in it one time in 256, which lets more pairs through, and never fewer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, dropped, mix64, shingles, small, space_words, written
from .components import connected_components

BANDS, ROWS = 25, 5
BATCH = 25
#: Bytes of text in one go: numpy needs about eighty times as much for a moment.
CHUNK = 1_000_000
_U32 = np.uint64(32)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """For each set of shingle hashes, values[offsets[i]:offsets[i + 1]], the least of n 32-bit hash
    functions; sets are not empty."""
    mul, add = _family(n)
    out = np.empty((len(offsets) - 1, n), np.uint32)
    if not len(out):
        return out
    for i in range(n):
        hashed = ((values * mul[i] + add[i]) >> _U32).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(hashed, offsets[:-1])
    return out


def least_matches(threshold: float, n: int, batch: int, miss: float) -> dict[int, int]:
    """After k compared hashes, the fewest matches at which P(similarity >= threshold | matches) is still
    at least ``miss``: one minus the distribution function of Beta(m + 1, k - m + 1)."""
    out = {}
    for k in range(batch, n + 1, batch):
        tail = 0.0  # P(Binomial(k + 1, threshold) <= m) = P(Beta(m + 1, k - m + 1) >= threshold)
        for m in range(k + 1):
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= miss:
                out[k] = m
                break
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature a 64-bit key of each band."""
    banded = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        keys = mix64(keys * _MUL + banded[:, :, r])
    return keys.view(np.int64)


def _class(text: bytes) -> str:
    """Names the word sequence of a text, A-Z lower-cased."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).hexdigest()


def _sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, values, offsets) of the shingles of the texts, a megabyte of text at a time."""
    for lo, hi in chunks(texts, CHUNK):
        hashes, owner = space_words(texts[lo:hi])
        yield lo, *shingles(hashes, owner, hi - lo, size)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, and, null without words, class (of the word sequence), keys (a 64-bit bucket of each band) and sketch (the low byte of each of the signature's values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2).to_pylist())
            counts, names, keys, sketches = [], [], [], []
            for lo, values, offsets in _sets(texts, size):
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                sig = signatures(values, np.append(offsets[:-1][some], offsets[-1]))
                at = {int(t): i for i, t in enumerate(some)}
                banded, low = band_keys(sig), sig.astype(np.uint8)
                for t in range(len(n)):
                    i = at.get(t)
                    counts.append(int(n[t]))
                    names.append(None if i is None else _class(texts[lo + t]))
                    keys.append(None if i is None else banded[i].tobytes())
                    sketches.append(None if i is None else low[i].tobytes())
            columns = [pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "text_hash", "n_shingles", "class", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class string, keys binary, sketch binary")


def surviving(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, matches): the pairs (row of ``a``, row of ``b``) that the sequential test leaves, whose sets
    have ``n_a`` and ``n_b`` shingles. A set that is too small for the other can't hold enough of it."""
    at = np.flatnonzero(np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b))
    same = np.zeros(len(at), np.int64)
    for k in range(BATCH, a.shape[1] + 1, BATCH):
        same = same + (a[at, k - BATCH : k] == b[at, k - BATCH : k]).sum(axis=1)
        keep = same >= least[k]
        at, same = at[keep], same[keep]
    return at, same


def similar(mine: np.ndarray, theirs: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough."""
    if len(mine) > len(theirs):
        mine, theirs = theirs, mine
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    both = int((theirs[at] == mine).sum())
    return both * 100 >= percent * (len(mine) + len(theirs) - both)


def _stack(column) -> np.ndarray:
    """Binary values of one length as a matrix of bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1) if values else np.zeros((0, BANDS * ROWS), np.uint8)


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether this connects what wasn't connected."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _tasks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each task, from batches sorted by the columns ``keys``."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        where = np.column_stack([b.column(c).to_numpy() for c in keys]) if b.num_rows else np.zeros((0, len(keys)), np.int64)
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and tuple(where[lo]) != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            now = tuple(where[lo])
    if held:
        yield pa.Table.from_batches(held)


TASK = ("task", "a", "b")


class _Task:
    """One bucket, or a pair of its tiles: which pairs are to be compared here, and which survive."""

    def __init__(self, rows: pa.Table, percent: int, least: dict[int, int]):
        self.percent, self.least = percent, least
        order = np.argsort(rows.column("cid").to_numpy(), kind="stable")
        self.rows = rows.take(pa.array(order))
        self.tile, self.cid, self.root, self.n = (self.rows.column(c).to_numpy() for c in ("tile", "cid", "root", "n"))
        self.a, self.b, self.band = (self.rows.column(c)[0].as_py() for c in ("a", "b", "band"))
        self.sig = _stack(self.rows.column("sketch"))
        self.keys = np.frombuffer(b"".join(self.rows.column("keys").to_pylist()), np.int64).reshape(len(self.cid), BANDS)

    def mates(self, i: int) -> np.ndarray:
        """The later rows of other components that survive with row i; a pair that shares an earlier band is
        another task's."""
        at = np.arange(i + 1, len(self.cid))
        at = at[(self.root[at] != self.root[i]) & (self.tile[at] == (self.b if self.tile[i] == self.a else self.a))]
        if self.band and len(at):
            at = at[~(self.keys[at, : self.band] == self.keys[i, : self.band]).any(axis=1)]
        left, same = surviving(np.broadcast_to(self.sig[i], (len(at), self.sig.shape[1])), self.sig[at], np.full(len(at), self.n[i]), self.n[at], self.percent, self.least)
        return at[left[np.argsort(-same, kind="stable")]]


class _Search:
    """One search for near duplicates: its classes, the rounds of candidates, and the components so far."""

    def __init__(self, docs: DataFrame, size: int, percent: int, miss: float, tile: int):
        self.docs, self.size, self.percent, self.tile = docs, size, percent, tile
        self.least = least_matches(percent / 100, BANDS * ROWS, BATCH, miss)
        self.tables: list[DataFrame] = []
        self.described = self._written(describe(docs, size), "described")
        some = self.described.filter(F.col("class").isNotNull()).groupBy("class")
        # the written ids stay as they are; only how pairs are tried depends on them, not what is found
        self.classes = self._written(some.agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.roots: DataFrame | None = None

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, f"neardup-{name}"))
        return self.tables[-1]

    def run(self) -> None:
        keyed = self.classes.select("cid", "n", F.posexplode(F.array(*[F.substring("keys", 1 + 8 * b, 8) for b in range(BANDS)])).alias("band", "part"))
        keyed = keyed.select("cid", "n", "band", F.xxhash64("band", "part").alias("key"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).filter("members > 1").withColumnRenamed("key", "_key")
        buckets = self._written(keyed.join(sizes, F.col("key") == F.col("_key")).drop("_key"), "buckets")
        mates = buckets.groupBy("cid").agg(F.sum(F.col("members") - 1).alias("mates")).withColumnRenamed("cid", "_cid")
        central = F.max(F.struct("mates", "cid"))
        stars = buckets.join(mates, F.col("cid") == F.col("_cid")).groupBy("key").agg(central.alias("first")).withColumnRenamed("key", "_key")
        spokes = self._written(buckets.join(stars, F.col("key") == F.col("_key")).filter("cid <> first.cid").groupBy("cid", F.col("first.cid").alias("u")).agg(F.max("first.mates").alias("mates")), "spokes")
        best = spokes.groupBy("cid").agg(F.max_by("u", F.struct("mates", "u")).alias("u"))
        self._confirm(self._pruned(best.select("u", F.col("cid").alias("v"))))
        self._confirm(self._pruned(self._apart(spokes.select("u", F.col("cid").alias("v")))))
        self._connect(self._within(buckets))

    def _rooted(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the root of the component of a class, by the links so far."""
        if self.roots is None:
            return df.withColumn(out, F.col(column))
        roots = self.roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return df.join(roots, F.col(column) == F.col("_node"), "left").withColumn(out, F.coalesce("_root", column)).drop("_node", "_root")

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that no links connect yet."""
        if self.roots is None:
            return pairs
        return self._rooted(self._rooted(pairs, "u", "_ru"), "v", "_rv").filter("_ru <> _rv").select("u", "v")

    def _pruned(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that the sequential test leaves."""
        sketch = lambda c: self.classes.select(F.col("cid").alias(f"_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        both = pairs.join(sketch("u"), F.col("u") == F.col("_u")).join(sketch("v"), F.col("v") == F.col("_v")).select("u", "v", "n_u", "n_v", "s_u", "s_v")
        percent, least = self.percent, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, _ = surviving(_stack(b.column(4)), _stack(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy(), percent, least)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["u", "v"])

        return both.mapInArrow(run, "u long, v long")

    def _within(self, buckets: DataFrame) -> DataFrame | None:
        """(u, v): links that connect what the remaining candidates do, those of buckets that hold classes of
        several components. None if there are none.

        Rows meet without their sets first, and only those that have a surviving partner come again with them.
        """
        kept = self._tiled(buckets)
        if kept is None:
            return None
        sketch = self.classes.select(F.col("cid").alias("_c"), "n", "sketch", "keys")
        met = kept.join(sketch, F.col("cid") == F.col("_c")).drop("_c")
        percent, least = self.percent, self.least
        plain = "task long, a int, b int, tile int, band int, cid long, root long"

        def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _tasks(batches, TASK):
                t = _Task(rows, percent, least)
                some = np.zeros(len(t.cid), bool)
                for i in range(len(t.cid)):
                    mates = t.mates(i)
                    some[mates] = True
                    some[i] |= len(mates) > 0
                yield from t.rows.select(["task", "a", "b", "tile", "band", "cid", "root"]).filter(pa.array(some)).combine_chunks().to_batches()

        wanted = self._written(met.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(partnered, plain), "partnered")
        if not wanted.head(1):
            return None
        sets = self._written(self._shingles(wanted.select("cid").distinct()), "sets").withColumnRenamed("cid", "_s")
        full = wanted.join(sketch, F.col("cid") == F.col("_c")).drop("_c").join(sets, F.col("cid") == F.col("_s")).drop("_s")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _tasks(batches, TASK):
                t = _Task(rows, percent, least)
                values = [np.frombuffer(x.as_py(), np.uint64) for x in t.rows.column("set")]
                # rows of one component are connected already
                first: dict[int, int] = {}
                union = _Union(len(t.cid))
                for i, r in enumerate(t.root.tolist()):
                    union.join(first.setdefault(r, i), i)
                us, vs = [], []
                for i in range(len(t.cid)):
                    for j in t.mates(i).tolist():
                        if union.find(i) != union.find(j) and similar(values[i], values[j], percent):
                            union.join(i, j)
                            us.append(t.cid[i])
                            vs.append(t.cid[j])
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        return self._written(full.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(linked, "u long, v long"), "links")

    def _tiled(self, buckets: DataFrame) -> DataFrame | None:
        """(task, a, b, tile, band, cid, root): the rows of the buckets that hold several components.

        A bucket whose sets weigh more than ``tile`` shingles becomes tiles: members of one component in tiles
        of their own, those of small components in mixed ones. A task gets a pair of tiles (a, b), unless both
        are of one component; a bucket that isn't split is the task (0, 0).
        """
        now = self._written(self._rooted(buckets.filter("members > 2"), "cid", "root"), "rooted")
        several = now.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).filter("_a <> _z").select(F.col("key").alias("_key"))
        kept = self._written(now.join(several, F.col("key") == F.col("_key")).select("key", "band", "cid", "n", "root", "members", "weight"), "open")
        if not kept.head(1):
            return None
        tile = self.tile
        zero = F.lit(0)
        light = kept.filter(F.col("weight") <= tile).select(F.col("key").alias("task"), zero.alias("a"), zero.alias("b"), zero.alias("tile"), "band", "cid", "root")
        heavy = kept.filter(F.col("weight") > tile)
        if not heavy.head(1):
            return light
        sizes = heavy.groupBy("key", "root").agg(F.sum("n").alias("w"))
        mixed = sizes.groupBy("key").agg((F.coalesce(F.sum(F.when(F.col("w") < tile, F.col("w"))), F.lit(0)) / tile + 1).cast("int").alias("_mixed")).withColumnRenamed("key", "_k")
        sized = sizes.join(mixed, F.col("key") == F.col("_k")).select(F.col("key").alias("_k"), F.col("root").alias("_r"), "w", "_mixed")
        pure = F.col("w") >= tile
        name = F.when(pure, F.concat_ws(":", "root", F.expr(f"pmod(xxhash64(cid), w div {tile} + 1)"))).otherwise(F.concat_ws(":", F.lit("m"), F.expr("pmod(xxhash64(root), _mixed)")))
        own = heavy.join(sized, (F.col("key") == F.col("_k")) & (F.col("root") == F.col("_r"))).select("key", "band", "cid", "root", name.alias("name"), F.when(pure, F.col("root")).alias("only"))
        names = own.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("name", "only"))).alias("tiles")).withColumnRenamed("key", "_k")  # a tile each, not a member
        place = lambda c: F.array_position(F.transform("tiles", lambda t: t["name"]), c).cast("int")
        others = F.filter("tiles", lambda t: t["only"].isNull() | F.col("only").isNull() | (t["only"] != F.col("only")))
        each = own.join(names, F.col("key") == F.col("_k")).withColumn("tile", place(F.col("name"))).withColumn("o", F.explode(others)).withColumn("other", place(F.col("o.name")))
        return light.union(each.select(F.col("key").alias("task"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "band", "cid", "root"))

    def _confirm(self, pairs: DataFrame) -> None:
        """Confirms pairs (u, v) on their full sets, and brings the components up to date."""
        pairs = self._written(pairs, "candidates")
        if not pairs.head(1):
            return
        sets = self._written(self._shingles(pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()), "sets")
        of = lambda c: sets.select(F.col("cid").alias(f"_{c}"), F.col("set").alias(f"s_{c}"))
        both = pairs.join(of("u"), F.col("u") == F.col("_u")).join(of("v"), F.col("v") == F.col("_v")).select("u", "v", "s_u", "s_v")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                same = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(same, pa.bool_()))

        self._connect(self._written(both.mapInArrow(run, "u long, v long"), "links"))
        dropped(sets)

    def _connect(self, links: DataFrame | None) -> None:
        if links is not None and links.head(1):
            edges = links if self.roots is None else self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)
            self.roots = self._written(connected_components(edges), "roots")

    def _shingles(self, cids: DataFrame) -> DataFrame:
        """(cid, set): the full sets of classes, sorted 64-bit values, from the one document of each class that
        has its least id, or from any if it has no ids."""
        needed = cids.withColumnRenamed("cid", "_cid").join(self.classes.select("cid", "class", "least_id"), F.col("_cid") == F.col("cid")).select("cid", F.col("class").alias("_class"), "least_id")
        needed = self._written(needed, "needed")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = texts.join(small(needed.filter("least_id IS NOT NULL").select(F.col("least_id").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
        if needed.filter("least_id IS NULL").head(1):
            rows = rows.union(texts.filter("doc_id IS NULL"))
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, names, found = b.column(0).to_pylist(), [], []
                texts = as_bytes(b.column(1).to_pylist())
                for lo, values, offsets in _sets(texts, size):
                    names += [_class(t) for t in texts[lo : lo + len(offsets) - 1]]
                    found += [values[a:z].tobytes() for a, z in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["doc_id", "class", "set"])

        made = rows.mapInArrow(run, "doc_id long, class string, set binary")
        return made.join(needed, (F.col("class") == F.col("_class")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).groupBy("cid").agg(F.first("set").alias("set"))

    def named(self) -> DataFrame:
        """(doc_id, text_hash, n_shingles, class, component) of every document."""
        classed = self._rooted(self.classes.select("cid", "class", "least_id"), "cid", "root")
        named = classed.groupBy("root").agg(F.min("least_id").alias("component")).withColumnRenamed("root", "_root")
        of_class = classed.join(named, F.col("root") == F.col("_root")).select(F.col("class").alias("_class"), "root", "component")
        return self.described.select("doc_id", "text_hash", "n_shingles", "class").join(of_class, F.col("class") == F.col("_class"), "left").drop("_class")

    def close(self) -> None:
        for t in self.tables:
            dropped(t)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6, tile: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document.

    Documents link if 100 * common shingles >= percent * all shingles of both; a component is the documents
    that links connect. Null and empty texts have no shingles, link with nothing, and keep their own id.
    Copies, also ones of equal id, are one class; a null id is in the component of its class, but never its
    name (kept is false unless the ids are equal). An empty table gives no rows. Extra columns don't matter.
    A task compares the sets of two tiles of a bucket at most, each of about ``tile`` shingles (or one text's).
    """
    search = _Search(docs, size, percent, miss, tile)
    search.run()
    component = F.coalesce("component", "doc_id")
    out = written(search.named().select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "neardup")
    search.close()
    return out


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6, tile: int = 500_000) -> DataFrame:
    """The documents that stay, columns as given: of each component the one of the least id (of the least text
    hash, where ids are equal or all null), and every document without words. Of rows of equal id and text
    that stay only one does. What goes is joined back, not what stays."""
    search = _Search(docs, size, percent, miss, tile)
    search.run()
    named = written(search.named().filter(F.col("class").isNotNull()).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "neardup-rows")
    search.close()
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stays = named.groupBy("root").agg(F.min(place).alias("best")).select(F.col("root").alias("_root"), "best")
    marked = named.join(stays, F.col("root") == F.col("_root")).withColumn("_best", place == F.col("best"))
    gone = written(marked.filter("NOT _best").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "neardup-gone")
    kept = docs.withColumn("_text_hash", F.xxhash64("text")).join(small(gone), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    repeated = written(marked.filter("_best AND n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "neardup-repeated")
    if not repeated.head(1):
        return kept.drop("_text_hash")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(small(repeated), on, "left_semi").groupBy("doc_id", "_text_hash").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return kept.join(small(repeated), on, "left_anti").drop("_text_hash").union(one)
