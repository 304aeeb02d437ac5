"""Helpers shared by the corpus operators: the shared folder, written tables, tokens as arrays, hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset and the master
    is local (tests on one machine), a temporary folder that is removed at exit; elsewhere executors couldn't
    see such a folder, so this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: the lineage ends there, so a lost
    executor costs a reread and never a recomputation, and values made once stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().getName() == "tessera":
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` dealt out by ``key`` and checkpointed into the shared folder, in a way that later joins and
    cogroups by ``key`` find it dealt out already, so these rows move once. (Spark knows the partitioning
    of a checkpoint only if the plan that made it wasn't adaptive.)"""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parts, key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a table of short values that is read from disk, to be broadcast if it has at most ``rows``
    rows by count; beyond that it is joined like any table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered_in_order(df: DataFrame, group: list[str], order: list, hashed: str, weight: str | None, out: str, per_bucket: int = 4096, then: str | None = None) -> DataFrame:
    """``df`` with ``out``: for each row the number of rows (or the sum of ``weight``) before it in its
    group, in the order of the columns ``order``, the first of which is the string ``hashed`` of
    uniformly spread lower-case hex digits.

    No group is ever sorted in one task: rows fall into buckets by the leading hash digits, bucket totals
    are summed first (with map-side partial sums), and only rows of one bucket meet in a window. A bucket of
    too many rows, as of those without an id, is split by the leading digits of ``then``, a string of hex
    digits by which rows of equal ``hashed`` are in order; what is left together is equal in both.
    A row's number depends on its values alone, so a recomputed task gives the same.
    """
    digits = max(1, min(13, _hex_digits(df.count() / per_bucket)))
    bucketed = df.withColumn("_bucket", F.substring(hashed, 1, digits))
    value = F.col(weight) if weight else F.lit(1).cast("long")
    if then:
        rows = bucketed.groupBy(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 8 * per_bucket)
        most = rows.agg(F.max("_n")).first()[0]
        if most:
            same = F.col("_bucket") == F.col("_hot")
            for i, g in enumerate(group):
                same &= F.col(g).eqNullSafe(F.col(f"_h{i}"))
            finer = F.concat("_bucket", F.substring(hashed, digits + 1, 64), F.lit("/"), F.substring(then, 1, max(1, min(13, _hex_digits(most / per_bucket)))))
            bucketed = bucketed.join(small(rows), same, "left").withColumn("_bucket", F.when(F.col("_n").isNull(), F.col("_bucket")).otherwise(finer)).drop("_hot", "_n", *[f"_h{i}" for i in range(len(group))])
    totals = bucketed.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
    return _offset(bucketed, totals, group, order, value, out)


def copies_of(df: DataFrame, copies: str, block: int = 65_536) -> DataFrame:
    """Each row as often as its column ``copies`` says, with ``_copy`` from 0; many copies of a row are made by
    many tasks."""
    blocks = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(block).cast("long"))))
    if df.filter(F.col(copies) > block).head(1):
        blocks = blocks.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))
    return blocks.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + block, F.col(copies)) - 1))).drop("_from")


def _hex_digits(parts: float) -> int:
    n, digits = 1, 0
    while n < parts:
        n, digits = n * 16, digits + 1
    return digits


def _offset(bucketed: DataFrame, totals: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_offset"))
    inner = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        bucketed.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
        .join(offsets, same)
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_b", "_offset", "_within", *[f"_g{i}" for i in range(len(group))])
    )


# --- token arrays for the operators that run numpy code over Arrow batches ---

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        step = np.uint64(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF)
        done += more
    return out


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def space_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For the words ``[^\\x20\\x09-\\x0D]+`` of all texts: a 64-bit hash of each word, A-Z lower-cased,
    and the index of its text. Texts are UTF-8."""
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = ~_SPACES[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64) * _MUL)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(np.cumsum(lengths), starts, side="right")


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``size`` words of each text: hashes sorted within each text, and where
    each text's shingles begin (n_texts + 1 offsets). A text of fewer words, but some, has one shingle."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        part = np.zeros(len(hashes), np.uint64)
        part[: len(hashes) - i] = hashes[i:] if i else hashes
        rolled = mix64(rolled * _MUL + part + np.uint64(i + 1))
    whole = np.arange(len(hashes)) + size <= first[owner + 1] if len(hashes) else np.zeros(0, bool)
    values, texts = rolled[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = []
        for t in short:
            h = np.uint64(counts[t])
            for w in hashes[first[t] : first[t + 1]]:
                h = mix64(np.array([h], np.uint64) * _MUL + w)[0]
            extra.append(h)
        values, texts = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([texts, short])
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[new], texts[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=n_texts))])


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text of a pandas column or Arrow array; a null is the empty text."""
    return [b"" if t is None else t.encode() if isinstance(t, str) else bytes(t) for t in texts]


def chunks(texts: list[bytes], most: int = 4_000_000):
    """Index ranges of consecutive texts of about ``most`` bytes, so numpy buffers stay bounded whatever
    the batch holds; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
