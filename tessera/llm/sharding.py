"""Proportional stratified interleaving: every shard is a small copy of the whole mixture.

Rows are shuffled by a seeded hash within their source, each gets its fractional rank there,
``(rank + 1/2) / rows of the source``, and all rows sorted by that fraction are cut into shards whose
row counts differ by one at most. A run of the sorted rows holds every source in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import copies_of, numbered_in_order, small, written

#: Fractions are compared as integers of so many bits (13 hex digits).
FRACTION = 2**52


def seeded_hash(doc_id: Column, seed: int) -> Column:
    """32 hex digits that depend on the id and the seed alone; a null id has its own value."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _ordinals(strata: DataFrame) -> DataFrame:
    """``strata`` (_s, _rows) with _o: 13 hex digits in the order of the strata, null last. Ranges of strata are
    numbered in themselves, so many strata (one a host) are no single task's matter."""
    parts = strata.sparkSession.sparkContext.defaultParallelism
    ranged = written(strata.repartitionByRange(parts, F.col("_s").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "strata")
    before, n = {}, 0
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():  # a row a partition
        before[r["_p"]], n = n, n + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("_p").cast("long"))
    place = start + F.row_number().over(W.partitionBy("_p").orderBy(F.col("_s").asc_nulls_last())) - 1
    return ranged.withColumn("_o", F.lpad(F.lower(F.hex(F.floor(place / float(n) * float(FRACTION)).cast("long"))), 13, "0")).drop("_p")


def interleave(rows: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id", stratum_col: str = "source", ties: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 … n_shards - 1) and ``slot`` (gapless from 0 within the shard).

    Null strata form a stratum of their own and null ids are shuffled like any id. Rows of equal id are
    ordered by ``ties``, the first of which is an unsigned 32-bit hash (a hash of all columns unless given); rows equal in those too are interchangeable, and
    may be given once with their number in the column ``copies``. An empty table stays empty, and
    other columns pass through, whatever they are called but for names that begin with ``_``. With fewer
    rows than shards some shards are empty.
    """
    own = [c for c in rows.columns if c not in ("shard", "slot", copies)]
    number = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    keyed = rows.select(*[F.col(f"`{c}`") for c in own], number.alias("_copies"), seeded_hash(F.col(id_col), seed).alias("_hash"), F.col(stratum_col).alias("_stratum"))
    if ties:  # the first one is an unsigned hash of 32 bits
        keyed = keyed.withColumn("_then", F.lpad(F.lower(F.hex(F.coalesce(F.col(ties[0]), F.lit(0)).cast("long"))), 8, "0"))
    else:
        keyed, ties = keyed.withColumn("_then", F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in own]))), 16, "0")), ("_then",)
    n = keyed.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    hidden = ["_copies", "_hash", "_stratum", "_then"]
    if not n:
        return keyed.drop(*hidden).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    strata = _ordinals(keyed.groupBy(F.col("_stratum").alias("_s")).agg(F.sum("_copies").alias("_rows")))
    ranked = numbered_in_order(keyed, ["_stratum"], ["_hash", id_col, *ties], "_hash", "_copies", "_rank", then="_then")
    if copies:
        ranked = copies_of(ranked, "_copies").withColumn("_rank", F.col("_rank") + F.col("_copy")).drop("_copy")
    fraction = F.floor((F.col("_rank") + 0.5) / F.col("_rows") * float(FRACTION)).cast("long")
    spread = ranked.join(small(strata), F.col("_stratum").eqNullSafe(F.col("_s"))).withColumn("_key", F.lpad(F.lower(F.hex(fraction)), 13, "0"))
    placed = numbered_in_order(spread, [], ["_key", F.col("_o"), "_rank"], "_key", None, "_place", then="_o")
    shard = F.expr(f"(_place * {n_shards}L) div {n}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"_place - (cast(shard as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")).drop(*hidden, "_s", "_o", "_rows", "_rank", "_key", "_place")


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 8; a null text has none), text_crc32 (null for a null text),
    law, shard, slot, grown_shard. The law is ``rows``: shard counts differ by one at most. Only these
    narrow columns are shuffled, never the texts, and rows equal in them are counted first."""
    narrow = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    counted = written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")), "sharding")
    return interleave(counted, n_shards, seed, ties=("text_crc32", "size"), copies="copies").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
