"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: the token budget is shared by weight; a source is taken at most ``max_epochs`` times, and what
   it can't take goes to the others by weight.
2. Apportionment: the budget is cut into blocks of ``block_tokens``; blocks go to sources by the highest
   quotients target / (2 k + 1). The method is house-monotone, so the first j blocks are the apportionment
   of j blocks, and consecutive runs of the seats are integer quotas of the output shards.
3. Selection: a source's documents in seeded order are a line of tokens; its blocks are read off that line
   in order, and start again at its beginning once all of it is taken.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copies_of, numbered_in_order, small, written
from .sharding import seeded_hash
from .words import space_words

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def fill_targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets of the sources: ``budget`` shared by weight, none above ``max_epochs`` times its size."""
    caps = [max_epochs * s for s in sizes]
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (caps[i] / weights[i], i))
    left, weight, targets = float(min(budget, sum(caps))), float(sum(weights[i] for i in order)), [0.0] * len(sizes)
    for at, i in enumerate(order):
        if caps[i] > weights[i] * left / weight:
            for j in order[at:]:
                targets[j] = weights[j] * left / weight
            break
        targets[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return targets


def apportion(targets: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: the seats go to the highest quotients target / (2 k + 1), ties to the first source.

    A threshold found by bisection gives nearly all seats at once; the last few go one by one.
    """
    got = [0] * len(targets)
    if seats <= 0 or not any(t > 0 for t in targets):
        return got
    below, above, all_targets = 0.0, max(targets) * 2, np.array(targets)
    for _ in range(200):
        t = (below + above) / 2
        if t <= 0 or np.floor((all_targets / t + 1) / 2).sum() > seats:
            below = t
        else:
            above = t
    got = [max(0, int((x / above + 1) / 2) - 1) for x in targets]
    queue = [(-x / (2 * got[i] + 1), i) for i, x in enumerate(targets) if x > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        heapq.heappush(queue, (-targets[i] / (2 * got[i] + 1), i))
    return got


def plan_sources(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, block_tokens: int, n_shards: int) -> DataFrame:
    """One row a source: source, source_size, target, blocks and quotas (its blocks in the shards before
    each shard). Runs in one task over one row for each source, never over documents."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        given = [(None if v is None or v != v else v, int(s)) for v, s in zip(rows["source"].tolist(), rows["source_size"].tolist(), strict=True)]
        given.sort(key=lambda x: (x[0] is None, x[0] or ""))
        sizes, own = [s for _, s in given], [weights[i % len(weights)] for i in range(len(given))]
        targets = fill_targets(sizes, own, share * sum(sizes), max_epochs)
        seats = round(sum(targets) / block_tokens)
        steps = [apportion(targets, seats * h // n_shards) for h in range(n_shards + 1)]
        return pd.DataFrame({"source": [v for v, _ in given], "source_size": sizes, "target": targets, "blocks": steps[-1], "quotas": [[x[i] for x in steps[:-1]] for i in range(len(given))]})

    return sources.groupBy(F.lit("all")).applyInPandas(plan, "source string, source_size long, target double, blocks long, quotas array<long>")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, block_tokens: int = 64, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard: how many words of each document the mix
    takes (repeats counted), and the shard of the block in which its first word lies (null if untaken).

    Weights repeat over the sources by code point, null last (a null source is a source). Null texts have
    no words; sources without words have target 0. At most one document of a source is cut. Repeated rows
    are documents of their own, an empty table gives no rows. Only narrow columns are shuffled; a hot
    source is split into buckets of the seeded hash.
    """
    narrow = docs.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("_crc"), _row_key(docs).alias("_key"), seeded_hash(F.col("doc_id"), seed).alias("_hash"))
    # rows that are equal are counted, and stand next to each other in the line
    narrow = written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_copies")).withColumns({"_weight": F.col("size") * F.col("_copies"), "_then": F.lpad(F.lower(F.hex("_crc")), 8, "0")}), "mixing-sizes")
    plan = written(plan_sources(narrow.groupBy("source").agg(F.sum("_weight").alias("source_size")), weights, share, max_epochs, block_tokens, n_shards), "mixing-plan").withColumnRenamed("source", "_of")
    lined = numbered_in_order(narrow, ["source"], ["_hash", "doc_id", "_crc", "size", "_key"], "_hash", "_weight", "_at", then="_then")
    lined = copies_of(lined, "_copies").withColumn("_at", F.col("_at") + F.col("_copy") * F.col("size"))
    words = F.least(F.col("blocks") * block_tokens, (F.col("source_size") * max_epochs).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(0)
    rest = F.col("_words") - F.col("_passes") * F.col("source_size")
    joined = lined.join(small(plan), F.col("source").eqNullSafe(F.col("_of"))).withColumn("_words", words).withColumn("_passes", passes)
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    block = F.expr(f"_at div {block_tokens}L")
    shard = F.when(taken > 0, F.size(F.filter("quotas", lambda q: q <= block)) - 1)
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), shard.cast("int").alias("shard"), "source", "_key")


def _row_key(docs: DataFrame) -> Column:
    """Rows of equal id and key are equal in all columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The beginning of the text up to the end of its n-th word, without leading space."""
    pieces = F.split(F.regexp_replace(text, f"^{SPACE}+", ""), rf"(?<={SPACE})(?=[^\x20\x09-\x0D])")
    return F.regexp_replace(F.array_join(F.slice(pieces, 1, n), ""), f"{SPACE}+$", "")


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken in whole, and once more its first words
    where a part of it is taken (n_chars counts that part). Columns as in ``docs``. Of rows that are equal in
    all columns one text is joined with what each of them is taken."""
    keyed = docs.withColumn("_row", _row_key(docs))
    taken = written(mixed.filter("taken > 0").select(F.col("doc_id").alias("_id"), "_key", F.col("size").alias("_size"), F.col("taken").alias("_taken")), "mixing-taken")
    if taken.groupBy("_id", "_key").count().filter("count > 1").head(1):
        columns = [F.col(f"`{c}`") for c in docs.columns]
        keyed = keyed.groupBy(F.col("doc_id").alias("_d"), "_row").agg(F.first(F.struct(*columns)).alias("_one")).select("_one.*", "_row")
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")))
    part = F.expr("int(_taken - _size * (_taken div _size))")
    copies = joined.withColumn("_words", F.explode(F.concat(F.array_repeat(F.lit(-1), F.expr("int(_taken div _size)")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    cut = copies.withColumn("text", F.when(F.col("_words") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.greatest(F.col("_words"), F.lit(1)))))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
