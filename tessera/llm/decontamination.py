"""Benchmark decontamination by a positional inverted index, in SQL functions only.

1. The test items' windows give a vocabulary; the corpus' words are counted, and each window's terms are put
   in the order of their postings, rarest first. Windows with a term that the corpus lacks are done with.
2. The postings (document, term, position) of the rarest terms of all windows are stored: a row each, without
   the text.
3. Lists are intersected from the rarest term on: its postings with those of the second and third that stand
   nearby (a proximity match), then with those at the very offsets that the window asks for. What is left of a
   window's places is compared with the text, which only documents with such places give: a phrase match.

No row holds more than one posting until the places of a document are gathered, so a term or window of however
many places is dealt out like any other, and joins on hot terms split as Spark splits skewed joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .words import alnum_words


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words): the windows of ``size`` consecutive words of each item; an item of fewer words, but
    not none, is one window. Equal windows of an item are one."""
    split = items.select("item_id", alnum_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words")).distinct()


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term, pos): every place of the terms in the documents, words counted from 0."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))
    return written(each.join(small(terms.withColumnRenamed("term", "_term")), F.col("term") == F.col("_term"), "left_semi").select("doc_id", "text_hash", "term", "pos"), "postings")


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))


def _near(places: DataFrame, postings: DataFrame, term: str, reach: int) -> DataFrame:
    """The places with a posting of ``term`` at most ``reach`` words away, found by stretches of that length."""
    length = reach + 1
    other = postings.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("term").alias("_term"), F.col("pos").alias("_pos"), F.floor(F.col("pos") / length).alias("_stretch"))
    around = places.withColumn("_s", F.explode(F.sequence(F.floor((F.col("pos") - reach) / length), F.floor((F.col("pos") + reach) / length))))
    met = around.join(other, _same_document() & (F.col(term) == F.col("_term")) & (F.col("_s") == F.col("_stretch")) & (F.abs(F.col("pos") - F.col("_pos")) <= reach), "left_semi")
    return met.drop("_s").distinct()


def _at(places: DataFrame, postings: DataFrame, term: str, offset: str) -> DataFrame:
    """The places with a posting of ``term`` at its offset from where the window would begin."""
    other = postings.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("term").alias("_term"), F.col("pos").alias("_pos"))
    return places.join(other, _same_document() & (F.col(term) == F.col("_term")) & (F.col("start") + F.col(offset) == F.col("_pos")), "left_semi")


def matches(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, text_hash, hits, near): for each document with a match the exact matches as structs of start
    (in words), length and items, and the items of windows whose three rarest terms are all within
    ``size`` words of the rarest one. Documents are told apart by id and a hash of the text."""
    found = windows(items, size)
    by_window = written(found.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("window", F.monotonically_increasing_id()), "windows")
    terms = written(by_window.select(F.explode("words").alias("_term")).distinct(), "terms")
    # counted before they are joined: as many rows are shuffled as there are unlike words, not places
    counts = docs.select(F.explode(alnum_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = written(counts.join(small(terms), F.col("term") == F.col("_term")).select("term", "n"), "term-counts")
    listed = by_window.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term")).join(counts, "term")
    ranked = listed.groupBy("window", "length").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("t")).filter(F.size("t") == F.col("length"))
    place = lambda i: F.coalesce(F.get("t", F.lit(i)), F.get("t", F.lit(0)))
    index = written(ranked.select("window", "length", *[place(i)[c].alias(f"{c}{i}") for i in range(3) for c in ("term", "offset")]), "window-index")
    rare = written(index.select(F.explode(F.array("term0", "term1", "term2")).alias("term")).distinct(), "rare-terms")
    postings = _postings(docs, rare)
    places = postings.join(small(index), F.col("term") == F.col("term0")).drop("term")
    reach = size - 1
    near = written(_near(_near(places, postings, "term1", reach), postings, "term2", reach), "near")
    starts = near.withColumn("start", F.col("pos") - F.col("offset0")).filter("start >= 0")
    exact = written(_at(_at(starts, postings, "term1", "offset1"), postings, "term2", "offset2").select("doc_id", "text_hash", "window", "start", "length"), "places")
    hits = _phrases(docs, exact, by_window)
    near_items = near.select("doc_id", "text_hash", "window").distinct().join(by_window.select("window", "items"), "window").groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("near"))
    joined = near_items.join(hits, _same_document(), "left").drop("_doc", "_hash")
    return joined.withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))


def _phrases(docs: DataFrame, places: DataFrame, by_window: DataFrame) -> DataFrame:
    """(_doc, _hash, hits): the places at which the text has all words of the window."""
    asked = places.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("window", "start", "length")).alias("asked"))
    some = written(places.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "matched")
    of = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(small(some), _same_document(), "left_semi")
    once = of.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")).select("doc_id", "text_hash", alnum_words(F.col("text")).alias("w"))
    cut = F.transform("asked", lambda x: F.struct(x["window"].alias("window"), x["start"].alias("start"), F.slice("w", x["start"] + 1, x["length"]).alias("got")))
    each = once.join(asked, _same_document()).select("_doc", "_hash", F.explode(cut).alias("c")).select("_doc", "_hash", "c.window", "c.start", "c.got")
    same = each.join(by_window, "window").filter(F.col("got") == F.col("words"))
    return same.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("start", F.size("words").alias("n"), "items")).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items, one row for each row.

    A word inside any occurrence of a window is hit. A document is contaminated if it has hits and
    ``share`` * n_hit >= n_words. Null texts have no words, no hits and are clean. Rows of equal id and text
    get equal results; rows of equal id and another text their own. Items that are null, empty or without
    words have no windows; equal items count each. Without documents there are no rows, without items no hits.
    """
    found = matches(docs, items, size)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["n"]).alias("z")))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct(F.greatest(s["end"], x["z"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["end"], x["a"]))).alias("sum")), lambda s: s["sum"])
    names = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))
    some = found.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), covered.cast("long").alias("hit"), F.size(names).cast("long").alias("items"),
        F.array_join(F.array_sort(F.transform(names, lambda i: i.cast("string"))), ",").alias("listed"), F.size("near").cast("long").alias("near"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The documents that aren't contaminated, columns as given; nulls and repeats as in ``contamination``.
    Only the contaminated ones' ids and text hashes are joined back."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    bad = written(contamination(keyed, items, size).filter("contaminated").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_hash")).distinct(), "contaminated")
    kept = docs.withColumn("_text_hash", F.xxhash64("text")).join(small(bad), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    return kept.drop("_text_hash")
