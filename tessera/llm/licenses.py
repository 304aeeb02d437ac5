"""License scan by a positional index of rare license words, in SQL functions only.

1. Every template is a sequence of words with a mandatory key phrase in it. The corpus gives each word of a key
   phrase its document frequency, and the ``RARE`` words of the highest inverse document frequency of each
   phrase are looked up. The index has their postings: by word, the phrases and the word's offset there.
2. In a file, the postings of each license word that stands in it vote for the place where a phrase would begin,
   by relative position. A place that all looked-up words of a phrase vote for is where their lists intersect.
3. There the whole key phrase is verified, and the share of each of its templates' words that stand in their
   places is the template's score.

Index and templates are data, not code: their number doesn't change the plan. All lookups stay in the text's own
row, so nothing is shuffled but the document frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import alnum_words

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, template, key phrase. The words of well-known public license notices.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: A template counts from this share of its words on.
LEAST = 0.6
#: Words of a phrase that are looked up.
RARE = 2


def phrases(templates: tuple = TEMPLATES) -> list[str]:
    return sorted({*BASE, *(key for _, _, key in templates)})


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How many documents hold each of a fixed list of words (as many rows reach the driver at most)."""
    found = F.array_distinct(F.filter(alnum_words(F.col("text")), lambda w: w.isin(words)))
    return {r["w"]: r["n"] for r in docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def index_of(keys: list[str], counts: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """(postings, votes): by word the (phrase, offset) pairs, and how many words of each phrase are looked up.
    The lowest count is the highest inverse document frequency; ties go to the longer, then the first word."""
    postings: dict[str, list[tuple[int, int]]] = {}
    votes = []
    for p, key in enumerate(keys):
        words = key.split()
        rare = sorted(set(words), key=lambda w: (counts.get(w, 0), -len(w), w))[:RARE]
        votes.append(len(rare))
        for w in rare:
            postings.setdefault(w, []).append((p, words.index(w)))
    return postings, votes


def _literal(values: list, kind: str) -> Column:
    """A constant array of SQL values."""
    return F.array(*values).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row.

    n_base counts all places of base phrases, overlapping ones too. Null and empty texts have no words,
    no places, empty label lists, score 0 and null first and last word. Repeated rows are scanned each, an
    empty table gives no rows, and other columns don't matter.
    """
    keys = phrases(templates)
    counts = document_frequencies(docs, sorted({w for p in keys for w in p.split()}))
    postings, votes = index_of(keys, counts)
    names = sorted(postings)
    by_word = F.create_map(*[x for w in names for x in (F.lit(w), _literal([F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in postings[w]], "struct<p:int,o:int>"))])
    key_words = F.array(*[_list(k.split()) for k in keys])
    # the templates of a phrase: number, words, and where the phrase stands in them
    of_key = [[(i, t.split(), _place(t.split(), k.split())) for i, (_, t, key) in enumerate(templates) if key == k] for k in keys]
    template = "struct<i:int,words:array<string>,first:int>"
    by_key = F.array(*[_literal([F.struct(F.lit(i).alias("i"), _list(ws).alias("words"), F.lit(f).alias("first")) for i, ws, f in ts], template) for ts in of_key])

    split = docs.select("doc_id", alnum_words(F.col("text")).alias("_w"))
    met = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(names), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    looked = split.select("doc_id", "_w", met.alias("_met"))
    vote = F.array_sort(F.flatten(F.transform("_met", lambda x: F.transform(F.element_at(by_word, x["w"]), lambda p: F.struct(p["p"].alias("p"), (x["i"] - p["o"]).alias("start"))))))
    voted = looked.select("doc_id", "_w", F.when(F.size("_met") > 0, vote).otherwise(F.array().cast("array<struct<p:int,start:int>>")).alias("_votes"))
    # sorted votes: a place has all of a phrase's votes if the last of them stands where it should
    needed = F.array(*[F.lit(v) for v in votes])
    full = F.filter("_votes", lambda v, i: (F.get("_votes", i + F.get(needed, v["p"]) - 1) == v) & ((i == 0) | (F.get("_votes", i - 1) != v)))
    whole = F.filter(full, lambda v: (v["start"] >= 0) & (F.slice("_w", F.greatest(v["start"], F.lit(0)) + 1, F.size(F.get(key_words, v["p"]))) == F.get(key_words, v["p"])))
    placed = voted.select("doc_id", "_w", F.when(F.size("_votes") > 0, whole).otherwise(F.col("_votes")).alias("_at"))

    def scores(v: Column) -> Column:
        hit = lambda t: F.aggregate(F.transform(t["words"], lambda w, j: (F.coalesce(F.get("_w", v["start"] - t["first"] + j), F.lit("")) == w).cast("int")), F.lit(0), lambda s, x: s + x)
        return F.transform(F.get(by_key, v["p"]), lambda t: F.struct(t["i"].alias("i"), (hit(t) / F.size(t["words"])).alias("score")))

    some = F.size("_at") > 0
    scored = placed.select("doc_id", F.size("_w").cast("long").alias("n_words"), "_at", F.when(some, F.flatten(F.transform("_at", scores))).otherwise(F.array().cast("array<struct<i:int,score:double>>")).alias("_scores"))
    base = F.array(*[F.lit(BASE.get(k)) for k in keys])
    named = scored.select("doc_id", "n_words", "_scores", F.filter("_at", lambda v: F.get(base, v["p"]).isNotNull()).alias("_base"))
    label = F.array(*[F.lit(t[0]) for t in templates])
    base_labels = F.transform("_base", lambda v: F.get(base, v["p"]))
    labels = F.transform(F.filter("_scores", lambda s: s["score"] >= LEAST), lambda s: F.get(label, s["i"]))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("_base", lambda v: v["start"])
    return named.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(base_labels).alias("base_labels"), listed(F.concat(base_labels, labels)).alias("labels"), F.coalesce(F.array_max(F.transform("_scores", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def _place(words: list[str], key: list[str]) -> int:
    """Where the key phrase stands in the template."""
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)
