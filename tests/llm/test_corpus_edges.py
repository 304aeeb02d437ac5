"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for each operator."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, licenses, mixing, neardup, pii, quality, sharding, suffixes, topk, toxicity
from tessera.llm.components import connected_components

LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, LONG, "b"), (5, "The MIT License.", "a"), (5, "The MIT License.", "a"), (None, "no id here at all", None), (7, "Ünï cödé ßtraße ñ", "b")]
CLASH = ("size", "score", "shard", "block", "part", "key", "taken", "class", "near")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(make):
    return make(ODD, CLASH)


@pytest.fixture(scope="module")
def empty(make):
    return make([])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 120))), (2, "mit license"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], LABELS)


EVERY = {
    "shards": lambda df, labels, items: sharding.shard_documents(df),
    "mix": lambda df, labels, items: mixing.mix_documents(df),
    "licenses": lambda df, labels, items: licenses.scan(df),
    "suffixes": lambda df, labels, items: suffixes.digest(df),
    "quality": lambda df, labels, items: quality.classify(df, labels),
    "near": lambda df, labels, items: neardup.near_duplicates(df),
    "pii": lambda df, labels, items: pii.digest(df),
    "contamination": lambda df, labels, items: decontamination.contamination(df, items),
    "toxicity": lambda df, labels, items: toxicity.classify(df, labels),
}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_odd_rows_and_empty_tables(name, odd, empty, labels, items):
    assert len(EVERY[name](odd, labels, items).collect()) == len(ODD)
    assert EVERY[name](empty, labels, items).collect() == []


def test_filters_keep_columns(odd, labels, items):
    assert toxicity.reject(odd, labels).columns == odd.columns
    assert neardup.deduplicate(odd).columns == odd.columns
    assert decontamination.decontaminated(odd, items).columns == odd.columns
    assert pii.sanitise(odd).columns == odd.columns
    assert mixing.materialise(odd, mixing.mix_documents(odd)).columns == odd.columns


def test_shards_mirror_the_mixture(make):
    docs = make([(i, f"t{i}", "big" if i % 3 else f"s{i % 6}") for i in range(600)])
    rows = sharding.shard_documents(docs, 6).collect()
    for s in range(6):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(100))
        assert abs(sum(r["source"] == "big" for r in own) - 200 / 3) <= 2


def test_mix_takes_its_targets(make):
    rng = random.Random(4)
    docs = make([(i, "w " * rng.randint(0, 400), f"s{i % 5}" if i % 17 else None) for i in range(300)])
    rows = mixing.mix_documents(docs).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 128
        assert own[0]["target"] <= 2 * own[0]["source_size"]
    out = mixing.materialise(docs, mixing.mix_documents(docs)).select("source", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {s: sum(r["taken"] for r in own) for s, own in by.items()}
    assert rows == mixing.mix_documents(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(docs).collect()))


def test_apportionment_is_sainte_lague():
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.choice([0, 1, 3, 3, 10, 77, 1000]) * rng.choice([1, 1, 0.5]) for _ in range(rng.randint(1, 7))]
        for seats in (0, 1, 5, 40):
            want = [0] * len(t)
            for _ in range(seats if any(t) else 0):
                i = max(range(len(t)), key=lambda i: (t[i] / (2 * want[i] + 1), -i))
                want[i] += 1
            assert mixing.apportion(t, seats) == want
    assert mixing.fill_targets([10, 100, 0], [5, 2, 1], 90, 2) == [20, 70.0, 0]


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=8) if i % 4 else np.ones(8)).tolist()) for i in range(300)] + [(900, None), (1000, [float("nan")] * 8), (1100, [None] * 8), (1200, [float("inf")] * 8), (7, [1.0] * 8), (1300, [2.0] * 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    got = {}
    for r in topk.top_k(q, q.filter("vec_id % 100 = 0"), 10, rows_per_part=50, block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    rows = [(i, np.floor(np.pad(np.asarray(v, np.float32).astype(float), (0, 8 - len(v))) * 1024)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    assert set(got) == {0, 100, 200, 1300}
    for i, v in rows:
        if i % 100 == 0:
            best = sorted((-int(v @ w), j) for j, w in rows if j != i)[:10]
            assert sorted(got[i]) == [(k + 1, s, j) for k, (s, j) in enumerate(best)]
    assert topk.top_k(q.filter("false"), q).collect() == []


def test_blocks_below_the_bound_are_not_scored():
    docs = np.zeros((1000, 4))
    docs[:20] = 100
    *_, scored = topk.Blocks(np.arange(1000), docs, 20).search(np.array([5000]), np.ones((1, 4)), 10)
    assert scored == 20


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(3000)]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got, work = topk.search(q, q.filter("vec_id % 100 = 0"), 10, rows_per_part=300, block=32)
    assert work.agg(F.sum("scored")).first()[0] < 0.5 * 30 * 3000
    whole = np.floor(np.array([v for _, v in rows]) * 1024).astype(int)
    for i in (0, 1700):
        best = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:10]
        assert [(-r["score"], r["vec_id"]) for r in got.filter(f"query_id = {i}").orderBy("rank").collect()] == best


def test_ids_of_the_whole_range_and_clashing_columns(spark):
    rows = [(-9 * 10**18, [1.0, 2.0], 1), (5, [3.0, 1.0], 1), (9 * 10**18, [1.0, 1.0], 1), (5, [3.0, 1.0], 1), (7, [1e30, 1.0], 1)]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    got = {}
    for r in topk.top_k(q, q.filter("vec_id <> 7"), 3, rows_per_part=2, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[5]) == [(1, 7), (2, -9 * 10**18), (3, 9 * 10**18)]
    assert [v for _, v in sorted(got[9 * 10**18])] == [7, 5, 5]


def test_repeats_of_many_copies_and_edges(make):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [(i, base[rng.randint(0, 200) :][: rng.randint(20, 260)] + rng.choice("xyz")) for i in range(60)]
    texts += [(100, "a" * 300), (101, "a" * 120 + "b" + "a" * 49), (102, "ä" * 40), (103, "ä" * 40), (104, None), (105, base), (105, base), (106, base[:49]), (107, base[:50])]
    got = [(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffixes.digest(make(texts)).collect()]
    want = []
    for i, t in texts:
        t = (t or "").encode()
        gone = bytearray(len(t))
        smaller = [(u or "").encode() for j, u in texts if j < i]
        for k in range(len(t) - 49):
            if any(t[k : k + 50] in u for u in smaller):
                gone[k : k + 50] = b"\1" * 50
        want.append((i, sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))))
    assert sorted(got) == sorted(want)


def test_interval_scan_gives_every_interval_once():
    common = [3, 5, 5, 2, 4]
    assert sorted(suffixes.intervals(common, 2)) == [(2, 0, 5), (3, 0, 3), (4, 4, 5), (5, 1, 3)]


def test_maximal_repeats_list_all_occurrences():
    rights, lefts = [b"x" * 30 + b"a", b"x" * 30 + b"b", b"x" * 30 + b"c"], [b"q" * 25 + b"1", b"q" * 25 + b"2", b"r"]
    assert [(left, right, sorted(m)) for left, right, m in suffixes.maximal_repeats(rights, lefts, [1, 2, 3], 50)] == [(25, 30, [0, 1])]


def test_near_copies_of_one_base_connect_through_it(make):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        edited = list(base)
        for k in rng.sample(range(300), 6):
            edited[k] = f"e{i}_{k}"
        rows.append((i, " ".join(edited)))
    got = neardup.near_duplicates(make(rows), 3, 85, tile=3000).collect()
    assert {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]
    apart = neardup.near_duplicates(make(rows[1:]), 3, 99).collect()
    assert all(r["kept"] for r in apart)


def test_texts_like_their_neighbours_only_stay_apart(make):
    """A long chain of texts that share half with the next one: their buckets percolate, nothing is linked."""
    words = [f"c{j}" for j in range(9000)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 120])) for i in range(200)] + [(500 + i, " ".join(words[:118]) + f" x{i}") for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make(rows), 3, 85, tile=2000).collect()}
    assert got == {i: i for i in range(1, 200)} | {0: 0} | {500 + i: 0 for i in range(30)}


def test_one_document_of_each_group_stays(make):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, "a b c d e f"), (None, "a  b c d e f"), (8, None), (8, None), (9, "lone text of some words here")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in neardup.deduplicate(make(rows, ("n", "key"))).collect())
    assert [i for i, _ in got] == ["3", "8", "8", "9", "None"]


def test_bayes_bound_lets_similar_pairs_through():
    least = neardup.least_matches(0.85, 125, 25, 1e-6)
    rng = np.random.default_rng(0)
    drawn = rng.binomial(25, 0.85, size=(20_000, 5)).cumsum(axis=1)
    assert (drawn >= np.array([least[k] for k in sorted(least)])).all()
    assert least[125] > 125 * 0.55


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(5, 5), (300, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 140)} | {200: 200, 300: 200}


def test_contamination_by_words(make, items):
    window = " ".join(f"w{i}" for i in range(100, 120))
    docs = make([(1, f"start {window.upper()} end"), (2, "a " * 50 + "MIT, license"), (3, window.replace("w110", "x")), (4, "mit-license mit license")])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (22, 20, 1, True), 2: (52, 2, 1, False), 3: (20, 0, 0, False), 4: (4, 4, 1, True)}


def test_licenses(make):
    docs = make([(1, "Released under the MIT License. x mit-license"), (2, "GNU General Public License"), (3, "ſ MIT lıcense")])
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 3)) for r in licenses.scan(docs).collect()}
    assert got[1] == (8, 2, 3, 6, "mit", "mit", 1.0)
    assert got[2] == (4, 1, 1, 1, "gpl", "gpl", 0.333)
    assert got[3][1:6] == (0, None, None, "", "")


def test_terms_that_reveal_an_entity(make):
    docs = make([(i, f"{w} word{w}x zorgax mail bob@x.com now") for i, w in enumerate(["alpha", "beta", "gamma"])] + [(i, "plain mail text") for i in range(10, 60)])
    rows = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert rows[0]["spans"] == "email:29:38,term:17:23" and rows[10]["spans"] == ""
    assert pii.sanitise(docs).filter("doc_id = 1").first()["text"] == "beta wordbetax [TERM] mail [EMAIL] now"
    copies = make([(i, "alpha zorgax mail bob@x.com now") for i in range(3)] + [(i, "plain mail text") for i in range(10, 60)])
    assert sum(r["n_term"] for r in pii.digest(copies).collect()) == 0


def test_a_far_term_reveals_an_entity_seen_once(make):
    """Against brute force: whole documents are the context, and one meeting is enough in a corpus this large."""
    far = "plain mail text " * 20
    rows = [(0, f"zorgax {far}bob@x.com"), (1, f"Bob@x.com, {far}ann@x.com quux"), (2, f"{far}ann@x.com wombat"), (3, f"quux wombat {far}"), (4, "nobody"), (5, f"grault {far} 10.0.0.1"), (6, f"grault {far} 10.0.0.1")]
    rows += [(i, "plain mail text") for i in range(10, 4000)]
    docs = make(rows)
    of = [(pii.context(t, pii.entities(t))) for _, t in rows]
    words = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for _, t in rows]
    want = {}
    for e in {e for names, _, _ in of for e in names}:
        having = [i for i, x in enumerate(of) if e in x[0]]
        for t in {t for i in having for t in of[i][2]}:
            both = [i for i in having if t in of[i][2]]
            share = pii.disclosure(len(both), len(having), sum(t in w for w in words), len(rows), len({of[i][1] for i in both}))
            if share >= 0.9:
                want[t] = max(share, want.get(t, 0))
    got = {r["term"]: r["disclosure"] for r in pii.revealing_terms(docs, pii.detect(docs)).collect()}
    assert got == pytest.approx(want) and set(got) == {"zorgax", "grault"}
    found = {r["doc_id"]: r for r in pii.digest(docs).filter("n_term > 0").collect()}
    assert found[0]["spans"].endswith("term:0:6") and found[0]["n_term"] == 1 and set(found) == {0, 5, 6}


def test_terms_by_brute_force(make):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=12)) + (f" Rare{chr(97 + i % 26) * 5} mail p{i % 7}@x.com token=ab12cd34ef56ab78cd9 " if i % 40 == 0 else "")) for i in range(1500)]
    docs = make(rows)
    want = {r["term"] for r in pii.revealing_terms(docs, pii.detect(docs)).collect()}
    assert want
    for r in pii.digest(docs).collect():
        text = dict(rows)[r["doc_id"]]
        base = [f"{k}:{a}:{z}" for k, a, z in pii.entities(text)]
        taken = [(a, z) for _, a, z in pii.entities(text)]
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{4,}", text) if m.group().lower() in want and not any(a < m.end() and m.start() < z for a, z in taken)]
        assert r["spans"] == ",".join(base + terms) and r["n_private"] == len(base)


def test_sieve_lets_all_terms_pass(spark):
    terms = [f"term{i}ü" for i in range(5000)]
    sieve = pii.Sieve(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert all(t in sieve for t in terms) and sum(f"other{i}" in sieve for i in range(5000)) < 50


def test_secrets_by_their_information():
    found = lambda t: [t[a:z] for k, a, z in pii.entities(t) if k == "secret"]
    assert found('token = "27660c51feb63980dfaee7464f96210544c03fc3" x') == ["27660c51feb63980dfaee7464f96210544c03fc3"]
    assert found("password=b7db7aa4a5fcc78305 PASSWORD: aaaaaaaaaaaaaaaaaaaaaaaa mytoken=b7db7aa4a5fcc78305 key words") == ["b7db7aa4a5fcc78305"]


def test_many_entities_in_one_text():
    """Fifty thousand entities: quadratic work would take minutes."""
    import time

    text = "".join(f"user login from 10.1.2.{i % 250} accepted for bob{i}@x.com " for i in range(25_000))
    began = time.time()
    found = pii.entities(text)
    assert len(found) == 50_000 and len(pii.context(text, found)[0]) == 25_250
    assert time.time() - began < 20


def test_long_runs_are_scanned_in_linear_time():
    for text in ("password=" + "a" * 200_000, "token=" * 30_000, "a" * 200_000, "a" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1" + " " * 100_000, "@a" * 50_000):
        pii.entities(text)


def test_quality_without_labels_or_class(spark, make):
    rows = quality.classify(make([(1, "x"), (2, None)]), spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]


def test_toxicity_of_clashing_labels_ties_and_reruns(spark, make):
    rng = random.Random(3)
    plain = ["the", "house", "of", "river", "green", "walking", "morning", "table"]
    rows = [(i, " ".join(rng.choices(plain, k=40)) + (" zorblax grumfit zorblax" if i % 3 == 0 else "")) for i in range(400)]
    docs = make(rows + [(1000, "zorblax grumfit"), (1001, "zorblax grumfit"), (1002, None), (1003, "")], CLASH)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)] + [(5, 0, 1), (9000, 0, 1), (None, 0, 1)], LABELS)
    model = toxicity.fit(docs, labels)
    assert model == toxicity.fit(docs.repartition(7), labels.repartition(3)) and len(model["parts"]) == 2
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert got[1000] == got[1001] and got[1002] == got[1003] and got[1002][1] == 0
    assert sum(got[i][1] == int(i % 3 == 0) for i in range(300, 400)) >= 95
    known = {(r["y"], r["half"]): r["count"] for r in toxicity._sample(docs, labels, "toxic", 8000, 24000).groupBy("y", "half").count().collect()}
    assert sum(known.values()) == 299  # the id with labels that contradict each other is left out


def test_hot_ids_and_equal_rows_are_split(make, monkeypatch):
    """Small buckets give the same places as large ones."""
    import functools

    from tessera.llm import common

    rows = [(None, f"t {i} " + "w " * (i % 7), "big") for i in range(600)] + [(7, "same text here", "big")] * 500 + [(i + 100, "x y", f"h{i}") for i in range(400)]
    docs, found = make(rows), []
    for size in (4096, 20):
        for module in (sharding, mixing):
            monkeypatch.setattr(module, "numbered_in_order", functools.partial(common.numbered_in_order, per_bucket=size))
        shards = sharding.shard_documents(docs).collect()
        assert sorted(r["slot"] for r in shards if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in shards)))
        mixed = mixing.mix_documents(docs)
        words = mixing.materialise(docs, mixed).select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
        assert words == mixed.agg(F.sum("taken")).first()[0]
        found.append((sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in shards), sorted((str(r["doc_id"]), r["size"], r["taken"], r["_key"]) for r in mixed.collect())))
        assert sharding.interleave(docs, 24).count() == len(rows)
    assert found[0] == found[1]


def test_words_at_the_edges(spark):
    from tessera.llm import words

    texts = ["a\x00b C\x7fd", "", "  ", None, "\tMIT\x0blicense\x0c", "Ünï İ cödé-x_y[z]`{|}~9", "É"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(words.alnum_words(F.col("t")), words.space_words(F.col("t"))).collect()
    for t, (a, w) in zip(texts, got, strict=True):
        t = t or ""
        assert a == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) and w == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_short_items_and_repeated_documents(spark, make):
    items = spark.createDataFrame([(1, "the"), (2, "rare words here"), (3, "here rare")], "item_id long, text string")
    docs = make([(1, "the cat the dog"), (1, "the cat the dog"), (None, "some rare words here now"), (3, "here is rare")])
    got = sorted((str(r["doc_id"]), r["n_hit"], r["n_items"], r["n_near_items"]) for r in decontamination.contamination(docs, items).collect())
    assert got == [("1", 2, 1, 1), ("1", 2, 1, 1), ("3", 0, 0, 1), ("None", 3, 1, 2)]


def test_many_templates_are_data(make):
    more = (*licenses.TEMPLATES, *((f"own-{i}", f"granted by clause {i} of the house", f"clause {i}") for i in range(150)))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make([(1, "granted by clause 77 of the house"), (2, "clause 200"), (3, "MIT license")]), more).collect()}
    assert got[1] == ("own-77", 1.0) and got[2] == ("", 0.0) and got[3][0] == "mit"


def test_shared_folder_is_needed_off_a_local_master(spark, monkeypatch):
    from tessera.llm import common

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_entry_without_a_library(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("tessera.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    found = entry.queries()
    assert "triple_barrier" in found and "pipeline" not in found and not any(q.startswith("op4_") for q in found)


def test_quality_scores_by_inverses_and_determinants(spark, make):
    """The moments, factors and differences against plain numpy on all rows."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["good", "Fine", "words."] if i % 2 else ["bad!!!", "x", "##", "9"], k=rng.randint(5, 60)))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(4, 1, 0)], LABELS)
    measured = quality.with_statistics(make(rows))
    model = quality.fit(measured, labels)
    chosen = {r["doc_id"] for r in make(rows).filter(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)) % 3 != 0).collect()} - {4}
    x = {i: np.array(quality.statistics(t.encode())) for i, t in rows}
    own = {y: np.array([x[i] for i in sorted(chosen) if i % 2 == y]) for y in (0, 1)}
    cov = {y: np.cov(v.T, bias=True) for y, v in own.items()}
    n = {y: len(v) for y, v in own.items()}
    pooled = sum(cov[y] * n[y] for y in (0, 1)) / sum(n.values())
    z = 0
    at = x[7]
    for y, sign in ((1, 1), (0, -1)):
        a = max(0.1, min(0.9, 2 * len(quality.FEATURES) / n[y]))
        s = 0.95 * ((1 - a) * cov[y] + a * pooled) + 0.05 * np.diag(np.diag(pooled) + 1e-6) + 1e-9 * np.eye(len(pooled))
        d = at - own[y].mean(axis=0)
        z += sign * (np.log(n[y] / sum(n.values())) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.inv(s) @ d)
    want = np.sign(z) * np.log1p(abs(z))
    assert quality.difference(at[None], model)[0] == pytest.approx(want, rel=1e-5)
    slope, offset = model["calibration"]
    got = {r["doc_id"]: r["score"] for r in quality.score(measured, model).collect()}
    assert got[7] == pytest.approx(1 / (1 + np.exp(-np.clip(want * slope + offset, -30, 30))), rel=1e-4)
