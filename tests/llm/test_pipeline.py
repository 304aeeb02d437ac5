"""Every stage of the pipeline against a brute-force version, on its own parameters, with odd rows among the input."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import mixing, toxicity
from tessera.llm.common import table, written

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with copies, rows without an id or a text, and a source of its own."""
    top = str(tmp_path_factory.mktemp("pipeline"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{top}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    window = docs.sparkSession.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 20").orderBy("item_id").first()["text"]
    odd = [(None, text, "en", None, 1), (None, text, "en", None, 1), (10**6, text + " more", "en", None, 1), (10**6 + 1, None, "en", "srcX", 0), (10**6 + 2, "", None, "srcX", 0), (10**6 + 3, window, "en", "srcX", 9), (10**6 + 4, "two words", "en", "srcX", 9), (10**6 + 4, "two words", "en", "srcX", 9)]
    docs.union(spark.createDataFrame(odd, COLUMNS)).write.parquet(f"{top}/documents.parquet")
    return top


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows before the first stage and after each."""
    docs = table(spark, folder, "documents")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), name))
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_toxic_documents_go(spark, folder, stages):
    model = toxicity.fit(stages[0], table(spark, folder, "labels").filter(~toxicity.held_out()))
    one = toxicity.Scorer(model).score
    assert Counter(rows(stages[1])) == Counter(r for r in rows(stages[0]) if one((r[1] or "").encode()) < 0.3)


def test_one_of_each_near_copy_stays(stages):
    given = rows(stages[1])
    sets = []
    for _, text, *_ in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    common, inverted = defaultdict(int), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    for members in inverted.values():
        for pair in combinations(members, 2):
            common[pair] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(given)):
        groups[find(i)].append(i)
    got = Counter(rows(stages[2]))
    assert sum(got.values()) == len(groups) < len(given)
    for members in groups.values():
        ids = [given[i][0] for i in members if given[i][0] is not None]
        kept = [given[i] for i in members if given[i] in got]
        assert kept and (not sets[members[0]] or all(r[0] == (min(ids) if ids else None) for r in kept))


def test_contaminated_documents_go(spark, folder, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in table(spark, folder, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        hit = {i + j for k in sizes for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows for j in range(k)}
        return not (hit and 20 * len(hit) >= len(w))

    assert Counter(rows(stages[3])) == Counter(r for r in rows(stages[2]) if clean(r[1]))
    assert 10**6 + 3 not in {r[0] for r in rows(stages[3])}


def test_the_mix_comes_near_its_targets(stages):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given, out = rows(stages[3]), rows(stages[4])
    size, taken = Counter(), Counter()
    for r in given:
        size[r[3]] += count(r[1])
    for r in out:
        taken[r[3]] += count(r[1])
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.fill_targets([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(size.values()), 2)
    assert all(abs(taken[s] - t) <= 128 for s, t in zip(sources, targets, strict=True))
    texts = defaultdict(set)
    for r in given:
        texts[r[0], r[3]].add(" ".join((r[1] or "").split()))
    assert all(any(known.startswith(" ".join(r[1].split())) for known in texts[r[0], r[3]]) for r in out)


def test_shards_hold_the_mix(stages):
    got = stages[5].collect()
    assert Counter(rows(stages[5])) == Counter(rows(stages[4]))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_a_rerun_agrees(spark, folder, stages):
    key = lambda df: sorted((str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["shard"]) for r in df.collect())
    assert key(pipeline.run(spark, folder)) == key(stages[-1])


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
