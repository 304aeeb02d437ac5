"""The corpus queries on the driver's small tables against SQL or brute force."""

import hashlib
import os
import re
import sys
from collections import defaultdict
from itertools import combinations

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import assert_same, connect  # noqa: E402

from tessera.llm.oracles import ORACLES  # noqa: E402
from tessera.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sf(request):
    return f"/root/testdata/{request.param}"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def test_suffix_dedup_by_scanning_every_string(spark, sf, texts):
    got = {r["doc_id"]: r for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()}
    seen = {}
    for i in sorted(texts):
        t = texts[i].encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if t[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_minhash_by_all_pairs(spark, sf, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for members in inverted.values():
        for pair in combinations(sorted(members), 2):
            common[pair] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    for r in QUERIES["op6_minhash"](spark, sf).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_personal_data_by_the_patterns(spark, sf, texts):
    def luhn(s):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    for r in QUERIES["op8_pii"](spark, sf).collect():
        t = texts[r["doc_id"]]
        found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))]
        found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
        listed = ",".join(f"{k}:{a}:{z}" for k, a, z in found)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"].startswith(listed)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")]


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = out.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
