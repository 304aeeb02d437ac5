"""Information-theoretic sanitisation: personal data by pattern, and terms that reveal it by co-occurrence.

1. Patterns find the protected entities (e-mail addresses, IP addresses, card and phone numbers, and secrets:
   values given to a password, token or key whose characters carry ``SECRET_BITS`` or more).
2. The words of the documents that an entity occurs in are its context. Over the corpus, for each entity e and
   context term t, n(e, t), n(e) and n(t) count documents; the share of the entity's information that the term
   discloses is log2(p(e | t) / p(e)) / -log2 p(e), which is 1 where p(e | t) is 1.
   p(e | t) is n(e, t) / n(t), drawn to p(e) as if by ``prior`` contexts, against the unlike contexts (by their
   sets of terms) that the two were seen in: copies of one text weigh as one, and an entity seen once can have
   a revealing term where the corpus is large enough to tell that the two meeting is no chance.
3. A term at or above the threshold for some entity is a span of kind ``term`` wherever it occurs outside of
   entities, and is generalised like these. Words are sieved by a bit table of fixed size first; those that pass are
   joined with the terms, so neither the driver nor a task ever holds all terms.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match that fails from the start of a run of digits fails from within it too, so only starts are tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase)?|pwd|token|secret|(?:api|access|auth|private)[_-]?(?:key|token))(?![A-Za-z])[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_=-]++)", re.IGNORECASE)
_TERM = re.compile(r"[^\W\d_]{4,}")
#: The least information of a secret: its length times the entropy of its characters.
SECRET_BITS = 40.0
_SPAN = "array<struct<start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each @ to both sides, so no run is scanned twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    found = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found + _secrets(text)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return found + _secrets(text)


def _secrets(text: str) -> list[tuple[str, int, int]]:
    if "=" not in text and ":" not in text:
        return []
    return [("secret", *m.span(1)) for m in _SECRET.finditer(text) if information(m.group(1)) >= SECRET_BITS]


def information(value: str) -> float:
    """Bits that the characters of a value carry, by their frequencies in it."""
    n = len(value)
    return -sum(k * math.log2(k / n) for k in Counter(value).values())


def merged(found: list[tuple[str, int, int]]) -> list[list[int]]:
    """The union of spans, sorted."""
    out: list[list[int]] = []
    for a, z in sorted((a, z) for _, a, z in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def outside(text: str, found: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words of four or more letters outside all entities: both come in order, so one walk is enough."""
    spans, i = merged(found), 0
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        if i == len(spans) or m.end() <= spans[i][0]:
            yield m


def context(text: str, found: list[tuple[str, int, int]]) -> tuple[list[str], str, list[str]]:
    """(entities, hash of the terms, terms) of a text; terms are the lower-cased words of four or more letters
    outside all entities, each once and sorted."""
    names = set()
    for kind, a, z in found:
        value = text[a:z]
        names.add(f"{kind}:" + (value if kind == "secret" else value.lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", value)))
    ordered = sorted({m.group().lower() for m in outside(text, found)})
    return sorted(names), hashlib.blake2b(" ".join(ordered).encode(), digest_size=8).hexdigest(), ordered


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, entities, context, terms): the entities of every whole text; no shuffle. The
    last three are null where there is none."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, spans array<struct<kind:string,start:int,end:int>>, entities array<string>, context string, terms array<string>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    words = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, around = [], []
            for t in b.column(2).to_pylist():
                found = entities(t or "")
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
                around.append(context(t, found) if found else (None, None, None))
            columns = [pa.array([x[i] for x in around], kind) for i, kind in enumerate((words, pa.string(), words))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span_type), *columns], names=["doc_id", "text_hash", "spans", "entities", "context", "terms"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


class Sieve:
    """A Bloom filter of terms in a bit table of fixed size, made by an aggregation over its words: however many
    terms there are, the driver and a task hold four megabytes. It lets all terms pass and some others."""

    BITS = 1 << 25

    def __init__(self, terms: DataFrame):
        crc = F.crc32(F.col("term").cast("binary"))
        places = terms.select(F.explode(F.array(crc % self.BITS, F.expr(f"pmod(crc32(cast(term AS binary)) * {_SPREAD}L, 4294967296L) div 128"))).alias("p"))
        rows = places.groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("bits")).toPandas()
        table = np.zeros(self.BITS // 64, np.int64)
        table[rows["i"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self.table = table.astype("<i8").tobytes()

    def __contains__(self, term: str) -> bool:
        crc = zlib.crc32(term.encode())
        p, q = crc % self.BITS, crc * _SPREAD % 4294967296 // 128
        return bool(self.table[p >> 3] >> (p & 7) & 1 and self.table[q >> 3] >> (q & 7) & 1)


_SPREAD = 1640531527


class _Sieved(dict):
    """By word as it is written: the term if it passes the sieve, else None. Forgets when it grows too large."""

    def __init__(self, sieve: Sieve):
        super().__init__()
        self.sieve = sieve

    def __missing__(self, word: str) -> str | None:
        if len(self) >= 400_000:
            self.clear()
        term = word.lower()
        self[word] = term = term if term in self.sieve else None
        return term


def _frequencies(docs: DataFrame, sieve: Sieve, most: int = 200_000) -> DataFrame:
    """(term, n_t): in how many documents each term that passes the sieve occurs, outside of entities or within;
    a task holds the counts of at most ``most`` terms and those of one document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        terms = _Sieved(sieve)
        for b in batches:
            for t in b["text"]:
                for w in {terms[m] for m in set(_TERM.findall(t or ""))} - {None}:
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > most:
                    yield pd.DataFrame(list(counts.items()), columns=["term", "n"])
                    counts = {}
        yield pd.DataFrame(list(counts.items()), columns=["term", "n"])

    return docs.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def revealing_terms(docs: DataFrame, detected: DataFrame, threshold: float = 0.9, prior: float = 1.0) -> DataFrame:
    """(term, disclosure): terms that disclose at least ``threshold`` of some entity's information. Entities of
    the same documents have the same counts, so one stands for all. A term's documents are first counted among
    those with entities, which bounds what it can disclose; the few pairs left need the count over all."""
    total = detected.count()
    held = detected.filter(F.col("entities").isNotNull()).select(F.xxhash64("doc_id", "text_hash").alias("doc"), "doc_id", "text_hash", "entities", "context", "terms")
    # rows of equal id and text are rows of their own in every count
    held = written(held.groupBy("doc_id", "text_hash", "doc").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"), F.first("context").alias("context"), F.first("terms").alias("terms")), "pii-held")
    each = held.select("doc", "rows", F.explode("entities").alias("entity"))
    grouped = each.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count("*").alias("n"), F.sum(F.col("doc").cast("decimal(38,0)")).alias("h"))
    groups = grouped.groupBy("n_e", "n", "h").agg(F.min("entity").alias("entity")).filter(F.col("n_e") < total).select("entity", "n_e")
    of_doc = each.join(groups, "entity").select("doc", "entity", "n_e")
    terms = held.select("doc", "rows", "context", F.explode("terms").alias("term"))
    within = terms.groupBy("term").agg(F.sum("rows").alias("n_w"))
    p_e = F.col("n_e") / total

    def disclosed(n_t):
        p = (F.col("c") * F.col("n_et") / F.col(n_t) + prior * p_e) / (F.col("c") + prior)
        return F.log2(p / p_e) / -F.log2(p_e)

    pairs = terms.join(of_doc, "doc").groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.sum("rows").alias("n_et"), F.countDistinct("context").alias("c"))
    counted = written(pairs.join(within, "term").filter(disclosed("n_w") >= threshold).select("entity", "term", "n_e", "n_et", "c"), "pii-pairs")
    scored = counted.join(_frequencies(docs, Sieve(counted.select("term").distinct())), "term").groupBy("term").agg(F.max(disclosed("n_t")).alias("disclosure"))
    return written(scored.filter(F.col("disclosure") >= threshold), "pii-terms")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, _hash, extra): the spans of the terms outside entities, sorted, for the documents that have any."""
    sieve = Sieve(terms)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sieved(sieve)
        for b in batches:
            at, names, spans = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if not t or not any(known[w] for w in set(_TERM.findall(t))):
                    continue
                found: dict[str, list] = {}
                for m in outside(t, entities(t)):
                    if (term := known[m.group()]) is not None:
                        found.setdefault(term, []).append({"start": m.start(), "end": m.end()})
                at += [i] * len(found)
                names += found
                spans += found.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(names, pa.string()), pa.array(spans, span_type)], names=["_id", "_hash", "term", "spans"])

    passed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _hash long, term string, spans {_SPAN}")
    # copies of a document are one here; what the sieve let through by chance goes in the join
    once = passed.join(terms.select("term"), "term").groupBy("_id", "_hash", "term").agg(F.first("spans").alias("spans"))
    return once.groupBy("_id", "_hash").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("extra"))


def all_spans(docs: DataFrame, threshold: float = 0.9, prior: float = 1.0) -> DataFrame:
    """(doc_id, text_hash, base, spans) of every row: the entities, and these with the revealing terms that
    lie outside of them. Nulls are empty texts; rows of equal id and text have equal spans."""
    detected = written(detect(docs), "pii-entities")
    terms = revealing_terms(docs, detected, threshold, prior)
    base = detected.select("doc_id", "text_hash", F.col("spans").alias("base"))
    if not terms.head(1):
        return base.withColumn("spans", F.col("base"))
    extra = _term_spans(docs, terms)
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    more = F.transform(F.coalesce("extra", F.array().cast(_SPAN)), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "text_hash", "base", F.concat("base", more).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term and n_private (all but the
    terms) of every row. Null and empty texts have no spans; repeated rows and rows without an id each have
    their own row; an empty table gives none. Of an id's rows with unlike texts each has its own spans."""
    found = all_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    patterns = F.filter("base", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(patterns).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), count("secret"), count("term"), F.size("base").cast("long").alias("n_private"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every entity and revealing term generalised to its kind in brackets, like [EMAIL]; of spans
    that overlap the first, or the longer of two that begin together, counts. Nulls stay null."""
    spans = all_spans(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).groupBy("_id", "_hash").agg(F.first("_spans").alias("_spans"))
    joined = docs.withColumn("_text_hash", F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for t, a, z, k in zip(text, starts, ends, kinds, strict=True):
            if t is None or a is None or not len(a):
                out.append(t)
                continue
            parts, at = [], 0
            for start, _, end, kind in sorted((int(i), -int(j), int(j), x) for i, j, x in zip(a, z, k, strict=True)):
                if start >= at:
                    parts += [t[at:start], f"[{kind.upper()}]"]
                    at = end
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    clean = cut(F.col("text"), F.col("_spans.start"), F.col("_spans.end"), F.col("_spans.kind"))
    return joined.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def disclosure(n_et: int, n_e: int, n_t: int, total: int, contexts: int, prior: float = 1.0) -> float:
    """The measure of ``revealing_terms`` for one pair."""
    p_e = n_e / total
    p = (contexts * n_et / n_t + prior * p_e) / (contexts + prior)
    return math.log2(p / p_e) / -math.log2(p_e)
