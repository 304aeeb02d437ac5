"""Exact substring deduplication by the common-prefix interval trees of distributed suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document of a smaller id. Not every
suffix is sorted: each string of ``length`` bytes has one anchor, the leftmost least hash of its ``GRAM``-byte
grams, which depends on the string alone, so equal strings have equal anchors. Consecutive strings of one
anchor form a span (about 66 bytes, one for each 18 bytes of text).

1. Texts are packed into compressed blocks, which are dealt out and checkpointed; all later steps work on
   blocks and bring what they need to them. Whole copies of a document of a smaller id are found first.
2. Hashes of anchors are gathered, once for each block; those that only one document has are done with.
3. Spans of the other anchors meet by gram. Equal spans collapse; the unlike ones, as suffixes from the anchor
   on, form an enhanced suffix array. A stack scan of its common-prefix lengths gives the intervals of the
   tree, and a second scan over each interval, in the order of the reversed left contexts, splits it where the
   left extension differs. What comes out are the maximal repeats through the anchor with all occurrences.
4. A repeat removes its bytes in all documents but the one of the smallest id; the blocks gather what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held, mix64, written

GRAM = 16
_NONE = np.int64(2**63 - 1)  # stands for a null id, which is smaller than none
_LOW48 = np.uint64(2**48 - 1)


# --- blocks ---


def pack(ids: list, texts: list[bytes]) -> bytes:
    """Ids and texts as one compressed byte string."""
    head = np.array([len(texts)], np.int64).tobytes() + np.array([_NONE if i is None else i for i in ids], np.int64).tobytes() + np.array([len(t) for t in texts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of a block: text i is bytes[offsets[i]:offsets[i + 1]]."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    return ids, np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 8 * n))]), np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, size, blob): consecutive documents of about ``block_bytes`` of text; a longer text is alone.
    The name of a block is a hash of what it holds, so a recomputed task gives the same names."""

    def row(ids: list, texts: list[bytes]) -> tuple:
        blob = pack(ids, texts)
        return int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True), sum(map(len, texts)), blob

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "size", "blob"])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1).to_pylist()), strict=True):
                if texts and size + len(t) > block_bytes:
                    yield emit([row(ids, texts)])
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield emit([row(ids, texts)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, size long, blob binary")


# --- anchors ---


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (by doubling; wrong in the last GRAM - 1 places)."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, mul = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h[:-step] = h[:-step] * np.uint64(mul) + h[step:] if len(h) > step else h[:-step]
        mul, step = mul * mul & (2**64 - 1) | 1, step * 2
    return mix64(h)


def spans(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the spans of a block: text index, anchor, first and last start of its strings, and a 48-bit hash
    of the anchor's gram. The strings of every text, and no string across texts, are in one span each."""
    none = np.zeros(0, np.int64)
    n, width = len(data), length - GRAM + 1
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    value = grams(data)[: n - GRAM + 1]
    at = np.arange(len(value), dtype=np.int32)
    reach = 1
    keys = value
    while reach < width:  # least over [i, i + reach), the leftmost of equal ones
        step = min(reach, width - reach)
        take = keys[step:] < keys[:-step]
        at = np.where(take, at[step:], at[:-step])
        keys = np.where(take, keys[step:], keys[:-step])
        reach += step
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][owner])
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    anchor, owner = at[start].astype(np.int64), owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return owner[first], anchor[first], start[first], start[last], value[anchor[first]] & _LOW48


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return np.concatenate([raw, np.zeros((len(raw), 2), np.uint8)], axis=1).view("<u8").ravel()


# --- the interval tree ---


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a sorted list, of depth ``least`` or more, by
    a stack scan; common[i] is the length of the prefix that entries i and i + 1 share. Children come
    before their parents."""
    stack: list[tuple[int, int]] = []
    for i in range(len(common) + 1):
        now = common[i] if i < len(common) else -1
        first = i
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def maximal_repeats(rights: list[bytes], lefts: list[bytes], docs: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the repeats of ``length`` bytes or more through an anchor, ``left`` bytes before
    it and ``right`` from it on, each with all entries that have it, if they are of unlike documents.

    Entry i is a suffix rights[i] from its anchor on and the reversed bytes lefts[i] before it. Intervals of
    the sorted suffixes share what follows, and among them intervals in the order of the reversed left contexts
    share what precedes; where neither side can grow without losing an entry, the repeat is maximal.
    """
    array = sorted(range(len(rights)), key=rights.__getitem__)
    common = [_common(rights[a], rights[b]) for a, b in zip(array, array[1:], strict=False)]
    for right, first, last in intervals(common, GRAM):
        members = array[first : last + 1]
        if len(members) == 2:
            a, b = members
            if docs[a] != docs[b] and (left := _common(lefts[a], lefts[b])) + right >= length:
                yield left, right, members
            continue
        least = docs[members[0]]
        if all(docs[m] == least for m in members):
            continue
        members.sort(key=lefts.__getitem__)
        before = [_common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, x, y in intervals(before, max(0, length - right)):
            group = members[x : y + 1]
            if any(docs[m] != docs[group[0]] for m in group):
                yield left, right, group


# --- the steps ---


def _shared_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the anchors' hashes: for each block, those that some other document has as well."""
    each = [_of_six(b) for b in rows["blob"]]
    value = np.concatenate(each)
    block = np.repeat(np.arange(len(each)), [len(e) for e in each])
    twice = np.concatenate([np.arange(len(e)) < n for e, n in zip(each, rows["twice"], strict=True)])
    order = np.argsort(value, kind="stable")
    value, block, twice = value[order], block[order], twice[order]
    same = value[1:] == value[:-1]
    shared = twice.copy()
    shared[1:] |= same
    shared[:-1] |= same
    # a hash that is in one block only, but there in two documents, is flagged once, and no other row has it
    value, block = value[shared], block[shared]
    order = np.argsort(block, kind="stable")
    value, block = value[order], block[order]
    cuts = np.searchsorted(block, np.arange(len(each) + 1))
    found = [(rows["block"].iloc[i], _six(value[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pd.DataFrame(found, columns=["block", "blob"])


def _encode(entries: list[tuple[bytes, int, int, list[tuple[int, int]]]]) -> bytes:
    """Spans with the length of their left part, their document, and where they are (text, anchor)."""
    where = [p for e in entries for p in e[3]]
    parts = [
        np.array([len(entries), len(where)], np.int64), np.array([e[2] for e in entries], np.int64), np.array([len(e[3]) for e in entries], np.int32),
        np.array([p[0] for p in where], np.int32), np.array([p[1] for p in where], np.int64), np.array([e[1] for e in entries], np.uint8), np.array([len(e[0]) for e in entries], np.uint8),
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts) + b"".join(e[0] for e in entries))


def _decode(blob: bytes) -> Iterator[tuple[bytes, int, int, list[tuple[int, int]]]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    pos = 16
    out = []
    for kind, count in ((np.int64, n), (np.int32, n), (np.int32, m), (np.int64, m), (np.uint8, n), (np.uint8, n)):
        out.append(np.frombuffer(raw, kind, count, pos).tolist())
        pos += count * np.dtype(kind).itemsize
    at = 0
    for doc, places, left, size in zip(out[0], out[1], out[4], out[5], strict=True):
        yield raw[pos : pos + size], left, doc, list(zip(out[2][at : at + places], out[3][at : at + places], strict=True))
        at, pos = at + places, pos + size


def _intervals_blob(found: list[tuple[int, int, int]]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array(found, np.int64).reshape(-1, 3).astype("<i8").tobytes())


def merged(found: np.ndarray) -> np.ndarray:
    """Rows (text, start, end) sorted and joined where they overlap or touch."""
    if not len(found):
        return found.reshape(-1, 3)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    # ends so far within a text: texts are set apart by an offset beyond any end
    apart = found[:, 0] * (int(found[:, 2].max()) + 2)
    reach = np.maximum.accumulate(found[:, 2] + apart)
    new = np.ones(len(found), bool)
    new[1:] = found[1:, 1] + apart[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([found[first, 0], found[first, 1], reach[np.append(first[1:], len(found)) - 1] - apart[first]])


def _collapse(entries) -> dict[tuple[bytes, int], list]:
    """Equal spans as one: [smallest document, its places, places in other documents]; a place is any tuple."""
    unlike: dict[tuple[bytes, int], list] = {}
    for span, left, doc, places in entries:
        known = unlike.get((span, left))
        if known is None:
            unlike[span, left] = [doc, list(places), []]
        elif doc == known[0]:
            known[1].extend(places)
        elif doc > known[0]:
            known[2].extend(places)
        else:
            known[2].extend(known[1])
            known[0], known[1] = doc, list(places)
    return unlike


def _copies(packed: DataFrame, length: int) -> DataFrame:
    """(block, copies): which texts of a block, of ``length`` bytes or more, are a whole copy of a document of
    a smaller id. They go as a whole, and whatever they hold a smaller document has, so they take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, offsets, data = unpack(blob)
                raw = data.tobytes()
                by: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
                    by.setdefault(hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest(), []).append(i)
                own = [ids[x] for x in by.values()]
                columns = [pa.array([block] * len(by), pa.int64()), pa.array(list(by), pa.binary()), pa.array(list(by.values()), pa.list_(pa.int32())), pa.array([x.tolist() for x in own], pa.list_(pa.int64())), pa.array([int(x.min()) for x in own], pa.int64()), pa.array([int(x.max()) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "key", "texts", "ids", "least", "most"])

    # a row for each unlike text of a block, so copies of one text are as many rows as there are blocks
    each = written(packed.select("block", "blob").mapInArrow(run, "block long, key binary, texts array<int>, ids array<long>, least long, most long"), "suffix-keys")
    first = each.groupBy(F.col("key").alias("_key")).agg(F.min("least").alias("_least"), F.max("most").alias("_most")).filter("_most > _least")
    met = each.join(first, F.col("key") == F.col("_key")).select("block", F.expr("transform(filter(arrays_zip(texts, ids), x -> x.ids > _least), x -> x.texts)").alias("copies"))
    return met.groupBy("block").agg(F.sort_array(F.flatten(F.collect_list("copies"))).alias("copies")).filter("size(copies) > 0")


def _less(found: tuple, known: pd.DataFrame) -> tuple:
    """The spans without those of the texts that ``known`` lists as copies."""
    lists = known["copies"].dropna() if len(known) else []
    if not len(lists):
        return found
    keep = ~np.isin(found[0], np.concatenate([np.asarray(c) for c in lists]))
    return tuple(x[keep] for x in found)


def removable(docs: DataFrame, length: int = 50, block_bytes: int = 1_000_000, part_bytes: int = 24_000_000) -> tuple[DataFrame, DataFrame]:
    """(blocks, found): the packed texts and, for each block, blobs of the byte ranges (text, start, end) that
    also occur in a document of a smaller id. See ``deduplicated`` for what to do with them."""
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(8, int(n_bytes // part_bytes))
    total = held(blocks(docs, block_bytes), "block", parts)
    copies = written(_copies(total, length), "suffix-copies")

    def gather(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for block, blob in mine[["block", "blob"]].drop_duplicates("block").itertuples(index=False):
            _, offsets, data = unpack(blob)
            owner, _, _, _, value = _less(spans(data, offsets, length), known)
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            group = np.cumsum(new) - 1
            twice = np.zeros(int(new.sum()), bool)
            twice[group[1:][(~new[1:]) & (owner[1:] != owner[:-1])]] = True
            value = value[new]
            part = (value % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((~twice, part))
            value, part, twice = value[order], part[order], twice[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows += [(i, block, int(twice[x:y].sum()), _six(value[x:y])) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        return pd.DataFrame(rows, columns=["part", "block", "twice", "blob"])

    by_block = total.select("block", "blob").groupBy("block")
    hashes = by_block.cogroup(copies.groupBy("block")).applyInPandas(gather, "part int, block long, twice int, blob binary")
    shared = written(hashes.groupBy("part").applyInPandas(_shared_anchors, "block long, blob binary"), "suffix-shared")

    def extract(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        gone = known["copies"].dropna()
        if len(known):
            wanted = np.unique(np.concatenate([_of_six(b) for b in known["blob"].dropna()] or [np.zeros(0, np.uint64)]))
            for block, blob in mine[["block", "blob"]].drop_duplicates("block").itertuples(index=False):
                ids, offsets, data = unpack(blob)
                owner, anchor, first, last, value = _less(spans(data, offsets, length), known)
                keep = np.flatnonzero(np.isin(value, wanted))
                raw, base = data.tobytes(), offsets[owner[keep]]
                part = (value[keep] % np.uint64(parts)).tolist()
                doc = ids[owner[keep]].tolist()
                columns = zip(first[keep].tolist(), (last[keep] + length).tolist(), anchor[keep].tolist(), doc, owner[keep].tolist(), base.tolist(), part, strict=True)
                whole = _collapse((raw[a:z], p - a, d, [(o, p - s, q)]) for a, z, p, d, o, s, q in columns)
                by: dict[int, list] = {}
                local = [(i, 0, int(offsets[i + 1] - offsets[i])) for c in gone for i in c]
                for (span, left), (d, own, others) in whole.items():
                    by.setdefault(own[0][2], []).append((span, left, d, [(o, p) for o, p, _ in own]))
                    local.extend((o, p - left, p - left + len(span)) for o, p, _ in others)
                rows.extend((q, block, _encode(e)) for q, e in by.items())
                if local:
                    rows.append((-1 - int(block % parts), block, _intervals_blob(merged(np.array(local, np.int64)).tolist())))
        return pd.DataFrame(rows, columns=["part", "block", "blob"])

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] < 0:
            return rows[["block", "blob"]]
        found: dict[int, list[tuple[int, int, int]]] = {}
        mark = lambda places, left, right: [found.setdefault(b, []).append((o, p - left, p + right)) for b, o, p in places]
        names = rows["block"].tolist()
        unlike = _collapse((s, left, d, [(b, o, p) for o, p in places]) for b, blob in zip(names, rows["blob"], strict=True) for s, left, d, places in _decode(blob))
        keys, held = list(unlike), list(unlike.values())
        for (span, left), (_, _, others) in zip(keys, held, strict=True):
            mark(others, left, len(span) - left)
        rights, lefts, docs_of = [s[n:] for s, n in keys], [s[:n][::-1] for s, n in keys], [h[0] for h in held]
        widest: dict[tuple[int, int], int] = {}
        for left, right, members in maximal_repeats(rights, lefts, docs_of, length):
            least = min(docs_of[m] for m in members)
            for m in members:
                if docs_of[m] > least and widest.get((m, right), -1) < left:
                    widest[m, right] = left
        for (m, right), left in widest.items():
            mark(held[m][1], left, right)
        # a span in other documents than its smallest goes there as a whole, so those need no more
        return pd.DataFrame([(b, _intervals_blob(merged(np.array(x, np.int64)).tolist())) for b, x in found.items()], columns=["block", "blob"])

    known = shared.select("block", "blob", F.lit(None).cast("array<int>").alias("copies")).union(copies.select("block", F.lit(None).cast("binary"), "copies"))
    drawn = by_block.cogroup(known.groupBy("block")).applyInPandas(extract, "part int, block long, blob binary")
    found = written(drawn.groupBy("part").applyInPandas(resolve, "block long, blob binary"), "suffix-found")
    return total, found


def _each(mine: pd.DataFrame, found: pd.DataFrame) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(id, text, removed ranges) of each text of a block."""
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8").reshape(-1, 3) for b in found["blob"]]
    gone = merged(np.concatenate(raw)) if raw else np.zeros((0, 3), np.int64)
    for blob in mine["blob"]:
        ids, offsets, data = unpack(blob)
        cuts = np.searchsorted(gone[:, 0], np.arange(len(ids) + 1))
        whole = data.tobytes()
        for i, doc in enumerate(ids.tolist()):
            yield doc, whole[offsets[i] : offsets[i + 1]], gone[cuts[i] : cuts[i + 1], 1:]


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    at, out = 0, []
    for a, z in gone.tolist():
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null texts are empty. Documents of equal id, and so repeated rows, remove nothing from each other; a null
    id is larger than any id. An empty table gives no rows.
    """
    packed, found = removable(docs, length)

    def summed(mine: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        rows = [(None if doc == _NONE else doc, len(text), int((r[:, 1] - r[:, 0]).sum()), len(r), hashlib.sha256(_kept(text, r)).hexdigest()) for doc, text, r in _each(mine, gone)]
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    return packed.select("block", "blob").groupBy("block").cogroup(found.groupBy("block")).applyInPandas(summed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, text without the removed bytes (cut characters are dropped), and the removed ranges."""
    packed, found = removable(docs, length)

    def cut(mine: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        rows = [(None if doc == _NONE else doc, _kept(text, r).decode("utf-8", "ignore"), r.tolist()) for doc, text, r in _each(mine, gone)]
        return pd.DataFrame(rows, columns=["doc_id", "text", "removed"]).astype({"doc_id": "Int64"})

    return packed.select("block", "blob").groupBy("block").cogroup(found.groupBy("block")).applyInPandas(cut, "doc_id long, text string, removed array<array<long>>")
