"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

The others are held against brute force in the tests: suffix arrays and MinHash (too slow over whole texts),
personal data (patterns with look-behind) and the classifiers.
"""

from __future__ import annotations

from .licenses import BASE, LEAST, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _positions(phrase: str) -> str:
    """Places (from 1) at which the phrase's words stand in the list w."""
    words = phrase.split()
    tests = " AND ".join(f"w[i + {j}] = '{v}'" if j else f"w[i] = '{v}'" for j, v in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({tests}, false))"


def _share(template: str, key: str) -> str:
    words, first = template.split(), 0
    while words[first : first + len(key.split())] != key.split():
        first += 1
    # a place before the text is null, as is one after it; w[0] and below never match
    hits = " + ".join(f"CASE WHEN i + {j - first} >= 1 AND w[i + {j - first}] = '{v}' THEN 1 ELSE 0 END" for j, v in enumerate(words))
    return f"coalesce(list_max(list_transform({_positions(key)}, lambda i: ({hits}) / {len(words)}.0::DOUBLE)), 0.0)"


def _licenses() -> str:
    places = ", ".join(f"{_positions(p)} AS p{i}" for i, p in enumerate(BASE))
    shares = ", ".join(f"{_share(t, k)} AS s{i}" for i, (_, t, k) in enumerate(TEMPLATES))
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{v}' END" for i, v in enumerate(BASE.values()))
    named = ", ".join(f"CASE WHEN s{i} >= {LEAST} THEN '{t[0]}' END" for i, t in enumerate(TEMPLATES))
    listed = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ',')"
    return f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents), found AS (SELECT doc_id, len(w) AS n, {places}, {shares} FROM words),
    every AS (SELECT *, list_concat(list_concat(p0, p1), p2) AS places FROM found)
    SELECT doc_id, n AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, {listed(base)} AS base_labels, {listed(base + ", " + named)} AS labels,
      greatest({", ".join(f"s{i}" for i in range(len(TEMPLATES)))}) AS score FROM every"""


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""

# water filling: sources in the order in which they reach twice their size; those before the first that
# doesn't are full, the others share what is left by weight
_MIXING = r"""WITH RECURSIVE docs AS (SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
  sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS o FROM docs GROUP BY source),
  weighted AS (SELECT *, CASE o % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM sources),
  ordered AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * s / w, o) AS k, (SELECT sum(w) FROM weighted WHERE s > 0) AS total_w, (SELECT 1.5::DOUBLE * sum(s) FROM weighted) AS budget FROM weighted WHERE s > 0),
  fill AS (SELECT CAST(1 AS BIGINT) AS k, (SELECT any_value(budget) FROM ordered) AS budget, (SELECT any_value(total_w) FROM ordered) AS weight, false AS done
    UNION ALL SELECT f.k + 1, CASE WHEN 2.0::DOUBLE * o.s > o.w * f.budget / f.weight THEN f.budget ELSE f.budget - 2.0::DOUBLE * o.s END, CASE WHEN 2.0::DOUBLE * o.s > o.w * f.budget / f.weight THEN f.weight ELSE f.weight - o.w END, f.done OR 2.0::DOUBLE * o.s > o.w * f.budget / f.weight
    FROM fill f JOIN ordered o ON o.k = f.k WHERE NOT f.done),
  open AS (SELECT min(k) - 1 AS k, any_value(budget) AS budget, any_value(weight) AS weight FROM fill WHERE done),
  targets AS (SELECT source, s, o, CASE WHEN open.k IS NULL OR ordered.k < open.k THEN 2.0::DOUBLE * s ELSE w * open.budget / open.weight END AS target FROM ordered LEFT JOIN open ON true),
  seats AS (SELECT CAST(round_even(sum(target) / 64, 0) AS BIGINT) AS n FROM targets),
  quotients AS (SELECT o, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, o) AS r FROM (SELECT o, target, unnest(range(0, CAST(target / 64 AS BIGINT) + 20)) AS j FROM targets)),
  quotas AS (SELECT o, count(*) AS blocks FROM quotients, seats WHERE r <= n GROUP BY o),
  shards AS (SELECT o, h, (SELECT count(*) FROM quotients q, seats WHERE q.o = t.o AND q.r <= n * h // 24) AS quota FROM targets t, range(0, 24) x(h)),
  lined AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM docs d),
  taken AS (SELECT d.doc_id, d.size, x.s, coalesce(t.target, 0.0) AS target, x.o, d.pos, least(coalesce(q.blocks, 0) * 64, 2 * x.s) AS words
    FROM lined d JOIN sources x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN targets t ON t.o = x.o LEFT JOIN quotas q ON q.o = x.o),
  out AS (SELECT *, CASE WHEN s > 0 THEN words // s * size + greatest(0, least(size, words % s - pos)) ELSE 0 END AS n FROM taken)
  SELECT doc_id, size, s AS source_size, target, CAST(n AS BIGINT) AS taken, CASE WHEN n > 0 THEN CAST((SELECT count(*) FROM shards z WHERE z.o = out.o AND z.quota <= pos // 64) - 1 AS INTEGER) END AS shard FROM out"""

_WINDOWS = f"""WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark), doc AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
  windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
  spans AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)),
  hits AS (SELECT doc_id, i, k, item_id FROM spans JOIN windows USING (win)),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
"""
# proximity: the three rarest terms of a window, by their count in the corpus, are within 12 words of a place of the rarest
_DECONTAMINATION = _WINDOWS + """, used AS (SELECT DISTINCT t FROM (SELECT unnest(win) AS t FROM windows)), placed AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM doc) SEMI JOIN used USING (t)),
  counts AS (SELECT t, count(*) AS c FROM placed GROUP BY t),
  ranked AS (SELECT win, t, row_number() OVER (PARTITION BY win ORDER BY c, f, t) AS r FROM (SELECT win, t, c, o AS f FROM (SELECT win, unnest(win) AS t, unnest(range(0, len(win))) AS o FROM (SELECT DISTINCT win FROM windows)) JOIN counts USING (t))),
  full_windows AS (SELECT win, list(t ORDER BY r) AS terms FROM ranked GROUP BY win HAVING count(*) = len(win)),
  close AS (SELECT DISTINCT a.doc_id, f.win FROM full_windows f JOIN placed a ON a.t = f.terms[1]
    JOIN placed b ON b.doc_id = a.doc_id AND b.t = coalesce(f.terms[2], f.terms[1]) AND b.p BETWEEN a.p - 12 AND a.p + 12
    JOIN placed c ON c.doc_id = a.doc_id AND c.t = coalesce(f.terms[3], f.terms[1]) AND c.p BETWEEN a.p - 12 AND a.p + 12),
  near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM close JOIN windows USING (win) GROUP BY doc_id)
  SELECT doc.doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated, coalesce(near.n, 0) AS n_near_items
  FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""



def _crc_table() -> list[int]:
    """Remainders of the 256 bytes under the reflected CRC-32 polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


_SHARDING = f"""WITH bytes AS (SELECT doc_id, source, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM documents),
  docs AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 8 AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
    xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM bytes),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM docs),
  placed AS (SELECT *, row_number() OVER (ORDER BY CAST(floor((r + 0.5::DOUBLE) / n * 4503599627370496::DOUBLE) AS BIGINT), source NULLS LAST, r) - 1 AS p, count(*) OVER () AS total FROM ranked)
  SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard, p - ((p * 24 // total) * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed"""

ORACLES: dict[str, str] = {
    "op1_sharding": _SHARDING,
    "op2_license_scan": _licenses(),
    "op3_exact_topk": _TOP_K,
    "op7_mixing": _MIXING,
    "op9_decontamination": _DECONTAMINATION,
}
