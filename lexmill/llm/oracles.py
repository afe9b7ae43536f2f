"""Equivalent SQL of the operators' queries, in DuckDB's dialect."""

from __future__ import annotations

from lexmill.llm.licenses import known_templates

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op4_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), root AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, root.root AS component_id, root.root = s.doc_id AS kept
FROM s JOIN root ON root.node = s.doc_id
"""


def license_sql() -> str:
    """Key phrases at every place, and the share of their templates' words around them."""
    words = r"regexp_extract_all(" + ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    texts = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    parts = []
    for t in known_templates():
        m = len(t.key)
        at = f"i - {t.key_at} + "
        share = " + ".join(f"(CASE WHEN {at}{j} BETWEEN 1 AND len(w) AND w[{at}{j}] = '{x}' THEN 1 ELSE 0 END)" for j, x in enumerate(t.words))
        parts.append(
            f"SELECT doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, i - 1 AS word, ({share}) / {len(t.words)}.0::double AS share"
            f" FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) - {m} + 2), lambda k: w[k:k + {m - 1}] = {texts(t.key)})) AS i FROM d)"
        )
    found = "\nUNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), m AS ({found})
SELECT d.doc_id, len(d.w)::bigint AS n_words,
  count(*) FILTER (m.base)::bigint AS n_base, min(m.word) FILTER (m.base) AS first_word, max(m.word) FILTER (m.base) AS last_word,
  coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label) FILTER (m.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label), '') AS labels, coalesce(max(m.share), 0.0) AS score
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, d.w
"""


ORACLES["op10_licenses"] = license_sql()

# Rules have at most three tokens; the labelled pages of the test tables are fewer than max_urls.
ORACLES["op8_url_rules"] = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), b AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM a
), c AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    string_split(host, '.') AS parts
  FROM b
), t AS (
  SELECT page_id, rule, rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') AS block, unnest(list_distinct(list_concat(
      list_transform(range(1, len(parts) + 1), lambda i: 'h:' || array_to_string(parts[len(parts) - i + 1:], '.')),
      list_filter(list_transform(string_split(path, '/'), lambda s, i: CASE WHEN s <> '' THEN 'p' || (i - 1) || ':' || regexp_replace(s, '[0-9]+', '#', 'g') END), lambda x: x IS NOT NULL),
      list_filter(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: CASE WHEN s <> '' THEN 'q:' || split_part(s, '=', 1) END), lambda x: x IS NOT NULL),
      ['s:' || split_part(url, '://', 1)],
      CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END))) AS token
  FROM c WHERE host <> ''
), combos AS (
  SELECT page_id, rule, block, [token] AS x FROM t
  UNION ALL SELECT t.page_id, t.rule, t.block, [t.token, u.token] FROM t JOIN t u ON t.page_id = u.page_id AND t.token < u.token
  UNION ALL SELECT t.page_id, t.rule, t.block, [t.token, u.token, v.token] FROM t JOIN t u ON t.page_id = u.page_id AND t.token < u.token
    JOIN t v ON u.page_id = v.page_id AND u.token < v.token
), mined AS (
  SELECT x FROM combos WHERE rule IS NOT NULL GROUP BY x
  HAVING count(*) FILTER (block) >= ceil(0.01 * (SELECT count(DISTINCT page_id) FROM t WHERE rule IS NOT NULL))
    AND count(*) FILTER (block) >= 0.9 * count(*) AND count(*) FILTER (block) > 0
), hits AS (
  SELECT DISTINCT page_id FROM combos JOIN mined USING (x) WHERE rule IS NULL
)
SELECT c.page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN hits.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN hits ON hits.page_id = c.page_id
"""

ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::integer AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op11_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint AS size,
    -ln((('0x' || substr(md5('42|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
      / ((length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) + 1)::double / (length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) + 1)::double) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM m GROUP BY source
), c AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, sum(w) OVER () AS all_w, row_number() OVER (ORDER BY cap::double / w, place) AS o FROM c
), b AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(w) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM o
), f AS (
  SELECT *, cap * (all_w - w_before) < w * (total - cap_before) AS filled FROM b
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap::double
    ELSE w * (total - coalesce(sum(cap) FILTER (filled) OVER (), 0))::double / (all_w - coalesce(sum(w) FILTER (filled) OVER (), 0))::double END AS target
  FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::bigint // source_size ELSE 0 END AS repeats FROM t
), k AS (
  SELECT m.doc_id, m.size, r.source_size, r.target, r.repeats, floor(r.target)::bigint - r.repeats * r.source_size AS budget,
    coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY m.key, m.doc_id, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, repeats::bigint AS repeats,
  (repeats * size + least(greatest(budget - before, 0), size))::bigint AS taken
FROM k
"""

# Pieces and words as the contract has them; every phrase is counted as text.
ORACLES["op12_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), g AS (
  SELECT lang, len(x) AS k, array_to_string(x, ' ') AS phrase, count(*)::hugeint AS f
  FROM (SELECT lang, unnest(list_concat(list_transform(w, lambda a: [a]),
      list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS x FROM p)
  GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::bigint AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10
), longer AS (
  SELECT lang, inside, max(a) AS over FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.phrase = longer.inside WHERE over IS NULL OR 100 * over < 50 * a
), cuts AS (
  SELECT lang, phrase, a, unnest(range(1, k)) AS c, w FROM kept
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.c, x.f AS l, y.f AS r, (1000000 * u.a * u.a) // (x.f * y.f) AS score
  FROM cuts u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.c], ' ')
    JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.c + 1:], ' ')
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE o = 1
)
SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score::bigint AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

# DuckDB has no crc32: the table of the 256 byte remainders comes from its rule, a feature's crc from a fold over its bytes.
ORACLES["op13_resample"] = rf"""
WITH byte AS (
  SELECT b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)
), crc AS (
  SELECT list(v ORDER BY b) AS v FROM byte
), words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), grams AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM words
), counted AS (
  SELECT side, id, g, count(*) AS n FROM grams GROUP BY ALL
), hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::bigint)),
    lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM counted), crc
), f AS (
  SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL
), b AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::double AS s, coalesce(sum(n) FILTER (side = 1), 0)::double AS t FROM f GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::bigint AS gain FROM b
), w AS (
  SELECT id AS doc_id, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY id
), d AS (
  SELECT words.id AS doc_id, len(words.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || words.id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM words LEFT JOIN w ON w.doc_id = words.id WHERE side = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS all_long FROM d
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * all_long // 100 THEN place END AS rank FROM r
"""
