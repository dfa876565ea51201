"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

import importlib

_OPS = {
    "op1_simhash": "simhash",
    "op2_toxicity": "toxicity",
    "op3_language": "langid",
    "op4_quality": "quality",
    "op5_lattice": "lattice",
    "op6_avi": "avi",
    "op7_decontaminate": "decontaminate",
    "op8_slots": "slots",
    "op9_pack": "packing",
    "op10_suffix": "suffix",
    "op11_trie": "trie",
    "op12_urlfilter": "urlfilter",
    "op13_divergence": "divergence",
}


def _lazy(name: str, module: str):
    def query(spark, sf_dir):
        return getattr(importlib.import_module(f".{module}", __package__), name)(spark, sf_dir)

    return query


def queries() -> dict:
    return {name: _lazy(name, module) for name, module in _OPS.items()}


#: Every 400-byte window of a text, as hexadecimal digits, by its MD5; texts are cut into pieces of 256 windows first, as
#: finding a place in a long string takes time that grows with the place.
_REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, base, substr(h, 2 * base + 1, 2 * (256 + 399)) AS s
    FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 399), 256)) AS base FROM docs)),
windows AS (SELECT r, base + i AS p, md5_number(substr(s, 2 * i + 1, 800)) AS m
    FROM (SELECT r, base, s, unnest(range(0, least(256, length(s) // 2 - 399))) AS i FROM pieces)),
again AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
hits AS (SELECT r, p, coalesce(p > 400 + lag(p) OVER (PARTITION BY r ORDER BY p), true) AS fresh FROM windows SEMI JOIN again USING (m)),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b
    FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM hits) GROUP BY r, g),
ends AS (SELECT r, a, b FROM spans UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM docs),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS lo, a AS hi, b FROM ends),
kept AS (SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, b) AS k FROM gaps JOIN docs USING (r) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, (length(h) - length(k)) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

#: Conversations rebuilt turn by turn; a node is the MD5 of the digests of its turns.  CRC-32 goes bit by bit.
_TRIE = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS n,
        left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS h
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'h': h, 'n': n} ORDER BY turn NULLS FIRST, role, h, n) AS ids FROM turns GROUP BY conv_id),
crc AS (SELECT conv_id, ids, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 9 AS k
    FROM own),
built AS (SELECT a.conv_id, list_concat(coalesce(b.ids, [])[1:k], a.ids[k + 1:]) AS ids FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
steps AS (SELECT conv_id, ids, unnest(range(0, len(ids) + 1)) AS d FROM built),
paths AS (SELECT conv_id, d, len(ids) = d AS ended, CASE WHEN d = 0 THEN 0 ELSE ids[d].n END AS n,
        md5(array_to_string(list_transform(ids[1:d], lambda x: x.h), ',')) AS node,
        CASE WHEN d > 0 THEN md5(array_to_string(list_transform(ids[1:d - 1], lambda x: x.h), ',')) END AS above
    FROM steps),
nodes AS (SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends
    FROM paths GROUP BY node, d),
kids AS (SELECT above AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
up AS (SELECT DISTINCT a.node, a.d, b.node AS low, b.d AS low_d FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d),
below AS (SELECT up.node, up.d, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
    FROM up JOIN nodes x ON x.node = up.low AND x.d = up.low_d LEFT JOIN kids k ON k.node = up.low AND k.d = up.low_d GROUP BY up.node, up.d)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN below b USING (node, d) LEFT JOIN kids k USING (node, d) LEFT JOIN nodes p ON p.node = a.above AND p.d = a.d - 1
"""

_URLS = """
WITH urls AS (SELECT page_id, row_number() OVER () AS r,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) = 1
"""

_DIVERGENCE = """
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c_lang FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c_lang)::HUGEINT AS n_lang FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM found GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v) AS p,
        1 + 1000000000::HUGEINT * (c_lang + 1) // (n_lang + v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it expresses; the others are tested against brute force in tests/llm."""
    return {"op10_suffix": _REPEATS, "op11_trie": _TRIE, "op12_urlfilter": _URLS, "op13_divergence": _DIVERGENCE}
