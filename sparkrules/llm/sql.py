"""DuckDB SQL of the queries that SQL can express, by brute force over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: crc32 of doc_id as text, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _components(nodes: str, links: str) -> str:
    """(node, root) by spreading every name along the links."""
    return f"c(node, root) AS (SELECT n, n FROM {nodes} UNION SELECT l.b, c.root FROM c JOIN {links} l ON l.a = c.node), roots AS (SELECT node, min(root) AS root FROM c GROUP BY node)"


EMBEDDING = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT n, vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL),
one AS (SELECT a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.n < b.n AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
l AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
{_components('v', 'l')},
named AS (SELECT r.node, min(v.vec_id) OVER (PARTITION BY r.root) AS component FROM roots r JOIN v ON v.n = r.node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.n) AS n_links, component AS component_id, v.vec_id = component AS kept FROM v JOIN named ON named.node = v.n
"""

MINHASH = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT row_number() OVER () AS n, text, class_id FROM (SELECT text, min(doc_id) AS class_id FROM t GROUP BY text)),
w AS (SELECT n, {_WORDS.format('text')} AS w FROM k),
s AS (SELECT n, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w WHERE len(w) > 0),
b AS (SELECT n, s, count(*) AS c FROM s GROUP BY ALL),
z AS (SELECT n, sum(c) AS size FROM b GROUP BY n),
o AS (SELECT x.n AS a, y.n AS b, sum(least(x.c, y.c)) AS common FROM b x JOIN b y ON x.s = y.s AND x.n < y.n GROUP BY ALL),
one AS (SELECT a, b FROM o JOIN z p ON p.n = a JOIN z q ON q.n = b WHERE common >= 0.8 * (p.size + q.size - common)),
l AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
{_components('k', 'l')},
named AS (SELECT r.node, min(k.class_id) OVER (PARTITION BY r.root) AS group_id FROM roots r JOIN k ON k.n = r.node)
SELECT t.doc_id, k.class_id, group_id, t.doc_id = group_id AS kept FROM t JOIN k USING (text) JOIN named ON named.node = k.n
"""

SUFFIX_WORDS = f"""
WITH t AS (SELECT DISTINCT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, text, unnest(range(1, len(w) - 48)) AS pos, w FROM t WHERE len(w) >= 50),
h AS (SELECT doc_id, text, pos, array_to_string(list_slice(w, pos, pos + 49), ' ') AS passage FROM p),
twice AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS k FROM (SELECT *, count(*) OVER (PARTITION BY passage) AS n FROM h) WHERE n > 1),
covered AS (SELECT doc_id, text, unnest(range(pos, pos + 50)) AS word, k > 1 AS later FROM twice),
counts AS (SELECT doc_id, text, count(DISTINCT word) AS shared, count(DISTINCT word) FILTER (WHERE later) AS removed FROM covered GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(shared, 0) AS n_shared_words, coalesce(removed, 0) AS n_removed_words FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.text = d.text
"""

RULE_FIGURES = rf"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT n, unnest(range(1, len(w) - 6)) AS pos, w FROM w WHERE len(w) >= 8),
h AS (SELECT n, pos, array_to_string(list_slice(w, pos, pos + 7), ' ') AS s FROM p),
twice AS (SELECT n, pos FROM (SELECT n, pos, count(*) OVER (PARTITION BY n, s) AS c FROM h) WHERE c > 1),
r AS (SELECT n, count(DISTINCT word) AS repeated FROM (SELECT n, unnest(range(pos, pos + 8)) AS word FROM twice) GROUP BY n),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (n))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
"""

NGRAM_BASE = rf"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, {_CRC} % 7 = 2 AS held_out, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT n, held_out, unnest(list_append({_WORDS.format('text')}, ' end')) AS w FROM t),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
a AS (SELECT sum(c) AS total, count(*) AS distinct_ FROM c),
s AS (SELECT n, count(*) AS n_tokens, count(c) AS n_known, sum(log10(coalesce(c, 0) + 1)) AS x FROM w LEFT JOIN c USING (w) GROUP BY n)
SELECT doc_id, held_out, n_tokens, n_known, total::BIGINT AS train_tokens, round(x - n_tokens * log10(total + distinct_ + 1), 3) AS base_score FROM t JOIN s USING (n), a
"""
