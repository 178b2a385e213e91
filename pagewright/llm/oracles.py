"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"

FILL_IN_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE}*{_SOLID}+|{_SPACE}+') AS tok,
        CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, tok, CAST(len(tok) AS BIGINT) AS n,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        CAST(least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS BIGINT) AS a,
        CAST(greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS BIGINT) AS b FROM e),
g AS (SELECT doc_id, t, n, form, coalesce(array_to_string(tok[1:a], ''), '') AS p, coalesce(array_to_string(tok[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(tok[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""

#: Distinct sets, all pairs that share a shingle, links on whole sets, and the
#: least id that the links reach.
TENSOR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SOLID}+') AS tok FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(tok) = 0 THEN [] WHEN len(tok) = 1 THEN [tok[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) END AS shingles FROM w),
c AS (SELECT shingles, min(doc_id) AS doc_id, len(shingles) AS n, row_number() OVER (ORDER BY min(doc_id)) AS c
    FROM s WHERE len(shingles) > 0 GROUP BY shingles),
x AS (SELECT c, n, unnest(shingles) AS g FROM c),
p AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.c < b.c
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(c, other) AS (SELECT c, c FROM c UNION SELECT reach.c, e.b FROM reach JOIN e ON reach.other = e.a),
root AS (SELECT reach.c AS c, min(c.doc_id) AS component_id FROM reach JOIN c ON reach.other = c.c GROUP BY reach.c)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(root.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(root.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN root ON c.c = root.c
"""

#: crc32 bit by bit; paths as digests of the turns so far; sums over subtrees
#: through the least member of every node, whose own path holds all ancestors.
PREFIX_TRIE = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM o),
heads AS (SELECT v.conv_id, o.pos AS d, o.role, o.text FROM v JOIN o ON o.conv_id = v.base AND o.pos <= v.h),
taken AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
r AS (SELECT * FROM heads UNION ALL SELECT o.conv_id, o.pos - v.h + coalesce(taken.n, 0), o.role, o.text FROM o JOIN v ON o.conv_id = v.conv_id
    LEFT JOIN taken ON taken.conv_id = o.conv_id WHERE o.pos > v.h),
t AS (SELECT conv_id, d, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id
    ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM v),
size AS (SELECT conv_id, max(d) AS size FROM t GROUP BY conv_id),
n AS (SELECT path, d, min(t.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(size) > d AS inner_,
    sha256(coalesce(string_agg(CAST(t.conv_id AS VARCHAR), ',' ORDER BY t.conv_id) FILTER (size = d), '')) AS ends_sha256
    FROM t JOIN size ON t.conv_id = size.conv_id GROUP BY path, d),
up AS (SELECT n.path, t.path AS above, t.d AS above_d FROM n JOIN t ON t.conv_id = n.conv_id AND t.d <= n.d),
sums AS (SELECT above AS path, count(*) FILTER (NOT n.inner_) AS n_leaves, count(*) FILTER (n.d = above_d + 1) AS n_children,
    sum((n.n_convs - 1) * n.chars) AS saved_tokens FROM up JOIN n ON up.path = n.path GROUP BY above),
parent AS (SELECT up.path, n.conv_id FROM up JOIN n ON up.above = n.path JOIN n own ON own.path = up.path WHERE up.above_d = own.d - 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON n.path = sums.path LEFT JOIN parent ON n.path = parent.path
"""

ORACLES = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op12_tensor_dedup": TENSOR_DEDUP, "op13_prefix_trie": PREFIX_TRIE}
