"""DuckDB SQL of the operators on mixtures and conversations, by other means than theirs: sorted prefix sums for the
fill level, ranks in place of digit sums, prefixes and ancestors written out, a recursion over single rows."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: list_concat([CAST(ascii({text}[i]) AS BIGINT)], " \
            "[-1, -1, -1, -1, -1, -1, -1, -1])))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) "
            "ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)")


MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         coalesce(CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT), 0) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(2 * s) OVER before, 0) AS c, sum(w) OVER from_here AS v, sum(s) OVER () AS total
  FROM s WINDOW before AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    from_here AS (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), f AS (
  SELECT *, 2 * w * c + 4 * s * v <= 3 * total * w AS clamped FROM o
), l AS (
  SELECT coalesce(sum(s) FILTER (clamped), 0) AS c, coalesce(sum(w) FILTER (NOT clamped), 0) AS v FROM f
), t AS (
  SELECT source, s, CASE WHEN clamped THEN CAST(2 * s AS DOUBLE)
                         ELSE CAST(w * (3 * total - 4 * l.c) AS DOUBLE) / CAST(2 * l.v AS DOUBLE) END AS target,
         CASE WHEN clamped THEN 2 * s ELSE w * (3 * total - 4 * l.c) // (2 * l.v) END AS words
  FROM f, l
), r AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE words // s END AS whole, CASE WHEN s = 0 THEN 0 ELSE words % s END AS rest FROM t
), x AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY k) AS upto,
         sum(size) OVER (PARTITION BY source, k) AS peers
  FROM d
)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target,
       CAST(whole * size + CASE WHEN upto <= rest THEN size WHEN upto - peers >= rest THEN 0
                                ELSE (rest - (upto - peers)) * size // peers END AS BIGINT) AS taken
FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source
"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, list({{'k': content, 'b': bytes}} ORDER BY turn NULLS FIRST, role, content) AS own,
         CAST(conv_id AS VARCHAR) AS name
  FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, own, {_crc32('name')} % 9 AS h FROM l
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS turns
  FROM h c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 5
), p AS (
  SELECT conv_id, depth, array_to_string(list_transform(turns[1:depth], lambda x: x.k), '') AS path,
         CASE WHEN depth = 0 THEN 0 ELSE turns[depth].b END AS bytes, depth = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM r)
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path
), c AS (
  SELECT depth - 1 AS depth, left(path, (64 * (depth - 1))::BIGINT) AS path, count(*) AS n_children
  FROM n WHERE depth > 0 GROUP BY 1, 2
), v AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, path)
), s AS (
  SELECT p.depth, p.path, sum((v.n_convs - 1) * v.bytes) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1, 2
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, path)
LEFT JOIN n u ON u.depth = v.depth - 1 AND u.path = left(v.path, (64 * (v.depth - 1))::BIGINT)
"""

_SPACES = r"E' \t\n\x0b\x0c\r'"

REPAIR = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32('name')} % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations)
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM k
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, content) AS i
  FROM (SELECT *, sha256(strlen(role) || ':' || role || text) AS content FROM d)
), q AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {_SPACES}) AS shown,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last
  FROM o
), f AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault
  FROM q
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), ins(st, mid, n) AS (
  VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)
), nxt(mid, nx, want) AS (
  VALUES (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), e AS (
  SELECT st, mid, nx, want, n, unnest(['D', 'R', 'K', 'S']) AS edit FROM ins JOIN nxt USING (mid)
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS best FROM ids
  UNION ALL
  SELECT g.conv_id, g.i + 1, CASE e.edit WHEN 'D' THEN e.mid WHEN 'S' THEN 1 ELSE e.nx END AS st,
         min({{'c': g.best.c + 5 * e.n + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                    + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
               'a': g.best.a || repeat('I', e.n) || CASE e.edit WHEN 'S' THEN 'K' ELSE e.edit END}})
  FROM dp g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1 JOIN e ON e.st = g.st
  WHERE e.edit = 'D' OR f.fault IN ('ok', 'truncated') AND (e.edit = 'R' OR e.edit = 'K' AND f.initial = e.want
        OR e.edit = 'S' AND e.mid = 0 AND f.initial = 's')
  GROUP BY 1, 2, 3
), z AS (
  SELECT ids.conv_id, coalesce(max(f.i), 0) AS n,
         CASE WHEN max(f.turn) IS NULL THEN 0 ELSE max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn) END AS gaps,
         count(*) FILTER (f.fault = 'blank') AS blank, count(*) FILTER (f.fault = 'duplicate') AS duplicate,
         count(*) FILTER (f.fault = 'truncated') AS truncated,
         count(*) FILTER (f.last IS NOT NULL AND f.last || f.initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id
), b AS (
  SELECT z.conv_id, min({{'c': best.c + 5 * CASE st WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END,
                          'a': best.a || CASE st WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END}}) AS best
  FROM dp JOIN z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.n = dp.i GROUP BY z.conv_id
), a AS (
  SELECT conv_id, best.a AS audit, unnest(range(1, len(best.a) + 1)) AS j FROM b
), w AS (
  SELECT a.conv_id, j, audit[j] AS edit, len(replace(audit[1:j], 'I', '')) AS i, len(replace(audit[1:j], 'D', '')) AS m FROM a
), y AS (
  SELECT w.conv_id, j, edit, m, f.role, f.text,
         max(CASE WHEN m = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS headed
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND w.edit <> 'I' WHERE edit <> 'D'
), x AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS h
  FROM y GROUP BY conv_id
)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, b.best.c AS cost, b.best.a AS audit,
       coalesce(x.h, sha256('')) AS repaired_sha256
FROM z JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id
"""
