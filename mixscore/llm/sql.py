"""SQL of the operators that need more than a statement of their own: CRC-32 and long counterparts."""

from __future__ import annotations

#: A common table expression (table crc with the one row ``t``): the 256 steps of CRC-32.
CRC_TABLE = """crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
                CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
            FROM (SELECT unnest(range(256)) AS i)
        )"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an expression; the table ``crc`` must be joined."""
    hexed = f"hex(encode({text}))"
    data = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || {hexed}[i:i + 1])::BIGINT)"
    step = "xor(t[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: {step}), 4294967295)"


OP12 = rf"""
        WITH RECURSIVE {CRC_TABLE}, runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL
        ), hashed AS (
            SELECT run, n, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc
        ), words AS (
            SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
                   sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
        ), deleted AS (
            SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS m FROM deleted a JOIN deleted b
            ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM deleted a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM deleted a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(m) AS form_n, min(other) FILTER (m = most) AS form
            FROM (SELECT *, max(m) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
        ), formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), chain(word, root) AS (
            SELECT word, word FROM formed
            UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
        ), roots AS (
            SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
    """

OP13 = rf"""
        WITH {CRC_TABLE}, turns AS (
            SELECT conv_id, list((coalesce(role, ''), coalesce(text, ''))
                ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), kept AS (
            SELECT conv_id, own, {crc32("conv_id::VARCHAR")} % 9 AS h FROM turns, crc
        ), rebuilt AS (
            SELECT k.conv_id, CASE WHEN b.own IS NULL THEN k.own[h + 1:] ELSE b.own[1:h] || k.own[h + 1:] END AS seq
            FROM kept k LEFT JOIN turns b ON b.conv_id = k.conv_id - k.conv_id % 5
        ), members AS (
            SELECT conv_id, seq, d, seq[1:d] AS prefix
            FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT prefix, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(prefix)[-1][2]) END AS saved,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d), '') AS ends
            FROM members GROUP BY prefix
        ), linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS above
            FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
        ), children AS (
            SELECT above, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above
        ), counted AS (
            SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.above = l.prefix
        ), below AS (
            SELECT prefix[1:u] AS top, saved, n_children
            FROM (SELECT prefix, saved, n_children, unnest(range(0, depth + 1)) AS u FROM counted)
        ), sums AS (
            SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM below GROUP BY top
        )
        SELECT c.conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
        FROM counted c JOIN sums s ON s.top = c.prefix
    """
