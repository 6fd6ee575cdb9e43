"""DuckDB SQL of the operators of this subpackage that SQL can express."""

from __future__ import annotations

# CRC-32 (polynomial 0xEDB88320, reflected) as a fold over bytes
_CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM range(256) r(b))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, with ``crc_table`` in scope."""
    steps = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), "
            f"lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT)")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Equal words p apart, in stretches of consecutive places (islands), for every p: runs by definition.
PERIODIC_RUNS = rf"""WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS own, {crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table),
shape AS (SELECT *, len(own) AS n, h // 10 AS g FROM docs),
bent AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE 0 END AS a, 1 + (n - CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE 0 END) // (3 + g % 8) AS p FROM shape),
texts AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(own, lambda w, i: CASE WHEN i - 1 >= a THEN own[(a + (i - 1 - a) % p + 1)::INT] ELSE w END) ELSE own END AS words FROM bent),
words AS (SELECT r, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM texts),
pairs AS (SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, p, min(i) AS s, count(*) + p AS l FROM islands GROUP BY r, p, island),
runs AS (SELECT r, s, l, min(p) AS q FROM stretches WHERE l >= greatest(6, 4 * p) GROUP BY r, s, l),
best AS (SELECT * FROM (SELECT r, s, l, q, row_number() OVER (PARTITION BY r ORDER BY l::DECIMAL(38, 18) / q DESC, s, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
covered AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS "start", l::BIGINT AS length, q::BIGINT AS period,
    (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

SHARDING = f"""WITH {_CRC_TABLE},
sized AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
cut AS (SELECT *, least(((2 * before + size) * 8) // (2 * (SELECT sum(size) FROM sized)), 7)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
    (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut"""

#: Prefixes are told apart by the SHA-256 of their turns' digests in order.
PREFIX_TRIE = rf"""WITH {_CRC_TABLE},
said AS (SELECT conv_id, turn, len({_WORDS}) AS words,
    sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS k FROM said),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said), crc_table),
paths AS (
    SELECT c.conv_id, 0 AS block, o.k, o.words, o.digest FROM convs c JOIN own o ON o.conv_id = c.base AND o.k < c.h
    UNION ALL SELECT c.conv_id, 1, o.k, o.words, o.digest FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k >= c.h),
rebuilt AS (SELECT conv_id, row_number() OVER w AS depth, words, sha256(string_agg(digest, ' ') OVER w) AS node FROM paths
    WINDOW w AS (PARTITION BY conv_id ORDER BY block, k ROWS UNBOUNDED PRECEDING)),
members AS (SELECT conv_id, depth, words, node FROM rebuilt UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
lasts AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
linked AS (SELECT m.*, up.node AS parent FROM members m LEFT JOIN members up ON up.conv_id = m.conv_id AND up.depth = m.depth - 1),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, min(words) AS words, count(*) AS n_convs FROM linked GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
below AS (SELECT m.node, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
    FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY m.node),
ends AS (SELECT m.node, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM members m JOIN lasts l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY m.node)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves::BIGINT AS n_leaves,
    b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted c JOIN below b USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON p.node = c.parent"""
