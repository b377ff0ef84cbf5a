"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

OP1 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM g
), x AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT x.doc_id, x.n, x.i, g.item FROM x JOIN g USING (n, gram)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# a window is the least run of whole lines with 50 words, from a line forward or
# to a line backward; lines of windows that occurred before are deleted
OP2 = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls,
    list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM documents
), c AS (
  SELECT doc_id, ls, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)) AS c FROM d
), w AS (
  SELECT doc_id, ls, c, i,
    list_position(list_transform(c, lambda x: x >= c[i] + 50), true) - 1 AS z,
    len(list_filter(c, lambda x: x <= c[i + 1] - 50)) AS a
  FROM (SELECT doc_id, ls, c, unnest(range(1, len(c))) AS i FROM c)
), s AS (
  SELECT DISTINCT doc_id, a, z, array_to_string(ls[a:z], chr(10)) AS key FROM (
    SELECT doc_id, ls, i AS a, z FROM w WHERE z IS NOT NULL AND z > 0 UNION ALL SELECT doc_id, ls, a, i AS z FROM w WHERE a > 0
  )
), l AS (
  SELECT doc_id, a, z FROM (SELECT *, min((doc_id, a)) OVER (PARTITION BY key) AS first FROM s) WHERE (doc_id, a) > first
), g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS p FROM l
), k AS (
  SELECT d.doc_id, len(ls) AS n_lines, list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: ls[i]) AS kept
  FROM d LEFT JOIN (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id) USING (doc_id)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(kept) AS BIGINT) AS n_lines_dropped,
  CAST(len(regexp_extract_all(array_to_string(kept, chr(10)), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words_left,
  sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM k
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1
  ) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
    OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars > 40 * n_words OR word_chars < 2 * n_words
    OR 2 * n_upper > word_chars OR 2 * n_letters < word_chars) AS kept
FROM m
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (
  SELECT *, length(text) + length(role) + 12 + 11 + 1
    + length(regexp_replace(text, '[^\x10]+', '', 'g')) + length(regexp_replace(role, '[^\x10]+', '', 'g'))
    + len(regexp_extract_all(text, '<\|(im_start|im_end|startoftext|endoftext|system|user|assistant|end)\|>|<s>|</s>|<<SYS>>|<</SYS>>|<bos>|<eos>|<start_of_turn>|<end_of_turn>|\[INST\]|\[/INST\]')) AS f
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# base 32 of a SHA-1: 20 bytes are 32 groups of five bits
OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), x AS (SELECT DISTINCT h FROM p
), bits AS (
  SELECT h, string_agg(lpad(bin(CAST(strpos('0123456789abcdef', substr(h, k, 1)) - 1 AS INTEGER)), 4, '0'), '' ORDER BY k) AS b
  FROM (SELECT h, unnest(range(1, 41)) AS k FROM x) GROUP BY h
), d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(b, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INTEGER)
    + 4 * CAST(substr(b, 5 * k + 3, 1) AS INTEGER) + 2 * CAST(substr(b, 5 * k + 4, 1) AS INTEGER) + CAST(substr(b, 5 * k + 5, 1) AS INTEGER) AS INTEGER), 1), '' ORDER BY k) AS digest
  FROM (SELECT h, b, unnest(range(0, 32)) AS k FROM bits) GROUP BY h
), m AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (h) JOIN d USING (h)
"""


def _crc_steps(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ 0xEDB88320 * (value & 1)
    return value


_NIBBLES = [_crc_steps(n) for n in range(16)]


def _crc(text: str) -> str:
    """The CRC-32 of a text's UTF-8, four bits a step."""
    step = lambda c: f"xor(({_NIBBLES}::BIGINT[])[({c} & 15) + 1], {c} >> 4)"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: {step(step('xor(c, b)'))}, CAST(4294967295 AS BIGINT)), 4294967295)"


# a node is known by the digest of the turns up to it; its ancestors are the
# prefixes of its smallest member
OP12 = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, n FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL)
), own AS (SELECT conv_id, list(k ORDER BY pos) AS ks, list(n ORDER BY pos) AS ns FROM o GROUP BY conv_id
), c AS (
  SELECT own.*, CAST({_crc("CAST(conv_id AS VARCHAR)")} AS BIGINT) % 6 AS h FROM own
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.ks[1:c.h], []), c.ks[c.h + 1:]) AS ks, list_concat(coalesce(b.ns[1:c.h], []), c.ns[c.h + 1:]) AS ns
  FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), p AS (
  SELECT conv_id, d, len(ks) AS len, md5(array_to_string(ks[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)
), nodes AS (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends
  FROM p GROUP BY d, node
), kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT p.d, p.node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(u.saved) AS saved
  FROM nodes u LEFT JOIN kids ON kids.d = u.d AND kids.node = u.node JOIN p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.d, p.node
)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v LEFT JOIN nodes up ON up.d = v.d - 1 AND up.node = v.up LEFT JOIN kids ON kids.d = v.d AND kids.node = v.node
JOIN sums ON sums.d = v.d AND sums.node = v.node
"""

OP13 = f"""
WITH d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, CAST({_crc("coalesce(text, '')")} AS BIGINT) AS crc,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, crc) AS rank, count(*) OVER (PARTITION BY source) AS n FROM d
), f AS (
  SELECT *, (CAST(rank AS DOUBLE) - (CAST(CAST('0x' || substr(md5('0:' || coalesce(source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0) / CAST(n AS DOUBLE) AS x FROM k
), p AS (SELECT *, row_number() OVER (ORDER BY x, source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS total FROM f
)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(place * 40 // total AS INTEGER) AS shard,
  place - ((place * 40 // total) * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_line_dedup": OP2, "op5_chat": OP5, "op8_warc": OP8, "op9_quality": OP9, "op12_trie": OP12, "op13_shards": OP13}
