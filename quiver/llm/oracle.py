"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

OP9 = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), named AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
         CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS response
  FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM named
"""

# CRC-32 by its rule: the table of single bytes, then byte by byte over the hexadecimal digits of a text
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
           lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS entries)"""


def _crc32(text: str, entries: str = "entries") -> str:
    """Of a text that isn't empty."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({text}))),
      lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda a, b: xor(a >> 8, {entries}[(xor(a, b) & 255) + 1])))"""


def _bag(source: str, key: str) -> str:
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"SELECT '{source}' AS source, {key} AS id, {words} AS w FROM {source}"


OP12 = f"""
WITH {CRC_TABLE},
bags AS ({_bag('documents', 'doc_id')} UNION ALL {_bag('benchmark', 'item_id')}),
grams AS (SELECT source, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM bags),
counted AS (SELECT source, id, gram, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (SELECT gram, {_crc32('gram')} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM counted), crc_table),
placed AS (SELECT c.source, c.id, h.bucket, c.n FROM counted c JOIN hashed h USING (gram)),
shares AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE source = 'documents'), 0)::DOUBLE AS s,
                  coalesce(sum(n) FILTER (WHERE source = 'benchmark'), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM shares),
weighed AS (SELECT p.id, sum(p.n) AS n_features, floor(sum(p.n * g.gain) / sum(p.n)) AS weight
            FROM placed p JOIN gains g USING (bucket) WHERE p.source = 'documents' GROUP BY p.id),
scored AS (SELECT b.id AS doc_id, len(b.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || b.id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS score
  FROM bags b LEFT JOIN weighed USING (id) WHERE b.source = 'documents'),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
                 floor(25 * count(*) FILTER (WHERE n_words >= 20) OVER () / 100) AS wanted FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= wanted THEN place END AS BIGINT) AS rank FROM drawn
"""

OP13 = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST) AS d,
                 list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST) AS w FROM turns GROUP BY c),
taken AS (SELECT v.*, {_crc32('v.c::VARCHAR')} % 4 AS h, b.d AS bd, b.w AS bw FROM crc_table, convs v LEFT JOIN convs b ON b.c = v.c - v.c % 20),
rebuilt AS (SELECT c, list_concat(coalesce(list_slice(bd, 1, h), []), list_slice(d, h + 1, len(d))) AS d,
                   list_concat(coalesce(list_slice(bw, 1, h), []), list_slice(w, h + 1, len(w))) AS w FROM taken),
prefixes AS (SELECT c, depth, len(d) AS n, sha256(depth || ':' || array_to_string(list_slice(d, 1, depth), ',')) AS key, coalesce(w[depth], 0) AS words
             FROM (SELECT *, unnest(range(len(d) + 1)) AS depth FROM rebuilt)),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS up FROM prefixes),
nodes AS (SELECT key, depth, min(c) AS rep, count(*) AS n_convs, any_value(up) AS up, any_value(words) AS words,
                 string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n) AS ends FROM linked GROUP BY key, depth),
families AS (SELECT up, count(*) AS n_children FROM nodes GROUP BY up),
valued AS (SELECT n.*, p.rep AS parent, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN nodes p ON p.key = n.up LEFT JOIN families f ON f.up = n.key),
sums AS (SELECT a.key, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
         FROM valued v JOIN prefixes a ON a.c = v.rep AND a.depth <= v.depth GROUP BY a.key)
SELECT rep AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM valued JOIN sums USING (key)
"""

SQL = {"op9_warc_capture_index": OP9, "op12_importance_resampling": OP12, "op13_conversation_trie": OP13}
