"""DuckDB SQL for the queries whose results SQL can express, over whole tables."""

#: The larger page_id of equal payloads of 1000 bytes or more is the response.
OP4 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN k.keeper IS NULL OR d.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keeper IS NULL OR d.page_id = k.keeper THEN NULL ELSE k.keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""

#: Links by the shingles themselves; components by following links to the smallest id.
OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(shingle) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""

#: All windows of 100 bytes (200 hex digits), the first place of each, and the union of the others.
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS pos, n, x FROM s WHERE n >= 100),
w AS (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 200)) AS k FROM p),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT doc_id, pos FROM f WHERE nth > 1),
g AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS new FROM c),
j AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
r AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 100 AS hi FROM j GROUP BY doc_id, run),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
k AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept, sum(hi - lo) AS removed, count(*) AS spans
  FROM q JOIN s USING (doc_id) GROUP BY doc_id
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM s LEFT JOIN k USING (doc_id)
"""

#: CRC-32 byte by byte with a table made from the polynomial; the slot map by its rule; positions in shard order; the map balanced by
#: bytes: slots beyond a shard's mean are laid out, in slot order, over the room below the mean of all shards.
OP9 = """
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
), x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, len(x) // 2 + 8 AS size, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM x),
c AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS vslot FROM b, t
), p AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws('/', doc_id, size, text_crc32)), 9, 8) AS BIGINT) % 16 AS part FROM c
), m AS (
  SELECT range AS vslot, list_reduce(list_prepend(CAST(0 AS BIGINT), range(2, 25)), lambda s, n: CASE WHEN CAST('0x' || substr(md5(CAST(range AS VARCHAR) || '/' || CAST(n AS VARCHAR)), 1, 8) AS BIGINT) % n = 0 THEN n - 1 ELSE s END) AS shard
  FROM range(4096)
), l AS (SELECT m.vslot, m.shard, CAST(coalesce(sum(size), 0) AS BIGINT) AS b FROM m LEFT JOIN p USING (vslot) GROUP BY ALL),
w AS (SELECT vslot, shard, b, 24 * b AS load, sum(b) OVER () AS total, sum(24 * b) OVER (PARTITION BY shard ORDER BY vslot) > sum(b) OVER () AND b > 0 AS moves FROM l),
f AS (SELECT s.range AS shard, greatest(max(total), coalesce(sum(load) FILTER (NOT moves AND w.shard = s.range), 0)) - coalesce(sum(load) FILTER (NOT moves AND w.shard = s.range), 0) AS free FROM range(24) s, w GROUP BY 1),
u AS (SELECT shard, sum(free) OVER (ORDER BY shard) AS upto FROM f),
v AS (SELECT vslot, sum(load) OVER (ORDER BY vslot) - load // 2 AS mid FROM w WHERE moves),
r AS (SELECT vslot, (SELECT min(u.shard) FROM u WHERE v.mid < u.upto) AS moved FROM v)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(m.shard AS INT) AS shard, row_number() OVER (PARTITION BY m.shard ORDER BY p.vslot, part, doc_id, size, text_crc32) - 1 AS slot,
  CAST(CASE WHEN CAST('0x' || substr(md5(CAST(p.vslot AS VARCHAR) || '/25'), 1, 8) AS BIGINT) % 25 = 0 THEN 24 ELSE m.shard END AS INT) AS grown_shard,
  CAST(p.vslot AS INT) AS vslot, CAST(sum(size) OVER (PARTITION BY p.vslot) AS BIGINT) AS slot_bytes, 1 AS map_version, CAST(coalesce(moved, m.shard) AS INT) AS balanced_shard
FROM p JOIN m USING (vslot) LEFT JOIN r USING (vslot)
"""
