"""DuckDB SQL of the engine's own queries, written from the operators' definitions."""

from __future__ import annotations

from ..operators.classify import EXECUTABLES, SIGNATURES

_HEADS = ["", *SIGNATURES.values(), *EXECUTABLES.values()]
_LONG = ("matroska", "riff", "id3")
_DOCS = "d AS (SELECT doc_id, lang, source, text, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)"
_BYTES = f"{_DOCS}, b AS (SELECT doc_id, lang, ('0x' || unnest(regexp_extract_all(substr(h, 1, 131072), '..')))::INT AS byte FROM d)"
_WHOLE = _BYTES.replace("substr(h, 1, 131072)", "h")
_HEADED = f"WITH p AS (SELECT doc_id, lang, ([{', '.join(repr(x) for x in _HEADS)}])[CAST(doc_id % {len(_HEADS)} AS INT) + 1] || hex(encode(text)) AS h FROM documents)"
_EXEC = "(length(h) >= 8 AND (" + " OR ".join(f"starts_with(h, '{x}')" for x in EXECUTABLES.values()) + "))"
_MAGIC = "CASE " + " ".join(f"WHEN starts_with(h, '{x}'){' AND length(h) >= 8' if k in _LONG else ''} THEN '{k}'" for k, x in SIGNATURES.items()) + " END"
_KINDS = f"""{_HEADED},
b AS (SELECT doc_id, ('0x' || unnest(regexp_extract_all(substr(h, 1, 131072), '..')))::INT AS byte FROM p),
c AS (SELECT doc_id, byte, count(*) AS c FROM b GROUP BY 1, 2),
e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy, sum(CASE WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS printable FROM c GROUP BY 1),
k AS (SELECT p.doc_id, p.lang, CASE WHEN {_EXEC} THEN 'Executable' WHEN {_MAGIC} IS NOT NULL THEN 'AlreadyCompressed' WHEN length(h) < 2048 THEN 'Binary'
      WHEN entropy >= 7.0 THEN 'AlreadyCompressed' WHEN printable > 0.90 THEN 'Text' ELSE 'Binary' END AS kind FROM p LEFT JOIN e ON p.doc_id = e.doc_id)"""
_BWT = """WITH t AS (SELECT item_id, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM benchmark),
s AS (SELECT item_id, n, h, unnest(range(n)) AS sa FROM t),
r AS (SELECT item_id, n, sa, row_number() OVER (PARTITION BY item_id ORDER BY substr(h, 2 * sa + 1)) - 1 AS "row",
      ('0x' || substr(h, CASE WHEN sa = 0 THEN 2 * n - 1 ELSE 2 * sa - 1 END, 2))::INT AS sym FROM s)"""
_MTF = f"""{_BWT},
l AS (SELECT *, lag("row") OVER (PARTITION BY item_id, sym ORDER BY "row") AS before FROM r),
m AS (SELECT l.item_id, l."row", CAST(CASE WHEN l.before IS NOT NULL THEN count(DISTINCT q.sym) FILTER (q."row" > l.before) ELSE l.sym + count(DISTINCT q.sym) FILTER (q.sym > l.sym) END AS INT) AS rank
      FROM l LEFT JOIN r q ON q.item_id = l.item_id AND q."row" < l."row" GROUP BY l.item_id, l."row", l.sym, l.before)"""
_RLE = f"""{_MTF},
i AS (SELECT *, "row" - sum(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY "row") AS island FROM m),
g AS (SELECT item_id, min("row") AS "row", count(*) AS run, 0 AS rank FROM i WHERE rank = 0 GROUP BY item_id, island UNION ALL SELECT item_id, "row", 1, rank FROM i WHERE rank > 0),
x AS (SELECT item_id, "row", unnest(CASE WHEN rank > 0 THEN [rank + 1] ELSE list_transform(range(CAST(floor(log2(run + 1)) AS BIGINT)), lambda j: CAST(((run + 1) >> CAST(j AS INT)) & 1 AS INT)) END) AS token,
      unnest(CASE WHEN rank > 0 THEN [0] ELSE range(CAST(floor(log2(run + 1)) AS BIGINT)) END) AS j FROM g),
tok AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY "row", j) - 1 AS pos, CAST(token AS INT) AS token FROM x)"""
_CTX = f"""{_RLE},
ctx AS (SELECT *, coalesce(last_value(CASE WHEN token <= 255 THEN token END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 256) AS ctx FROM tok),
h1 AS (SELECT item_id, ctx, token, count(*) AS cnt FROM ctx WHERE ctx < 256 GROUP BY 1, 2, 3)"""
_LANES = f"""{_BWT},
k AS (SELECT item_id, n, lane, CASE WHEN lane = 0 THEN 0 ELSE (n - list_sum(list_transform(range(lane), lambda j: n // 8 + CASE WHEN n % 8 > j THEN 1 ELSE 0 END))) % n END AS start
      FROM t, (SELECT unnest(range(8)) AS lane))
SELECT k.item_id, CAST(k.lane AS INT) AS lane, r."row" AS pidx FROM k JOIN r ON r.item_id = k.item_id AND r.sa = k.start"""
_ITEMS = """WITH u AS (SELECT page_id, url, split_part(url, '/', -1) AS b, html FROM pages),
i AS (SELECT page_id, CASE WHEN b = '' THEN 'page' || page_id ELSE b END AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, page_id * 1000 AS modified_ts, url AS path, page_id % 7 = 0 AS is_dir FROM u),
items AS (SELECT *, CASE WHEN is_dir THEN 'Folder' WHEN ends_with(name, '.ctx') THEN 'Archive' ELSE 'File' END AS type FROM i)"""
_DOC_DIGEST = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(encode(text)) AS md5 FROM documents"
_TURN_DIGEST = "SELECT concat_ws(':', conv_id, turn) AS archive_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(encode(text)) AS md5 FROM conversations"
_PAGE = "SELECT page_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, md5(x) AS md5 FROM (SELECT page_id, {} AS x FROM pages)"

SQL = {
    "block_split": f"WITH {_DOCS}, k AS (SELECT doc_id, h, n, unnest(range((n + 4095) // 4096)) AS block_idx FROM d) SELECT doc_id, block_idx, CAST(least(4096, n - 4096 * block_idx) AS BIGINT) AS orig_size, md5(unhex(substr(h, 8192 * block_idx + 1, 8192))) AS md5 FROM k",
    "block_sizes_by_level": "SELECT level, CAST(CASE WHEN level IN (0, 1) THEN 1 WHEN level = 2 THEN 4 WHEN level = 3 THEN 16 WHEN level IN (4, 5) THEN 32 WHEN level BETWEEN 6 AND 9 THEN 64 ELSE 16 END AS BIGINT) * 1048576 AS block_size, CASE WHEN level < 0 THEN 19 ELSE level END AS fast_level FROM (SELECT unnest(range(-1, 12)) AS level)",
    "byte_histogram": f"WITH {_WHOLE} SELECT byte, count(*) AS cnt FROM b GROUP BY byte",
    "byte_entropy": f"WITH {_BYTES}, c AS (SELECT doc_id, byte, count(*) AS c FROM b GROUP BY 1, 2) SELECT doc_id, round(abs(-sum(c / t * log2(c / t))), 6) AS entropy, round(sum(CASE WHEN byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) THEN c ELSE 0 END) / sum(c), 6) AS printable FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id",
    "entropy_by_lang": f"WITH {_WHOLE}, c AS (SELECT lang, byte, count(*) AS c FROM b GROUP BY 1, 2) SELECT lang, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY lang) AS t FROM c) GROUP BY lang",
    "classify_kind": f"{_KINDS} SELECT doc_id, kind, kind = 'AlreadyCompressed' AS stored FROM k",
    "classify_summary": f"{_KINDS} SELECT lang, kind, count(*) AS n FROM k GROUP BY 1, 2",
    "magic_hits": f"{_HEADED} SELECT {_MAGIC} AS magic, count(*) AS n FROM p GROUP BY 1",
    "exec_hits": f"{_HEADED} SELECT doc_id, {_EXEC} AS executable FROM p",
    "bwt_symbols": f'{_BWT} SELECT item_id, "row", sa, sym FROM r',
    "bwt_primary_indexes": _LANES,
    "kernel_primary_indexes": _LANES,
    "lf_mapping": f'{_BWT} SELECT item_id, "row", row_number() OVER (PARTITION BY item_id ORDER BY sym, CASE WHEN sa = 0 THEN 0 ELSE 1 END, "row") - 1 AS lf FROM r',
    "mtf_ranks": f'{_MTF} SELECT item_id, "row", rank FROM m',
    "rle_tokens": f"{_RLE} SELECT item_id, pos, token FROM tok",
    "kernel_tokens": f"{_RLE} SELECT item_id, pos, token FROM tok",
    "token_hist0": f"{_RLE} SELECT item_id, token, count(*) AS cnt FROM tok GROUP BY 1, 2",
    "token_hist1": f"{_CTX} SELECT item_id, ctx, token, cnt FROM h1",
    "token_contexts": f"{_RLE} SELECT item_id, pos, token, lag(token, 1, 0) OVER w AS prev1, lag(token, 2, 0) OVER w AS prev2 FROM tok WINDOW w AS (PARTITION BY item_id ORDER BY pos)",
    "symbol_cumulative": f"{_RLE}, h AS (SELECT item_id, token, count(*) AS cnt FROM tok GROUP BY 1, 2) SELECT item_id, token, cnt, CAST(sum(cnt) OVER (PARTITION BY item_id ORDER BY token) - cnt AS BIGINT) AS below FROM h",
    "cond_entropy": f"{_CTX}, given AS (SELECT *, sum(cnt) OVER (PARTITION BY item_id, ctx) AS n FROM h1) SELECT item_id, round(abs(-sum(cnt * log2(cnt / n))) / sum(cnt), 6) AS h1 FROM given GROUP BY item_id",
    "normalized_counts": f"""{_RLE}, h AS (SELECT item_id, token, count(*) AS cnt FROM tok GROUP BY 1, 2),
nf AS (SELECT *, greatest(1, cnt * 2048 // sum(cnt) OVER (PARTITION BY item_id)) AS f FROM h),
ng AS (SELECT *, 2048 - sum(f) OVER (PARTITION BY item_id) AS missing, row_number() OVER (PARTITION BY item_id ORDER BY f DESC, token) AS r FROM nf)
SELECT item_id, token, cnt, CAST(f + CASE WHEN r = 1 THEN missing ELSE 0 END AS BIGINT) AS norm FROM ng""",
    "e8e9_roundtrip": """WITH p AS (SELECT page_id, unhex('4D5AE8E9E8') || encode(html) || unhex('E8FFFFFFFFE9') AS x FROM pages),
v AS (SELECT *, hex(x) AS h, ('0x' || substr(hex(x), 7, 2))::BIGINT + 256 * ('0x' || substr(hex(x), 9, 2))::BIGINT + 65536 * ('0x' || substr(hex(x), 11, 2))::BIGINT + 16777216 * ('0x' || substr(hex(x), 13, 2))::BIGINT AS target FROM p),
t AS (SELECT *, (target + 2) % 4294967296 AS t FROM v)
SELECT page_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, md5(x) AS md5, substr(h, 1, 6) || printf('%02X%02X%02X%02X', t % 256, t // 256 % 256, t // 65536 % 256, t // 16777216) || substr(h, 15, 4) AS head, true AS changed FROM t""",
    "store_roundtrip": _PAGE.format("unhex('504B0304') || encode(html)"),
    "tans_roundtrip": _DOC_DIGEST,
    "range_roundtrip": _TURN_DIGEST,
    "zstd_roundtrip": _DOC_DIGEST,
    "archive_roundtrip_ratio": _DOC_DIGEST,
    "archive_roundtrip_balanced": _DOC_DIGEST,
    "archive_roundtrip_fast": _DOC_DIGEST,
    "table_roundtrip_fast": _DOC_DIGEST,
    "table_roundtrip_balanced": _DOC_DIGEST,
    "table_roundtrip_ratio": _DOC_DIGEST,
    "encrypt_roundtrip": _TURN_DIGEST,
    "wrong_password_null": "SELECT true AS is_null, count(*) AS n FROM conversations",
    "volume_split_sizes": "WITH e AS (SELECT source, sum(octet_length(encode(text))) AS total FROM documents GROUP BY source), v AS (SELECT source, total, unnest(range(CAST((total + 63999) // 64000 AS BIGINT))) AS volume FROM e) SELECT source, volume, CAST(least(64000, total - 64000 * volume) AS BIGINT) AS length FROM v",
    "volume_bytes": f"WITH {_DOCS}, k AS (SELECT doc_id, h, n, unnest(range((n + 999) // 1000)) AS part_index FROM d) SELECT doc_id, CAST(part_index AS INT) AS part_index, md5(unhex(substr(h, 2000 * part_index + 1, 2000))) AS md5 FROM k",
    "volume_rejoined": _DOC_DIGEST,
    "volume_total": "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum((n + 999) // 1000) AS BIGINT) AS volumes FROM (SELECT octet_length(encode(text)) AS n FROM documents)",
    "header_report": "SELECT concat_ws(':', conv_id, turn) AS archive_id, 'fast' AS mode, CAST(octet_length(encode(text)) AS BIGINT) AS orig_len, false AS encrypted, CAST(4096 AS BIGINT) AS block_size, CAST(2 AS BIGINT) AS meta_len, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE octet_length(encode(text)) > 0",
    "archive_stats": "SELECT CAST(sum(n) AS BIGINT) AS input_size, CAST(sum((n + 4095) // 4096) AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS stored, true AS smaller FROM (SELECT octet_length(encode(text)) AS n FROM documents)",
    "first_difference": f"WITH {_DOCS} SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN -1 WHEN n <= 10 THEN n ELSE 10 END AS BIGINT) AS diff_at FROM d",
    "metadata_json_roundtrip": f"{_ITEMS} SELECT page_id % 10 AS archive_id, name, size, type, modified_ts, path, is_dir FROM items",
    "archive_listing": f"{_ITEMS} SELECT page_id % 10 AS archive_id, name, size, path FROM items",
    "listing_order": f"{_ITEMS} SELECT page_id, page_id % 10 AS bucket, CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY is_dir DESC, lower(name), path, page_id) AS INT) AS place FROM items",
    "default_names": r"WITH q AS (SELECT page_id, url || (['', '.ctx', '.ctx.001', '.002'])[CAST(page_id % 4 AS INT) + 1] AS p FROM pages), v AS (SELECT *, regexp_replace(p, '\.[0-9]{3}$', '') AS b FROM q) SELECT page_id, p || '.ctx' AS packed, CASE WHEN ends_with(b, '.ctx') THEN left(b, -4) ELSE b || '.out' END AS restored, regexp_replace(b, '\.ctx$', '') || '_restored' AS folder, regexp_matches(p, '\.[0-9]{3}$') AS volume, split_part(p, '/', -1) AS base, CASE WHEN regexp_full_match(p, '/[^/]*') THEN '/' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END AS parent FROM v",
    "size_labels": "WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * CAST(power(32, doc_id % 6) AS BIGINT) AS n FROM documents) SELECT doc_id, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS label, CASE WHEN n * 1048576 < 1024 THEN (n * 1048576) || ' B' WHEN n < 1024 THEN regexp_replace(regexp_replace(printf('%.2f', n::DOUBLE), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ' MB' WHEN n < 1048576 THEN regexp_replace(regexp_replace(printf('%.2f', n / 1024.0::DOUBLE), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ' GB' ELSE regexp_replace(regexp_replace(printf('%.2f', n / 1048576.0::DOUBLE), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ' TB' END AS short FROM s",
    "hidden_filter": f"{_ITEMS} SELECT page_id, name FROM items WHERE page_id % 5 <> 0 AND NOT starts_with(name, '.')",
    "mode_selection": "SELECT k, (['balanced', 'fast', 'ratio', 'fast'])[k + 1] AS mode, k * 104857600 AS split_bytes FROM (SELECT unnest(range(4)) AS k)",
    "le_numbers": "WITH n AS (SELECT doc_id, doc_id * 7919 + 65537 AS n FROM documents), x AS (SELECT *, lpad(upper(to_hex(n)), 16, '0') AS b FROM n) SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(b, '..')), '') AS le, n AS back, b AS be FROM x",
    "bundle_members": "SELECT source, doc_id, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(text)) AS BIGINT) AS \"offset\", md5(encode(text)) AS md5 FROM documents",
    "progress_speed": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CAST(sum(event_id % 1000 + 1) AS BIGINT) AS done FROM events GROUP BY 1, 2),
p AS (SELECT *, us / 1e6 AS sec, CAST(sum(done) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS processed FROM e),
s AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 0.2 THEN (processed - lag(processed) OVER w) / (sec - lag(sec) OVER w) END AS speed FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, us, processed, round(processed * 100.0::DOUBLE / 1000000, 6) AS share, round(speed, 6) AS speed, round((1000000 - processed) / speed, 3) AS eta FROM s""",
    "stage_profile": "SELECT unnest(['transform', 'count', 'encode', 'decode', 'restore']) AS stage, count(*) AS blocks, true AS took FROM benchmark",
    "tar_roundtrip": "SELECT page_id % 10 AS archive_id, 'd/p' || page_id AS path, false AS is_dir, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(encode(html)) AS md5 FROM pages UNION ALL SELECT DISTINCT page_id % 10, 'd', true, 0, NULL FROM pages",
    "selection": f"""{_ITEMS}, n AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN name || '.ctx' ELSE name END AS shown FROM items),
t AS (SELECT path FROM (SELECT DISTINCT path FROM items WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT path FROM items WHERE page_id % 5 = 0) GROUP BY path HAVING count(*) = 1)
SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS size, count(*) AS n FROM n JOIN t USING (path) WHERE NOT is_dir AND regexp_matches(shown, '\\.ctx(\\.[0-9]{{3}})?$')""",
}
