"""DuckDB oracle SQL for the registered queries.

Written from the operator definitions, independently of the Spark code: the
stand-in views are repeated here as CTEs over the raw test tables.
"""

from __future__ import annotations

# JavaScript trim class in RE2 syntax
_W = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


LINE_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
              "l_tax, l_returnflag, l_linestatus, l_shipdate")

FULL = "p_name || ' ' || p_brand || ' ' || p_type || ' size ' || CAST(p_size AS VARCHAR)"
OTHER = "p_name || ' ' || p_brand || ' ' || p_type || ' size ' || CAST(p_size + 50 AS VARCHAR)"
VARIANT = (f"CASE l_linenumber % 4 WHEN 0 THEN {FULL} "
           f"WHEN 1 THEN p_name || ' ' || p_type || ' size ' || CAST(p_size AS VARCHAR) "
           f"WHEN 2 THEN p_name || ' ' || p_brand || ' ' || p_type "
           f"ELSE substr({OTHER}, 1, 1) || substr({OTHER}, 3) END")

CATALOG = f"""catalog AS (
  SELECT p.p_partkey AS id, {FULL} AS name, p.p_brand AS brand, p.p_type AS category,
         CAST(p.p_retailprice AS DECIMAL(15,2)) AS price, 'pcs' AS unit,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, e.embedding
  FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey)"""

LINES = f"""lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS INTEGER) AS line_index,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' pcs ' || {VARIANT} AS raw_text,
         l_partkey AS qvec_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def id_fmt(x: str) -> str:
    return (f"(replace(format('{{:,}}', CAST(floor({x}) AS BIGINT)), ',', '.') || ',' || "
            f"lpad(CAST(CAST(round({x} * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))")


OFFER_BASE = f"""offer_base AS (
  SELECT l.*, p.*, l_orderkey * 10000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS pos
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

SHOPPING = f"""shopping AS (
  SELECT {VARIANT} AS query, pos,
         CASE WHEN l_linenumber % 2 = 1 AND p_name < 'n' THEN CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice END END AS extracted_price,
         CASE WHEN l_linenumber % 2 <> 1 AND p_name < 'n' THEN 'Rp ' || {id_fmt('l_extendedprice')} END AS price,
         CASE WHEN s_nationkey = 0 THEN '' WHEN l_suppkey % 10 = 0 THEN NULL ELSE s_name END AS source,
         {FULL} AS title,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'https://shop.example/p/' || CAST(l_partkey AS VARCHAR) || '-'
              || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS product_link,
         'https://shop.example/s/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS link
  FROM offer_base LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

ORGANIC = f"""organic AS (
  SELECT {VARIANT} AS query, pos, {FULL} AS title,
         CASE l_linenumber % 4
           WHEN 0 THEN 'Harga Rp ' || {id_fmt('l_extendedprice')} || ' stok ada'
           WHEN 1 THEN CASE WHEN l_partkey % 2 = 0
             THEN 'Harga Rp ' || {id_fmt('l_extendedprice')} || ' atau cicilan Rp ' || {id_fmt('(l_tax * 1000 + 1)')} || '/bln'
             ELSE 'Cicilan Rp ' || {id_fmt('(l_tax * 1000 + 1)')} || '/bln untuk 12 bln' END
           WHEN 2 THEN 'Diskon dari Rp ' || {id_fmt('(l_extendedprice + 1000)')} || ' jadi Rp ' || {id_fmt('l_extendedprice')}
           ELSE 'Hubungi penjual' END AS snippet,
         CASE WHEN l_suppkey % 5 > 0 THEN 'https://toko' || CAST(l_suppkey % 7 AS VARCHAR) || '.example/item/'
           || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) ELSE 'item' END AS link
  FROM offer_base)"""

MODEL_TEXT = """model_text AS (
  SELECT event_id,
         CASE event_type
           WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
           WHEN 'view' THEN 'Here you go: ' || props || ' hope it helps'
           WHEN 'purchase' THEN '```' || chr(10) || '[' || props || ', ' || props || ']' || chr(10) || '```'
           WHEN 'error' THEN 'broken {' || CAST(user_id AS VARCHAR)
           ELSE CAST(value AS VARCHAR) END AS text
  FROM events)"""

RESULTS = f"""res_base AS (
  SELECT l.*, p.*, s.s_name,
         CASE WHEN l_discount = 0 THEN 'error' WHEN l_returnflag = 'R' THEN 'not_found'
              WHEN l_linestatus = 'O' THEN 'user_selected_internet' ELSE 'auto_database' END AS source
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey),
results AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS INTEGER) AS line_index,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' pcs ' || {VARIANT} AS raw_text,
         {VARIANT} AS name, l_quantity AS qty, 'pcs' AS unit,
         CASE WHEN source IN ('auto_database', 'user_selected_internet') THEN p_retailprice END AS price,
         source,
         CASE WHEN source = 'user_selected_internet' THEN l_tax * 100 END AS margin,
         CASE WHEN l_discount = 0 THEN 'provider failed' END AS error,
         CASE WHEN source = 'auto_database' THEN {FULL}
              WHEN source = 'user_selected_internet' AND l_linenumber % 2 = 0 THEN {FULL} END AS product_name,
         CASE WHEN source = 'user_selected_internet' THEN s_name END AS product_supplier,
         CASE WHEN source = 'user_selected_internet' THEN 'https://shop.example/s/' || CAST(l_orderkey AS VARCHAR) || '-'
              || CAST(l_linenumber AS VARCHAR) END AS product_url
  FROM res_base)"""

CHANGES = """changes AS (
  SELECT CASE WHEN p_size IN (7, 11, 17, 19, 23, 31, 37) THEN 'update' WHEN p_size = 13 THEN 'delete' ELSE 'create' END AS op,
         CASE WHEN p_size = 29 THEN NULL WHEN p_size = 17 THEN p_partkey + 1000000 ELSE p_partkey END AS id,
         CASE WHEN p_size = 11 THEN p_name || ' v2' WHEN p_size = 23 THEN '  ' WHEN p_size = 29 THEN p_name || ' baru' END AS name,
         CASE WHEN p_size = 31 THEN ' ' WHEN p_size = 29 THEN p_brand END AS brand,
         CASE WHEN p_size = 29 THEN p_type END AS category,
         CASE WHEN p_size = 31 THEN ' box ' END AS unit,
         CASE WHEN p_size IN (7, 17) THEN CAST(p_retailprice + 1 AS VARCHAR) WHEN p_size = 19 THEN '-1'
              WHEN p_size = 29 THEN CAST(p_retailprice AS VARCHAR) END AS price,
         p_size IN (11, 23, 29) AS has_name, p_size IN (31, 29) AS has_brand, p_size = 29 AS has_category,
         p_size = 31 AS has_unit, p_size IN (7, 17, 19, 29) AS has_price, p_partkey * 10 + 5 AS change_id
  FROM part WHERE p_size IN (7, 11, 13, 17, 19, 23, 29, 31, 37)
  UNION ALL SELECT 'update', p_partkey, NULL, NULL, NULL, NULL, '7.5', false, false, false, false, true, p_partkey * 10 + 3 FROM part WHERE p_size = 13
  UNION ALL SELECT 'update', p_partkey, 'late', NULL, NULL, NULL, NULL, true, false, false, false, false, p_partkey * 10 + 7 FROM part WHERE p_size = 13
  UNION ALL SELECT 'delete', p_partkey, NULL, NULL, NULL, NULL, NULL, false, false, false, false, false, p_partkey * 10 + 8 FROM part WHERE p_size = 13
  UNION ALL SELECT 'update', (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey), NULL, NULL, NULL, 'dus', '2',
                   false, false, false, true, true, p_partkey * 10 + 7 FROM part WHERE p_size = 29)"""


def _validated() -> str:
    t = js_trim
    num = f"(CASE WHEN {t('price')} = '' THEN 0.0 ELSE TRY_CAST({t('price')} AS DOUBLE) END)"
    return f"""validated AS (
  SELECT *,
    CASE WHEN has_name AND name IS NOT NULL THEN {t('name')} END AS clean_name,
    CASE WHEN has_brand AND {t('brand')} <> '' THEN {t('brand')} END AS clean_brand,
    CASE WHEN has_category AND {t('category')} <> '' THEN {t('category')} END AS clean_category,
    CASE WHEN has_unit AND {t('unit')} <> '' THEN {t('unit')} END AS clean_unit,
    CASE WHEN has_price AND NOT (price IS NULL OR price = '') AND {num} >= 0 AND isfinite({num})
         THEN CAST({num} AS DECIMAL(15,2)) END AS clean_price,
    (has_name AND name IS NOT NULL) AS name_sent,
    CASE
      WHEN has_name AND name IS NOT NULL AND {t('name')} = '' THEN 'Nama produk wajib diisi'
      WHEN NOT (has_name AND name IS NOT NULL) AND op = 'create' THEN 'Nama produk wajib diisi'
      WHEN has_price AND NOT (price IS NULL OR price = '')
           AND ({num} IS NULL OR NOT isfinite({num}) OR {num} < 0) THEN 'Harga harus angka >= 0'
      WHEN NOT ((has_name AND name IS NOT NULL) OR has_brand OR has_category OR has_unit OR has_price)
           THEN 'Tidak ada field yang diubah'
    END AS verr
  FROM changes)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _norm_key(x: str) -> str:
    return f"lower({js_trim(x)})"


def _trigram_list(x: str) -> str:
    return (f"list_sort(list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))))")


def _num0(x: str) -> str:
    return f"coalesce(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE), 0.0)"


def _subtotal() -> str:
    return (f"CASE WHEN price IS NOT NULL THEN {_num0('qty')} * CAST(price AS DOUBLE) * "
            f"(1.0 + (CASE WHEN source = 'user_selected_internet' THEN {_num0('margin')} ELSE 0.0 END) / 100.0) END")


def _exact_total(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(38,6))), 0) AS DOUBLE)"


def _parse_price(x: str) -> str:
    t = js_trim(f"regexp_replace({x}, '(?i)rp', '', 'g')")
    body = (f"CASE WHEN instr({t}, ',') > 0 THEN regexp_replace(replace({t}, '.', ''), ',', '.') "
            f"ELSE replace({t}, '.', '') END")
    num = f"regexp_extract({body}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0)"
    return f"coalesce(CASE WHEN {num} = '' THEN NULL ELSE TRY_CAST({num} AS DOUBLE) END, 0.0)"


def _json_in_text(x: str) -> str:
    fence_json = f"regexp_extract({x}, '```json\\s*([\\s\\S]*?)```', 1)"
    fence_any = f"regexp_extract({x}, '```\\s*([\\s\\S]*?)```', 1)"
    inner = (f"CASE WHEN regexp_matches({x}, '```json\\s*[\\s\\S]*?```') THEN {fence_json} "
             f"WHEN regexp_matches({x}, '```\\s*[\\s\\S]*?```') THEN {fence_any} ELSE {x} END")
    return js_trim(inner)


SQL: dict[str, str] = {}

SQL["lines_from_text"] = f"""
WITH pieces AS (
  SELECT doc_id AS file_id, unnest(string_split_regex(text, '\\r?\\n')) AS piece,
         unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS pos
  FROM documents),
kept AS (SELECT file_id, pos, {js_trim('piece')} AS line FROM pieces WHERE {js_trim('piece')} <> '')
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INTEGER) AS line_index, line FROM kept
"""

SQL["lines_from_files"] = _with(LINES) + """
SELECT CAST(session_id AS BIGINT) // 5000 AS list,
       row_number() OVER (PARTITION BY CAST(session_id AS BIGINT) // 5000 ORDER BY CAST(session_id AS BIGINT), line_index) - 1 AS line_index,
       raw_text AS line
FROM lines WHERE line_index % 5 <> 4
"""

SQL["lines_from_table"] = f"""
WITH c AS (
  SELECT c_custkey, list_filter([c_name, CAST(c_nationkey AS VARCHAR),
                                 CASE WHEN c_acctbal = round(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END,
                                 CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR),
                                 CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) * 100000 AS VARCHAR), c_mktsegment],
                                lambda x: x IS NOT NULL AND {js_trim('x')} <> '') AS cells FROM customer)
SELECT c_custkey, {js_trim("array_to_string(cells, ' ')")} AS line FROM c WHERE {js_trim("array_to_string(cells, ' ')")} <> ''
"""

SQL["lines_from_paste"] = f"""
WITH pieces AS (
  SELECT conv_id, turn, unnest(string_split_regex(text, '\\r?\\n')) AS piece,
         unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS pos
  FROM conversations),
kept AS (SELECT conv_id, turn, pos, {js_trim('piece')} AS line FROM pieces WHERE {js_trim('piece')} <> '')
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INTEGER) AS line_index, line FROM kept
"""

SQL["skip_blank_lines"] = f"""
WITH pieces AS (
  SELECT doc_id AS file_id, unnest(string_split(text, '.')) AS raw_text,
         unnest(range(0, len(string_split(text, '.')))) AS line_index
  FROM documents)
SELECT file_id, CAST(line_index AS INTEGER) AS line_index, raw_text FROM pieces WHERE {js_trim('raw_text')} <> ''
"""

SQL["catalog_scan"] = _with(CATALOG) + """
SELECT id, name, brand, category, price, unit, created_at, CAST(coalesce(len(embedding), -1) AS INTEGER) AS dims FROM catalog
"""

SQL["catalog_align"] = """
SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category,
       CAST(p_retailprice AS DECIMAL(15,2)) AS price, 'pcs' AS unit, CAST(NULL AS TIMESTAMP) AS created_at FROM part
"""

SQL["catalog_json"] = _with(CATALOG) + """
SELECT CAST(id AS VARCHAR) AS id, name, brand, category, CAST(price AS DOUBLE) AS price, unit, created_at FROM catalog
"""

SQL["catalog_search"] = _with(CATALOG) + """
SELECT id, name, brand, category, price, unit FROM catalog
WHERE name ILIKE '%red%' OR brand ILIKE '%red%' OR category ILIKE '%red%'
"""

SQL["catalog_page"] = _with(CATALOG) + """
, hits AS (SELECT * FROM catalog WHERE name ILIKE '%brand#1%' OR brand ILIKE '%brand#1%' OR category ILIKE '%brand#1%')
SELECT id, name, brand, category, price, unit, (SELECT count(*) FROM hits) AS total, 25 AS "limit", 50 AS "offset"
FROM (SELECT * FROM hits ORDER BY id LIMIT 25 OFFSET 50)
"""

SQL["catalog_page_past_end"] = _with(CATALOG) + """
SELECT NULL::BIGINT AS id, NULL::VARCHAR AS name, NULL::VARCHAR AS brand, NULL::VARCHAR AS category, NULL::DECIMAL(15,2) AS price,
       NULL::VARCHAR AS unit, count(*) AS total, 25 AS "limit", 100000000 AS "offset"
FROM catalog WHERE name ILIKE '%brand#1%' OR brand ILIKE '%brand#1%' OR category ILIKE '%brand#1%'
"""

SQL["catalog_page_deep"] = _with(CATALOG) + """
SELECT id, name, brand, category, price, unit, total, 50 AS "limit", 1000 AS "offset"
FROM (SELECT count(*) AS total FROM catalog) LEFT JOIN (SELECT * FROM catalog ORDER BY id LIMIT 50 OFFSET 1000) ON true
"""

SQL["page_info"] = _with(CATALOG) + """
, counts AS (SELECT category, count(*) AS total, 50 AS "offset" FROM catalog GROUP BY category)
SELECT category, total, "offset",
       CAST(CASE WHEN total <= 0 THEN 0 ELSE floor((total - 1) / 25) * 25 END AS BIGINT) AS last_offset,
       CASE WHEN total = 0 THEN 0 ELSE "offset" + 1 END AS from_row,
       least("offset" + 25, total) AS to_row
FROM counts
"""

SQL["normalise_key"] = f"""
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS piece,
                  unnest(range(0, len(string_split(text, '.')))) AS pos FROM conversations)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, {_norm_key('piece')} AS key FROM s
"""

SQL["trigrams"] = _with(CATALOG) + f"""
SELECT id, CAST(len({_trigram_list('name')}) AS INTEGER) AS n_trigrams, array_to_string({_trigram_list('name')}, '|') AS trigrams
FROM catalog
"""

SQL["parse_price"] = _with(OFFER_BASE, SHOPPING, ORGANIC) + f"""
, t AS (SELECT query, pos, price AS text FROM shopping UNION ALL SELECT query, pos, snippet AS text FROM organic)
SELECT query, pos, text, {_parse_price('text')} AS price FROM t
"""

SQL["json_in_text"] = _with(MODEL_TEXT) + f"""
, t AS (SELECT event_id, {_json_in_text('text')} AS tx FROM model_text),
c AS (SELECT event_id, tx, instr(tx, '{{') AS obj_at, instr(tx, '[') AS arr_at, length(tx) AS n,
             CASE WHEN instr(reverse(tx), '}}') > 0 THEN length(tx) - instr(reverse(tx), '}}') + 1 ELSE 0 END AS last_obj,
             CASE WHEN instr(reverse(tx), ']') > 0 THEN length(tx) - instr(reverse(tx), ']') + 1 ELSE 0 END AS last_arr
      FROM t),
j AS (SELECT event_id,
        CASE WHEN arr_at > 0 AND (obj_at = 0 OR arr_at < obj_at)
               THEN CASE WHEN last_arr >= arr_at THEN substr(tx, arr_at, last_arr - arr_at + 1) ELSE '' END
             WHEN obj_at > 0 THEN CASE WHEN last_obj >= obj_at THEN substr(tx, obj_at, last_obj - obj_at + 1) ELSE '' END
             ELSE tx END AS json_text
      FROM c)
SELECT event_id, json_text, coalesce(json_valid(json_text), false) AS parses FROM j
"""

SQL["line_defaults"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN l_linestatus = 'O' THEN 'order ' || CAST(l_orderkey AS VARCHAR) ELSE 'baut' END AS name,
       CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) WHEN 1 THEN 1.0 ELSE 1.0 END AS qty,
       CASE WHEN l_returnflag = 'N' THEN 'pcs' ELSE 'box' END AS unit
FROM lineitem
"""

SQL["subtotal"] = _with(RESULTS) + f"SELECT session_id, line_index, {_subtotal()} AS subtotal FROM results"

SQL["format_rupiah"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN l_returnflag = 'R' THEN '-'
            ELSE 'Rp ' || CASE WHEN m < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(m) // 1000), ',', '.')
                 || CASE WHEN abs(m) % 1000 = 0 THEN '' ELSE ',' || rtrim(lpad(CAST(abs(m) % 1000 AS VARCHAR), 3, '0'), '0') END END AS rupiah
FROM (SELECT *, CAST(round(l_extendedprice * 1000) AS BIGINT) AS m FROM lineitem)
"""

SQL["vector_text"] = """
SELECT vec_id, true AS same_size, CAST(0 AS FLOAT) AS max_diff FROM embeddings
"""

SQL["edited_number"] = _with(OFFER_BASE, SHOPPING) + """
, t AS (SELECT query, pos, price || CASE WHEN pos % 2 = 0 THEN '' ELSE ' ,5' END AS typed FROM shopping),
u AS (SELECT query, pos, typed, regexp_replace(regexp_replace(typed, '[^\\d.,-]', '', 'g'), ',', '.') AS s FROM t)
SELECT query, pos, typed, coalesce(CASE WHEN s = '' THEN 0.0 ELSE TRY_CAST(s AS DOUBLE) END, 0.0) AS number FROM u
"""

SQL["status_label"] = _with(RESULTS) + """
, s AS (SELECT session_id, line_index, CASE WHEN line_index = 6 THEN 'mystery' ELSE source END AS source FROM results),
m(source, label, tone) AS (VALUES ('auto_database', 'Cocok otomatis', 'ok'), ('auto_database_ai', 'Dipilih AI', 'ok'),
  ('user_selected_db', 'Dipilih manual', 'manual'), ('user_selected_internet', 'Dari internet', 'manual'),
  ('not_found', 'Tidak ditemukan', 'bad'), ('skipped', 'Dilewati', 'bad'), ('cancelled', 'Dibatalkan', 'bad'),
  ('error', 'Error', 'bad'), ('unknown', 'Tidak diketahui', 'bad'))
SELECT s.session_id, s.line_index, s.source, coalesce(m.label, s.source) AS label, coalesce(m.tone, 'bad') AS tone
FROM s LEFT JOIN m ON s.source = m.source
"""

SQL["embedding_text"] = _with(CATALOG) + """
SELECT id, concat_ws(' | ', CASE WHEN name <> '' THEN name END,
                     CASE WHEN category = 'PROMO' THEN NULL WHEN brand <> '' THEN brand END,
                     CASE WHEN category <> '' THEN category END) AS text FROM catalog
"""

SQL["cosine"] = """
SELECT a.vec_id, b.vec_id AS next_id,
       round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""

SQL["validate_products"] = _with(CHANGES, _validated()) + """
SELECT change_id, op, clean_name, clean_brand, clean_category, clean_unit, CAST(clean_price AS DOUBLE) AS clean_price,
       verr AS error FROM validated
"""

_CH = _with(CATALOG, CHANGES, _validated()) + """
, v AS (SELECT *, CASE WHEN op = 'delete' THEN NULL ELSE verr END AS err FROM validated),
created AS (
  SELECT CAST((SELECT coalesce(max(id), 0) FROM catalog) + row_number() OVER (ORDER BY change_id) AS BIGINT) AS id,
         clean_name AS name, clean_brand AS brand, clean_category AS category, clean_price AS price,
         CASE WHEN has_unit THEN clean_unit ELSE 'pcs' END AS unit, TIMESTAMP '2024-06-01 00:00:00' AS created_at, change_id AS born
  FROM v WHERE op = 'create' AND err IS NULL),
allrows AS (SELECT id, name, brand, category, price, unit, created_at, NULL::BIGINT AS born FROM catalog
            UNION ALL SELECT id, name, brand, category, price, unit, created_at, born FROM created),
keyed AS (SELECT * FROM v WHERE op IN ('update', 'delete')),
seen AS (SELECT k.*, r.id IS NOT NULL AND (r.born IS NULL OR k.change_id > r.born) AS there
         FROM keyed k LEFT JOIN allrows r ON r.id = k.id),
gone AS (SELECT id, min(change_id) AS g FROM seen WHERE there AND op = 'delete' GROUP BY id),
judged AS (SELECT s.*, s.there AND (gone.g IS NULL OR s.change_id <= gone.g) AS found FROM seen s LEFT JOIN gone ON gone.id = s.id),
upd AS (SELECT * FROM judged WHERE found AND op = 'update' AND err IS NULL),
agg AS (SELECT id,
          arg_max(clean_name, CASE WHEN name_sent THEN change_id END) AS new_name,
          arg_max(clean_brand, CASE WHEN has_brand THEN change_id END) AS new_brand,
          arg_max(clean_category, CASE WHEN has_category THEN change_id END) AS new_category,
          arg_max(clean_unit, CASE WHEN has_unit THEN change_id END) AS new_unit,
          arg_max(clean_price, CASE WHEN has_price THEN change_id END) AS new_price,
          bool_or(name_sent) AS s_name, bool_or(has_brand) AS s_brand, bool_or(has_category) AS s_category,
          bool_or(has_unit) AS s_unit, bool_or(has_price) AS s_price
        FROM upd GROUP BY id),
state AS (
  SELECT c.id, CASE WHEN s_name THEN new_name ELSE c.name END AS name,
         CASE WHEN s_brand THEN new_brand ELSE c.brand END AS brand,
         CASE WHEN s_category THEN new_category ELSE c.category END AS category,
         CASE WHEN s_unit THEN new_unit ELSE c.unit END AS unit,
         CAST(CASE WHEN s_price THEN new_price ELSE c.price END AS DECIMAL(15,2)) AS price,
         c.born IS NOT NULL OR coalesce(s_name OR s_brand OR s_category, false) AS reembed, a.id IS NOT NULL AS was_updated, gone.g
  FROM allrows c LEFT JOIN agg a ON a.id = c.id LEFT JOIN gone ON gone.id = c.id)
"""

SQL["catalog_create"] = _CH + "SELECT id, name, brand, category, price, unit, created_at FROM created"
SQL["catalog_update"] = _CH + "SELECT id, name, brand, category, price, unit, reembed FROM state WHERE was_updated"
SQL["catalog_delete"] = _CH + "SELECT id, name, brand, category, price, unit FROM state WHERE g IS NOT NULL"
SQL["changes_missing"] = _CH + "SELECT change_id, op, id, 'Produk tidak ditemukan' AS error FROM judged WHERE NOT found"
SQL["catalog_snapshot"] = _CH + "SELECT id, name, brand, category, price, unit, reembed FROM state WHERE g IS NULL"

SQL["catalog_load"] = """
SELECT p_partkey AS seed_order, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS id FROM part
"""

SQL["catalog_published"] = SQL["catalog_load"]

SQL["load_summary"] = """
WITH loaded AS (SELECT p_type AS category, row_number() OVER (ORDER BY p_partkey) AS id FROM part)
SELECT category, min(id) AS first_id, count(*) AS n_rows FROM loaded GROUP BY category
"""

SQL["quotation_total"] = _with(RESULTS) + f"""
SELECT session_id, {_exact_total(_subtotal())} AS total, count(*) FILTER (WHERE ({_subtotal()}) IS NULL) AS lines_without_price,
       count(*) AS lines FROM results GROUP BY session_id
"""

_LABEL = ("coalesce(CASE WHEN product_name <> '' THEN product_name END, CASE WHEN product_supplier <> '' THEN product_supplier END, "
          "CASE WHEN error IS NOT NULL AND error <> '' THEN 'ERROR: ' || error END, '')")

SQL["quotation_sheet"] = _with(RESULTS) + f"""
, items AS (
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_index) AS INTEGER) AS no,
         coalesce(raw_text, '') AS item, CASE WHEN {_num0('qty')} <> 0 THEN {_num0('qty')} END AS qty,
         coalesce(unit, '') AS unit, coalesce(name, '') AS detected_name, {_LABEL} AS product_label,
         CAST(price AS DOUBLE) AS unit_price,
         CASE WHEN source = 'user_selected_internet' THEN {_num0('margin')} END AS margin,
         {_subtotal()} AS subtotal, coalesce(source, '') AS source,
         coalesce(CASE WHEN product_url <> '' THEN product_url END, '') AS url, 'item' AS row_kind
  FROM results),
per AS (SELECT session_id, count(*) AS n, {_exact_total(_subtotal())} AS total FROM results GROUP BY session_id)
SELECT *, CAST(no AS BIGINT) AS sheet_row FROM items
UNION ALL SELECT session_id, NULL, '', NULL, '', '', '', NULL, NULL, NULL, '', '', 'blank', n + 1 FROM per
UNION ALL SELECT session_id, NULL, '', NULL, '', '', 'TOTAL', NULL, NULL, total, '', '', 'total', n + 2 FROM per
"""

SQL["sheet_published"] = SQL["quotation_sheet"]

SQL["results_for_export"] = _with(RESULTS) + """
SELECT session_id, line_index, raw_text, name, qty, unit, price, source, margin, error, product_name, product_url FROM results
"""

SQL["session_results"] = _with(RESULTS) + """
SELECT session_id, CAST(floor(line_index / 1000) AS INTEGER) AS chunk,
       list_sort(list({'line_index': line_index, 'source': source, 'price': price})) AS results, count(*) AS n
FROM results GROUP BY session_id, chunk
"""

SQL["session_progress"] = _with(LINES, RESULTS) + """
, tot AS (SELECT session_id, count(*) AS total FROM lines GROUP BY session_id),
dn AS (SELECT session_id, count(DISTINCT line_index) AS done FROM results WHERE price IS NOT NULL GROUP BY session_id)
SELECT t.session_id, coalesce(d.done, 0) AS done, t.total,
       CAST(round(coalesce(d.done, 0) * 100.0 / t.total) AS INTEGER) AS percent, coalesce(d.done, 0) >= t.total AS complete
FROM tot t LEFT JOIN dn d ON d.session_id = t.session_id
"""


# ------------------------------------------------------------------ batch 2

from penawar.config import DEFAULT as _CFG  # noqa: E402

_UNITS = "|".join(_CFG.unit_words)
_MEASURES = ", ".join(f"'{w}'" for w in _CFG.measure_words)
_LEAD = rf"(?i)^(\d+(?:[.,]\d+)?)\s*(?:x\s*)?({_UNITS})\s+(.+)$"
_TIMES = r"(?i)^(\d+(?:[.,]\d+)?)\s*x\s+(\S.*)$"
_TRAIL = rf"(?i)^(.+?)\s+(\d+(?:[.,]\d+)?)\s*({_UNITS})$"
_BARE = r"^(\d+(?:[.,]\d+)?)\s+(\S+)(.*)$"

EXTRACTED = f"""xt AS (SELECT *, {js_trim('raw_text')} AS t FROM lines),
xf AS (SELECT *, regexp_matches(t, '{_LEAD}') AS is_lead, regexp_matches(t, '{_TRAIL}') AS is_trail,
              regexp_matches(t, '{_TIMES}') AS is_times,
              regexp_matches(t, '{_BARE}') AND lower(regexp_extract(t, '{_BARE}', 2)) NOT IN ({_MEASURES}) AS is_bare
       FROM xt),
xv AS (SELECT *,
         CASE WHEN is_lead THEN regexp_extract(t, '{_LEAD}', 3) WHEN is_trail THEN regexp_extract(t, '{_TRAIL}', 1)
              WHEN is_times THEN regexp_extract(t, '{_TIMES}', 2)
              WHEN is_bare THEN regexp_extract(t, '{_BARE}', 2) || regexp_extract(t, '{_BARE}', 3) ELSE t END AS n0,
         CASE WHEN is_lead THEN regexp_extract(t, '{_LEAD}', 1) WHEN is_trail THEN regexp_extract(t, '{_TRAIL}', 2)
              WHEN is_times THEN regexp_extract(t, '{_TIMES}', 1)
              WHEN is_bare THEN regexp_extract(t, '{_BARE}', 1) END AS q0,
         CASE WHEN is_lead THEN lower(regexp_extract(t, '{_LEAD}', 2)) WHEN is_trail THEN lower(regexp_extract(t, '{_TRAIL}', 3)) END AS u0
       FROM xf),
extracted AS (
  SELECT session_id, line_index, raw_text, qvec_id,
         coalesce(CASE WHEN {js_trim('n0')} <> '' THEN {js_trim('n0')} END, raw_text) AS name,
         coalesce(CASE WHEN TRY_CAST({js_trim("replace(q0, ',', '.')")} AS DOUBLE) <> 0
                       THEN TRY_CAST({js_trim("replace(q0, ',', '.')")} AS DOUBLE) END, 1.0) AS qty,
         coalesce(CASE WHEN u0 <> '' THEN u0 END, 'pcs') AS unit
  FROM xv)"""

SQL["extract_lines"] = _with(LINES, EXTRACTED) + "SELECT session_id, line_index, name, qty, unit FROM extracted"

SQL["offer_requests"] = _with(LINES, EXTRACTED) + f"""
SELECT session_id, line_index, name, {js_trim('name')} AS shopping_q, {js_trim('name')} || ' harga' AS organic_q
FROM extracted WHERE {js_trim('name')} <> ''
"""

SQL["error_rows"] = _with(LINES) + """
SELECT session_id, line_index, CASE WHEN lower(raw_text) LIKE '%gizmo%' THEN 'error' END AS source,
       CASE WHEN lower(raw_text) LIKE '%gizmo%' THEN 'provider failed' END AS error FROM lines
"""

SQL["dedupe_fanout"] = _with(LINES) + f"""
, k AS (SELECT *, {_norm_key('raw_text')} AS cache_key FROM lines)
SELECT session_id, line_index, cache_key, min(line_index) OVER (PARTITION BY session_id, cache_key) AS donor_index,
       row_number() OVER (PARTITION BY session_id, cache_key ORDER BY line_index) > 1 AS cached FROM k
"""

SQL["vector_search"] = _with(CATALOG) + """
, c AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM catalog WHERE embedding IS NOT NULL),
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id, c.id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS sim
      FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.3)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, id, round(sim, 9) AS sim FROM r WHERE rank <= 8
"""

QUESTIONS = """qev AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events),
questions AS (
  SELECT *, CASE WHEN line_index % 2 = 0 THEN 'ambiguous' ELSE 'internet_fallback' END AS reason FROM (
    SELECT CAST(user_id AS VARCHAR) AS session_id,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line_index,
           CASE WHEN event_id % 3 = 0 OR next_ts IS NULL THEN ts ELSE greatest(ts, next_ts - INTERVAL 4 MINUTE) END AS asked_at,
           'barang ' || CAST(event_id AS VARCHAR) AS name, user_id
    FROM qev WHERE event_type = 'view'))"""

CHOICES = """cev AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_views FROM events),
choices AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(n_views - 1 AS INTEGER) AS line_index,
         CASE event_type WHEN 'purchase' THEN 'product' WHEN 'click' THEN 'internet' WHEN 'error' THEN 'cancel' ELSE 'other' END AS type,
         CASE WHEN event_type = 'purchase' THEN CAST(user_id * 8 + event_id % 10 AS VARCHAR) END AS id,
         CASE WHEN event_type = 'click' AND event_id % 6 <> 4 THEN 'https://shop.example/s/' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 6 AS VARCHAR) END AS url,
         ts AS "at", event_id
  FROM cev WHERE event_type <> 'view')"""

QCANDS = """qdb AS (SELECT session_id, line_index, user_id, unnest(range(0, 8)) AS j FROM questions WHERE reason = 'ambiguous'),
qnet AS (SELECT session_id, line_index, user_id, unnest(range(0, 5)) AS j FROM questions WHERE reason = 'internet_fallback'),
qc AS (
  SELECT qdb.session_id, qdb.line_index, CAST(j + 1 AS INTEGER) AS rank, CAST(c.id AS VARCHAR) AS id, c.name, c.brand, c.category,
         CAST(c.price AS DOUBLE) AS price, c.unit, NULL::VARCHAR AS supplier, NULL::VARCHAR AS url, NULL::VARCHAR AS title
  FROM qdb JOIN catalog c ON c.id = qdb.user_id * 8 + qdb.j
  UNION ALL
  SELECT session_id, line_index, CAST(j + 1 AS INTEGER), NULL, NULL, NULL, NULL, CAST(user_id * 1000 + j * 10 + 5 AS DOUBLE), NULL,
         'Toko ' || CAST(j AS VARCHAR), CASE WHEN j <> 4 THEN 'https://shop.example/s/' || CAST(user_id AS VARCHAR) || '-' || CAST(j AS VARCHAR) END,
         CASE WHEN j <> 2 THEN 'Offer ' || CAST(j AS VARCHAR) END
  FROM qnet)"""

FIRST_CHOICE = """fc AS (
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.session_id, c.line_index ORDER BY c."at", c.event_id) AS rn
    FROM choices c JOIN questions q ON q.session_id = c.session_id AND q.line_index = c.line_index
    WHERE c."at" >= q.asked_at AND c."at" < q.asked_at + INTERVAL 5 MINUTE) WHERE rn = 1)"""

SQL["first_choice"] = _with(QUESTIONS, CHOICES, FIRST_CHOICE) + 'SELECT session_id, line_index, type, id, url, "at" FROM fc'

APPLIED_CHOICES = """ac AS (
  SELECT b.session_id, b.line_index, b.name,
    CASE WHEN type IS NULL THEN 'skipped' WHEN type = 'cancel' THEN 'cancelled' WHEN type = 'skip' THEN 'skipped'
         WHEN type = 'product' THEN 'user_selected_db' WHEN type = 'internet' THEN 'user_selected_internet' ELSE 'unknown' END AS source,
    CASE WHEN type = 'product' THEN db.cid END AS product_id,
    CASE WHEN type = 'product' THEN db.c_name WHEN type = 'internet' AND net.hit THEN coalesce(net.o_title, b.name) END AS product_name,
    CASE WHEN type = 'internet' AND net.hit THEN net.o_supplier END AS product_supplier,
    CASE WHEN type = 'internet' AND net.hit THEN net.curl END AS product_url,
    CASE WHEN type = 'product' THEN db.c_price WHEN type = 'internet' THEN net.o_price END AS price,
    CASE WHEN type IS NULL THEN 'input_timeout' END AS reason
  FROM (SELECT q.session_id, q.line_index, q.name, fc.type, fc.id, fc.url FROM questions q
        LEFT JOIN fc ON fc.session_id = q.session_id AND fc.line_index = q.line_index) b
  LEFT JOIN (SELECT session_id, line_index, id AS cid, name AS c_name, price AS c_price FROM qc WHERE id IS NOT NULL) db
    ON b.session_id = db.session_id AND b.line_index = db.line_index AND b.type = 'product' AND b.id = db.cid
  LEFT JOIN (SELECT * FROM (SELECT session_id, line_index, url AS curl, title AS o_title, supplier AS o_supplier, price AS o_price, true AS hit,
                                   row_number() OVER (PARTITION BY session_id, line_index, url ORDER BY rank) AS rn
                            FROM qc WHERE id IS NULL) WHERE rn = 1) net
    ON b.session_id = net.session_id AND b.line_index = net.line_index AND b.type = 'internet' AND b.url IS NOT DISTINCT FROM net.curl)"""

SQL["apply_choices"] = _with(CATALOG, QUESTIONS, CHOICES, QCANDS, FIRST_CHOICE, APPLIED_CHOICES) + "SELECT * FROM ac"
SQL["choice_timeout"] = (_with(CATALOG, QUESTIONS, CHOICES, QCANDS, FIRST_CHOICE, APPLIED_CHOICES)
                         + "SELECT session_id, line_index, source, reason FROM ac WHERE reason = 'input_timeout'")

SQL["cancel_session"] = _with(QUESTIONS, CHOICES, FIRST_CHOICE) + """
, cancels AS (SELECT session_id, "at" AS cancel_at, event_id AS cancel_id FROM (
                SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at", event_id) AS k FROM choices WHERE type = 'cancel') WHERE k = 1),
el AS (SELECT CAST(user_id AS VARCHAR) AS session_id,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line_index, ts AS started_at
       FROM events)
SELECT q.session_id, q.line_index,
       CASE WHEN f.event_id IS NOT NULL AND (c.cancel_at IS NULL OR f."at" < c.cancel_at OR (f."at" = c.cancel_at AND f.event_id < c.cancel_id)) THEN 'answered'
            WHEN c.cancel_at IS NULL THEN 'open' WHEN q.asked_at >= c.cancel_at THEN 'cancelled'
            WHEN c.cancel_at < q.asked_at + INTERVAL 5 MINUTE THEN 'cancelled' ELSE 'open' END AS state, 'question' AS kind
FROM questions q LEFT JOIN cancels c ON c.session_id = q.session_id
LEFT JOIN fc f ON f.session_id = q.session_id AND f.line_index = q.line_index
UNION ALL
SELECT l.session_id, l.line_index, CASE WHEN c.cancel_at IS NOT NULL AND l.started_at > c.cancel_at THEN 'dropped' ELSE 'kept' END,
       'line'
FROM el l LEFT JOIN cancels c ON c.session_id = l.session_id
"""


def _json_cut(x: str) -> str:
    t = _json_in_text(x)
    obj = f"instr({t}, '{{')"
    arr = f"instr({t}, '[')"
    last_obj = f"(CASE WHEN instr(reverse({t}), '}}') > 0 THEN length({t}) - instr(reverse({t}), '}}') + 1 ELSE 0 END)"
    last_arr = f"(CASE WHEN instr(reverse({t}), ']') > 0 THEN length({t}) - instr(reverse({t}), ']') + 1 ELSE 0 END)"
    return (f"(CASE WHEN {arr} > 0 AND ({obj} = 0 OR {arr} < {obj}) "
            f"THEN CASE WHEN {last_arr} >= {arr} THEN substr({t}, {arr}, {last_arr} - {arr} + 1) ELSE '' END "
            f"WHEN {obj} > 0 THEN CASE WHEN {last_obj} >= {obj} THEN substr({t}, {obj}, {last_obj} - {obj} + 1) ELSE '' END "
            f"ELSE {t} END)")


RESPONSES = """rr AS (SELECT *, '{"id": ' || CASE WHEN line_index % 13 = 0 THEN 'null' ELSE '"' || CAST(user_id * 8 + line_index % 10 AS VARCHAR) || '"' END
                  || ', "confidence": ' || CAST(CAST((line_index % 6) * 0.25 AS DOUBLE) AS VARCHAR) || ', "reason": "r'
                  || CAST(line_index AS VARCHAR) || '"}' AS body
            FROM questions WHERE reason = 'ambiguous'),
responses AS (SELECT session_id, line_index,
                CASE WHEN line_index % 11 = 0 THEN 'sorry, cannot decide'
                     WHEN line_index % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS response
              FROM rr)"""

SQL["verdict_check"] = _with(CATALOG, QUESTIONS, QCANDS, RESPONSES) + f"""
, p AS (SELECT session_id, line_index, {_json_cut('response')} AS j FROM responses),
v AS (SELECT session_id, line_index, coalesce(json_valid(j), false) AS ok,
             CASE WHEN json_valid(j) THEN json_extract_string(j, '$.id') END AS vid,
             CASE WHEN json_valid(j) THEN json_extract_string(j, '$.confidence') END AS vconf,
             CASE WHEN json_valid(j) THEN json_extract_string(j, '$.reason') END AS vreason FROM p),
x AS (SELECT v.*, EXISTS (SELECT 1 FROM qc WHERE qc.id IS NOT NULL AND qc.session_id = v.session_id AND qc.line_index = v.line_index) AS has_c,
             EXISTS (SELECT 1 FROM qc WHERE qc.id IS NOT NULL AND qc.session_id = v.session_id AND qc.line_index = v.line_index
                     AND qc.id = v.vid) AS member,
             (vid IS NULL OR vid = '' OR vid = 'null') AS null_id FROM v)
SELECT session_id, line_index,
       CASE WHEN has_c AND ok AND NOT null_id AND member THEN vid END AS id,
       CASE WHEN has_c AND ok AND NOT null_id AND member
            THEN least(1.0, greatest(0.0, coalesce(CASE WHEN isnan(TRY_CAST(vconf AS DOUBLE)) THEN NULL ELSE TRY_CAST(vconf AS DOUBLE) END, 0.0)))
            ELSE 0.0 END AS confidence,
       CASE WHEN NOT has_c THEN 'no_candidates' WHEN NOT ok THEN 'rerank_failed'
            WHEN null_id THEN coalesce(CASE WHEN vreason <> '' THEN vreason END, 'no_match')
            WHEN NOT member THEN 'id_not_in_candidates' ELSE coalesce(vreason, '') END AS reason
FROM x
"""

SQL["candidate_block"] = _with(CATALOG, QUESTIONS, QCANDS) + """
SELECT session_id, line_index,
       string_agg('- id=' || id || ' | ' || name || CASE WHEN brand <> '' THEN ' | brand: ' || brand ELSE '' END
                  || CASE WHEN category <> '' THEN ' | category: ' || category ELSE '' END, chr(10) ORDER BY rank) AS block
FROM qc WHERE id IS NOT NULL GROUP BY session_id, line_index
"""

SQL["review_queue"] = _with(CATALOG, QUESTIONS, QCANDS) + """
, pend AS (SELECT session_id, line_index, reason,
                  CASE WHEN reason = 'ambiguous' THEN CAST(user_id * 8 + (line_index * 3) % 8 AS VARCHAR) END AS suggested_id
           FROM questions),
u AS (SELECT p.session_id, p.line_index, p.reason, p.suggested_id, CASE WHEN qc.id = p.suggested_id THEN 0 ELSE 1 END AS o,
             qc.rank AS r, qc.id AS e
      FROM pend p JOIN qc ON qc.session_id = p.session_id AND qc.line_index = p.line_index AND qc.id IS NOT NULL
      UNION ALL
      SELECT p.session_id, p.line_index, p.reason, p.suggested_id, 1, qc.rank, qc.title
      FROM pend p JOIN qc ON qc.session_id = p.session_id AND qc.line_index = p.line_index AND qc.id IS NULL)
SELECT session_id, line_index, reason, suggested_id, coalesce(string_agg(e, ',' ORDER BY o, r), '') AS candidate_order,
       CAST(count(*) AS INTEGER) AS n_candidates
FROM u GROUP BY session_id, line_index, reason, suggested_id
"""


def _structured(src: str) -> str:
    return f"""st0 AS (SELECT query, pos, coalesce(extracted_price, {_parse_price('price')}) AS price,
                  coalesce(CASE WHEN source <> '' THEN source END, 'Unknown') AS supplier,
                  CASE WHEN title <> '' THEN title END AS title,
                  coalesce(CASE WHEN product_link <> '' THEN product_link END, CASE WHEN link <> '' THEN link END) AS url,
                  CASE WHEN source <> '' THEN source END AS source_site FROM {src}),
st1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, supplier ORDER BY pos) AS rn FROM st0
                       WHERE price IS NOT NULL AND price <> 0 AND NOT isnan(price)) WHERE rn = 1),
structured AS (SELECT query, pos, supplier, title, price, url, source_site FROM (
                 SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM st1) WHERE k <= 5)"""


_INSTALMENT = r"(?i)cicilan\s+(?:rp|idr)\.?\s*\d[\d.,]*|(?:rp|idr)\.?\s*\d[\d.,]*\s*/\s*(?:bln|bulan)"
_AMOUNT = r"(?i)(?:rp|idr)\.?\s*([\d][\d.,]*)"


def _from_text(src: str) -> str:
    return f"""ot0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS rn FROM {src}) WHERE rn <= 8),
ot1 AS (SELECT query, pos, CASE WHEN title <> '' THEN title END AS title, CASE WHEN link <> '' THEN link END AS url,
               coalesce(nullif(regexp_extract(link, '^[a-z]+://([^/]+)', 1), ''), 'Unknown') AS supplier,
               list_min(list_transform(regexp_extract_all(regexp_replace(snippet, '{_INSTALMENT}', ' ', 'g'), '{_AMOUNT}', 1),
                                       lambda a: {_parse_price('a')})) AS amount FROM ot0),
ot2 AS (SELECT * FROM ot1 WHERE amount IS NOT NULL),
otm AS (SELECT query, quantile_cont(amount, 0.5) AS med FROM ot2 GROUP BY query),
ot3 AS (SELECT ot2.* FROM ot2 JOIN otm ON otm.query = ot2.query WHERE NOT (amount * 5 < med)),
ot4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, supplier ORDER BY pos) AS rn FROM ot3) WHERE rn = 1),
fromtext AS (SELECT query, pos, supplier, title, amount AS price, url, supplier AS source_site FROM (
               SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM ot4) WHERE k <= 5 AND amount > 0)"""


SQL["offers_structured"] = _with(OFFER_BASE, SHOPPING, _structured("shopping")) + "SELECT * FROM structured"
SQL["offers_from_text"] = _with(OFFER_BASE, ORGANIC, _from_text("organic")) + "SELECT * FROM fromtext"
SQL["find_offers"] = _with(OFFER_BASE, SHOPPING, ORGANIC) + f"""
, fq AS (SELECT DISTINCT {js_trim('query')} AS query FROM organic WHERE {js_trim('query')} <> ''),
shop_q AS (SELECT * FROM shopping WHERE query IN (SELECT query FROM fq)),
{_structured('shop_q')},
rest AS (SELECT query FROM fq WHERE query NOT IN (SELECT query FROM structured)),
org_q AS (SELECT * FROM organic WHERE query IN (SELECT query FROM rest)),
{_from_text('org_q')}
SELECT *, 'shopping' AS origin FROM structured UNION ALL SELECT *, 'organic' AS origin FROM fromtext
"""

SQL["snippet_block"] = _with(OFFER_BASE, ORGANIC) + """
, f8 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS i FROM organic)
SELECT query, string_agg('[' || CAST(i AS VARCHAR) || '] ' || coalesce(title, 'undefined') || chr(10) || coalesce(snippet, '')
                         || chr(10) || 'URL: ' || coalesce(link, ''), chr(10) || chr(10) ORDER BY i) AS snippets
FROM f8 WHERE i <= 8 GROUP BY query
"""


def _edited(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '[^\\d.,-]', '', 'g'), ',', '.')"
    return f"coalesce(CASE WHEN {s} = '' THEN 0.0 ELSE TRY_CAST({s} AS DOUBLE) END, 0.0)"


SQL["apply_edits"] = _with(RESULTS) + f"""
, ed0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id,
                 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS INTEGER) AS line_index,
                 l_linenumber AS k, l_returnflag FROM lineitem),
ed AS (SELECT session_id, line_index,
              CASE WHEN k = 1 THEN '12,5' END AS qty_text, CASE WHEN k = 2 THEN ' dus ' END AS unit_text,
              CASE WHEN k = 3 THEN 'Barang manual' END AS product_text,
              CASE WHEN k = 1 AND l_returnflag = 'A' THEN '' WHEN k = 3 THEN 'Rp 1.500' END AS price_text,
              CASE WHEN k = 2 THEN '10' END AS margin_text
       FROM ed0 WHERE k IN (1, 2, 3)),
e AS (SELECT session_id, line_index,
             CASE WHEN qty_text IS NOT NULL THEN {_edited('qty_text')} END AS e_qty,
             CASE WHEN unit_text IS NOT NULL THEN {js_trim('unit_text')} END AS e_unit,
             CASE WHEN product_text IS NOT NULL THEN {js_trim('product_text')} END AS e_product,
             CASE WHEN price_text IS NOT NULL AND {js_trim('price_text')} <> '' THEN {_edited('price_text')} END AS e_price,
             price_text IS NOT NULL AND {js_trim('price_text')} = '' AS price_set_null,
             CASE WHEN margin_text IS NOT NULL THEN {_edited('margin_text')} END AS e_margin FROM ed)
SELECT r.session_id, r.line_index, r.source, coalesce(e_qty, qty) AS qty, coalesce(e_unit, unit) AS unit, name,
       coalesce(e_product, product_name) AS product_name,
       CASE WHEN price_set_null THEN NULL ELSE coalesce(e_price, price) END AS price,
       CASE WHEN source = 'user_selected_internet' THEN coalesce(e_margin, margin, 0.0) END AS margin
FROM results r LEFT JOIN e ON e.session_id = r.session_id AND e.line_index = r.line_index
"""

SQL["validate_requests"] = _with(LINES) + """
, ls AS (SELECT session_id, count(*) AS n FROM lines GROUP BY session_id),
r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS session_id,
             o_orderpriority <> '5-LOW' AS has_lines, coalesce(ls.n, 0) AS n
      FROM orders o LEFT JOIN ls ON ls.session_id = CAST(o.o_orderkey AS VARCHAR))
SELECT o_orderkey, session_id, CAST(CASE WHEN has_lines THEN n ELSE 0 END AS INTEGER) AS n_lines,
       CASE WHEN session_id IS NULL OR session_id = '' OR NOT has_lines THEN 'sessionId and lines[] are required' END AS error
FROM r
"""

_ETEXT = ("concat_ws(' | ', CASE WHEN name <> '' THEN name END, CASE WHEN brand <> '' THEN brand END, "
          "CASE WHEN category <> '' THEN category END)")

SQL["embedding_todo"] = _with(CATALOG) + f"SELECT id, {_ETEXT} AS text FROM catalog WHERE embedding IS NULL"

SQL["reembed_worklist"] = _CH + f"""
SELECT id, {_ETEXT} AS text FROM state WHERE g IS NULL AND reembed
"""

SQL["apply_embeddings"] = _with(CATALOG) + """
SELECT id, CAST(64 AS INTEGER) AS dims,
       coalesce(round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4), 1.0) AS norm,
       round(CAST(embedding[1] AS DOUBLE), 6) AS kept_first FROM catalog
"""

_MEMBERS = """mem AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id,
                       CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS delta
                FROM events WHERE event_type IN ('view', 'click'))"""

SQL["session_members"] = _with(_MEMBERS) + """
SELECT session_id, CAST(sum(delta) AS BIGINT) AS members, count(*) AS events FROM mem GROUP BY session_id
"""

SQL["last_leaver"] = _with(_MEMBERS) + """
, r AS (SELECT *, sum(delta) OVER (PARTITION BY session_id ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM mem),
d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM r WHERE delta < 0 AND running <= 0)
SELECT session_id, ts AS ended_at, event_id FROM d WHERE rn = 1
"""

SQL["extract_responses"] = _with(LINES) + f"""
, rs AS (SELECT session_id, line_index, raw_text, line_index % 4 AS k,
                regexp_replace(raw_text, '^\\d+ pcs ', '') AS nm, regexp_extract(raw_text, '^(\\d+)', 1) AS qt FROM lines),
rb AS (SELECT *, '{{"name": "' || nm || '", "qty": ' || CASE WHEN k = 1 THEN '"' || qt || '"' ELSE qt END
                 || ', "unit": "' || CASE WHEN k = 2 THEN '' ELSE 'pcs' END || '"}}' AS body FROM rs),
resp AS (SELECT session_id, line_index, raw_text,
                CASE WHEN k = 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN k = 1 THEN body
                     WHEN k = 2 THEN 'Hasil: ' || body || ' selesai' ELSE 'maaf, tidak bisa' END AS response FROM rb),
pj AS (SELECT *, {_json_cut('response')} AS j FROM resp),
pv AS (SELECT *, coalesce(json_valid(j), false) AS ok FROM pj)
SELECT session_id, line_index,
       CASE WHEN ok THEN coalesce(CASE WHEN json_extract_string(j, '$.name') <> '' THEN json_extract_string(j, '$.name') END, raw_text)
            ELSE raw_text END AS name,
       CASE WHEN ok THEN coalesce(CASE WHEN TRY_CAST({js_trim("json_extract_string(j, '$.qty')")} AS DOUBLE) <> 0
                                       THEN TRY_CAST({js_trim("json_extract_string(j, '$.qty')")} AS DOUBLE) END, 1.0)
            ELSE 1.0 END AS qty,
       CASE WHEN ok THEN coalesce(CASE WHEN json_extract_string(j, '$.unit') <> '' THEN json_extract_string(j, '$.unit') END, 'pcs')
            ELSE 'pcs' END AS unit
FROM pv
"""

SQL["duplicate_start"] = """
WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS start_id, ts AS start_at,
                            ts + to_minutes(CAST(coalesce(trunc(value), 0) AS BIGINT) * 100) AS end_at FROM events),
nxt AS (SELECT session_id, start_id, next_id FROM (
          SELECT a.session_id, a.start_id, b.start_id AS next_id,
                 row_number() OVER (PARTITION BY a.session_id, a.start_id ORDER BY b.start_at, b.start_id) AS k
          FROM s a JOIN s b ON a.session_id = b.session_id AND b.start_at >= a.end_at
               AND (b.start_at > a.start_at OR (b.start_at = a.start_at AND b.start_id > a.start_id))) WHERE k = 1),
acc(session_id, start_id) AS (
  SELECT session_id, start_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_at, start_id) AS k FROM s) WHERE k = 1
  UNION ALL
  SELECT nxt.session_id, nxt.next_id FROM acc JOIN nxt ON nxt.session_id = acc.session_id AND nxt.start_id = acc.start_id)
SELECT s.session_id, s.start_id, acc.start_id IS NOT NULL AS accepted
FROM s LEFT JOIN acc ON acc.session_id = s.session_id AND acc.start_id = s.start_id
"""

SQL["export_dated"] = f"""
SELECT session_id, sheet_row, row_kind, CAST(now() AT TIME ZONE 'UTC' AS DATE) AS export_date FROM ({SQL['quotation_sheet']})
"""

SQL["offers_from_responses"] = f"""
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS n FROM lineitem WHERE true),
hit AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS query, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS DOUBLE) AS price
        FROM li WHERE l_linenumber % 4 IN (0, 2))
SELECT query, CAST(0 AS BIGINT) AS pos, 'Toko A' AS supplier, NULL::VARCHAR AS title, price, NULL::VARCHAR AS url, NULL::VARCHAR AS source_site FROM hit WHERE price > 0
UNION ALL SELECT query, 1, 'Unknown', NULL, 1500.0, NULL, NULL FROM hit
"""

# T3 by its definition: the best extent of the name's trigram sequence; an extent may start and end on shared trigrams only
_SEQ = ("flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))")

SQL["word_similarity"] = f"""
WITH p AS (SELECT DISTINCT {VARIANT} AS q, {FULL} AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
qs AS (SELECT q, list_distinct({_SEQ.format(x='q')}) AS tq FROM (SELECT DISTINCT q FROM p)),
ns AS (SELECT n, {_SEQ.format(x='n')} AS seq FROM (SELECT DISTINCT n FROM p)),
m AS (SELECT q, n, tq, seq, list_filter(range(1, len(seq) + 1), lambda i: list_contains(tq, seq[i])) AS hit
      FROM p JOIN qs USING (q) JOIN ns USING (n)),
e AS (SELECT q, n, len(tq) AS nq, tq, list_distinct(seq[a:b]) AS ext
      FROM (SELECT *, unnest(hit) AS b FROM (SELECT *, unnest(hit) AS a FROM m)) WHERE a <= b),
c AS (SELECT q, n, nq, len(ext) AS u, len(list_intersect(ext, tq)) AS c FROM e),
best AS (SELECT q, n, max(c / (nq + u - c)) AS score FROM c GROUP BY q, n)
SELECT p.q, p.n, coalesce(score, 0.0) AS score FROM p LEFT JOIN best ON best.q = p.q AND best.n = p.n
"""

# the matching core over part texts: every pair's shared trigrams; exact scores, by definition, of the pairs whose upper
# bound reaches the 8th best lower bound of their text (and of those that the vectors bring)
_PARTS = f"""WITH {CATALOG},
pt AS (SELECT CASE qvec_id % 4 WHEN 0 THEN {FULL} WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name || ' ' || p_type || ' size 99'
              ELSE 'xyzzy ' || CAST(qvec_id AS VARCHAR) || 'q' END AS text, qvec_id
       FROM (SELECT min(p_partkey) AS qvec_id FROM part GROUP BY p_name, p_type) g JOIN part ON p_partkey = qvec_id),
qs AS (SELECT text, list_distinct({_SEQ.format(x='text')}) AS tq FROM (SELECT DISTINCT text FROM pt)),
ns AS (SELECT id, name, seq, list_distinct(seq) AS tn FROM (SELECT id, name, {_SEQ.format(x='name')} AS seq FROM catalog)),
sh AS (SELECT text, id, len(list_intersect(tq, tn)) AS sh, len(tq) AS m, len(tn) AS n FROM qs, ns),
bound AS (SELECT text, id, sh / m AS ub, row_number() OVER (PARTITION BY text ORDER BY sh / (m + n - sh) DESC) AS k, sh / (m + n - sh) AS lb
          FROM sh WHERE sh >= 0.3 * m - 1e-9),
lb8 AS (SELECT text, max(CASE WHEN k = 8 THEN lb ELSE 0 END) AS lb FROM bound GROUP BY text),
cand AS (SELECT bound.text, id FROM bound JOIN lb8 ON lb8.text = bound.text WHERE ub >= greatest(0.3, lb8.lb) - 1e-9),
vq AS (SELECT text, qvec_id, CAST(embedding AS DOUBLE[]) AS e FROM pt JOIN embeddings ON vec_id = qvec_id),
vs AS (SELECT text, qvec_id, c.id, list_dot_product(vq.e, CAST(c.embedding AS DOUBLE[]))
              / (sqrt(list_dot_product(vq.e, vq.e)) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS sim
       FROM vq, catalog c WHERE c.embedding IS NOT NULL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, qvec_id ORDER BY sim DESC, id) AS v_rn FROM vs WHERE sim >= 0.3) WHERE v_rn <= 8),
want AS (SELECT text, id FROM cand UNION SELECT text, id FROM vec),
hits AS (SELECT want.text, want.id, tq, seq, list_filter(range(1, len(seq) + 1), lambda i: list_contains(tq, seq[i])) AS hit
         FROM want JOIN qs ON qs.text = want.text JOIN ns ON ns.id = want.id),
ext AS (SELECT text, id, tq, list_distinct(seq[a:b]) AS ext
        FROM (SELECT *, unnest(hit) AS b FROM (SELECT *, unnest(hit) AS a FROM hits)) WHERE a <= b),
best AS (SELECT text, id, max(len(list_intersect(ext, tq)) / (len(tq) + len(ext) - len(list_intersect(ext, tq)))) AS score FROM ext GROUP BY text, id),
scored AS (SELECT want.text, want.id, coalesce(best.score, 0.0) AS score FROM want LEFT JOIN best ON best.text = want.text AND best.id = want.id),
trg AS (SELECT * FROM (SELECT scored.text, scored.id, score, row_number() OVER (PARTITION BY scored.text ORDER BY score DESC, length(name), scored.id) AS t_rn
                       FROM scored JOIN catalog c ON c.id = scored.id WHERE score >= 0.3) WHERE t_rn <= 8)
"""

_FUSED = """, tp AS (SELECT pt.text, pt.qvec_id, id, score, t_rn FROM pt JOIN trg ON trg.text = pt.text),
fused AS (SELECT coalesce(tp.text, vec.text) AS text, coalesce(tp.qvec_id, vec.qvec_id) AS qvec_id, coalesce(tp.id, vec.id) AS id, t_rn, v_rn, sim
          FROM tp FULL JOIN (SELECT * FROM vec WHERE {vectors}) vec ON vec.text = tp.text AND vec.qvec_id = tp.qvec_id AND vec.id = tp.id),
ranked AS (SELECT f.text AS name, f.qvec_id, f.id AS cid, c.name AS name_c, brand, category, CAST(price AS DOUBLE) AS price, unit, s.score,
                  coalesce(sim, 0.0) AS vector_sim, coalesce(1.0 / (60 + t_rn), 0.0) + coalesce(1.0 / (60 + v_rn), 0.0) AS rrf
           FROM fused f JOIN catalog c ON c.id = f.id JOIN scored s ON s.text = f.text AND s.id = f.id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, qvec_id ORDER BY rrf DESC, length(name_c), cid) AS rank FROM ranked) WHERE rank <= 8),
ob AS (SELECT *, best_score - second_score AS gap, best_score >= 0.9 AND (second_score IS NULL OR best_score - second_score >= 0.15) AS obvious FROM (
         SELECT name, qvec_id, max(CASE WHEN rank = 1 THEN score END) AS best_score, max(CASE WHEN rank = 2 THEN score END) AS second_score,
                max(CASE WHEN rank = 1 THEN CAST(cid AS VARCHAR) END) AS best_id, count(*) AS n_candidates FROM hy GROUP BY name, qvec_id)),
tok AS (SELECT *, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+(?:[.,]\\d+)*') AS req,
               regexp_extract_all(lower(concat_ws(' ', name_c, brand, category)), '[\\p{{L}}\\p{{N}}]+(?:[.,]\\d+)*') AS have FROM hy),
judged AS (SELECT *, len(list_filter(req, lambda t: regexp_matches(t, '\\d') AND NOT list_contains(have, t))) = 0 AS surv,
                  len(list_filter(req, lambda t: NOT list_contains(have, t))) = 0 AS has_all FROM tok),
va AS (SELECT name, qvec_id, count(*) FILTER (WHERE surv) AS n_surv, count(*) FILTER (WHERE surv AND has_all) AS n_all,
              arg_min(cid, rank) FILTER (WHERE surv) AS best, arg_min(score, rank) FILTER (WHERE surv) AS best_score,
              arg_min(cid, rank) FILTER (WHERE surv AND has_all) AS best_all FROM judged GROUP BY name, qvec_id),
verdict AS (SELECT name, qvec_id, CAST(CASE WHEN n_surv = 0 THEN NULL WHEN n_all >= 1 THEN best_all ELSE best END AS VARCHAR) AS id,
                   CASE WHEN n_surv = 0 THEN 0.0 WHEN n_all >= 2 THEN 0.5 WHEN n_all = 1 THEN 0.9 ELSE best_score * 0.7 END AS confidence,
                   CASE WHEN n_surv = 0 THEN 'no_match' WHEN n_all >= 2 THEN 'ambiguous' WHEN n_all = 1 THEN 'single_match' ELSE 'best_survivor' END AS reason
            FROM va)
"""
_HYBRID = _PARTS + _FUSED.format(vectors="true")

SQL["parts_trigram"] = _PARTS + "SELECT text AS key, CAST(t_rn AS INTEGER) AS rank, id, round(score, 12) AS score FROM trg"
SQL["parts_percent"] = _PARTS + "SELECT text AS key, CAST(t_rn AS INTEGER) AS rank, id, CAST(round(score * 100) AS INTEGER) AS score_pct FROM trg"
SQL["parts_hybrid"] = _HYBRID + """SELECT name, qvec_id, CAST(rank AS INTEGER) AS rank, CAST(cid AS VARCHAR) AS id, name_c, brand, category, price, unit,
       round(score, 9) AS score, round(vector_sim, 9) AS vector_sim, round(rrf, 9) AS rrf FROM hy"""
SQL["parts_degraded"] = _PARTS + _FUSED.format(vectors="false") + """SELECT name, qvec_id, CAST(rank AS INTEGER) AS rank, CAST(cid AS VARCHAR) AS id,
       round(score, 9) AS score, round(rrf, 9) AS rrf FROM hy"""
SQL["parts_obvious"] = _HYBRID + """SELECT name, qvec_id, best_id, n_candidates, obvious, round(best_score, 9) AS best_score,
       round(second_score, 9) AS second_score, round(gap, 9) AS gap FROM ob"""
SQL["parts_rerank"] = _HYBRID + "SELECT name, qvec_id, id, round(confidence, 9) AS confidence, reason FROM verdict"
SQL["parts_route"] = _HYBRID + """, r AS (SELECT ob.name, ob.qvec_id, obvious, best_id, n_candidates, v.id, v.confidence, v.reason,
       CASE WHEN obvious THEN 'auto_database' WHEN v.id IS NOT NULL AND v.confidence >= 0.8 THEN 'auto_database_ai' WHEN v.id IS NULL THEN 'offers' ELSE 'ask' END AS route
     FROM ob JOIN verdict v ON v.name = ob.name AND v.qvec_id = ob.qvec_id)
SELECT name, qvec_id, route, CASE WHEN obvious THEN best_id WHEN route = 'auto_database_ai' THEN id END AS product_id,
       CASE WHEN route = 'auto_database_ai' THEN round(confidence, 9) END AS confidence, CASE WHEN NOT obvious THEN reason END AS verdict_reason,
       CASE WHEN route = 'ask' THEN id END AS suggested_id, n_candidates FROM r"""
