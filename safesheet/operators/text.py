"""Scalar and text operators as column expressions."""

_DIGITS = "replace(cas, '-', '')"

QUERIES = {
    "un_valid": "SELECT document_id, value, MATCHES(value, '^[0-9]{4}$') AND CAST(value AS INT) BETWEEN 4 AND 3550 AS valid FROM extractions WHERE field_name = 'un_number'",
    "cas_format": "SELECT document_id, value, MATCHES(value, '^[0-9]{2,7}-[0-9]{2}-[0-9]$') AS valid FROM extractions WHERE field_name = 'cas_number' AND value IS NOT NULL",
    "cas_valid": "SELECT cas, (" + " + ".join(f"{k} * CAST(coalesce(nullif(substr({_DIGITS}, length({_DIGITS}) - {k}, 1), ''), '0') AS INT) * CASE WHEN length({_DIGITS}) > {k} THEN 1 ELSE 0 END" for k in range(1, 10)) + f") % 10 = CAST(substr({_DIGITS}, length({_DIGITS}), 1) AS INT) AS valid FROM chem",
    "packing_group": "SELECT document_id, CASE upper(trim(value)) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' ELSE upper(trim(value)) END AS packing_group FROM extractions WHERE field_name = 'packing_group'",
    "code_penalty": "SELECT document_id, value, CASE WHEN length(value) < 5 AND value = upper(value) THEN confidence * 0.6E0 ELSE confidence END AS confidence FROM extractions WHERE field_name = 'packing_group'",
    "ghs_categories": "SELECT code, count(*) AS n FROM (SELECT EXPLODE(ALL_MATCHES(value, 'H[234]')) AS code FROM extractions WHERE field_name = 'h_statements') x GROUP BY code",
    "incompat_tokens": "SELECT document_id, token FROM (SELECT document_id, trim(REPLACE_ALL(t, '[(][^)]*[)]', '')) AS token FROM (SELECT document_id, EXPLODE(SPLIT(value, ',')) AS t FROM extractions WHERE field_name = 'incompatibilities' AND value <> 'not applicable') s) x WHERE length(token) BETWEEN 4 AND 99",
    "chunk_fixed": "SELECT doc_id, k AS chunk_index, substr(text, k * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, EXPLODE(RANGE_TO(CAST(floor((length(text) - 1) / 800) AS INT))) AS k FROM documents WHERE length(text) > 0) x",
    "lang_keywords": "SELECT doc_id, CASE WHEN de >= en AND de >= fr AND de >= es THEN 'de' WHEN en >= fr AND en >= es THEN 'en' WHEN fr >= es THEN 'fr' ELSE 'es' END AS lang FROM (SELECT doc_id, CAST(text LIKE '% der %' AS INT) + CAST(text LIKE '% und %' AS INT) AS de, CAST(text LIKE '% the %' AS INT) + CAST(text LIKE '% and %' AS INT) AS en, CAST(text LIKE '% le %' AS INT) + CAST(text LIKE '% et %' AS INT) AS fr, CAST(text LIKE '% el %' AS INT) + CAST(text LIKE '% que %' AS INT) AS es FROM documents) x",
    "vendor_profile": "SELECT doc_id, CASE WHEN substr(text, 1, 3000) LIKE '%License%' THEN 'Open' WHEN substr(text, 1, 3000) LIKE '%#%' THEN 'Marked' ELSE 'Generic' END AS profile FROM documents",
    "chem_identifier": "SELECT document_id, coalesce(CASE WHEN cas_number NOT IN ('NOT_FOUND', 'N/A') THEN cas_number END, CASE WHEN length(product_name) > 5 THEN product_name END, un_number) AS identifier FROM wide",
    "needs_enrich": "SELECT document_id, is_dangerous OR completeness < 0.8 AS needs FROM wide",
    "enrichment": "SELECT w.document_id, CASE WHEN h.cas IS NULL THEN 'missing' WHEN h.name = w.product_name THEN 'ok' ELSE 'mismatch' END AS outcome FROM wide w LEFT JOIN hazards h ON h.cas = w.cas_number WHERE w.avg_confidence < 0.8",
    "missing_codes": """SELECT w.document_id, t.field_name, t.code FROM wide w JOIN hazards h ON h.cas = w.cas_number JOIN (VALUES ('flammable', 'h_statements', 'H225'), ('toxic', 'h_statements', 'H300'), ('corrosive', 'h_statements', 'H314'), ('flammable', 'p_statements', 'P210'), ('toxic', 'p_statements', 'P264'), ('corrosive', 'p_statements', 'P280')) AS t(flag, field_name, code)
        ON t.flag = 'flammable' AND h.flammable OR t.flag = 'toxic' AND h.toxic OR t.flag = 'corrosive' AND h.corrosive
        EXCEPT SELECT document_id, field_name, code FROM (SELECT document_id, 'h_statements' AS field_name, EXPLODE(ALL_MATCHES(h_statements, 'H[0-9][0-9][0-9]')) AS code FROM wide
        UNION ALL SELECT document_id, 'p_statements' AS field_name, EXPLODE(ALL_MATCHES(p_statements, 'P[0-9][0-9][0-9]')) AS code FROM wide) x""",
    "badges": "SELECT document_id, CASE WHEN is_dangerous THEN 'danger' WHEN completeness < 0.7 THEN 'check' ELSE 'ok' END AS badge, concat(CAST(CAST(round(completeness * 100) AS INT) AS STRING), '%') AS percent FROM wide",
    "clean_name": """SELECT document_id, name FROM (SELECT document_id, trim(REPLACE_ALL(trim(REPLACE_ALL(value, '[ \t\r\n]+', ' ')), '(?i)codigo do produto:?.*$', '')) AS name FROM extractions WHERE field_name = 'product_name' AND length(value) >= 3) x
        WHERE length(name) >= 3 AND NOT MATCHES(name, '^[0-9]+$')""",
    "page_fields": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages",
    "few_shot_prompt": "SELECT conv_id, turn, concat_ws(': ', role, text) AS line FROM conversations",
    "concentration": "SELECT document_id, cas_number, line_no, round(least(concentration_min, concentration_max), 6) AS low, round(greatest(concentration_min, concentration_max), 6) AS high FROM ingredients",
    # text nodes of a page, one a line; entities stay as they are
    "html_to_text": "SELECT page_id, REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ''), '<[^>]*>', chr(10)), '[ \t\r\n]*\n[ \t\r\n]*', chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '') AS text FROM pages",
    "composition": """SELECT document_id, line_no, l_orderkey, regexp_extract(line, '[0-9]{2,7}-[0-9]{2}-[0-9]', 0) AS cas, regexp_extract(line, '([0-9]+) ?%', 1) AS percent, trim(REPLACE_ALL(line, '[0-9]{2,7}-[0-9]{2}-[0-9]|[0-9]+ ?%|[;,]', '')) AS name FROM (
        SELECT document_id, line_no, l_orderkey, concat(chemical_name, '; ', cas_number, ', ', CAST(CAST(floor(concentration_max + 0.01E0) AS INT) AS STRING), ' %') AS line FROM ingredients) x""",
    "translation_meta": "SELECT doc_id, length(text) >= 3 AND lang <> 'en' AS translated, lang AS source_lang, CASE WHEN length(text) >= 3 AND lang <> 'en' THEN substr(text, 1, 500) END AS original FROM documents",
}
