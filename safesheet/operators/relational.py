"""Scans, filters, joins, aggregations, sorts, set operations and mutations (as latest-wins views) over the domain tables."""

FOUND = "value IS NOT NULL AND value NOT IN ('', 'NOT_FOUND', 'N/A', 'ERROR')"

QUERIES = {
    # scans, filters and sorted lists
    "doc_lookup": "SELECT id, filename, file_hash, status FROM sds_documents WHERE file_hash = md5('x') OR id = 42",
    "table_counts": "SELECT 'documents' AS name, count(*) AS n FROM sds_documents UNION ALL SELECT 'extractions', count(*) FROM extractions UNION ALL SELECT 'rules', count(*) FROM rules UNION ALL SELECT 'hazards', count(*) FROM hazards",
    "doc_fields": "SELECT document_id, field_name, value, confidence, validation_status FROM extractions WHERE document_id = 7",
    "dangerous_docs": "SELECT document_id, product_name, hazard_class FROM wide WHERE is_dangerous",
    "search_rules": "SELECT cas_a, cas_b, rule, source FROM rules WHERE rule = 'I' AND (cas_a LIKE '6%' OR cas_b LIKE '6%') ORDER BY cas_a, cas_b LIMIT 50",
    "search_hazards": "SELECT cas, name, idlh, pel, env_risk FROM hazards WHERE env_risk AND idlh <= 100 ORDER BY cas LIMIT 50",
    "rule_lookup": "SELECT r.cas_a, r.cas_b, r.rule FROM rules r JOIN (SELECT min(cas_a) AS a, min(cas_b) AS b FROM rules WHERE rule = 'R') x ON r.cas_a = least(x.a, x.b) AND r.cas_b = greatest(x.a, x.b)",
    "hazard_lookup": "SELECT cas, JSON_STRING(hazard_flags, '$.flammable') AS flammable, JSON_STRING(hazard_flags, '$.toxic') AS toxic, idlh FROM hazards WHERE cas LIKE '1%'",
    "rag_documents_list": "SELECT id, source_type, source_url, content_hash, chunk_count, CAST(indexed_at AS STRING) AS indexed_at FROM rag_documents ORDER BY rag_documents.indexed_at DESC NULLS LAST, id",
    "manufacturers": f"SELECT DISTINCT trim(value) AS name FROM extractions WHERE field_name = 'manufacturer' AND {FOUND} ORDER BY name",
    "recent_decisions": "SELECT id, filename, CAST(processed_at AS STRING) AS processed_at FROM sds_documents WHERE processed_at > DATE '2024-07-01' - INTERVAL '7' DAY",
    "hash_exists": "SELECT id FROM sds_documents WHERE file_hash IN (SELECT file_hash FROM sds_documents WHERE status = 'failed')",
    "ingredients_ordered": "SELECT document_id, cas_number, line_no, round(concentration_max, 6) AS concentration_max, confidence FROM ingredients ORDER BY document_id, confidence DESC NULLS LAST, cas_number, line_no",
    "packet_files": "SELECT d.filename, c.cas FROM sds_documents d JOIN chem c ON c.document_id = d.id WHERE replace(c.cas, '-', '') LIKE '12%'",
    "danger_report": "SELECT document_id AS codigo, product_name AS produto, cas_number AS numero_cas, hazard_class AS classe_de_perigo, completeness AS completude FROM wide WHERE is_dangerous ORDER BY codigo",
    "hazard_matrix": "SELECT document_id, coalesce(nullif(product_name, ''), 'Unknown') AS product, coalesce(nullif(hazard_class, ''), 'Unknown') AS hazard, coalesce(un_number, '') AS un, coalesce(packing_group, '') AS packing, coalesce(avg_confidence, 0.0E0) AS confidence FROM wide",
    "row_to_text": "SELECT n_nationkey, concat_ws(' | ', CASE WHEN n_name <> '' THEN concat('name: ', n_name) END, CASE WHEN n_regionkey IS NOT NULL THEN concat('region: ', CAST(n_regionkey AS STRING)) END) AS text FROM nation",
    "backup_rules": "SELECT cas_a, cas_b, rule, source FROM rules ORDER BY cas_a, cas_b",
    "backup_hazards": "SELECT cas, hazard_flags, idlh, pel, env_risk FROM hazards ORDER BY cas",
    "backup_documents": "SELECT id, source_type, content_hash, chunk_count FROM rag_documents ORDER BY id",
    "collection_stats": "SELECT source_type, count(*) AS n_documents, count(DISTINCT content_hash) AS n_contents, CAST(sum(chunk_count) AS BIGINT) AS n_chunks FROM rag_documents GROUP BY source_type",
    "regex_validation": """SELECT field_name, n, matched, round(100.0E0 * matched / n, 4) AS percent, CASE WHEN matched * 10 >= n * 9 THEN 'good' WHEN matched * 10 >= n * 7 THEN 'fair' ELSE 'poor' END AS status FROM (
        SELECT e.field_name, count(*) AS n, CAST(sum(CASE WHEN MATCHES(e.value, p.pattern) THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM extractions e
        JOIN (VALUES ('cas_number', '^[0-9]{2,7}-[0-9]{2}-[0-9]$'), ('un_number', '^[0-9]{4}$'), ('packing_group', '^I{1,3}$'), ('hazard_class', '^[1-9]([.][1-6])?$')) AS p(field_name, pattern) ON p.field_name = e.field_name GROUP BY e.field_name) x""",
    # the benchmark set of ten statements
    "bench_q01": "SELECT id, filename, status FROM sds_documents WHERE status = 'success'",
    "bench_q02": "SELECT id, filename FROM sds_documents WHERE is_dangerous",
    "bench_q03": "SELECT document_id, value FROM extractions WHERE field_name = 'product_name' AND value LIKE '%a%'",
    "bench_q04": "SELECT d.filename, e.field_name, e.value FROM sds_documents d JOIN extractions e ON e.document_id = d.id WHERE d.status = 'success' AND e.field_name = 'cas_number'",
    "bench_q05": "SELECT document_id, field_name, validation_status FROM extractions WHERE validation_status = 'invalid'",
    "bench_q06": "SELECT document_id, value FROM extractions WHERE field_name = 'cas_number' AND value = '51-11-6'",
    "bench_q07": "SELECT cas_a, cas_b, rule FROM rules WHERE rule = 'I'",
    "bench_q08": "SELECT cas, idlh FROM hazards WHERE idlh < 50",
    "bench_q09": "SELECT cas_a, cas_b, rule FROM rules WHERE cas_a = '60-20-8' OR cas_b = '60-20-8'",
    "bench_q10": "SELECT count(*) AS n FROM sds_documents WHERE processed_at >= DATE '2024-03-01' - INTERVAL '7' DAY",
    # joins
    "processed_paths": "SELECT file_path FROM sds_documents d WHERE status IN ('success', 'partial') AND EXISTS (SELECT 1 FROM extractions e WHERE e.document_id = d.id)",
    "already_processed": "SELECT d.status, count(e.document_id) AS n_fields, count(DISTINCT d.id) AS n_documents FROM sds_documents d LEFT JOIN extractions e ON e.document_id = d.id GROUP BY d.status",
    "processed_meta": "SELECT d.filename, d.file_size_bytes, count(*) AS n FROM sds_documents d JOIN extractions e ON e.document_id = d.id WHERE d.status = 'success' GROUP BY d.filename, d.file_size_bytes HAVING count(e.value) > 0",
    "processed_ts": "SELECT d.filename, max(CAST(d.processed_at AS STRING)) AS processed_at FROM sds_documents d JOIN extractions e ON e.document_id = d.id GROUP BY d.filename HAVING count(*) > 0",
    "cas_manufacturer": "SELECT DISTINCT cas, manufacturer FROM cas_maker",
    "cas_ghs": f"SELECT c.cas_number, c.hazard_class FROM wide c WHERE c.cas_number NOT IN ('NOT_FOUND', 'N/A') AND c.hazard_class <> ''",
    "cas_h": "SELECT DISTINCT cas_number, EXPLODE(ALL_MATCHES(h_statements, 'H[234][0-9][0-9]')) AS h_code FROM wide WHERE cas_number NOT IN ('NOT_FOUND', 'N/A')",
    "cas_p": "SELECT DISTINCT cas_number, EXPLODE(ALL_MATCHES(p_statements, 'P[1-5][0-9][0-9]')) AS p_code FROM wide WHERE cas_number NOT IN ('NOT_FOUND', 'N/A')",
    "cas_inventory": f"SELECT value AS cas FROM extractions WHERE field_name = 'cas_number' AND {FOUND} UNION SELECT cas_number FROM ingredients WHERE cas_number IS NOT NULL ORDER BY cas",
    "identified_chemicals": f"""SELECT cas, max_by(name, ord) AS best_name, max(conf) AS best_confidence, count(DISTINCT document_id) AS n_documents FROM (
        SELECT e.value AS cas, p.value AS name, e.confidence AS conf, e.document_id, e.confidence * 1000000 - e.document_id / 1000000.0E0 AS ord FROM extractions e LEFT JOIN (SELECT document_id, value FROM extractions WHERE field_name = 'product_name') p ON p.document_id = e.document_id
        WHERE e.field_name = 'cas_number' AND e.value IS NOT NULL AND e.value NOT IN ('', 'NOT_FOUND', 'N/A', 'ERROR') UNION ALL SELECT cas_number, chemical_name, confidence, document_id, confidence * 1000000 - document_id / 1000000.0E0 FROM ingredients) x GROUP BY cas""",
    "cas_hazard": "SELECT c.value AS cas, h.value AS hazard FROM extractions c LEFT JOIN extractions h ON h.document_id = c.document_id AND h.field_name = 'hazard_class' WHERE c.field_name = 'cas_number' AND c.value NOT IN ('NOT_FOUND', 'N/A') AND h.value IS NOT NULL",
    "hazard_rule_pairs": """WITH chemical AS (SELECT DISTINCT cas, hazard_class FROM chem), held AS (SELECT hazard_class, count(*) AS n FROM chemical GROUP BY hazard_class),
        given AS (SELECT x, y, priority FROM (VALUES ('1', '5', 1), ('3', '5', 2), ('8', '4', 3), ('3', '1', 4), ('6', '8', 5)) AS r(x, y, priority)), pair AS (SELECT x, y, min(priority) AS priority FROM (SELECT x, y, priority FROM given UNION ALL SELECT y, x, priority FROM given) u GROUP BY x, y)
        SELECT c.cas, c.hazard_class, p.y AS partner_class, p.priority, h.n - CASE WHEN p.x = p.y THEN 1 ELSE 0 END AS n_partners FROM chemical c JOIN pair p ON p.x = c.hazard_class JOIN held h ON h.hazard_class = p.y""",
    "rules_with_names": "SELECT r.cas_a, a.name AS name_a, r.cas_b, b.name AS name_b, r.rule FROM rules r LEFT JOIN hazards a ON a.cas = r.cas_a LEFT JOIN hazards b ON b.cas = r.cas_b",
    "rules_for_cas": "SELECT r.cas_a, r.cas_b, r.rule FROM rules r JOIN (SELECT min(cas_a) AS cas FROM rules) x ON r.cas_a = x.cas UNION SELECT r.cas_a, r.cas_b, r.rule FROM rules r JOIN (SELECT min(cas_a) AS cas FROM rules) x ON r.cas_b = x.cas",
    "mixture_pairs": "SELECT DISTINCT a.document_id, r.cas_a, r.cas_b, r.rule FROM ingredients a JOIN ingredients b ON a.document_id = b.document_id AND a.cas_number < b.cas_number JOIN rules r ON r.cas_a = a.cas_number AND r.cas_b = b.cas_number",
    "product_families": """WITH member AS (SELECT DISTINCT cas, manufacturer FROM cas_maker)
        SELECT m.manufacturer, m.cas, f.n - 1 AS n_partners FROM member m JOIN (SELECT manufacturer, count(*) AS n FROM member GROUP BY manufacturer HAVING count(*) > 1) f ON f.manufacturer = m.manufacturer""",
    "profile_pairs": """WITH profiled AS (SELECT cas, concat(CAST(flammable AS STRING), CAST(toxic AS STRING), CAST(corrosive AS STRING)) AS profile, CAST(flammable AS INT) + CAST(toxic AS INT) + CAST(corrosive AS INT) AS n FROM hazards)
        SELECT p.cas, p.profile, least(0.95E0, 0.7E0 + 0.05E0 * p.n) AS score, s.members - 1 AS n_partners FROM profiled p JOIN (SELECT profile, count(*) AS members FROM profiled GROUP BY profile HAVING count(*) > 1) s ON s.profile = p.profile WHERE p.n > 0""",
    "un_class_check": """SELECT u.document_id, u.value AS un_number, t.expected, h.value AS found, CASE WHEN t.expected <> h.value THEN round(h.confidence * 0.7E0, 6) ELSE h.confidence END AS confidence FROM extractions u JOIN (VALUES ('1005', '2'), ('1017', '2'), ('1090', '3'), ('1170', '3'), ('1203', '3'), ('1789', '8'), ('1824', '8'), ('1830', '8'), ('2014', '5')) AS t(un, expected) ON t.un = u.value
        JOIN extractions h ON h.document_id = u.document_id AND h.field_name = 'hazard_class' WHERE u.field_name = 'un_number'""",
    "mixture_hazards": """SELECT i.document_id, t.code, min(i.cas_number) AS cas, round(max(i.concentration_max), 6) AS concentration FROM ingredients i JOIN hazards h ON replace(h.cas, '-', '') = replace(i.cas_number, '-', '') JOIN (VALUES ('H225', 10.0E0), ('H300', 0.1E0), ('H315', 10.0E0)) AS t(code, least_conc)
        ON i.concentration_max >= t.least_conc AND (t.code = 'H225' AND h.flammable OR t.code = 'H300' AND h.toxic OR t.code = 'H315' AND h.corrosive) GROUP BY i.document_id, t.code""",
    "external_validation": """SELECT c.document_id, c.product_name, CASE WHEN n.name IS NOT NULL AND c.cas = h.cas THEN 0.15E0 WHEN h.cas IS NOT NULL THEN 0.08E0 WHEN n.name IS NOT NULL THEN 0.1E0 ELSE 0.0E0 END AS boost FROM chem c LEFT JOIN hazards h ON h.cas = c.cas LEFT JOIN (SELECT DISTINCT name FROM hazards WHERE env_risk) n ON n.name = c.product_name""",
    # the matrix
    "wide_results": "SELECT document_id, filename, status, product_name, cas_number, hazard_class, manufacturer, un_number, packing_group, h_statements, p_statements, incompatibilities, completeness, avg_confidence FROM wide ORDER BY processed_at DESC NULLS LAST, document_id LIMIT 500",
    # mutations, as the tables that they leave
    "register_new_docs": "SELECT c.id, c.file_hash FROM sds_documents c WHERE NOT EXISTS (SELECT 1 FROM sds_documents k WHERE k.file_hash = c.file_hash AND k.id < c.id)",
    "upsert_latest": "SELECT document_id, field_name, value FROM (SELECT document_id, field_name, value, row_number() OVER (PARTITION BY document_id % 1000, field_name ORDER BY document_id DESC) AS k FROM extractions) x WHERE k = 1",
    "status_update": "SELECT d.id, coalesce(n.status, d.status) AS status, coalesce(n.score, d.completeness_score) AS completeness, n.message AS error_message FROM sds_documents d LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'success' END AS status, CASE WHEN id % 3 = 0 THEN 1.0E0 END AS score, CASE WHEN id % 5 = 0 THEN 'late' END AS message FROM sds_documents WHERE id % 4 = 0) n ON n.id = d.id",
    "hazard_upsert": "SELECT cas, idlh, pel FROM (SELECT cas, idlh, pel, row_number() OVER (PARTITION BY cas ORDER BY seq DESC) AS k FROM (SELECT cas, idlh, pel, 1 AS seq FROM hazards UNION ALL SELECT cas, idlh + 1, pel, 2 FROM hazards WHERE env_risk) u) x WHERE k = 1",
    "apply_edits": "SELECT document_id, field_name, value FROM (SELECT document_id, field_name, value, row_number() OVER (PARTITION BY document_id, field_name ORDER BY level DESC) AS k FROM (SELECT document_id, field_name, value, 0 AS level FROM extractions UNION ALL SELECT document_id, field_name, 'edited', 1 FROM extractions WHERE document_id % 90 = 0 AND field_name = 'manufacturer') u) x WHERE k = 1",
    "merge_chemicals": "SELECT cas, max_by(product_name, document_id) AS product_name, max_by(hazard_class, document_id) AS hazard_class FROM chem GROUP BY cas",
    "hazard_relationships": "SELECT DISTINCT cas_number AS cas, 'class' AS kind, hazard_class AS code FROM wide WHERE hazard_class <> '' AND cas_number NOT IN ('NOT_FOUND', 'N/A')",
}

#: Query -> its table that Spark joins by sorting. Judged by the bytes of a file's few columns, a table of all documents would be broadcast, and the driver would hold it whole.
SORTED_JOINS = {"bench_q04": "d", "processed_meta": "d", "processed_ts": "d"}
