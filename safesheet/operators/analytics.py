"""Statistics, quality reports and tiers."""

FOUND = "value IS NOT NULL AND value NOT IN ('', 'NOT_FOUND', 'N/A', 'ERROR')"
HELPFUL = "sum(CASE WHEN rating = 'positive' THEN 1 ELSE 0 END)"

QUERIES = {
    "db_statistics": """SELECT count(*) AS n_documents, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS n_success, CAST(sum(CASE WHEN is_dangerous THEN 1 ELSE 0 END) AS BIGINT) AS n_dangerous,
        round(avg(completeness_score), 6) AS completeness, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS n_bytes, CAST(max(processed_at) AS STRING) AS last_processed FROM sds_documents""",
    "harvest_stats": "SELECT count(*) AS total, CAST(sum(CASE WHEN status = 'downloaded' THEN 1 ELSE 0 END) AS BIGINT) AS downloaded, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM harvest",
    "harvest_by_source": "SELECT source, count(*) AS total, CAST(sum(CASE WHEN status = 'downloaded' THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM harvest GROUP BY source ORDER BY total DESC, source LIMIT 5",
    "hazard_distribution": "SELECT coalesce(nullif(hazard_class, ''), 'unknown') AS hazard_class, count(*) AS n FROM wide GROUP BY 1",
    "matrix_stats": "SELECT count(*) AS n, round(avg(completeness), 6) AS completeness, round(avg(avg_confidence), 6) AS confidence, CAST(sum(CASE WHEN is_dangerous THEN 1 ELSE 0 END) AS BIGINT) AS dangerous FROM wide",
    "incompat_pair_count": "SELECT count(DISTINCT concat(least(product_name, token), '|', greatest(product_name, token))) AS n FROM (SELECT product_name, trim(t) AS token FROM (SELECT product_name, EXPLODE(SPLIT(incompatibilities, ',')) AS t FROM wide) w) x WHERE token <> ''",
    "processing_summary": "SELECT status, count(*) AS n, round(avg(processing_seconds), 6) AS seconds FROM sds_documents GROUP BY status",
    "query_perf": "SELECT count(*) AS n, round(avg(total_time) * 1000, 2) AS avg_ms, round(min(total_time) * 1000, 2) AS min_ms, round(max(total_time) * 1000, 2) AS max_ms, CAST(sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM query_logs WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'",
    "feedback_summary": f"SELECT count(*) AS total_feedback, CAST({HELPFUL} AS BIGINT) AS positive, round(100.0E0 * {HELPFUL} / greatest(count(*), 1), 4) AS percent FROM feedback",
    "slow_queries": "SELECT q.id, q.total_time, q.result_count FROM query_logs q CROSS JOIN (SELECT QUANTILES(total_time) AS p FROM query_logs) t WHERE q.total_time > t.p OR q.result_count = 0 ORDER BY q.total_time DESC, q.id LIMIT 20",
    "query_metrics_hourly": "SELECT HOUR_OF(ts) AS hour, count(*) AS n, round(avg(total_time), 6) AS avg_time, round(max(total_time), 6) AS max_time FROM query_logs GROUP BY 1",
    "retrain_opportunities": """SELECT 'few_chunks' AS reason, count(*) AS n FROM rag_documents WHERE chunk_count < 2 UNION ALL SELECT 'duplicates', count(*) FROM (SELECT content_hash FROM rag_documents GROUP BY content_hash HAVING count(*) > 1) d
        UNION ALL SELECT 'old', count(*) FROM rag_documents WHERE indexed_at < DATE '2024-10-01' - INTERVAL '6' MONTH UNION ALL SELECT 'recent', count(*) FROM rag_documents WHERE indexed_at >= DATE '2024-10-01' - INTERVAL '7' DAY""",
    "retrain_history": "SELECT id, CAST(indexed_at AS STRING) AS indexed_at, chunk_count FROM rag_documents ORDER BY rag_documents.indexed_at DESC, id LIMIT 10",
    "perf_tier": "SELECT CASE WHEN avg_ms < 500 THEN 'excellent' WHEN avg_ms < 2000 THEN 'good' WHEN avg_ms < 5000 THEN 'fair' ELSE 'poor' END AS tier, user_id FROM (SELECT user_id, avg(total_time) * 1000 AS avg_ms FROM query_logs GROUP BY user_id) x",
    "feedback_tier": f"SELECT day, CASE WHEN percent >= 80 THEN 'excellent' WHEN percent >= 60 THEN 'good' WHEN percent >= 40 THEN 'fair' ELSE 'poor' END AS tier FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, 100.0E0 * {HELPFUL} / count(*) AS percent FROM feedback GROUP BY 1) x",
    "problem_queries": "SELECT id, CASE WHEN result_count = 0 THEN 'no results' WHEN total_time > 5 THEN 'slow' ELSE 'other' END AS problem FROM query_logs WHERE result_count = 0 OR total_time > 2",
    "kb_breakdown": "SELECT source_type, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS chunks, round(avg(chunk_count), 4) AS avg_chunks FROM rag_documents GROUP BY source_type",
    "recommendations": "SELECT 'improve retrieval' AS advice FROM (SELECT avg(CASE WHEN result_count = 0 THEN 1.0E0 ELSE 0.0E0 END) AS share FROM query_logs) x WHERE share > 0.1 UNION ALL SELECT 'add documents' FROM (SELECT count(*) AS n FROM rag_documents) y WHERE n < 5000",
    "graph_quality": "SELECT count(*) AS n_edges, count(DISTINCT cas_a) AS n_a, count(DISTINCT cas_b) AS n_b, (SELECT count(*) FROM (SELECT cas_a AS c FROM rules UNION SELECT cas_b FROM rules) u) AS n_chemicals FROM rules",
    "rule_distribution": "SELECT rule, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM rules GROUP BY rule",
    "hazard_flag_distribution": "SELECT flag, count(*) AS n FROM (SELECT 'flammable' AS flag FROM hazards WHERE flammable UNION ALL SELECT 'toxic' FROM hazards WHERE toxic UNION ALL SELECT 'corrosive' FROM hazards WHERE corrosive) x GROUP BY flag",
    "field_coverage": f"SELECT field_name, count(*) AS n, CAST(sum(CASE WHEN {FOUND} THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM extractions GROUP BY field_name",
    "extended_coverage": f"SELECT f.field_name, count(e.value) AS filled FROM (VALUES ('un_number'), ('flash_point'), ('boiling_point'), ('packing_group')) AS f(field_name) LEFT JOIN (SELECT field_name, value FROM extractions WHERE {FOUND}) e ON e.field_name = f.field_name GROUP BY f.field_name",
    "hazard_summary": "SELECT count(DISTINCT cas) AS chemicals, CAST(sum(CAST(flammable AS INT) + CAST(toxic AS INT) + CAST(corrosive AS INT)) AS BIGINT) AS hazards FROM hazards",
    "top_manufacturers": "SELECT manufacturer, count(DISTINCT cas) AS n FROM cas_maker GROUP BY manufacturer ORDER BY n DESC, manufacturer LIMIT 20",
    "llm_stats": "SELECT count(*) AS n, round(avg(CASE WHEN success THEN 1.0E0 ELSE 0.0E0 END), 4) AS success_rate, round(avg(latency), 4) AS mean_latency, round(MEDIAN_OF(latency), 4) AS median_latency, round(avg(CASE WHEN success THEN confidence END), 4) AS confidence, round(avg(CASE WHEN cache_hit THEN 1.0E0 ELSE 0.0E0 END), 4) AS hit_rate FROM llm_calls",
    "llm_stats_by_field": "SELECT field_name, count(*) AS n, round(avg(CASE WHEN success THEN 1.0E0 ELSE 0.0E0 END), 3) AS success_rate, round(avg(latency), 3) AS mean_latency FROM llm_calls GROUP BY field_name",
    "llm_stats_by_model": "SELECT model, count(*) AS n, round(avg(CASE WHEN success THEN 1.0E0 ELSE 0.0E0 END), 3) AS success_rate, round(min(latency), 3) AS min_latency, round(max(latency), 3) AS max_latency FROM llm_calls GROUP BY model",
    "completeness": f"SELECT document_id, round(CAST(sum(CASE WHEN {FOUND} AND field_name IN ('product_name', 'cas_number', 'hazard_class', 'un_number') THEN 1 ELSE 0 END) AS DOUBLE) / 4, 4) AS completeness FROM extractions GROUP BY document_id",
    "overall_confidence": f"SELECT document_id, round(avg(CASE WHEN {FOUND} THEN confidence END), 6) AS confidence FROM extractions GROUP BY document_id",
    "document_confidence": """SELECT document_id, round(mean, 6) AS mean, passes, CASE WHEN mean >= 0.9 AND critical THEN 'excellent' WHEN mean >= 0.8 THEN 'good' WHEN mean >= 0.7 THEN 'acceptable' WHEN mean >= 0.6 THEN 'poor' ELSE 'unreliable' END AS tier FROM (
        SELECT document_id, avg(confidence) AS mean, CAST(sum(CASE WHEN confidence >= 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS passes, coalesce(bool_and(CASE WHEN field_name IN ('product_name', 'cas_number') THEN confidence >= 0.75 END), TRUE) AS critical FROM extractions GROUP BY document_id) x""",
    "batch_summary": "SELECT count(*) AS total, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS ok, round(100.0E0 * sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) / count(*), 4) AS percent FROM sds_documents",
    "phase1_totals": "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM rules UNION ALL SELECT count(*) FROM hazards UNION ALL SELECT count(*) FROM cas_maker) x",
    "folder_stats": "SELECT lang, CASE WHEN n_chars < 50 THEN 'incomplete' WHEN n_chars > 20000 THEN 'too large' ELSE 'taken' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2",
    "ml_training_set": "SELECT document_id, field_name, confidence, validation_status AS tier FROM extractions WHERE validation_status <> 'invalid' AND value IS NOT NULL",
    "ml_tier_distribution": "SELECT validation_status AS tier, count(*) AS n FROM extractions GROUP BY validation_status",
    "ml_fallback": "SELECT document_id, field_name, round(least(1.0E0, 0.5E0 + 0.2E0 * confidence + 0.1E0 * CASE WHEN validation_status = 'valid' THEN 1 ELSE 0 END), 6) AS score FROM extractions",
    "llm_fallback": "SELECT id, field_name, CASE WHEN success AND confidence >= 0.6 THEN 'primary' ELSE 'fallback' END AS used FROM llm_calls",
    "incremental_docs": "SELECT id, CAST(indexed_at AS STRING) AS indexed_at FROM rag_documents WHERE indexed_at > DATE '2024-08-01' ORDER BY rag_documents.indexed_at DESC, id LIMIT 100",
    "should_retrain": "SELECT max(indexed_at) < DATE '2024-12-01' - INTERVAL '1' DAY AS due FROM rag_documents",
    "extraction_list": """SELECT id, filename FROM (SELECT id, filename, row_number() OVER (PARTITION BY filename, file_size_bytes ORDER BY id) AS j FROM (SELECT id, filename, file_size_bytes, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS k FROM sds_documents) x WHERE k = 1) y WHERE j = 1""",
    "dedupe_plan": "SELECT d.id, CASE WHEN h.first_id < d.id THEN 'hash' WHEN d.status = 'success' THEN 'processed' ELSE 'new' END AS skip_reason FROM sds_documents d JOIN (SELECT file_hash, min(id) AS first_id FROM sds_documents GROUP BY file_hash) h ON h.file_hash = d.file_hash",
    "ingest_blobs": "SELECT content_hash, min(id) AS id, max(chunk_count) AS chunks FROM rag_documents WHERE length(trim(text)) > 40 GROUP BY content_hash",
    "ingest_snapshot": """SELECT CASE WHEN html IS NULL OR trim(html) = '' THEN 'blank' WHEN NOT MATCHES(url, '^https?://') THEN 'invalid' ELSE 'processed' END AS outcome, count(*) AS n, CAST(sum(ceil(coalesce(length(html), 0) / 800.0E0)) AS BIGINT) AS chunks FROM pages GROUP BY 1""",
}
