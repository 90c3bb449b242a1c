"""Queries and oracle SQL of this package's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, importance_resampling, language_id, lexical_search, line_dedup, ngram_join, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity, url_filters
from .common import table


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removable_spans(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")[0])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filters(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_quality_rules, op3_language_id, op4_substring_dedup, op5_token_counts, op6_decontamination, op7_ngram_join, op8_url_filters, op9_line_dedup, op10_bpe, op11_lexical_search, op12_suffix_dedup, op13_importance_resampling)
    return {f.__name__: f for f in own}


#: White space of ASCII but the line end, as in line_dedup.BLANKS.
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), base AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w
), line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM w
), solid AS (
  SELECT doc_id, source, raw, trim(lower(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm FROM line WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM solid GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS text FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, text) > 1
), rep AS (
  SELECT doc_id, sum(least(8, i - coalesce(before, -8))) AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id
), host AS (
  SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY source
), often AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM solid GROUP BY source, norm) JOIN host USING (source)
  WHERE n > {quality_rules.MAX_DOCS} AND n > {quality_rules.MAX_SHARE} * host_docs
), lost AS (
  SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM solid JOIN often USING (source, norm) GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words,
  n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND coalesce(lost.n, 0) <= {quality_rules.MAX_LOST} * n_words AS kept
FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP8_SQL = """
WITH rule(verdict, h, p) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filters.RULES) + """),
rest AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), page AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM page JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM page LEFT JOIN best USING (page_id)
"""

OP9_SQL = f"""
WITH line AS (
  SELECT doc_id, source, generate_subscripts(lines, 1) AS i, unnest(lines) AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)
), norm AS (
  SELECT *, trim(raw, {_BLANKS}) AS norm FROM line
), host AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), often AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM norm WHERE norm <> '' GROUP BY source, norm) JOIN host USING (source)
  WHERE n >= {line_dedup.MIN_PAGES} AND n / pages > {line_dedup.MAX_RATIO}
), judged AS (
  SELECT norm.*, often.norm IS NOT NULL AS gone FROM norm LEFT JOIN often USING (source, norm)
), page AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE norm <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(page.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN page USING (doc_id)
"""


#: Only A-Z become small.
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents
), size AS (
  SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM size
), item AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY doc_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs
), m AS (
  SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_all) AS m FROM size, whole
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id::BIGINT AS doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {lexical_search.TOP}
"""

_LESS = suffix_dedup.WIDTH - 1

#: Bytes as pairs of hexadecimal digits; long texts in pieces, as a place in a long string is found slowly.
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (
  SELECT doc_id, base, least(500, length(h) // 2 - {_LESS} - base) AS n, substr(h, 2 * base + 1, {2 * (500 + _LESS)}) AS h
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {_LESS}, 500)) AS base FROM d WHERE length(h) >= {2 * suffix_dedup.WIDTH})
), win AS (
  SELECT doc_id, base + unnest(range(0, n)) AS p, unnest(list_transform(range(0, n), lambda i: substr(h, 2 * i + 1, {2 * suffix_dedup.WIDTH}))) AS w FROM piece
), first AS (
  SELECT w, min(doc_id) AS first FROM win GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT doc_id, p FROM win JOIN first USING (w) WHERE doc_id > first
), isle AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS isle FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {suffix_dedup.WIDTH} THEN 0 ELSE 1 END AS new FROM gone)
), span AS (
  SELECT doc_id, min(p) AS a, max(p) + {suffix_dedup.WIDTH} AS z FROM isle GROUP BY doc_id, isle
), stay AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM span
  UNION ALL
  SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, length(h) // 2) - s)), '' ORDER BY s) AS h FROM stay JOIN d USING (doc_id) GROUP BY doc_id
), total AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n FROM span GROUP BY doc_id
)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

#: CRC-32 by a table of 256 entries, made from the reflected polynomial.
OP13_SQL = f"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT b, 0, b FROM range(256) AS t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), entries AS (
  SELECT list(c ORDER BY b) AS tab FROM step WHERE k = 8
), d AS (
  SELECT doc_id, {_TERMS} AS words FROM documents
), dw AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word
), tw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({_TERMS}) AS word FROM benchmark) GROUP BY word
), hexed AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)
), coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {importance_resampling.BUCKETS} AS bucket
  FROM hexed, entries
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN coded USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS t FROM tw JOIN coded USING (word) GROUP BY bucket
), every AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s_all FROM s
), target AS (
  SELECT coalesce(sum(t), 0)::DOUBLE AS t_all FROM t
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {importance_resampling.BUCKETS}) / ((s::DOUBLE + 1) * (t_all + {importance_resampling.BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), every, target
), weight AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance_resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {importance_resampling.MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (WHERE n_features >= {importance_resampling.MIN_WORDS}) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance_resampling.MIN_WORDS} AND place <= {importance_resampling.SHARE} * able // 100 THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op8_url_filters": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL}
