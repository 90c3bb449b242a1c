"""Graph operators: edges and nodes, bounded walks as unrolled joins, degrees, neighbourhoods, shared and similar chemicals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.domain import partners_made

START = "(SELECT min(cas_a) AS cas FROM rules WHERE rule = 'I')"

QUERIES = {
    "graph_edges": "SELECT src, dst, 'incompatible_with' AS kind FROM both_ways UNION ALL SELECT cas, manufacturer, 'manufactured_by' FROM (SELECT DISTINCT cas, manufacturer FROM cas_maker) m",
    "graph_nodes": "SELECT src AS id, 'chemical' AS kind FROM both_ways UNION SELECT cas, 'chemical' FROM hazards UNION SELECT manufacturer, 'manufacturer' FROM cas_maker",
    "by_hazard_flag": "SELECT cas FROM hazards WHERE JSON_STRING(hazard_flags, '$.flammable') = 'true'",
    "similar_ghs": "SELECT c.cas, c.hazard_class, s.n - 1 AS n_similar FROM (SELECT DISTINCT cas, hazard_class FROM chem) c JOIN (SELECT hazard_class, count(DISTINCT cas) AS n FROM chem GROUP BY hazard_class) s ON s.hazard_class = c.hazard_class WHERE s.n > 1",
    "hazard_jaccard": """WITH profiled AS (SELECT cas, concat(CASE WHEN flammable THEN 'f' ELSE '' END, CASE WHEN toxic THEN 't' ELSE '' END, CASE WHEN corrosive THEN 'c' ELSE '' END) AS profile FROM hazards),
        held AS (SELECT profile, count(*) AS n FROM profiled WHERE profile <> '' GROUP BY profile), flagged AS (SELECT h.profile, EXPLODE(ALL_MATCHES(h.profile, '[ftc]')) AS flag FROM held h),
        near AS (SELECT a.profile AS x, b.profile AS y, count(*) AS common FROM flagged a JOIN flagged b ON a.flag = b.flag GROUP BY a.profile, b.profile)
        SELECT p.cas, near.y AS partner_profile, round(CAST(near.common AS DOUBLE) / (length(near.x) + length(near.y) - near.common), 6) AS score, h.n - CASE WHEN near.x = near.y THEN 1 ELSE 0 END AS n_partners
        FROM profiled p JOIN near ON near.x = p.profile JOIN held h ON h.profile = near.y WHERE near.common * 2 > length(near.x) + length(near.y) - near.common AND h.n > CASE WHEN near.x = near.y THEN 1 ELSE 0 END""",
    "subgraph": "SELECT r.cas_a, r.cas_b, r.rule FROM rules r WHERE r.cas_a IN (SELECT cas FROM hazards WHERE toxic) AND r.cas_b IN (SELECT cas FROM hazards WHERE toxic)",
    "graph_stats": "SELECT n AS nodes, m AS edges, round(2.0E0 * m / n, 6) AS avg_degree, round(m / (n * (n - 1.0E0)), 8) AS density FROM (SELECT count(DISTINCT src) AS n, count(*) AS m FROM both_ways) x",
    "degree_top": "SELECT src AS cas, count(*) AS degree FROM both_ways GROUP BY src ORDER BY degree DESC, cas LIMIT 10",
    "similar_scored": """WITH profiled AS (SELECT cas, concat(CAST(flammable AS STRING), CAST(toxic AS STRING), CAST(corrosive AS STRING)) AS profile, CAST(flammable AS INT) + CAST(toxic AS INT) + CAST(corrosive AS INT) AS n FROM hazards),
        given AS (SELECT cas, profile FROM profiled WHERE cas = (SELECT min(cas) FROM profiled WHERE n > 0))
        SELECT p.cas, round(least(0.95E0, 0.7E0 + 0.05E0 * p.n), 6) AS score FROM profiled p JOIN given g ON g.profile = p.profile AND g.cas <> p.cas WHERE least(0.95E0, 0.7E0 + 0.05E0 * p.n) >= 0.7E0 ORDER BY score DESC, cas""",
    "by_manufacturer": "SELECT DISTINCT cas FROM cas_maker WHERE manufacturer = 'Maker 3'",
    "family_of": "SELECT DISTINCT b.cas FROM cas_maker a JOIN cas_maker b ON a.manufacturer = b.manufacturer AND a.cas <> b.cas WHERE a.document_id = 8",
    "enriched_stats": "SELECT concat(CAST(sum(CASE WHEN h.cas IS NOT NULL THEN 1 ELSE 0 END) AS STRING), '/', CAST(count(*) AS STRING)) AS with_hazards FROM chem c LEFT JOIN hazards h ON h.cas = c.cas",
    "chemical_clusters": "SELECT src AS cas, count(DISTINCT dst) AS n, SORTED_SET(dst) AS partners FROM both_ways GROUP BY src HAVING count(DISTINCT dst) >= 5",
    "shared_incompat": """WITH given AS (SELECT src FROM both_ways GROUP BY src ORDER BY count(*) DESC, src LIMIT 2)
        SELECT min(src) AS cas_1, max(src) AS cas_2, dst AS shared FROM (SELECT DISTINCT src, dst FROM both_ways WHERE src IN (SELECT src FROM given)) x GROUP BY dst HAVING count(*) = 2""",
    "hazardous_clusters": "SELECT r.cas_a, r.cas_b, a.idlh AS idlh_a, b.idlh AS idlh_b FROM rules r JOIN hazards a ON a.cas = r.cas_a AND a.idlh >= 100 JOIN hazards b ON b.cas = r.cas_b AND b.idlh >= 100",
    "ghs_path": "SELECT DISTINCT a.hazard_class AS class_a, b.hazard_class AS class_b, r.rule FROM rules r JOIN wide a ON a.cas_number = r.cas_a JOIN wide b ON b.cas_number = r.cas_b WHERE a.hazard_class <> '' AND b.hazard_class <> ''",
    "neighborhood": f"SELECT w.document_id, w.product_name, w.cas_number FROM wide w WHERE w.cas_number IN (SELECT e.dst FROM both_ways e JOIN {START} s ON e.src = s.cas UNION SELECT cas FROM {START} t)",
}


def chemical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the query's SQL, by lists of parts in place of the rules."""
    return partners_made(spark, sf_dir).filter("n >= 5").select(F.col("src").alias("cas"), "n", "partners")


#: Queries of which the oracle alone runs the SQL.
FRAMES = {"chemical_clusters": chemical_clusters}
