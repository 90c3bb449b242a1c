"""Queries over time windows, sessions, roll-ups and classification trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rollups, trees
from ..streaming import metrics


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100).alias("total_time"), (F.col("event_id") % 7).alias("result_count"))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours that begin every two."""
    found = metrics.sliding_metrics(_logs(spark, sf_dir), "6 hours", "2 hours")
    return found.select(_text("start").alias("start"), "n", F.round("avg_time", 6).alias("avg_time"), "max_time")


SLIDING_SQL = """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(total_time), 6) AS avg_time, max(total_time) AS max_time FROM (
    SELECT CAST(to_timestamp((floor(epoch(ts) / 7200) - k) * 7200) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, value / 100 AS total_time FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events) e, range(3) AS r(k)) x GROUP BY start"""


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, parted by a day and a half."""
    found = metrics.sessions(_logs(spark, sf_dir), "36 hours")
    return found.select("user_id", _text("start").alias("start"), _text("end").alias("end"), "n", F.round("total_time", 6).alias("total_time"))


SESSION_SQL = """SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('second', max(ts) + INTERVAL 36 HOUR), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(total_time), 6) AS total_time FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, value / 100 AS total_time,
        CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 36 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM events) e) a) b GROUP BY user_id, s"""


def latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and users of each day, of the merged sketches of its hours."""
    days = rollups.merged(rollups.hourly(_logs(spark, sf_dir)), F.date_trunc("day", "hour").alias("day"))
    return rollups.read(days)


def place_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a tree for each region, whose nations and suppliers are nodes; notes between hold codes that don't count."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    info = lambda *names: F.array(*[F.struct(n.alias("Name"), F.lit('"Name": "H999"').alias("Value")) for n in names])
    code = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    leaf = t("supplier").select("s_nationkey", "s_suppkey", F.struct(info(code("H", "s_suppkey"), code("Hx", "s_suppkey"), code("GHS0", "s_nationkey")).alias("Information")).alias("node"))
    leaves = leaf.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "node"))), lambda x: x["node"]).alias("below"))
    middle = t("nation").join(leaves, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", "n_nationkey", F.struct(info(code("P", "n_nationkey"), F.col("n_name")).alias("Information"), F.col("below").alias("Node")).alias("node"))
    tops = middle.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "node"))), lambda x: x["node"]).alias("below"))
    made = tops.select(F.col("n_regionkey").alias("id"), F.to_json(F.struct(info(F.lit("H000")).alias("Information"), F.col("below").alias("Node"))).alias("tree"))
    return trees.tree_codes(made).withColumn("nth", F.col("nth").cast("long"))


TREE_SQL = """WITH s AS (SELECT n_regionkey AS id, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT id, kind, row_number() OVER (PARTITION BY id, kind ORDER BY a, b) AS nth, code FROM (
    SELECT DISTINCT n_regionkey AS id, 'hazard' AS kind, -1 AS a, -1 AS b, 'H000' AS code FROM nation UNION ALL SELECT id, 'hazard', n_nationkey, s_suppkey, concat('H', s_suppkey) FROM s
    UNION ALL SELECT id, 'pictogram', n_nationkey, s_suppkey, concat('GHS0', n_nationkey) FROM s UNION ALL SELECT n_regionkey, 'precaution', n_nationkey, 0, concat('P', n_nationkey) FROM nation) x"""


QUERIES = {"sliding_metrics": sliding_metrics, "session_metrics": session_metrics, "latency_rollup": latency_rollup, "place_tree_codes": place_tree_codes}
SQL = {"sliding_metrics": SLIDING_SQL, "session_metrics": SESSION_SQL, "place_tree_codes": TREE_SQL}
