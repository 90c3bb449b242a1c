"""Roll-ups of query logs that merge without the raw rows: counts, and sketches of times and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch: ranks within half a percent; and logarithm of the registers for distinct counts, within two percent.
QUANTILE_K, DISTINCT_LG = 800, 14
RANK_ERROR, DISTINCT_ERROR = 0.005, 0.02


def hourly(logs: DataFrame) -> DataFrame:
    """(hour, n, n_empty, total_time, max_time, times, users) of the logs (ts, total_time, result_count, user_id): a row of a few kilobytes for each hour,
    whatever the number of queries. times is a quantile sketch of total_time, users one of the distinct user_id; nulls are in neither."""
    return logs.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("n_empty"), F.sum("total_time").alias("total_time"), F.max("total_time").alias("max_time"),
        F.kll_sketch_agg_double(F.col("total_time").cast("double"), QUANTILE_K).alias("times"), F.hll_sketch_agg("user_id", DISTINCT_LG).alias("users"),
    )


def merged(rollup: DataFrame, *keys) -> DataFrame:
    """The rows of a roll-up added up by ``keys`` (columns over it; none: all): the roll-up of a day is that of its hours, and any two may be merged again."""
    return rollup.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty"), F.sum("total_time").alias("total_time"), F.max("max_time").alias("max_time"),
        F.kll_merge_agg_double("times", QUANTILE_K).alias("times"), F.hll_union_agg("users").alias("users"),
    )


def read(rollup: DataFrame, ranks: dict[str, float] | None = None) -> DataFrame:
    """The columns of a roll-up with its sketches read: avg_time, n_users and a column for each of ``ranks`` (name to share, by default p50, p95 and p99)."""
    ranks = ranks or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    quantiles = [F.when(F.kll_sketch_get_n_double("times") > 0, F.kll_sketch_get_quantile_double("times", F.lit(q))).alias(name) for name, q in ranks.items()]
    return rollup.select(*[c for c in rollup.columns if c not in ("times", "users")], (F.col("total_time") / F.col("n")).alias("avg_time"), F.hll_sketch_estimate("users").alias("n_users"), *quantiles)
