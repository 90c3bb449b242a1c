"""Vector operators: scores of unit vectors by dot product, JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors


def _dot(a: str, b: str):
    double = lambda c: F.col(c).cast("array<double>")
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_topk(spark: SparkSession, sf_dir: str, k: int = 5, label: int | None = None) -> DataFrame:
    """The k vectors nearest to vector 0, perhaps of one label; ties by id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = e if label is None else e.filter(F.col("label") == label)
    # one row is broadcast: the query
    scored = rows.crossJoin(F.broadcast(query)).select("vec_id", F.round(_dot("embedding", "q"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk(spark, sf_dir, label=1)


def doc_similarity(spark: SparkSession, sf_dir: str, over: float | None = None) -> DataFrame:
    """Similarities of the query vectors (ids divisible by 100) with all others, the heat map's input; with ``over`` those above it."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.products(e.filter("id % 100 = 0"), e, over)


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of the sources of the five vectors nearest to vector 0, best first; a vector's document has its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "source", "text")
    top = vector_topk(spark, sf_dir).join(docs, "vec_id")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"), "source", "text")))
    return top.agg(F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), x["source"], F.lit("]\n"), x["text"])), "\n---\n").alias("context"))


def relevance_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by label of the scores of vector 0 with all vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row is broadcast
    scored = e.crossJoin(F.broadcast(query)).select("label", _dot("embedding", "q").alias("score"))
    return scored.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.percentile("score", p), 6).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


QUERIES = {"rag_context": rag_context, "relevance_dist": relevance_dist, "vector_topk": vector_topk, "vector_topk_filtered": vector_topk_filtered, "doc_similarity": doc_similarity}
_TOP = "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {} ORDER BY score DESC, vec_id LIMIT 5"
SQL = {
    "rag_context": f"""SELECT string_agg(concat('[Source ', CAST(k AS VARCHAR), ': ', source, ']', chr(10), text), concat(chr(10), '---', chr(10)) ORDER BY k) AS context FROM (
        SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS k, source, text FROM ({_TOP.format("")}) t JOIN documents d ON d.doc_id = t.vec_id) x""",
    "relevance_dist": """SELECT label, count(*) AS n, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3 FROM (
        SELECT e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) x GROUP BY label""",
    "vector_topk": _TOP.format(""),
    "vector_topk_filtered": _TOP.format("WHERE e.label = 1"),
    "doc_similarity": "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id",
}
