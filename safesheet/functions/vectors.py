"""Nearest vectors by an index of inverted lists, and exactly."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

#: The centroids are fitted on at most SAMPLE vectors, those whose hashed ids come first; every vector is in a list all the same.
SAMPLE, ROUNDS = 20_000, 15
#: Vectors of a list are searched in blocks of about so many, so a list of a third of all vectors isn't one task.
BLOCK = 20_000
#: The number of lists probed is the least that has this share of the true neighbours of ASKED vectors of the sample.
RECALL, ASKED = 0.95, 200


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles; those that are null or hold a null aren't in the index."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull()))


def _sample(vectors: DataFrame, most: int) -> DataFrame:
    return _usable(vectors).orderBy(F.xxhash64("id"), "id").limit(most)


def fit_centroids(vectors: DataFrame, n_lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of ``n_lists`` lists (by default the root of the number of vectors, of the sample at most) of (id, embedding)."""
    picked = _sample(vectors, sample).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).cache()
    try:
        n = picked.count()
        if not n:
            return np.zeros((0, 0))
        k = min(n, n_lists or max(1, round(math.sqrt(n))))
        if k == 1:
            return np.array([picked.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
        return np.array(KMeans(k=k, maxIter=ROUNDS, seed=seed).fit(picked).clusterCenters())
    finally:
        picked.unpersist()


def _order(data: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists of each vector from the nearest to the farthest centroid, of equal ones the first."""
    return np.argsort((centroids**2).sum(axis=1) / 2 - data @ centroids.T, axis=1, kind="stable")


def probes_needed(vectors: DataFrame, centroids: np.ndarray, k: int = 5, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """How many lists a search has to probe so that ``recall`` of the ``k`` nearest of ASKED vectors are in them, as found in the bounded sample by comparing all.

    In the whole table neighbours are nearer than in the sample, so there the share is higher. Data without groups need most lists."""
    data = _matrix(_sample(vectors, sample).select("embedding").toArrow().column("embedding").combine_chunks())  # bounded by ``sample``
    if not len(data) or not len(centroids):
        return 1
    asked = data[:ASKED]
    near = np.argsort(-(asked @ data.T), axis=1, kind="stable")[:, :k]
    home, order = _order(data, centroids)[:, 0], _order(asked, centroids)
    place = np.argsort(order, axis=1)  # of each list in the order of a query
    found = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1


def assign(rows: DataFrame, centroids: np.ndarray, n: int = 1, column: str = "embedding") -> DataFrame:
    """``rows`` with ``list``: the ``n`` lists of the nearest centroids, a row for each; of equal ones the first."""
    n = min(n, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            near = _order(_matrix(b.column(column)), centroids)[:, :n]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, n), pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "__lists"])

    usable = _usable(rows, column)
    schema = StructType([*usable.schema.fields, StructField("__lists", ArrayType(IntegerType()))])
    return usable.mapInArrow(run, schema).withColumn("list", F.explode("__lists")).drop("__lists")


def index(vectors: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """The vectors (id, embedding and others) written to ``path`` by list, with block: lists of over BLOCK vectors are parted by hashed ids. A filter by list or block is a filter of folders."""
    listed = assign(vectors, centroids)
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each centroid
    listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).write.partitionBy("list", "block").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def search(indexed: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, rank, id, score): for each of the stated ``queries`` (query_id, embedding) the ``k`` vectors with the greatest dot products, of equal ones the least ids, a query's own id too.

    Only ``probes`` lists of each query are searched (see ``probes_needed``); with as many as there are centroids the result is exact. A metadata filter on ``indexed`` holds
    before the choice. Each block of a list meets the queries that probe it in one task: the block's rows come once, and the queries in parts that are multiplied as
    matrices; each gives ``k`` candidates, and only these are ranked."""
    wanted = assign(queries.select("query_id", "embedding"), centroids, probes)
    blocks = indexed.select(F.col("list").alias("__l"), F.col("block").alias("__b")).distinct()  # a row for each block
    wanted = wanted.join(blocks, F.col("list") == F.col("__l")).select("query_id", "embedding", F.col("__l").alias("wl"), F.col("__b").alias("wb"))
    kind, own = indexed.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("id")
        asked = asked.combine_chunks()
        out = []
        if len(rows):
            data = _matrix(rows.column("embedding").combine_chunks())
            for at in range(0, len(asked), 256):
                part = asked.slice(at, 256)
                scores = _matrix(part.column("embedding").combine_chunks()) @ data.T
                best = np.argsort(-scores.round(9), axis=1, kind="stable")[:, :k]
                who = np.repeat(np.arange(len(part)), best.shape[1])
                out.append(pa.table([part.column("query_id").take(pa.array(who)), rows.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], ["query_id", "id", "score"]))
        return pa.concat_tables(out) if out else pa.table([asked.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())], ["query_id", "id", "score"])

    found = indexed.select("list", "block", "id", "embedding").groupBy("list", "block").cogroup(wanted.groupBy("wl", "wb")).applyInArrow(run, f"query_id {own}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: Sizes of the blocks of asked and of all vectors that meet in one group, and the asked ones of a block that are worked on at once.
ASKED_BLOCK, ROWS_BLOCK, AT_ONCE = 1000, 4000, 16


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, filled up with zeros, and their lengths; that of a null one, or one that holds a null, is -1."""
    lengths, whole = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy(), column.flatten()
    inside = np.arange(max(lengths.max(initial=0), 0)) < lengths[:, None]
    data = np.zeros(inside.shape)
    data[inside] = whole.fill_null(0.0).to_numpy(zero_copy_only=False)
    holes = np.zeros(inside.shape, bool)
    holes[inside] = whole.is_null().to_numpy(zero_copy_only=False)
    return data, np.where(holes.any(axis=1), -1, lengths)


def products(asked: DataFrame, rows: DataFrame, over: float | None = None) -> DataFrame:
    """(id_a, id_b, score): the dot product of each of the ``asked`` vectors (id, embedding) with each of ``rows`` (id, embedding) under another id, to 6 places; null if the lengths differ or a
    part is null. With ``over`` only the scores above it.

    The result is the product of both numbers; a task holds a block of each, the pairs of some asked vectors, and what it gives. Terms are added up in their order, as an aggregate over an array does."""
    n, m = asked.count() // ASKED_BLOCK + 1, rows.count() // ROWS_BLOCK + 1
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n * m)
    deal = lambda df, own, of, other, to: df.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(other)).repartition(tasks, "i", "j")
    a, b = deal(asked.filter("id is not null"), "i", n, "j", m), deal(rows.filter("id is not null"), "j", m, "i", n)
    kind, own = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def run(one: pa.Table, two: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(one) or not len(two):
            return
        x, y = (t.column("embedding").combine_chunks() for t in (one, two))
        (x, at_x), (y, at_y) = _padded(x), _padded(y)
        sides, y = min(x.shape[1], y.shape[1]), np.ascontiguousarray(y.T)
        ids = two.column("id").combine_chunks()
        for at in range(0, len(one), AT_ONCE):
            part = x[at : at + AT_ONCE]
            sums = np.zeros((len(part), len(ids)))
            for k in range(sides):
                sums += part[:, k, None] * y[k]
            none = (at_x[at : at + AT_ONCE, None] != at_y) | (at_y < 0)
            keep = np.ones(sums.shape, bool) if over is None else ~none & ~(sums < over - 1e-5)
            p, q = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([one.column("id").combine_chunks().slice(at, AT_ONCE).take(pa.array(p)), ids.take(pa.array(q)), pa.array(sums[p, q], mask=none[p, q])], ["id_a", "id_b", "score"])

    def table(one: pa.Table, two: pa.Table) -> pa.Table:
        made = list(run(one, two))
        return pa.Table.from_batches(made) if made else pa.table([one.column("id").slice(0, 0), two.column("id").slice(0, 0), pa.array([], pa.float64())], ["id_a", "id_b", "score"])

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(table, f"id_a {own}, id_b {kind}, score double").filter("id_a <> id_b").withColumn("score", F.round("score", 6))
    return found if over is None else found.filter(F.col("score") > over)
