"""Communities of a weighted graph by modularity: local moves, then contraction, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

#: Gains below this are none.
LEAST = 1e-9


def _both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w): each undirected edge (src, dst, weight) both ways, a loop once with twice its weight; equal edges added up."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w")).filter("a is not null and b is not null and w > 0")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """The modularity of a parting (node, community) of all nodes of the edges (src, dst, weight); 0 without an edge."""
    return _modularity(_both_ways(edges), labels)


def _modularity(both: DataFrame, labels: DataFrame) -> float:
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    # a row for each community, then one: what is inside it and what its nodes have in all
    inside = both.join(la, "a").join(lb, "b").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("in"), F.sum("w").alias("tot"))
    row = inside.agg(F.sum("tot").alias("all"), F.sum("in").alias("in"), F.sum(F.col("tot") * F.col("tot")).alias("sq")).first()
    return 0.0 if not row["all"] else row["in"] / row["all"] - row["sq"] / row["all"] ** 2


def _moved(both: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """``labels`` after each node whose turn it is has gone to the neighbouring community with the greatest gain of modularity, if that is more than where it is has."""
    degree = both.groupBy("a").agg(F.sum("w").alias("k")).withColumnRenamed("a", "node")
    own = labels.join(degree, "node")
    sums = own.groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
    near = both.filter("a <> b").join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    choices = near.unionByName(own.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
    here = own.select("node", F.col("community").alias("now"), "k").join(sums.select(F.col("community").alias("now"), F.col("n").alias("n_now")), "now")
    scored = choices.join(here, "node").join(sums, "community")
    stays = F.col("community") == F.col("now")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    # of two nodes alone only the greater label goes, so they don't change places
    allowed = stays | (F.col("n") > 1) | (F.col("n_now") > 1) | (F.col("community") < F.col("now"))
    best = scored.filter(allowed).groupBy("node").agg(F.max(F.struct(F.round(gain, 12).alias("g"), stays.alias("stays"), "community")).alias("x"), F.max(F.when(stays, F.round(gain, 12))).alias("stay"), F.max("now").alias("now"))
    goes = (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2) & (F.col("x.g") > F.col("stay") + LEAST)
    return best.select("node", F.when(goes, F.col("x.community")).otherwise(F.col("now")).alias("community"))


def by_modularity(edges: DataFrame, rounds: int = 10, levels: int = 5) -> tuple[DataFrame, float]:
    """(node, community) of undirected edges (src, dst, weight), and its modularity; community is the least node of it that a merge kept as its name.

    In a round each node moves once, a half of them by hash at a time, to the neighbouring community that adds most to the modularity; the best parting seen is kept, and
    two rounds in a row without a better one end the level. Then communities become nodes and their edges are added up, until no level finds
    more. What meets in a join is a node's edges or a row for each of a node's neighbouring communities, not pairs of nodes. Equal edges are added up;
    edges with a null, or without a positive weight, don't count; a node without an edge isn't in the result."""
    both = written(_both_ways(edges), "graph")
    total = both.agg(F.sum("w")).first()[0]
    alone = lambda g: g.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
    names = written(alone(both), "communities")
    if not total:
        return names, 0.0
    best = _modularity(both, names)
    for k in range(levels):
        labels = kept = names if k == 0 else written(alone(both), "communities")
        level, idle = best, 0
        for turn in range(rounds):
            for half in (2 * turn, 2 * turn + 1):
                labels = written(_moved(both, labels, total, half), "communities")
            now = _modularity(both, labels)
            idle = 0 if now > level + LEAST else idle + 1
            if not idle:
                level, kept = now, labels
            if idle == 2:
                break
        if level <= best + LEAST:
            break
        best = level
        step = kept.select(F.col("node").alias("community"), F.col("community").alias("__to"))
        names = kept if k == 0 else written(names.join(step, "community").select("node", F.col("__to").alias("community")), "communities")
        la, lb = kept.select(F.col("node").alias("a"), F.col("community").alias("ca")), kept.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        both = written(both.join(la, "a").join(lb, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "graph")
    return names, best
