"""Walks over edges (src, dst): loops of joins with the frontier, which each step writes; as its size is known then, a small one is broadcast and the edges aren't shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import spread, written


def closure(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) of every node that a walk of at most ``depth`` edges reaches from a start (start): a row for each length of such a walk, cycles too."""
    e = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    front = starts.select("start", F.col("start").alias("node")).distinct()
    found = None
    for k in range(1, depth + 1):
        front = written(front.join(e, front["node"] == e["__src"]).select("start", F.col("__dst").alias("node")).distinct(), "front")
        step = front.withColumn("depth", F.lit(k))
        found = step if found is None else found.unionByName(step)
    return found


def nearest(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) of the nodes but the start itself within ``depth`` edges, at their least distance."""
    e = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        reached = front.join(e, front["node"] == e["__src"]).select("start", F.col("__dst").alias("node")).distinct()
        front = written(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, path) of every path of 1 to ``depth`` edges from a start that meets no node twice."""
    edges = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    front = starts.select("start", F.array("start").alias("path"))
    found = None
    for _ in range(depth):
        ends = front.select(F.element_at("path", -1).alias("__src")).distinct()
        e = edges.join(ends, "__src", "left_semi").distinct()
        grown = front.join(e, F.element_at("path", -1) == e["__src"]).filter(~F.array_contains("path", F.col("__dst")))
        front = written(grown.select("start", F.array_append("path", F.col("__dst")).alias("path")), "front")
        found = front if found is None else found.unionByName(front)
    return found


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """The edges (start, src, dst) between nodes within ``depth`` of a start, itself among them."""
    near = nearest(edges, starts, depth).select("start", "node").unionByName(starts.select("start", F.col("start").alias("node")))
    a = near.select("start", F.col("node").alias("src"))
    b = near.select("start", F.col("node").alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, ["start", "dst"]).select("start", "src", "dst").distinct()


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """(id, class, bits): of the fingerprints (id, bits array) that have a bit, their class, which is the least id with the same bits, and these, sorted and each once."""
    sets = prints.select("id", F.array_sort(F.array_distinct("bits")).alias("bits")).filter("size(bits) > 0")
    return sets.join(sets.groupBy("bits").agg(F.min("id").alias("class")), "bits").select("id", "class", "bits")


def similar_classes(classes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity), a < b, of the classes of ``fingerprint_classes`` whose shares of common bits reach ``threshold``. Exact, without comparing all pairs.

    Bits are ordered from rare to common; two sets that reach the threshold share a bit among the first n - ceil(t n) + 1 of each, so
    those prefixes alone are joined. Equal fingerprints are one class, so copies make no pairs."""
    sets = classes.filter(F.col("id") == F.col("class")).select("id", "bits")
    often = sets.select("id", F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    ordered = sets.select("id", F.explode("bits").alias("bit")).join(often, "bit").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "bit"))), lambda x: x["bit"]).alias("bits"))
    size = F.size("bits")
    prefix = F.slice("bits", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)
    keyed = written(ordered.select("id", "bits", F.explode(prefix).alias("bit")), "prefixes")
    # few bytes that meet in many pairs: dealt out by their number
    a, b = spread(keyed.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"), "bit"), "a", 500), keyed.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), "bit")
    n, m = F.size("bits_a"), F.size("bits_b")
    pairs = a.join(b, "bit").filter((F.col("a") < F.col("b")) & (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9))
    both = F.size(F.array_intersect("bits_a", "bits_b"))
    # judged before they are made distinct, as the bits needn't be kept for that
    return pairs.select("a", "b", (both / (n + m - both)).alias("similarity")).filter(F.col("similarity") >= threshold).distinct()


#: Members of a class that meet others' at once, and pairs that a task gives.
MEMBERS, PAIRS = 1000, 2_000_000


def tanimoto_pairs(prints: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity), a < b, of all fingerprints (id, bits array) that reach ``threshold``: the classes' pairs and their members'. The result holds every pair, equal
    fingerprints too, which is a square where many are equal; ``similar_classes`` says the same without it. A task holds parts of two classes and gives their pairs, in
    as many tasks as the pairs need. Empty and null fingerprints have no pair."""
    classes = written(fingerprint_classes(prints).select("id", "class", "bits"), "classes")
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    parts = classes.join(sizes, "class").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)))
    members = written(parts.groupBy("class", "part").agg(F.collect_list("id").alias("ids")), "members")
    own = sizes.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    linked = written(similar_classes(classes, threshold).unionByName(own), "linked")
    counted = linked.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("n")), "a").join(sizes.select(F.col("class").alias("b"), F.col("n").alias("m")), "b")
    total = counted.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    x, y = (members.select(F.col("class").alias(c), F.col("part").alias(k), F.col("ids").alias(ids)) for c, k, ids in (("a", "i", "xs"), ("b", "j", "ys")))
    met = linked.join(x, "a").join(y, "b").repartition(max(prints.sparkSession.sparkContext.defaultParallelism, total // PAIRS + 1), "a", "b", "i", "j")
    pairs = met.select("a", "b", "similarity", "xs", F.explode("ys").alias("y")).select("a", "b", "similarity", F.explode("xs").alias("x"), "y").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation over undirected edges (src, dst, weight): a node takes the label with the most weight around it, its own
    counting as one half more than the weakest, the least of equal ones. Not the greedy modularity of an in-memory graph: its merges are a sequence."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst")
    both = written(both.groupBy("src", "dst").agg(F.max("weight").alias("weight")), "graph")
    labels = written(both.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct(), "communities")
    stay = both.agg(F.min("weight")).first()[0]
    for k in range(rounds):
        told = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "community", "weight")
        own = labels.withColumn("weight", F.lit(0.5 * stay if stay is not None else 0.0))
        votes = told.unionByName(own).groupBy("node", "community").agg(F.sum("weight").alias("w"))
        new = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("x")).select("node", F.col("x.community").alias("community"))
        new = written(new, "communities")
        if k and not new.exceptAll(labels).take(1):
            break
        labels = new
    return labels


def hybrid_contexts(questions: DataFrame, edges: DataFrame, documents: DataFrame, depth: int = 2, top_k: int = 5, most: int = 500) -> DataFrame:
    """(id, cas, n_incompatible, context) of the questions (id, question, embedding): graph facts of the registry numbers in it, and the nearest documents.

    ``documents`` (content, embedding) are scored by dot product with the stated questions, the ``top_k`` best of each kept (ties by
    content), their contents cut at ``most`` characters. A question without a number has document excerpts alone."""
    asked = questions.select("id", "embedding", F.regexp_extract_all("question", F.lit(r"(?U)\b\d{2,7}-\d{2}-\d\b"), F.lit(0)).alias("cas"))
    starts = asked.select(F.explode("cas").alias("start")).distinct()
    counts = nearest(edges, starts, depth).groupBy("start").agg(F.count("*").alias("n"))
    facts = asked.select("id", F.posexplode("cas").alias("k", "start")).join(counts, "start")
    line = F.concat(F.lit("CAS "), "start", F.lit(" has "), F.col("n").cast("string"), F.lit(" incompatibilities at various depths"))
    graph = facts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("facts"), F.sum("n").alias("n_incompatible"))
    double = lambda c: F.col(c).cast("array<double>")
    score = F.aggregate(F.zip_with(double("embedding"), double("__e"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = documents.select(F.col("embedding").alias("__e"), "content").crossJoin(asked.select("id", "embedding")).select("id", F.struct((-score).alias("s"), "content").alias("x"))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("x"))).filter(F.col("k") <= top_k)
    top = best.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("top"))
    parts = F.transform("top", lambda x, k: F.concat(F.lit("\n### Document "), (k + 1).cast("string"), F.lit("\n"), F.substr(x["content"], F.lit(1), F.lit(most))))
    joined = asked.select("id", "cas").join(graph, "id", "left").join(top, "id", "left")
    head = F.when(F.size("cas") > 0, F.concat_ws("\n", F.lit("## Graph Context (Chemical Relationships)"), "facts"))
    tail = F.when(F.size("top") > 0, F.concat_ws("\n", F.lit("\n## Vector Context (Document Excerpts)"), F.array_join(parts, "\n")))
    return joined.select("id", "cas", F.coalesce("n_incompatible", F.lit(0)).alias("n_incompatible"), F.concat_ws("\n", head, tail).alias("context"))


def prompt(context, question):
    """The text that a model is asked, of what was found and the question; the model itself is the caller's."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
