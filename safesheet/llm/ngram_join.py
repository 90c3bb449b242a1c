"""N-gram Jaccard join by MinHash banding with verification on full sets (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, drop, likely, keep, python_ready, row_key, tidy, without, written
from .shingles import forget, shingle_set

WIDTH, THRESHOLD = 5, 0.8
#: Chance at least that a pair at the threshold meets in a band, and hash functions at most.
RECALL, MAX_HASHES = 0.9999, 128
#: Members of a bucket that are compared with each other in one group, and n-grams in all their sets (about); larger buckets are
#: split in blocks, every pair of which is a group of its own.
BLOCK, LIGHT_BLOCK, BLOCK_GRAMS = 400, 1000, 1_000_000
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 8192


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which the recall takes at most ``max_hashes``."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no number of bands reaches the recall")


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bucket's number for each band; the band is part of it."""
    a, b = perms
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * a[None] + b[None]
        np.minimum(least, part.min(axis=0), out=least)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + least.reshape(bands, rows)[:, k]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, __t0..2, key, n, bands) for each row: its digests, digest and size of its n-gram set, bucket of each band (none for an empty set)."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("ngram_join")
        perms = _permutations(bands * rows)
        for b in batches:
            keys, sizes, found = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text or "", width)
                keys.append(_set_key(s))
                sizes.append(len(s))
                found.append(band_hashes(s, bands, rows, perms).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ["doc_id", *ROW]), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", *ROW, "key", "n", "bands"],
            )
        forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in ROW)}, key binary, n long, bands array<long>"
    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of each key, which come sorted through one Python process a partition; groups have to be bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def each(t: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                out = work(t.slice(a, z - a))
                if out is not None and out.num_rows:
                    yield out

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            change = np.zeros(t.num_rows - 1, dtype=bool)
            for k in keys:
                v = t.column(k).to_numpy()
                change |= v[1:] != v[:-1]
            starts = [0, *(np.nonzero(change)[0] + 1).tolist()]
            yield from each(t, starts)
            held = t.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from each(t, [0, t.num_rows])
        tidy()

    python_ready(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _blocks(members: DataFrame, sizes: DataFrame, most: int, most_grams: int | None = None) -> DataFrame:
    """Each member of a bucket (bucket, m and grams of ``sizes``) once for every pair of blocks that its own block is in: bucket, i, j, own."""
    count = F.ceil(F.col("m") / most)
    if most_grams:
        count = F.greatest(count, F.least(F.col("m"), F.ceil(F.col("grams") / most_grams)))
    rows = members.join(sizes, "bucket").withColumn("blocks", count.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other", "m", "grams")


def _first_meeting(t: pa.Table, scale: int, least: int) -> np.ndarray:
    """Which pairs have this bucket as the first that they share and sizes that allow the similarity; across blocks only the pairs between them."""
    band, n = t.column("band")[0].as_py(), t.column("n").to_numpy()
    sig = np.array(t.column("bands").combine_chunks().flatten().to_numpy()).reshape(len(n), -1)
    pairs = n[:, None] * scale >= least * n[None]
    pairs &= pairs.T
    np.fill_diagonal(pairs, False)
    for k in range(band):
        pairs &= sig[:, k][:, None] != sig[:, k][None]
    if t.column("i")[0].as_py() != t.column("j")[0].as_py():
        own = t.column("own").to_numpy()
        pairs &= own[:, None] != own[None]
    return pairs


SCALE = 10_000
#: Columns of a member of a bucket: its set's digest, size and buckets, and the row that has its text.
MEMBER = ["key", "n", "bands", *ROW, "band", "bucket"]


def _needed(least: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def work(t: pa.Table) -> pa.RecordBatch | None:
        """Members that have some pair to verify in this bucket."""
        if t.num_rows < 2:
            return None
        some = _first_meeting(t, SCALE, least).any(axis=1)
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(some)) for c in MEMBER], MEMBER)

    return work


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, from the incidence matrix of the n-grams that two or more have."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), dtype=np.float32)
    total = int((count > 1).sum())
    for at in range(0, total, COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((m, min(COLUMNS, total - at)), dtype=np.float32)
        x[owner[a:z], column[a:z] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(width: int, least: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def work(t: pa.Table) -> pa.RecordBatch | None:
        """(key, root, links): members with verified pairs, how many, and the least member that these pairs connect them to."""
        if t.num_rows < 2:
            return None
        pairs = _first_meeting(t, SCALE, least)
        keys = t.column("key").to_pylist()
        sets = [shingle_set(x, width) for x in t.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        both = intersections(sets)
        pairs &= both * SCALE >= least * (sizes[:, None] + sizes[None] - both)
        links = pairs.sum(axis=1)
        some = np.nonzero(links)[0].tolist()
        if not some:
            return None
        root = [-1] * len(keys)
        for k in sorted(some, key=keys.__getitem__):
            if root[k] < 0:
                front = np.zeros(len(keys), dtype=bool)
                front[k] = True
                reached = front.copy()
                while front.any():
                    front = pairs[front].any(axis=0) & ~reached
                    reached |= front
                for x in np.nonzero(reached)[0].tolist():
                    root[x] = k
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array([keys[root[k]] for k in some], pa.binary()), pa.array(links[some], pa.int64())], ["key", "root", "links"])

    return work


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (u, v) but the roots: the least node connected with it.

    Alternates large stars and small stars, a logarithmic number of rounds. Every table of a round is written
    to the shared folder, so that the joins read two plain tables and Spark can split a hub's rows, and deleted after it.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before = state(e)
    while before[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        less = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(less, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = written(small.unionByName(less.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(e, least, large, less)
        e = made
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(docs: DataFrame, width: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows with a word (doc_id, __t0..2, key, rep, n_copies, root, class_id, n_links), and the other rows (doc_id, __t0..2)."""
    bands, rows = plan_bands(threshold, recall)
    least = round(threshold * SCALE)
    signed = written(signatures(docs, width, bands, rows), "signatures")
    solid = signed.filter("n > 0")
    sets = solid.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min(F.struct(*ROW)).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = written(sets.select("key", "rep", "n_copies", "at.*", "n", "bands"), "sets")
    members = sets.select("key", "n", "bands", *ROW, F.posexplode("bands").alias("band", "bucket"))
    sizes = written(sets.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    light = _blocks(likely(members, sizes, "bucket"), sizes, LIGHT_BLOCK)
    needed = by_group(light, ["bucket", "i", "j"], _needed(least), "key binary, n long, bands array<long>, " + ", ".join(f"{c} long" for c in ROW) + ", band int, bucket long")
    needed = written(needed.distinct(), "needed")
    sizes = written(needed.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("grams")), "buckets")
    # one text of each set, whatever its copies: repeated rows are dropped before the shuffle, copies by the filter and the join
    texts = likely(docs.select(*row_key(), "text"), needed, *ROW).groupBy(*ROW).agg(F.first("text").alias("text"))
    heavy = _blocks(needed, sizes, BLOCK, BLOCK_GRAMS).join(texts, ROW)
    verified = written(by_group(heavy.drop(*ROW), ["bucket", "i", "j"], _verify(width, least), "key binary, root binary, links long"), "verified")
    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("key").alias("u"), F.col("root").alias("v")))
    nodes = links.join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = sets.select("key", "rep", "n_copies").join(nodes, "key", "left").select("key", "rep", "n_copies", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = written(known, "sets")
    # a written table of the classes, so that the join reads two plain tables and Spark can split a large class
    known = known.join(written(known.groupBy("root").agg(F.min("rep").alias("class_id")), "class-ids"), "root")
    return solid.select("doc_id", *ROW, "key").join(known, "key"), signed.filter("n = 0").select("doc_id", *ROW)


def ngram_join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_copies, n_links) for each row of ``docs`` (doc_id of any type, text).

    Texts are sets of n-grams of lower-case words. Rows with equal sets are copies: copy_id is their least doc_id and
    n_copies their number. n_links is how many other sets have a Jaccard similarity of ``threshold`` or more with the row's
    set, and class_id the least doc_id among the sets that such links connect it with. Links are found by MinHash bands of the
    sets, a pair in the first bucket that both are in, and verified on the full sets of the texts. Buckets are worked on in
    blocks of bounded size, every pair of blocks; no pair is a row: a group returns its members with their number of links and
    a spanning star. A text of fewer words than ``width`` is one n-gram. Null, empty and wordless texts are alone:
    class_id and copy_id are their doc_id. Classes are of sets: different texts under one doc_id are in the classes of their
    own. Rows without doc_id take part like others, and copy_id or class_id is null where no row among them has one.
    """
    solid, alone = _classes(docs, width, threshold, recall)
    one = F.lit(1).cast("long").alias("n_copies")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), one, F.lit(0).cast("long").alias("n_links"))
    return solid.select("doc_id", "class_id", F.col("rep").alias("copy_id"), "n_copies", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of ``ngram_join``: that of the least doc_id (null last), of equal ones by the text's digest.

    Of repeated rows, equal in doc_id and text, the one whose columns have the least hash stays. Null, empty and wordless texts all stay.
    Which row stays is decided by doc_id and text, so a doc_id whose texts are in several classes can stay with some and go with others.
    """
    solid, _ = _classes(docs, width, threshold, RECALL)
    solid = written(solid.select("root", "doc_id", *ROW), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("first")
    kept = written(solid.groupBy("root").agg(first).select("root", *[F.col(f"first.{c}").alias(f"own{c}") for c in ROW]), "kept")
    same = F.lit(True)
    for c in ROW:
        same = same & (F.col(c) == F.col(f"own{c}"))
    marked = written(solid.join(kept, "root").groupBy(*ROW).agg(F.max(same).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "near-copies")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *row_key())
    rest = without(rows, marked, ROW)
    again = likely(rows, marked.filter("stays"), *ROW).join(marked.filter("stays").select(*ROW), ROW).groupBy(*ROW).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return rest.select("__row.*").unionByName(again.select("__row.*")).select(*names)
