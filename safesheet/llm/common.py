"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if the session is local, as in tests; else an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="safesheet-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and outlives lost executors. Deleted at exit, or by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/safesheet/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._safesheet_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._safesheet_path)


def python_ready(spark: SparkSession) -> None:
    """Before Python functions are planned: lowers the session's Arrow batch size to BATCH_ROWS and BATCH_BYTES where it is larger, and
    lets workers find this package where the driver found it (on a cluster it is installed, or in PYTHONPATH there)."""
    root, path = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, root]))
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys where null equals null; the right side's keys go."""
    other = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(r)) for k, r in other.items()))
    return left.join(right, on, how).drop(*other.values())


#: What empties each operator's store in a Python worker, by the operator's name.
caches: dict[str, Callable[[], None]] = {}


def keep(name: str) -> None:
    """At a task's start in a worker that other operators used before: empties their stores."""
    for other, clear in caches.items():
        if other != name:
            clear()


def tidy() -> None:
    """At a task's end, in a Python worker that later tasks use too: gives unused memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bits of ``likely``'s filter, in words of 64: at most 2**20 rows of 16 bytes are broadcast, however many keys there are.
FILTER_BITS = 26


def _flagged(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with __maybe: whether a bit filter of fixed size holds the bit of the keys; false means that ``wanted`` hasn't the keys."""
    at = F.xxhash64(*keys)
    word, place = F.shiftright(F.pmod(at, F.lit(1 << FILTER_BITS)), 6), F.pmod(at, F.lit(64)).cast("int")
    bits = wanted.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    held = rows.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return held.withColumn("__maybe", F.coalesce(F.getbit("__bits", place) == 1, F.lit(False))).drop("__word", "__bits")


def likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without most of those whose keys aren't in ``wanted``: what a join would throw away needn't be shuffled."""
    return _flagged(rows, wanted, list(keys)).filter("__maybe").drop("__maybe")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but those whose keys are in ``gone`` (no nulls among either's keys); only rows that the bit filter can't clear are shuffled."""
    flagged = _flagged(rows, gone, keys)
    doubtful = flagged.filter("__maybe").drop("__maybe").join(gone.select(*keys).distinct(), keys, "left_anti")
    return flagged.filter("not __maybe").drop("__maybe").unionByName(doubtful)


#: Names of the columns that tell rows apart: 64 bits of the id, and of the text (the second digest of the text follows from the first).
ROW = ["__t0", "__t1", "__t2"]


def row_key() -> list[Column]:
    """Digests of doc_id and text, never null: equal for repeated rows, different for different texts under one id."""
    return [F.xxhash64("doc_id").alias(ROW[0]), F.xxhash64("text").alias(ROW[1]), F.xxhash64("text", F.lit(1)).alias(ROW[2])]


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: a lambda's variable isn't inlined, a column of a lower projection is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with the column ``name``: 1, 2, 3... in the order; and their number. Rows are sorted by ranges, and a table of one row for each range has
    its start, so no task sees all rows. Equal rows are parted by a number of their place, so they don't meet in one range."""
    spark, spread = rows.sparkSession, F.col("__spread")
    by = [*order, spread]
    ordered = rows.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = written(ordered.drop("__spread").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, before, strict=False)], "__part long, __start long")
    placed = ordered.join(F.broadcast(starts), part == F.col("__part"))  # a row for each range
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn(name, place).drop("__at", "__part", "__start"), before[-1]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def bounded_ids(rows: DataFrame, label: str, values: list, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, label) of each value: those whose hashed id comes first, whatever the partitions."""
    parts = [
        rows.filter(F.col(label) == F.lit(v)).select("doc_id", label)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for v in values
    ]
    return reduce(DataFrame.unionByName, parts)
