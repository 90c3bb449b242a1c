"""The folder that the driver and all executors share, and tables written there to cut a plan."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder if the session is local, as in tests; else an error."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="safesheet-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, whatever reads it, and there when executors are lost. Deleted at exit."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its plan cut, as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bits of the filter of ``likely``, in words of 64: at most 2**18 rows of 16 bytes are broadcast, however many keys there are.
FILTER_BITS = 24


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``wanted``, by a bit filter of fixed size: what a join would throw away needn't be shuffled."""
    at = F.xxhash64(key)
    word = F.shiftright(F.pmod(at, F.lit(1 << FILTER_BITS)), 6)
    bits = wanted.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    held = rows.withColumn("__word", word).join(F.broadcast(bits), "__word")
    return held.filter(F.getbit("__bits", F.pmod(at, F.lit(64)).cast("int")) == 1).drop("__word", "__bits")


def spread(rows: DataFrame, key: str, each: int = 5000) -> DataFrame:
    """``rows``, narrow ones still, dealt out by the hash of ``key`` in as many parts as they need with ``each`` in one: a small file would be one task, however long a row's work takes."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each + 1), key)
