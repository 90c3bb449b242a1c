"""Files and rows that arrive, taken once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Stream of (path, content, file_hash) of the files in a folder; of files with equal contents one counts, whenever they come.

    The hashes of all files stay in the stream's state, 64 bytes each, as a copy may come at any time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content", F.sha2("content", 256).alias("file_hash")).dropDuplicates(["file_hash"])


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls ``work`` with each batch and its number. ``every`` is the time between polls; without it, what is there is worked off and the query ends.

    A batch comes again with its number after a failure, so ``work`` has to write by that number; the checkpoint keeps what was taken."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_once(folder: str) -> Callable[[DataFrame, int], None]:
    """Work for ``run`` that writes each batch to a folder of its number: one that comes again takes its own place."""

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return work


def since(rows: DataFrame, mark: tuple | None, limit: int | None = None, column: str = "indexed_at", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows after the ``mark`` (time, id), oldest first, at most ``limit``; and a row (time, id) of the last of these, the next mark, or none if there is none.

    The mark is the time and the id, so rows of equal times are parted where a limit falls between them. Rows without time or id aren't taken."""
    at, own = F.col(column), F.col(key)
    fresh = rows.filter(at.isNotNull() & own.isNotNull())
    if mark is not None:
        fresh = fresh.filter((at > F.lit(mark[0])) | (at == F.lit(mark[0])) & (own > F.lit(mark[1])))
    fresh = fresh.orderBy(column, key)
    taken = fresh.limit(limit) if limit is not None else fresh
    return taken, taken.agg(F.max(F.struct(at.alias("time"), own.alias("id"))).alias("m")).filter("m is not null").select("m.*")
