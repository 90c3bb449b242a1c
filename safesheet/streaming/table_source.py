"""A stream of a table's rows in the order of a time and an id, in bounded batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package


def _dataset(path: str) -> ds.Dataset:
    where, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return ds.dataset(inside, filesystem=where, format="parquet")


def _stored(value: pa.Scalar):
    """A scalar as JSON has it: times as whole microseconds."""
    return value.cast(pa.timestamp("us")).cast(pa.int64()).as_py() if pa.types.is_timestamp(value.type) else value.as_py()


def _scalar(value, kind: pa.DataType) -> pa.Scalar:
    if not pa.types.is_timestamp(kind):
        return pa.scalar(value, kind)
    return pa.scalar(value, pa.int64()).cast(pa.timestamp("us", kind.tz)).cast(kind)


@dataclass
class _Part(InputPartition):
    file: str
    groups: list[int]
    start: dict
    end: dict


class MarkedReader(DataSourceStreamReader):
    """The offset is the time and the id of the last row taken; null stands for the begin."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.time, self.id = options.get("time", "indexed_at"), options.get("id", "id")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.planned: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": None, "id": None}

    def _after(self, mark: dict, data: pa.Schema) -> ds.Expression:
        at, own = ds.field(self.time), ds.field(self.id)
        if mark["time"] is None:
            return at.is_valid() & own.is_valid()
        t, i = _scalar(mark["time"], data.field(self.time).type), _scalar(mark["id"], data.field(self.id).type)
        return (at > t) | ((at == t) & (own > i))

    def latestOffset(self) -> dict:
        """The mark of the ``limit``-th row after what was planned last; only that many times and ids are held at once."""
        start = self.planned or self.initialOffset()
        data = _dataset(self.path)
        keys = [(self.time, "ascending"), (self.id, "ascending")]
        held = None
        for batch in data.scanner(columns=[self.time, self.id], filter=self._after(start, data.schema)).to_batches():
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if self.limit is None:
                held = rows.take(pc.sort_indices(rows, sort_keys=[(k, "descending") for k, _ in keys])[:1])
            else:
                held = rows.take(pc.select_k_unstable(rows, min(self.limit, len(rows)), keys))
        if held is None:
            return start
        last = held.take(pc.sort_indices(held, sort_keys=[(k, "descending") for k, _ in keys])[:1])
        return {"time": _stored(last.column(0)[0]), "id": _stored(last.column(1)[0])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A part for each file of which some group of rows may lie between the marks. A restarted query plans its last batch first, which tells where it was."""
        self.planned = end
        if start == end:
            return []
        data = _dataset(self.path)
        between = self._after(start, data.schema) & ~self._after(end, data.schema)
        out = []
        for f in data.get_fragments(filter=between):
            groups = [g.id for part in f.split_by_row_group(between) for g in part.row_groups]
            if groups:
                out.append(_Part(f.path, groups, start, end))
        return out

    def commit(self, end: dict) -> None:
        self.planned = self.planned or end

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p: _Part = partition
        where = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        fragment = ds.ParquetFileFormat().make_fragment(p.file, filesystem=where, row_groups=p.groups)
        seen = fragment.physical_schema
        at, own = ds.field(self.time), ds.field(self.id)
        known = at.is_valid() & own.is_valid()
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)  # of times, microseconds in UTC
        for b in fragment.scanner(columns=self.schema.fieldNames(), filter=known & self._after(p.start, seen) & ~self._after(p.end, seen)).to_batches():
            yield pa.RecordBatch.from_arrays([c.cast(kinds.field(k).type) for k, c in enumerate(b.columns)], schema=kinds)


class MarkedTable(DataSource):
    """``spark.readStream.format("marked_table")``: the rows of a Parquet table after a mark, oldest first.

    Options: path (local or a URI that pyarrow reads), time (indexed_at), id (id), limit (rows of a batch). The offset, in the query's checkpoint, is the time
    and id of the last row taken, so rows of equal times are parted by their ids, and a batch that comes again has the same rows. Equal times and
    ids come in one batch. Rows without either are never taken, nor is a row added later with a time and id before the mark.
    """

    @classmethod
    def name(cls) -> str:
        return "marked_table"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=False)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return MarkedReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkedTable)
