"""Arrow tables, batches and IPC files."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frame import Frame
from ..session import active


def from_arrow(data: pa.Table | pa.RecordBatch | pa.RecordBatchReader | pa.Array | Iterable[pa.RecordBatch], name: str = "value") -> Frame:
    """A table, a batch, or a stream of batches, which is read to its end; of a reader an empty one keeps its schema.
    An array of structs gives their fields, any other array one column of that name."""
    if isinstance(data, pa.StructArray):
        data = pa.RecordBatch.from_struct_array(data)
    elif isinstance(data, (pa.Array, pa.ChunkedArray)):
        data = pa.table({name: data})
    if isinstance(data, pa.RecordBatchReader):
        table = data.read_all()
    else:
        table = data if isinstance(data, pa.Table) else pa.Table.from_batches([data] if isinstance(data, pa.RecordBatch) else list(data))
    return Frame(active().createDataFrame(table))


def from_records(rows: Sequence[Any], schema: Any = None) -> Frame:
    """Dicts, rows, tuples or dataclass instances."""
    import dataclasses

    rows = [dataclasses.asdict(r) if dataclasses.is_dataclass(r) else r for r in rows]
    return Frame(active().createDataFrame(rows, schema))


def from_columns(columns: Mapping[str, Sequence[Any]]) -> Frame:
    return from_arrow(pa.table(dict(columns)))


class _Piece(InputPartition):
    def __init__(self, path: str, batch: int) -> None:
        self.path, self.batch = path, batch


class _IpcReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.files = _files(path)

    def partitions(self):
        out = []
        for f in self.files:
            with pa.memory_map(f) as source:
                out += [_Piece(f, k) for k in range(pa.ipc.open_file(source).num_record_batches)]
        return out or [_Piece("", -1)]

    def read(self, partition):
        if partition.path:
            with pa.memory_map(partition.path) as source:
                yield pa.ipc.open_file(source).get_batch(partition.batch)


class IpcSource(DataSource):
    """Arrow IPC files, one task a record batch. Files must be on a path that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(_files(self.options["path"])[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema):
        return _IpcReader(self.options["path"])


def _files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.arrow"))) if os.path.isdir(path) else sorted(glob.glob(path))


def read_ipc(path: str) -> Frame:
    spark = active()
    spark.dataSource.register(IpcSource)
    return Frame(spark.read.format("arrow_ipc").load(path))


def write_ipc(frame: Frame, path: str) -> None:
    """One file a partition, in place of all that an earlier write left in the folder.

    Tasks write under names of this run, and only once all have ended do the files get theirs; a run that fails leaves
    the folder as it was. The folder must be on a path that the driver and all executors mount.
    """
    os.makedirs(path, exist_ok=True)
    run = uuid.uuid4().hex
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(frame.df.schema)

    def write(batches):
        from pyspark import TaskContext

        at = os.path.join(path, f"part-{TaskContext.get().partitionId():05d}.arrow")
        mine = f"{at}.{TaskContext.get().taskAttemptId()}-{run}"
        with pa.OSFile(mine, "wb") as sink, pa.ipc.new_file(sink, schema) as out:
            for b in batches:
                out.write_batch(b.cast(schema))
        yield pa.RecordBatch.from_pydict({"at": [at], "mine": [mine]})

    written = {r["at"]: r["mine"] for r in frame.df.mapInArrow(write, "at string, mine string").collect()}
    for old in set(glob.glob(os.path.join(path, "part-*.arrow"))) - set(written):
        os.remove(old)
    for at, mine in written.items():
        os.replace(mine, at)
    for spare in glob.glob(os.path.join(path, f"part-*-{run}")):
        os.remove(spare)


class _BatchReader(DataSourceReader):
    def __init__(self, make: Callable[[int], Iterable[pa.RecordBatch]], parts: int) -> None:
        self.make, self.parts = make, parts

    def partitions(self):
        return [_Piece("", k) for k in range(self.parts)]

    def read(self, partition):
        yield from self.make(partition.batch)


def scan_batches(make: Callable[[int], Iterable[pa.RecordBatch]], schema: str, partitions: int = 1) -> Frame:
    """A lazy frame over make(k), the batches of partition k, which is called anew for each run. The schema is given,
    so an empty stream keeps it."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "record_batches"

        def schema(self):
            return schema

        def reader(self, schema):
            return _BatchReader(make, partitions)

    spark = active()
    spark.dataSource.register(Source)
    return Frame(spark.read.format("record_batches").load())
