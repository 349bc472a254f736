"""Databases by JDBC, and by any DB-API driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

import pyarrow as pa

from ..frame import Frame
from ..session import active
from .arrow import scan_batches

BATCH = 50_000


def read_jdbc(url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **properties: str) -> Frame:
    """With a column and its bounds, that many partitions read the table side by side."""
    split = {"column": column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions} if column else {}
    return Frame(active().read.jdbc(url, table, properties=properties, **split))


def write_jdbc(frame: Frame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    frame.df.write.jdbc(url, table, mode=mode, properties=properties)


def read_dbapi(connect: Callable[[], Any], queries: list[str], schema: str, batch: int = BATCH) -> Frame:
    """One partition a query; each opens its own connection whenever the frame runs."""

    def rows(k: int) -> Iterable[pa.RecordBatch]:
        connection = connect()
        try:
            cursor = connection.cursor()
            cursor.execute(queries[k])
            names = [d[0] for d in cursor.description]
            while found := cursor.fetchmany(batch):
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in found] for i, n in enumerate(names)})
        finally:
            connection.close()

    return scan_batches(rows, schema, len(queries))


def write_dbapi(frame: Frame, connect: Callable[[], Any], insert: str, batch: int = BATCH, overrides: Mapping[str, Callable[[Any], Any]] | None = None) -> None:
    """Each partition inserts its rows in batches through its own connection and commits once, at its end.

    A task reads on only when its batch is in, so it holds `batch` rows at most. overrides: by column, what makes of a
    value the one that the driver takes; nulls stay None.
    """
    given = dict(overrides or {})
    frame._known(*given)
    makers = [given.get(c) for c in frame.columns]

    def write(rows) -> None:
        connection = connect()
        try:
            cursor, held = connection.cursor(), []
            for r in rows:
                held.append(tuple(v if f is None or v is None else f(v) for v, f in zip(r, makers)))
                if len(held) == batch:
                    cursor.executemany(insert, held)
                    held.clear()
            if held:
                cursor.executemany(insert, held)
            connection.commit()
        finally:
            connection.close()

    frame.df.foreachPartition(write)
