"""Batches handed to a function: on executors, or one after another on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from ..frame import Frame


def sink_batches(frame: Frame, f: Callable[[pa.RecordBatch], None]) -> None:
    """f runs on the executors, batch by batch; its errors fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            f(b)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"rows": [n]})

    frame.df.mapInArrow(run, "rows long").agg({"rows": "sum"}).collect()


def export_batches(frame: Frame, f: Callable[[pa.RecordBatch], None]) -> None:
    """f runs on the driver, for results that fit there; its errors reach the caller."""
    for b in frame.to_arrow().to_batches():
        f(b)
