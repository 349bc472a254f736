"""SQL over registered frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .frame import Frame
from .session import active


class SqlContext:
    """Names of frames for queries; names are this context's own and gone when it closes."""

    def __init__(self) -> None:
        self.tag = uuid.uuid4().hex[:12]
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, frame: Frame | DataFrame) -> SqlContext:
        self.frames[name] = frame.df if isinstance(frame, Frame) else frame
        return self

    def execute(self, query: str) -> Frame:
        """Lazy, as any frame. Frames are common table expressions of the query, so no name leaves this context."""
        spark = active()
        head = []
        for name, df in self.frames.items():
            view = f"v_{self.tag}_{name}"
            df.createOrReplaceTempView(view)
            head.append(f"`{name}` AS (SELECT * FROM `{view}`)")
        if not head:
            return Frame(spark.sql(query))
        text = query.strip().rstrip(";")
        return Frame(spark.sql(f"WITH {', '.join(head)} SELECT * FROM ({text})" if not _ordered(text) else f"WITH {', '.join(head)} {text}"))

    def close(self) -> None:
        for name in self.frames:
            active().catalog.dropTempView(f"v_{self.tag}_{name}")
        self.frames.clear()

    def __enter__(self) -> SqlContext:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _ordered(text: str) -> bool:
    """A query that doesn't start with its own WITH goes under ours as it is, and keeps its order."""
    return not text.lower().startswith("with")
