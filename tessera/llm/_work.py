"""Shared plumbing: intermediate tables in the cluster's shared folder, bounded broadcasts and id joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids or 64-bit keys that may be broadcast at most (8 MB); beyond it a shuffle join does the same work.
BROADCAST_KEYS = 1_000_000

#: Bytes of one Arrow batch sent to a Python worker; keeps long texts from piling up in one batch.
ARROW_BATCH_BYTES = 4 << 20

#: Bytes of a row group, which a writer holds in memory until it is full.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; only where that is unset and there is but this machine,
    as in tests, a folder of our own."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then left to its owner
            return


class Workspace:
    """Tables of one operator call, written as Parquet below the shared folder and removed when the driver ends.

    A written table cuts lineage: a lost executor costs only the tasks since the last one.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES)),):
            spark.conf.set(key, value)
        atexit.register(_at_exit, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").options(**{"parquet.block.size": str(ROW_GROUP_BYTES), **options}).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def numbered(self, df: DataFrame, row: str, name: str = "numbered") -> DataFrame:
        """df with a number of its own for each row, written so that it never changes."""
        return self.save(df.withColumn(row, F.monotonically_increasing_id()), name, compression="zstd")

    def drop(self, name: str) -> None:
        self.names.discard(name)
        _remove(self.spark, self.path(name))

    def finish(self, before: set[str], *keep: str) -> None:
        """An operator is done: what it has written since there were the tables `before` goes, but for those to keep."""
        for name in self.names - before - set(keep):
            self.drop(name)
        self.release()

    def release(self) -> None:
        """Shuffle files that no table needs any more go. Spark removes them when the driver's collector finds their
        plans unused, and in a job whose work is done by Python tasks that may not run for long. Spark's event queues
        hold the plan that ended last until something else happens, hence the empty job."""
        self.spark.range(0).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: str = "text"):
    """The column's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray(b"")))


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is among keys: broadcast up to BROADCAST_KEYS keys, else by shuffle."""
    return df.join(small_side(keys.select(on).distinct()), on, "left_semi")


def small_side(keys: DataFrame) -> DataFrame:
    """Ids or 64-bit keys, a few in a row, to be broadcast where there are up to BROADCAST_KEYS rows of them."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def per_gb_partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which follow the input's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
