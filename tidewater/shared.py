"""The folder that driver and executors share, and written tables in it that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Used only where the cluster names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all of Spark runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = FALLBACK_DIR
    return root.rstrip("/")


#: Rows of text that one task works on, where a small file holds many.
TEXT_ROWS = 20_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as their number asks for: a file of a few MB is read by one task, however much is worked out of each row."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TEXT_ROWS))
    return rows.repartition(tasks, key)


_ROOTS: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Deletes what the operators of this program wrote for themselves; results are read from it until then."""
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):  # the session may have ended, and its JVM with it
            if spark.sparkContext._jsc is not None:
                fs_delete(spark, root)


class Scratch:
    """Written tables that cut lineage, below the shared folder; they go when the program ends, or by drop().

    Every table is complete once it is committed, so an executor that is lost
    later costs nothing but the tasks it was running.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, files: int | None = None, **options: str) -> DataFrame:
        """files bounds the number of files, and so of tasks, of a table that is small for its number of partitions."""
        writer = (df if files is None else df.coalesce(files)).write.options(**options)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df.schema if partition_by is None else None)

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            fs_delete(self.spark, self.path(name))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fs_delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
