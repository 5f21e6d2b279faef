"""A streaming source over far listings: each batch holds the messages whose modseq lies beyond the last one.

Listings are Parquet files, one or more for each snapshot, in a folder that
every executor reads.  The offset is the greatest modseq seen; it comes from the
files' statistics, so the driver reads no rows, and files without a change are
not opened.  A batch commits the offset up to which it has read and not what
its own writes cause, so those are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

_COLUMNS = ["account", "channel", "uid", "flags", "modseq"]
_ARROW = pa.schema([("account", pa.int32()), ("channel", pa.int32()), ("uid", pa.int64()), ("flags", pa.int32()), ("modseq", pa.int64())])


class _Slice(InputPartition):
    def __init__(self, file: str, group: int, after: int, upto: int):
        self.file, self.group, self.after, self.upto = file, group, after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.store, self.path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.start = int(options.get("after", "0"))

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """File, row group, and its least and greatest modseq."""
        for f in sorted(self.store.get_file_info(fs.FileSelector(self.path, recursive=True)), key=lambda f: f.path):
            if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
                with self.store.open_input_file(f.path) as source:
                    meta = pq.ParquetFile(source).metadata
                    column = meta.schema.names.index("modseq")
                    for g in range(meta.num_row_groups):
                        stats = meta.row_group(g).column(column).statistics
                        if stats is not None and stats.has_min_max:
                            yield f.path, g, stats.min, stats.max

    def initialOffset(self) -> dict:
        return {"modseq": self.start}

    def latestOffset(self) -> dict:
        return {"modseq": max([self.start, *(top for *_, top in self._groups())])}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        a, b = start["modseq"], end["modseq"]
        return [_Slice(f, g, a, b) for f, g, least, top in self._groups() if top > a and least <= b]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(part.file) as source:
            table = pq.ParquetFile(source).read_row_group(part.group, columns=_COLUMNS).select(_COLUMNS).cast(_ARROW)
        own = table.filter(pc.and_(pc.greater(table["modseq"], part.after), pc.less_equal(table["modseq"], part.upto)))
        yield from own.to_batches()


class FarChanges(DataSource):
    """spark.readStream.format("far_changes").option("after", modseq).load(folder): account, channel, uid, flags, modseq."""

    @classmethod
    def name(cls) -> str:
        return "far_changes"

    def schema(self) -> str:
        return "account int, channel int, uid bigint, flags int, modseq bigint"

    def streamReader(self, schema):
        return _Reader(self.options)


def latest(changes: DataFrame) -> DataFrame:
    """One row for each message of a batch: its last state."""
    last = F.max_by(F.struct("flags", "modseq"), F.struct("modseq", "flags"))
    return changes.groupBy("account", "channel", "uid").agg(last.alias("m")).select("account", "channel", "uid", "m.*")


def follow(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None], after: int = 0) -> StreamingQuery:
    """Starts a query that hands each batch of changes, one row for each message, to apply and ends when all are read.

    A batch that fails is handed over again with the same rows and number, so
    apply should be idempotent by that number.
    """
    spark.dataSource.register(FarChanges)
    changes = spark.readStream.format("far_changes").option("after", str(after)).load(folder)
    return changes.writeStream.foreachBatch(lambda df, k: apply(latest(df), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
