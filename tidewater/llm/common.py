"""Plumbing shared by the corpus operators: shared storage, Arrow batches, text folding."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.shared import Scratch, fs_delete, shared_root

#: Text handled at once in one worker; a single longer text is handled alone.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of about BATCH_BYTES, not of 10,000 rows whatever their length."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 * BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as worker processes are used again."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that df reads, by the optimizer's figures; None where one has no known size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(x >= 1 << 60 for x in sizes) else sum(sizes)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of the tables that df reads, or else of its texts, which takes a pass over them."""
    known = plan_bytes(df)
    return known if known is not None else int(df.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions so that each holds about bytes_each of what df reads, which is a written table; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(plan_bytes(df) or 0) // bytes_each))


def few_files(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Files for tables that hold a few bytes for each row of df: four for each core, or more for a large input."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-(plan_bytes(df) or 0) // bytes_each))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `most` bytes in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most or i - start >= 4096):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df but those whose names clash, whatever their case, with result columns."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    fields: list[T.StructField],
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds columns worked out from whole texts, in Arrow batches and without a shuffle.

    make() runs once in a task and gives a function from UTF-8 texts to the
    arrays of `fields`.  carry names the columns to keep (None: all); kept
    columns that clash with a result column are replaced by it.
    """
    kept = [c for c in without(df, [f.name for f in fields]) if carry is None or c in carry]
    bound_batches(df.sparkSession)
    source = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(text_col).cast("binary").alias("t"))
    inner = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)])
    names = inner.names
    n_kept = len(kept)

    def run(batches):
        work = make()
        for whole in batches:
            for part in slices(whole, "t"):
                made = work(part.column(n_kept).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_kept)] + made, names=names)
        tidy()

    out = source.mapInArrow(run, inner)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)])


#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []
