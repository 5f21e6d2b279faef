"""What a run saves: versioned tables behind a pointer, and the text files of single folders.

Tables go to any store that Spark writes to.  A version is complete before the
pointer names it, and the pointer is replaced by one rename, so readers see the
old or the new version, never a part; plain overwriting gives no such promise.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources.maildir import BASELINE, BASELINE_HEAD, BASELINE_VERSION, HEADERS, FolderState

_LETTERS = ((16, "D"), (4, "F"), (32, "P"), (2, "R"), (1, "S"), (8, "T"))


def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(tables: dict[str, DataFrame], root: str) -> str:
    """Writes a new version of all tables (pairs, headers, baseline ...) and then points to it."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    mine, fs = _path(spark, f"{root}/.current-{version}")
    out = fs.create(mine, True)
    out.write(bytearray(version.encode()))
    out.hsync()
    out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(mine, _path(spark, f"{root}/CURRENT")[0], options)
    return version


def load(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the version that the pointer names; null before the first save."""
    pointer, fs = _path(spark, f"{root}/CURRENT")
    if not fs.exists(pointer):
        return None
    version = spark.read.text(pointer.toString(), wholetext=True).first()["value"]
    return spark.read.parquet(f"{root}/{version}/{name}")


def _replace(path: str, lines: Iterable[str]) -> None:
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(mine, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(lines)
            out.flush()
            os.fsync(out.fileno())
        os.replace(mine, path)
    finally:
        if os.path.exists(mine):
            os.unlink(mine)


def write_state(path: str, state: FolderState, pairs: Iterable[tuple[int | None, int | None, int]] | None = None) -> None:
    """A folder's state file, as `read_state` reads it; pairs may come from toLocalIterator, so that none are gathered."""
    head = [f"{name} {getattr(state, own)}\n" for name, own in HEADERS.items()]
    letters = lambda flags: "".join(c for b, c in _LETTERS if flags & b)
    rows = (f"{f or 0} {n or 0} {letters(flags)}\n" for f, n, flags in (state.pairs if pairs is None else pairs))
    _replace(path, (line for part in (head, ["\n"], rows) for line in part))


def write_uid_validity(path: str, validity: int, last: int) -> None:
    _replace(path, [f"{validity}\n{last}\n"])


def write_baseline(path: str, baseline: dict[str, int]) -> None:
    """A folder's baseline; it may be lost, which only costs a full listing."""
    _replace(path, [f"{BASELINE_HEAD} {BASELINE_VERSION}\n", *(" ".join([key, *(str(baseline[n]) for n in names)]) + "\n" for key, names in BASELINE.items())])
