"""Server replies as logical lines: a line that ends in {N} goes on after N bytes of literal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_LITERAL = re.compile(rb"\{([0-9]+)\}$")


def logical_lines(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """(line, body) of each complete logical line.

    Literals are cut out of the line.  Those of a message body (after BODY[)
    are the body, with CRLF as LF and other carriage returns kept; the rest are
    skipped.  A line or literal that is not complete is an error.
    """
    at, line, body = 0, b"", None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("connection lost")
        own = data[at:end].removesuffix(b"\r")
        line, at = line + own, end + 1
        if m := _LITERAL.search(line):
            line, size = line[: m.start()], int(m[1])
            if at + size > len(data):
                raise ValueError("connection lost")
            if b"BODY[" in line:
                body = (body or b"") + data[at : at + size].replace(b"\r\n", b"\n")
            at += size
            if at >= len(data):
                raise ValueError("connection lost")
            continue
        yield line, body
        line, body = b"", None
    if line:
        raise ValueError("connection lost")


def reply_lines(streams: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """The logical lines of each recorded stream: id, number from 0, line (bytes beyond UTF-8 replaced), body."""
    kind = streams.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                made = list(logical_lines(b.column(1)[row].as_py() or b""))
                ids = b.column(0).take(pa.array([row] * len(made), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(made)), pa.int64()), pa.array([x.decode("utf-8", "replace") for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.binary())], names=["id", "number", "line", "body"])

    return streams.selectExpr(f"`{id_col}` AS id", f"cast(`{data_col}` AS binary) AS data").mapInArrow(run, f"id {kind}, number long, line string, body binary")
