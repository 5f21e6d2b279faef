"""Packed token ids as binary files: id matrices, cumulative segment lengths and position resets.

Pieces are packed by best-fit decreasing (packing.py).  Blocks of BLOCK_ROWS
sequences become three files each: the id matrix, row after row and padded; for
each row the cumulative lengths of its segments; and for each row the offsets
at which positions start again at 0, the padding's start among them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import fsio
from tidewater.llm.common import Scratch, partitions_for
from tidewater.llm.packing import MAX_LEN, pack_in_place, token_pieces
from tidewater.llm.tokens import default_vocabulary, word_tokenizer

BLOCK_ROWS = 1024


def ragged(rows: list[list[int]]) -> bytes:
    """The number of rows, the bounds of each row and the values, as little-endian 32-bit numbers."""
    bounds = np.cumsum([0, *map(len, rows)])
    return np.concatenate(([len(rows)], bounds, [v for r in rows for v in r])).astype("<i4").tobytes()


def unragged(data: bytes) -> list[list[int]]:
    x = np.frombuffer(data, "<i4")
    n = int(x[0])
    bounds, values = x[1 : n + 2], x[n + 2 :].tolist()
    return [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def position_ids(resets: list[int], length: int) -> np.ndarray:
    out = np.arange(length)
    for a, b in zip(resets, [*resets[1:], length]):
        out[a:b] -= a
    return out


def write_packed(docs: DataFrame, root: str | None = None, vocabulary: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """Writes all documents and gives an index row for each piece: doc_id, piece, start, length, sequence_id, offset, block, row.

    Null and empty texts are the end id alone; an empty table writes no file.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    scratch = Scratch(spark, "tokens")
    root = root or scratch.path("files")
    kind = "<u2" if word_tokenizer(vocabulary).size <= 1 << 16 else "<u4"
    placed = pack_in_place(token_pieces(docs, vocabulary, max_len, with_ids=True), scratch, max_len)
    placed = placed.withColumn("block", F.floor(F.col("sequence_id") / BLOCK_ROWS).cast("long"))

    def write(batches):
        block, rows = None, []
        unpacker = zstandard.ZstdDecompressor()

        def close():
            height = 1 + max(r[4] for r in rows) % BLOCK_ROWS
            ids = np.zeros((height, max_len), kind)
            ends, resets = [[0] for _ in range(height)], [[] for _ in range(height)]
            for _, _, _, length, seq, offset, data in rows:
                r = seq % BLOCK_ROWS
                ids[r, offset : offset + length] = np.frombuffer(unpacker.decompress(data), kind)
                ends[r].append(offset + length)
                resets[r].append(offset)
            for r in range(height):
                if ends[r][-1] < max_len:
                    resets[r].append(ends[r][-1])
            name = f"{root}/block-{block:09d}"
            fsio.put(f"{name}.ids", ids.tobytes())
            fsio.put(f"{name}.cu_seqlens", ragged(ends))
            fsio.put(f"{name}.resets", ragged(resets))
            cols = list(zip(*rows))
            kinds = [doc_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:6], kinds)] + [pa.array([block] * len(rows), pa.int64())], names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "block"])

        doc_type = pa.int64()
        for b in batches:
            doc_type = b.schema.field(0).type
            for *row, own in zip(*(c.to_pylist() for c in b.columns)):
                if own != block and rows:
                    yield close()
                    rows = []
                block = own
                rows.append(row)
        if rows:
            yield close()

    wide = placed.select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids", "block")
    sorted_ = wide.repartition(partitions_for(wide, 8 << 20), "block").sortWithinPartitions("block", "sequence_id", "offset")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, sequence_id long, offset long, block long"
    index = scratch.write(sorted_.mapInArrow(write, schema), "index")
    return index.withColumns({"root": F.lit(root), "kind": F.lit(kind)})


def read_packed(index: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Every piece read back from the files: its ids' CRC-32, and whether lengths and resets agree with the index."""

    def run(batches):
        block, ids, ends, resets = None, None, [], []
        for b in batches:
            crc, good = [], []
            for seq, offset, length, own, root, kind in zip(*(b.column(n).to_pylist() for n in ("sequence_id", "offset", "length", "block", "root", "kind"))):
                if own != block:
                    block, name = own, f"{root}/block-{own:09d}"
                    ids = np.frombuffer(fsio.get(f"{name}.ids"), kind).reshape(-1, max_len)
                    ends, resets = unragged(fsio.get(f"{name}.cu_seqlens")), unragged(fsio.get(f"{name}.resets"))
                r = seq % BLOCK_ROWS
                crc.append(zlib.crc32(ids[r, offset : offset + length].astype("<u4").tobytes()))
                good.append(offset in resets[r] and offset + length in ends[r])
            keep = [b.column(n) for n in ("doc_id", "piece", "start", "length", "sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32", "boundaries_agree"])

    schema = f"doc_id {index.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long, boundaries_agree boolean"
    return index.repartition(partitions_for(index, 1 << 20), "block").sortWithinPartitions("block").mapInArrow(run, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as packed id matrices, and every piece read back."""
    return read_packed(write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
