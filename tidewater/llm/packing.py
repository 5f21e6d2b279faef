"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths.

Best fit looks only at lengths and remaining capacities, and pieces of one
length are interchangeable.  So the driver plans on at most max_len counts,
whatever the number of documents: it goes through the lengths from the longest
on, finds the tightest open bins with a segment tree over remaining capacities,
and places a whole run of equal pieces into a run of equal bins at once.  The
plan is that of best-fit decreasing over all pieces of the corpus.  Every piece
then looks up its own place by its length and its rank among its equals.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import fsio
from tidewater.llm.common import Scratch, bound_batches, partitions_for, quoted, slices, tidy
from tidewater.llm.tokens import default_vocabulary, word_tokenizer

MAX_LEN = 2048
_RANK_BITS = 44
#: monotonically_increasing_id() numbers rows in this many bits, below the number of the partition.
_PART_BITS = 33


class CapacityTree:
    """A segment tree over remaining capacities; a leaf is set while a bin with that capacity is open."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.most = most
        self.full = [False] * (2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.full[i] = is_open
        while i > 1:
            i >>= 1
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least `need`, in logarithmic time."""
        if need > self.most:
            return None
        i = need + self.leaves
        if self.full[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass
class Plan:
    """Sorted by length and first rank: pieces of a length from a rank on go `each` to a bin, from a bin and an offset on."""

    keys: np.ndarray
    each: np.ndarray
    bins: np.ndarray
    offsets: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << _RANK_BITS) + rank
        i = np.searchsorted(self.keys, key, "right") - 1
        local = key - self.keys[i]
        return self.bins[i] + local // self.each[i], self.offsets[i] + local % self.each[i] * length


def plan_packing(histogram: dict[int, int], max_len: int = MAX_LEN) -> Plan:
    """Best-fit decreasing over counts by length; lengths are 1 to max_len."""
    tree = CapacityTree(max_len)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int]] = []
    n_bins = 0

    def push(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            open_runs.setdefault(capacity, []).append((first, count))
            tree.put(capacity, True)

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = max_len, max_len // length
                first, count = n_bins, -(-left // each)
                n_bins += count
            else:
                each = capacity // length
                first, count = open_runs[capacity].pop()
                used = min(count, -(-left // each))
                if used < count:
                    open_runs[capacity].append((first + used, count - used))
                elif not open_runs[capacity]:
                    tree.put(capacity, False)
                count = used
            placed = min(left, count * each)
            rows.append(((length << _RANK_BITS) + rank, each, first, max_len - capacity))
            filled, rest = divmod(placed, each)
            push(capacity - each * length, first, filled)
            if rest:
                push(capacity - rest * length, first + filled, 1)
            left, rank = left - placed, rank + placed
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(4)), n_bins)


def token_pieces(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, with_ids: bool = False, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most max_len ids: doc_id, piece, start, length, and ids_crc32 or, if asked for, the ids themselves.

    A document is its ids and then `end`; a null text is an empty one.  Only a
    longer document is cut, every max_len ids; nothing is lost.  Each input row
    is a document of its own, repeated and null ids included.  ids holds
    little-endian unsigned 16-bit numbers, or 32-bit ones for a large vocabulary,
    compressed by zstd so that shuffles move less.
    """
    bound_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    fields.append(T.StructField("ids", T.BinaryType()) if with_ids else T.StructField("ids_crc32", T.LongType()))

    def run(batches):
        tokenizer = word_tokenizer(vocabulary)
        kind = "<u2" if tokenizer.size <= 1 << 16 else "<u4"
        packer = zstandard.ZstdCompressor(level=6)
        for whole in batches:
            for part in slices(whole, "t"):
                ids, bounds = tokenizer.encode(part.column(1).to_pylist(), end)
                data = ids.astype(kind if with_ids else "<u4").tobytes()
                width = len(data) // max(1, len(ids))
                row, piece, start, length, last = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for k, s in enumerate(range(a, b, max_len)):
                        e = min(b, s + max_len)
                        row.append(i)
                        piece.append(k)
                        start.append(s - a)
                        length.append(e - s)
                        own = data[width * s : width * e]
                        last.append(packer.compress(own) if with_ids else zlib.crc32(own))
                made = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(last, pa.binary() if with_ids else pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])
        tidy()

    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("t")).mapInArrow(run, T.StructType(fields))


def _ranked(pieces: DataFrame, scratch: Scratch, max_len: int) -> tuple[DataFrame, DataFrame]:
    """The stored pieces with a row number each, and (row, sequence_id, offset) by best-fit decreasing over all of them.

    The pieces are written once, with a row number; a rank that is worked out
    again after a lost executor is therefore the same.
    """
    stored = scratch.write(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces", compression="zstd").withColumn("part", F.shiftright("row", _PART_BITS))
    by_part = scratch.write(stored.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    plan = plan_packing(histogram, max_len)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part", "length").orderBy("row")
    ranks = stored.select("row", "part", "length").withColumn("k", F.row_number().over(own) - 1)
    ranked = ranks.join(first.hint("merge"), ["part", "length"]).select("row", "length", (F.col("k") + F.col("first")).alias("rank"))

    def place(batches):
        for b in batches:
            row, length, rank = b.columns
            bins, offsets = plan.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([row, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=["row", "sequence_id", "offset"])

    return stored.drop("part"), ranked.mapInArrow(place, "row long, sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, scratch: Scratch, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length`; packs all of them by best-fit decreasing."""
    stored, placed = _ranked(pieces, scratch, max_len)
    return stored.join(placed, "row").drop("row")


def pack_in_place(pieces: DataFrame, scratch: Scratch, max_len: int = MAX_LEN) -> DataFrame:
    """As pack_pieces, for pieces that carry ids: only row numbers and places are shuffled.

    The places of each part, which is what one task wrote, become a file in the
    shared folder; tasks that read a part's pieces look their places up there.
    """
    stored, placed = _ranked(pieces, scratch, max_len)
    root = scratch.path("places")

    def store(batches):
        part, held = None, []

        def close():
            fsio.put(f"{root}/{part}", np.concatenate(held, axis=1).astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["part"])

        for b in batches:
            table = np.stack([c.to_numpy() for c in b.columns])
            for run in np.split(table, np.flatnonzero(np.diff(table[0] >> _PART_BITS)) + 1, axis=1):
                if not run.shape[1]:
                    continue
                own = int(run[0, 0] >> _PART_BITS)
                if own != part and held:
                    yield close()
                    held = []
                part = own
                held.append(run)
        if held:
            yield close()

    n = partitions_for(stored, 64 << 20)
    by_part = placed.repartition(n, F.shiftright("row", _PART_BITS)).sortWithinPartitions("row")
    scratch.write(by_part.mapInArrow(store, "part long"), "parts")
    names = [c for c in stored.columns if c != "row"]

    def look_up(batches):
        part, places = None, np.zeros((3, 0), np.int64)
        for b in batches:
            row = b.column(0).to_numpy()
            found = np.zeros((2, len(row)), np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(row >> _PART_BITS)) + 1).tolist(), len(row)]
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end > start:
                    own = int(row[start] >> _PART_BITS)
                    if own != part:
                        part, places = own, np.frombuffer(fsio.get(f"{root}/{own}"), "<i8").reshape(3, -1)
                    found[:, start:end] = places[1:, np.searchsorted(places[0], row[start:end])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found[0]), pa.array(found[1])], names=[*names, "sequence_id", "offset"])

    fields = [stored.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return stored.select("row", *names).mapInArrow(look_up, T.StructType(fields))


def pack(docs: DataFrame, vocabulary: str | None = None, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty table gives no rows; null and empty texts give one piece, the end
    id alone; equal lengths are placed in the order of the input.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, vocabulary or default_vocabulary(), max_len, id_col=id_col, text_col=text_col)
    return pack_pieces(pieces, scratch, max_len)


def op6_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
