"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Each task rolls two independent hashes over all windows of its documents
   (prefix sums of powers, so a whole batch at once).  One picks the bucket, the
   other is counted.  What repeats inside a task is settled there: of equal
   windows only the one of the smallest document goes on, so a passage that
   every document holds is sent once by each task, never in one row a document.
2. Windows meet by bucket, packed many to a row.  A window whose smallest
   document is another one is answered to the documents that hold it.
3. Answers and texts are dealt and sorted together by blocks of documents, a
   block's answers before its texts, so that texts pass one at a time; the
   windows are merged there into maximal removal intervals.

A counted window is told apart by 64 bits and the bucket's bits of the second
hash; buckets grow with the input, and with them the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tidewater.llm.common import bound_batches, few_files, input_bytes, quoted, slices, space_words, tidy, without

WINDOW = 50
#: Windows that a task holds before it sends them, and answers that it gathers.
FLUSH = 1 << 20
#: Input bytes for each bucket, and documents (ids) in each block of answers.
BUCKET_BYTES, BLOCK_BITS = 1 << 20, 6

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BASE_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class WindowHasher:
    """Rabin-Karp hashes modulo 2^64 of all windows of a run of words."""

    def __init__(self, window: int):
        self.window = window
        self.powers = [np.ones(1, np.uint64)] * 4

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            size = 1 << n.bit_length()
            for k, base in enumerate((*_BASES, *_BASE_INVERSES)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                self.powers[k] = np.multiply.accumulate(p)

    def roll(self, x: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """For every start the hash of its window, and the second hash if asked for."""
        self._grow(len(x) + 1)
        return self._roll(x, 0), self._roll(_mix(x ^ np.uint64(_BASES[1])), 1) if second else None

    def _roll(self, x: np.ndarray, k: int) -> np.ndarray:
        n, w = len(x), self.window
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.powers[k][:n], out=sums[1:])
        return _mix((sums[w:] - sums[:-w]) * self.powers[k + 2][: n - w + 1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, one after another, and where each text begins."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        words += space_words(text)
        bounds.append(len(words))
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), np.array(bounds)


def _min_by_group(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where the groups begin, and each row's smallest document of its group."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.flatnonzero(new)
    return starts, np.minimum.reduceat(docs, starts)[np.cumsum(new) - 1]


def _pack(docs: np.ndarray, keys: np.ndarray) -> bytes:
    base = docs.min()
    away = docs - base
    kind = "<u2" if away.max() < 1 << 16 else "<u4" if away.max() < 1 << 32 else "<u8"
    return np.array([len(keys), base, int(kind[2])], "<i8").tobytes() + keys.astype("<u8").tobytes() + away.astype(kind).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, base, width = np.frombuffer(data, "<i8", 3).tolist()
    return np.frombuffer(data, f"<u{width}", n, 24 + 8 * n).astype(np.int64) + base, np.frombuffer(data, "<u8", n, 24)


_ROWS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("answer", T.BooleanType()), T.StructField("packed", T.BinaryType())])
_ANSWERS = T.StructType([T.StructField("block", T.LongType()), T.StructField("packed", T.BinaryType())])


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds["long" if f.dataType == T.LongType() else f.dataType.typeName()]) for k, f in enumerate(schema)], names=schema.names)


def _answers(docs: np.ndarray, keys: np.ndarray):
    """Rows (block, packed) of windows to remove."""
    order = np.argsort(docs >> BLOCK_BITS, kind="stable")
    docs, keys = docs[order], keys[order]
    blocks = docs >> BLOCK_BITS
    cuts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(blocks[a]), _pack(docs[a:b], keys[a:b])


def _send(bits: int, window: int):
    def run(batches):
        hasher = WindowHasher(window)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            keys, buckets, docs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys, kind="stable")
            order = order[np.argsort(buckets[order], kind="stable")]
            keys, buckets, docs = keys[order], buckets[order], docs[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])))
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(docs, starts)
            later = docs > least[np.cumsum(new) - 1]
            rows = []
            if later.any():
                rows += [(block % (1 << bits), True, np.int64(block).tobytes() + packed) for block, packed in _answers(docs[later], keys[later])]
            keys, buckets = keys[starts], buckets[starts]
            cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True])))
            rows += [(int(buckets[a]), False, _pack(least[a:b], keys[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            for i in range(0, len(rows), 256):
                yield _batch(_ROWS, rows[i : i + 256])

        for whole in batches:
            for part in slices(whole, "t"):
                x, bounds = word_hashes(part.column(1).to_pylist())
                if len(x) < window:
                    continue
                sizes = np.diff(bounds)
                inside = np.arange(len(x)) + window <= np.repeat(bounds[1:], sizes)
                at = np.flatnonzero(inside)
                if len(at):
                    keys, second = hasher.roll(x, True)
                    buckets = (second[at] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                    held.append((keys[at], buckets, np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)[at]))
                    size += len(at)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        tidy()

    return run


def _meet(batches):
    """Of rows sorted by bucket: which documents hold a window that also starts in a smaller one."""
    bucket, held = None, []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle():
        docs, keys = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        docs, keys = docs[order], keys[order]
        _, least = _min_by_group(keys, docs)
        later = docs > least
        return docs[later], keys[later]

    def out():
        rows = list(_answers(*(np.concatenate(x) for x in zip(*found))))
        for i in range(0, len(rows), 1024):
            yield _batch(_ANSWERS, rows[i : i + 1024])

    for b in batches:
        for key, answer, packed in zip(*(c.to_pylist() for c in b.columns)):
            if answer:
                yield _batch(_ANSWERS, [(int(np.frombuffer(packed, "<i8", 1)[0]), packed[8:])])
                continue
            if key != bucket and held:
                found.append(settle())
                size += len(found[-1][0])
                held = []
                if size >= FLUSH:
                    yield from out()
                    found, size = [], 0
            bucket = key
            held.append(_unpack(packed))
    if held:
        found.append(settle())
    if any(len(f[0]) for f in found):
        yield from out()


def _intervals(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that the windows starting at `hit` cover."""
    if not len(hit):
        return []
    gap = np.flatnonzero(hit[1:] > hit[:-1] + window)
    first = np.concatenate((hit[:1], hit[gap + 1]))
    last = np.concatenate((hit[gap], hit[-1:])) + window
    return list(zip(first.tolist(), last.tolist()))


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _by_document(answers: list[bytes]) -> dict[int, np.ndarray]:
    """The windows to remove from each document of a block."""
    if not answers:
        return {}
    ids, keys = (np.concatenate(x) for x in zip(*map(_unpack, answers)))
    order = np.argsort(ids, kind="stable")
    ids, keys = ids[order], keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    return {int(ids[a]): keys[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}


def _cut(names: list[str], n_kept: int, window: int):
    """From rows (kept columns, d, t, block, packed) sorted by block, its answers first, the texts without their repeats."""

    def run(batches):
        hasher = WindowHasher(window)
        block, answers, gone = None, [], {}
        for whole in batches:
            for part in slices(whole, "t"):
                n_words, removed, texts = [], [], []
                for b, packed, doc, text in zip(*(part.column(c).to_pylist() for c in ("block", "packed", "d", "t"))):
                    if b != block:
                        block, answers, gone = b, [], {}
                    if packed is not None:
                        answers.append(packed)
                        continue
                    if answers:
                        gone, answers = _by_document(answers), []
                    words = space_words(text)
                    ranges = []
                    if doc in gone and len(words) >= window:
                        keys, _ = hasher.roll(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
                        ranges = _intervals(np.flatnonzero(np.isin(keys, gone[doc])), window)
                    n_words.append(len(words))
                    removed.append([{"start": x, "end": y} for x, y in ranges])
                    for x, y in reversed(ranges):
                        del words[x:y]
                    texts.append(b" ".join(words))
                if texts:
                    own = part.filter(pc.is_null(part.column("packed")))
                    made = [pa.array(n_words, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([own.column(i) for i in range(n_kept)] + made, names=names)
        tidy()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_words, removed (maximal intervals of word positions) and kept_text.

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller id; windows are judged on the input.  kept_text is
    the other words, joined by one space.  Ids are integers.  Rows of one id
    are one document here: they never remove from each other, and each loses
    what a smaller id holds.  A document without an id neither removes nor
    loses words.  Null and empty texts have no words; shorter texts no window;
    an empty table gives no rows.
    Columns of the same name in docs are replaced.
    """
    spark = docs.sparkSession
    keyed = docs.select(quoted(id_col).cast("long").alias("d"), quoted(text_col).cast("binary").alias("t"))
    bound_batches(spark)
    size = input_bytes(keyed, "t")
    bits = min(30, max(6, (size // BUCKET_BYTES).bit_length()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 << 20)))
    sent = keyed.where("d is not null").mapInArrow(_send(bits, window), _ROWS)
    answers = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _ANSWERS)

    fields = [T.StructField("n_words", T.LongType()), T.StructField("removed", _RANGES), T.StructField("kept_text", T.StringType())]
    kept = [c for c in without(docs, [f.name for f in fields]) if carry is None or c in carry]
    inner = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)])
    n_kept = len(kept)
    d = quoted(id_col).cast("long")
    block = F.coalesce(F.shiftright(d, BLOCK_BITS), -1 - F.abs(F.xxhash64(quoted(text_col)) % (1 << 40)))
    texts = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], d.alias("d"), quoted(text_col).cast("binary").alias("t"), block.alias("block"), F.lit(None).cast("binary").alias("packed"))
    bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema if f.name not in ("block", "packed")]
    both = texts.unionAll(answers.select(*bare, "block", "packed")).repartition(n, "block").sortWithinPartitions("block", F.col("packed").isNull())
    out = both.mapInArrow(_cut(inner.names, n_kept, window), inner)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its words, those that repeat 50-word windows of earlier documents, and a digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, carry=["doc_id"]).coalesce(few_files(docs))
    return out.select(
        "doc_id",
        "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )
