"""Near-duplicate documents by HyperMinHash.

1. A document's distinct word shingles are dealt to 128 buckets by their hash's
   top bits.  Of each bucket's smallest hash a 16-bit register keeps the count
   of leading zeros and ten mantissa bits; an empty bucket takes the smallest
   of a permutation of its own.  Documents with equal sets are one class from
   here on.
2. Bands of registers bring classes together.  In each band bucket every class
   is paired with the smallest one; pairs whose collision-corrected Jaccard
   estimate is far below the threshold fall away, and the others are confirmed
   on full sets.  So a large group gives a star, not all its pairs, and the text
   of its hub goes to a task for every PER_HUB of them, not to every pair.
3. Where a band bucket still holds several components, each class outside the
   largest one is compared, register against register and then by its least
   hashes, with all classes of other components, in tiles of at most BLOCK
   classes a side; only pairs that may well be links leave their tile, to be
   confirmed likewise.
4. Components come from large-star and small-star rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tidewater.llm.common import Scratch, bound_batches, few_files, lower_words, partitions_for, quoted, slices, tidy
from tidewater.llm.components import connected_components

SHINGLE = 5
REGISTERS, BUCKET_BITS, MANTISSA_BITS = 128, 7, 10
#: The chance that the bands miss a pair at the threshold, at most.
MISS = 1e-6
#: A pair is dropped unconfirmed if its estimate is this many standard deviations below the threshold.
SLACK = 6.0
#: Classes on each side of a tile, about; and pairs that share one copy of their hub's text.
BLOCK, PER_HUB = 1000, 256
#: Least hashes that compare two classes more closely before their pair leaves its block.
KMV = 256

_MASK = (1 << 64) - 1
_C = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(16)]
_BOUNDS = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.uint64)
_SEEDS = np.array([(0xA24BAED4963EE407 * (2 * k + 3)) & _MASK for k in range(REGISTERS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; fewer words than `size` are one shingle, none give none."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        words += lower_words(text)
        bounds.append(len(words))
    x = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(x) >= size:
        h = np.zeros(len(x) - size + 1, np.uint64)
        for j in range(size):
            h += x[j : j + len(h)] * np.uint64(_C[j])
            h ^= h >> np.uint64(29)
        h = _mix(h)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        else:
            out.append(np.array([xxh3_64_intdigest(b"\x00" + b" ".join(words[a:b]))], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of a sorted, non-empty set: leading zeros and mantissa of each bucket's smallest hash."""
    at = np.searchsorted(shingles, _BOUNDS)
    found = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero((at == len(shingles)) | (found >> np.uint64(64 - BUCKET_BITS) != np.arange(REGISTERS, dtype=np.uint64)))
    least = found & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    if len(empty):
        step = max(1, 65536 // len(shingles))
        for k in range(0, len(empty), step):
            part = empty[k : k + step]
            least[part] = _mix(shingles[None, :] ^ _SEEDS[part][:, None]).min(axis=1) >> np.uint64(BUCKET_BITS)
    mantissa, exponent = np.frexp(least.astype(np.float64))
    bits = np.minimum((mantissa - 0.5) * (2 << MANTISSA_BITS), (1 << MANTISSA_BITS) - 1)
    return (exponent * (1 << MANTISSA_BITS) + np.maximum(bits, 0)).astype("<u2")


def collision_rate(n: np.ndarray) -> np.ndarray:
    """The chance that two buckets with different minima have equal registers, for sets of n shingles."""
    m = np.maximum(1.0, np.asarray(n, np.float64) / REGISTERS)[:, None]
    edge = 0.5 ** np.arange(0, 57)
    share = (1 - edge[1:]) ** m - (1 - edge[:-1]) ** m
    return (share**2).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(equal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The Jaccard similarity from the number of equal registers, corrected for collisions."""
    c = collision_rate(n)
    return (equal / REGISTERS - c) / (1 - c)


def band_shape(threshold: float) -> tuple[int, int]:
    """Bands and rows: the most rows with a miss of at most MISS at the threshold."""
    for rows in range(8, 0, -1):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    return REGISTERS, 1


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For a matrix of registers the 64-bit key of each band."""
    x = regs[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(_C[9]), (len(regs), bands)).copy()
    for j in range(rows):
        h = _mix(h + x[:, :, j] * np.uint64(_C[j]) + np.uint64(j + 1))
    return h.view(np.int64)


def _sketch(size: int):
    names = ["doc_id", "n", "f1", "f2", "regs"]

    def run(batches):
        for whole in batches:
            for part in slices(whole, "t"):
                n, f, regs = [], [], []
                for own in shingle_sets(part.column(1).to_pylist(), size):
                    n.append(len(own))
                    f.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    regs.append(registers(own).tobytes() if len(own) else None)
                f = np.frombuffer(b"".join(f), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(regs, pa.binary())], names=names)
        tidy()

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _may_link(n_a, n_b, equal, percent: int) -> np.ndarray:
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    t = percent / 100
    least = t - SLACK * np.sqrt(t * (1 - t) / REGISTERS)
    return (100 * low >= percent * high) & (estimate(equal, high) >= least)


def _by_estimate(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers allow to be links."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                n_a, n_b = (b.column(k).to_numpy() for k in (2, 4))
                keep = _may_link(n_a, n_b, (_matrix(b.column(3)) == _matrix(b.column(5))).sum(axis=1), percent)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return joined.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, needed: DataFrame, scratch: Scratch, label: str, files: int, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; needed has the texts of their documents."""
    pairs = scratch.write(pairs, f"{label}-pairs", files=files)
    salts = scratch.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_HUB).cast("int").alias("salts")), f"{label}-salts", files=files)
    texts = needed.select("doc_id", F.col("text").cast("binary").alias("t"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b")).join(texts.withColumnRenamed("doc_id", "a"), "a")
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b").join(texts.withColumnRenamed("doc_id", "b"), "b")
    both = hubs.select("a", "salt", "b", "t").unionByName(dealt.select("a", "salt", "b", "t"))

    def run(batches):
        hub, own = None, []
        for whole in batches:
            for part in slices(whole, "t"):
                a, salt, b = (part.column(k).to_pylist() for k in range(3))
                left, right = [], []
                for i, other in enumerate(shingle_sets(part.column(3).to_pylist(), size)):
                    if hub != (a[i], salt[i]):
                        hub, own = (a[i], salt[i]), []
                    if b[i] is None:  # the hub's text stands before those of its pairs
                        if not any(np.array_equal(x, other) for x in own):
                            own.append(other)
                        continue
                    for x in own:
                        both = len(np.intersect1d(x, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(other) - both):
                            left.append(a[i])
                            right.append(b[i])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        own.clear()
        tidy()

    n = partitions_for(needed, 8 << 20)
    return both.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _least_hashes(size: int):
    """A text's KMV shingles of least hash, 32 bits each: the whole set where it has no more."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, "t"):
                kmv = [np.sort((_mix(x) >> np.uint64(32)).astype("<u4"))[:KMV].tobytes() for x in shingle_sets(part.column(1).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kmv, pa.binary())], names=["rep", "kmv"])

    return run


def _across(percent: int, bands: int, rows: int):
    """Of a band bucket's tile, the pairs of a query with a class of another component that may be links.

    A pair that shares several bands is looked at in the first one; a pair of two queries once.
    """
    t = percent / 100

    def run(table: pa.Table) -> pa.Table:
        asks, minor = (table.column(k).to_numpy(zero_copy_only=False) for k in ("asks", "minor"))
        rep, comp, n = (table.column(k).to_numpy() for k in ("rep", "component", "n"))
        regs = _matrix(table.column("regs"))
        keys = band_keys(regs, bands, rows)
        band = int(np.flatnonzero((keys == table.column("key")[0].as_py()).all(axis=0))[0])
        least = [np.frombuffer(x, "<u4") for x in table.column("kmv").to_pylist()]
        there = np.flatnonzero(~asks)
        a, b = [], []
        for q in np.flatnonzero(asks):
            other = there[(comp[there] != comp[q]) & ~(minor[there] & (rep[there] < rep[q]))]
            if band:
                other = other[~(keys[other, :band] == keys[q, :band]).any(axis=1)]
            if len(other):
                other = other[_may_link(np.full(len(other), n[q]), n[other], (regs[other] == regs[q]).sum(axis=1), percent)]
            for o in other.tolist():
                x, y = least[q], least[o]
                union = np.unique(np.concatenate((x, y)))
                whole = n[q] <= KMV and n[o] <= KMV
                if not whole:
                    union = union[:KMV]
                    x, y = x[x <= union[-1]], y[y <= union[-1]]
                similar = (len(x) + len(y) - len(union)) / len(union)
                if similar >= (t - 1e-3 if whole else t - SLACK * np.sqrt(t * (1 - t) / KMV)):
                    a.append(min(rep[o], rep[q]))
                    b.append(max(rep[o], rep[q]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their
    distinct shingle sets; component_id is the smallest id reachable.  Null and
    empty texts have no shingles and are linked with nothing.  Ids are integers;
    rows of one id are one document whose non-empty texts all count.  An empty
    table gives no rows.  A row without an id is linked with nothing: its component_id is null, and it is
    kept.  Other columns of docs are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "minhash")
    bands, rows = band_shape(percent / 100)
    files = few_files(docs)
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    sketched = source.select("doc_id", F.col("text").cast("binary").alias("t"))
    sketches = scratch.write(sketched.mapInArrow(_sketch(size), "doc_id long, n long, f1 long, f2 long, regs binary"), "sketches")
    live = sketches.where("n > 0 and doc_id is not null")
    classes = scratch.write(live.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes", files=files)
    reps = classes.select("rep", "n", "regs")
    members = live.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "rep").distinct()

    def banded(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column(1)), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(keys.ravel())], names=["rep", "key"])

    in_bands = reps.select("rep", "regs").mapInArrow(banded, "rep long, key long").distinct()
    in_bands = scratch.write(in_bands, "bands", files=files)
    hubs = in_bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    hubs = scratch.write(hubs, "hubs", files=files)  # so that Spark may split the join where a band is hot
    stars = in_bands.join(hubs, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    stars = scratch.write(stars, "stars", files=files)
    ids = stars.select(F.col("a").alias("doc_id")).unionAll(stars.select(F.col("b").alias("doc_id"))).distinct()
    needed = scratch.write(source.join(ids.hint("merge"), "doc_id", "left_semi"), "texts", files=files, compression="zstd")  # the one time that texts are dealt out
    links = scratch.write(_confirm(_by_estimate(stars, reps, percent), needed, scratch, "stars", files, size, percent), "links", files=files)
    parts = scratch.write(connected_components(links, scratch, "cc-a"), "parts", files=files)

    placed = in_bands.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    tally = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = F.max_by("component", F.struct("c", "component")).alias("largest")
    tiles = [F.ceil(n / BLOCK).cast("int").alias(x) for n, x in ((F.sum("c"), "blocks"), (F.sum("c") - F.max("c"), "ask_blocks"))]
    mixed = scratch.write(tally.groupBy("key").agg(largest, *tiles, F.count("*").alias("parts")).where("parts > 1").drop("parts"), "mixed", files=files)
    open_rows = placed.join(mixed, "key").withColumn("minor", F.col("component") != F.col("largest"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.hash("rep"), F.col(n))
    asks = open_rows.where("minor").withColumn("ask_block", mine("ask_blocks")).withColumn("block", spread("blocks")).withColumn("asks", F.lit(True))
    dealt = open_rows.withColumn("block", mine("blocks")).withColumn("ask_block", spread("ask_blocks")).withColumn("asks", F.lit(False))
    both = scratch.write(asks.unionByName(dealt).select("key", "ask_block", "block", "asks", "minor", "rep", "component"), "open", files=files)
    close = needed.join(both.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("t"))
    close = scratch.write(close.mapInArrow(_least_hashes(size), "rep long, kmv binary").distinct().join(reps, "rep"), "close", files=files)
    second = scratch.write(both.join(close, "rep").groupBy("key", "ask_block", "block").applyInArrow(_across(percent, bands, rows), "a long, b long").distinct(), "across", files=files)
    if second.isEmpty():
        final = parts
    else:
        more = scratch.write(_confirm(second, needed, scratch, "across", files, size, percent), "more", files=files)
        final = scratch.write(connected_components(links.unionAll(more), scratch, "cc-b"), "final", files=files)
    found = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("root"))
    least = found.groupBy("doc_id").agg(F.min("root").alias("root"))
    out = sketches.join(least, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their group of near duplicates, with all columns; of rows of one id all or none stay."""
    gone = near_duplicates(docs, percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, quoted(id_col).cast("long") == F.col("__gone"), "left_anti")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
