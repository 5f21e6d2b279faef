"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned over training windows.

The benchmark's size is checked first.  It is turned into n-gram sets of at
most SLICE_BYTES of text; a benchmark beyond that is scanned set after set over
the same rows, so what is broadcast at once is bounded whatever its size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_text, quoted, without

SLICE_BYTES = 4 << 20
NGRAM = 10

#: A-Z lower-cased; every ASCII byte but 0-9 and letters becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class NgramSet:
    """Every window of the items: of n words, or of all words of an item that has fewer.

    Held as arrays, about 40 bytes for each word of the items: the items' word
    numbers, and for each size of window the sorted hashes of the distinct ones,
    where one of each stands, and the items that hold it.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        ids, first, owner = [], [], []
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if own:
                first.append(sum(map(len, ids[-1:])) + (first[-1] if first else 0))
                ids.append(np.array(own, np.uint32))
                owner.append(number[item])
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.sizes = {size: self._windows(size, [(f, len(x), o) for f, x, o in zip(first, ids, owner) if min(n, len(x)) == size]) for size in sorted({min(n, len(x)) for x in ids})}

    def _windows(self, size: int, items: list[tuple[int, int, int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Multiplier, hashes, a place of each, and where its items begin and which they are."""
        at = np.concatenate([np.arange(f, f + n - size + 1) for f, n, _ in items])
        owner = np.repeat([o for *_, o in items], [n - size + 1 for _, n, _ in items])
        for k in range(64):  # a multiplier that gives different windows different hashes
            mult = (_MULT + 2 * k * _MULT) & _MASK | 1
            hashes = self._hash(self.ids.astype(np.uint64), size, mult)[at]
            order = np.lexsort((owner, hashes))
            h, p, o = hashes[order], at[order], owner[order]
            same = h[1:] == h[:-1]
            if all((self.ids[p[1:] + j] == self.ids[p[:-1] + j])[same].all() for j in range(size)):
                break
        else:
            raise ValueError("no hash tells the windows apart")
        new = np.concatenate(([True], ~same))
        keep = new | np.concatenate(([True], o[1:] != o[:-1]))
        h, p, o, new = h[keep], p[keep], o[keep], new[keep]
        starts = np.flatnonzero(new)
        return mult, h[starts], p[starts], np.append(starts, len(h)), o

    @staticmethod
    def _hash(ids: np.ndarray, size: int, mult: int) -> np.ndarray:
        m = len(ids) - size + 1
        h = np.zeros(m, dtype=np.uint64)
        for j in range(size):
            h *= np.uint64(mult)
            h += ids[j : j + m]
        return h ^ (h >> np.uint64(29))

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, the word ranges that windows hit, and the items; every hit is held against the words."""
        get, ids, starts = self.vocabulary.get, [], []
        for text in texts:
            starts.append(len(ids))
            ids += [get(w, 0) for w in words(text)]
            ids.append(0)  # no window crosses texts: 0 is in none
        starts.append(len(ids))
        flat = np.array(ids, dtype=np.uint64)
        unknown = np.concatenate(([0], np.cumsum(flat == 0)))
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        bounds = np.array(starts)
        for size, (mult, hashes, places, items_at, owners) in self.sizes.items():
            if len(flat) < size:
                continue
            known = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(known):
                continue
            own = self._hash(flat, size, mult)[known]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            like = np.flatnonzero(hashes[at] == own)
            known, at = known[like], at[like]
            real = np.ones(len(at), bool)
            for j in range(size):
                real &= flat[known + j] == self.ids[places[at] + j]
            for start, k, doc in zip(known[real].tolist(), at[real].tolist(), (np.searchsorted(bounds, known[real], "right") - 1).tolist()):
                ranges, items = found.setdefault(doc, ([], set()))
                ranges.append((start - starts[doc], start - starts[doc] + size))
                items.update(owners[items_at[k] : items_at[k + 1]].tolist())
        out = []
        for doc in range(len(texts)):
            ranges, items = found.get(doc, ([], set()))
            out.append((starts[doc + 1] - starts[doc] - 1, union(ranges), {self.names[i] for i in items}))
        return out


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal disjoint ranges that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = NGRAM,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Adds n_words, hit_words (maximal ranges of word positions) and hit_items (sorted strings).

    Words have A-Z lower-cased and are parted by every other ASCII character
    but digits.  Null and empty texts have no words and no hits; an item
    without words has no window; a null item_id counts as the item "null".
    Items that are repeated name the same item once.  An empty benchmark hits
    nothing.  Columns of the same name in docs are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(quoted(item_id_col).cast("string"), F.lit("null")).alias("i"), quoted(item_text_col).cast("binary").alias("t"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.octet_length("i") + 16)).first()[0] or 0
    sets = max(1, -(-total // slice_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", _RANGES), T.StructField("hit_items", T.ArrayType(T.StringType()))]

    def scanner(grams):
        def make():
            found = grams.value

            def work(texts):
                rows = found.scan(texts)
                return [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _ARROW_RANGES),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                ]

            return work

        return make

    source = docs.select(*[quoted(c) for c in without(docs, ["__text"])], quoted(text_col).alias("__text"))
    kept = [c for c in without(docs, [f.name for f in fields]) if carry is None or c in carry]
    out = None
    for k in range(sets):
        part = items if sets == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(sets)) == k)
        grams = spark.sparkContext.broadcast(NgramSet([(r["i"], r["t"]) for r in part.collect()], n))
        if out is None:
            out = map_text(source, scanner(grams), fields, "__text", kept if sets == 1 else [*kept, "__text"])
        else:
            before = out.withColumnsRenamed({"n_words": "__n", "hit_words": "__w", "hit_items": "__i"})
            out = map_text(before, scanner(grams), fields, "__text")
            joined = F.array_sort(F.concat("__w", "hit_words"))
            out = out.withColumn("hit_words", merge_ranges(joined)).withColumn("hit_items", F.array_sort(F.array_union("__i", "hit_items"))).drop("__n", "__w", "__i")
    return out.select(*[quoted(c) for c in kept], *[f.name for f in fields])


def merge_ranges(ranges):
    """The maximal disjoint ranges of a sorted array of ranges."""
    empty = F.slice(ranges, 1, 0)
    return F.aggregate(
        ranges,
        empty,
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )


def hit_count(ranges):
    """The number of words in disjoint ranges."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark window hits, with their own columns."""
    found = find_contamination(docs.withColumnsRenamed({c: f"__d_{c}" for c in docs.columns}), benchmark, text_col=f"__d_{options.pop('text_col', 'text')}", **options)
    return found.where(F.size("hit_words") == 0).select(*[quoted(f"__d_{c}").alias(c) for c in docs.columns])


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, with the words that benchmark windows hit cut out of their texts.

    The text from a hit range's first word to its last goes; all else stays as it was.
    """
    inner = docs.withColumnsRenamed({c: f"__d_{c}" for c in docs.columns})
    found = find_contamination(inner, benchmark, text_col=f"__d_{text_col}", **options)

    @F.pandas_udf("string")
    def cut(texts, ranges):
        return texts.combine(ranges, lambda text, own: _cut(text, [(r["start"], r["end"]) for r in own] if own is not None else []))

    text = quoted(f"__d_{text_col}")
    clean = F.when(F.size("hit_words") > 0, cut(text, F.col("hit_words"))).otherwise(text)
    return found.select(*[(clean if c == text_col else quoted(f"__d_{c}")).alias(c) for c in docs.columns])


def _cut(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    if text is None or not ranges:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document the words and items that 10-word benchmark windows hit, over whole tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, benchmark, carry=["doc_id"])
    n_hit = hit_count(F.col("hit_words"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
