"""Hierarchical empirical Bayes quality classifier.

A logistic model of words, word beginnings and style, trained here on a bounded
sample of labelled documents, gives each document's own evidence that it is
toxic and that it is poor.  The share of each kind at a host, and at a path
within the host, is the mean of that evidence over all its documents, shrunk
toward the level above: a site's weight is its number of documents against a
prior strength that the spread between sites gives by the method of moments.
The shrunk share of a document's path takes the place of the global one as the
document's prior: its posterior log-odds are its own, less the global prior's,
plus its path's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import Scratch, bound_batches, few_files, map_text, quoted, slices, tidy
from tidewater.llm.decontaminate import words

#: Labelled rows that the document classifier is fitted on, at most; chosen by a hash of their id.
TRAIN_ROWS = 12_000
#: Features that each head may use.
FEATURES = 1_500
#: Labelled documents that must hold a feature, the standard deviations by which it must tell a head's documents
#: from the others, and the penalty on squared weights.
SUPPORT, SIGNIFICANT, PENALTY = 3, 3.5, 1e-3
#: Sites whose posteriors are broadcast; more of them meet the documents by a salted join.
BROADCAST_SITES, SALTS = 200_000, 16
HEADS = ("toxic", "poor")
_EDGES = (0.002, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95)
_UPPER, _PUNCT = bytes(range(65, 91)), bytes(b for b in range(33, 127) if not chr(b).isalnum())


def style(text: bytes, own: list[bytes], distinct: set[bytes]) -> list[bytes]:
    """Binned style measures."""
    n, size = max(1, len(own)), max(1, len(text))
    lines = text.split(b"\n")
    measures = (
        (size - len(text.translate(None, _UPPER))) / size,
        (size - len(text.translate(None, _PUNCT))) / size,
        text.count(b" | ") / n,
        text.count(b"!") / n,
        len(distinct) / n,
        len(set(lines)) / len(lines),
        min(1.0, len(own) / 5000),
        min(1.0, sum(map(len, distinct)) / max(1, len(distinct)) / 20),
    )
    return [b"s%d:%d" % (k, bisect_right(_EDGES, m)) for k, m in enumerate(measures)]


def features(text: bytes | None) -> set[bytes]:
    """Binary features: words, their first four and five bytes, and binned style measures."""
    text = text or b""
    own = words(text)
    distinct = set(own)
    return {b"w" + w for w in distinct} | {b"4" + w[:4] for w in distinct} | {b"5" + w[:5] for w in distinct} | set(style(text, own, distinct))


class Model:
    """Weights of the selected features, one column for each head."""

    def __init__(self, index: dict[bytes, int], weights: np.ndarray, bias: np.ndarray):
        self.words, self.four, self.five, self.style = {}, {}, {}, {}
        parts = {b"w": self.words, b"4": self.four, b"5": self.five}
        for f, i in index.items():
            if f[:1] in parts:
                parts[f[:1]][f[1:]] = i
            else:
                self.style[f] = i
        self.weights, self.bias, self.index = weights, bias, index

    def logits(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        own = words(text)
        distinct = set(own)
        at = [self.words[w] for w in distinct & self.words.keys()]
        at += [self.four[w] for w in {w[:4] for w in distinct} & self.four.keys()]
        at += [self.five[w] for w in {w[:5] for w in distinct} & self.five.keys()]
        at += [i for f in style(text, own, distinct) if (i := self.style.get(f)) is not None]
        return self.bias + self.weights[at].sum(axis=0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits both heads on at most `rows` labelled documents; null labels count as 0 (toxic) and 1 (quality).

    Of several labels of an id the worse counts, of several texts the least.
    Without labelled rows the model gives log-odds of -6 for everything.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "training")
    worst = [F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("__toxic"), F.max(F.coalesce("quality", F.lit(1)) == 0).alias("__poor")]
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(*worst)
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    named = F.broadcast(spark.createDataFrame(chosen.toArrow(), chosen.schema))  # `rows` rows at most
    sample = docs.select(quoted(id_col).cast("long").alias("__id"), quoted(text_col).cast("binary").alias("t")).join(named, "__id")
    sample = scratch.write(sample.groupBy("__id").agg(F.first("__toxic").alias("__toxic"), F.first("__poor").alias("__poor"), F.min("t").alias("t")).drop("__id"), "sample", files=few_files(named))

    def count(batches):
        seen: dict[int, Counter] = {k: Counter() for k in range(3)}
        n = np.zeros(3, np.int64)
        for whole in batches:
            for part in slices(whole, "t"):
                for toxic, poor, text in zip(*(c.to_pylist() for c in part.columns)):
                    own = features(text)
                    for k, there in enumerate((True, toxic, poor)):
                        if there:
                            n[k] += 1
                            seen[k].update(own)
        seen[0][b"n"], seen[1][b"n"], seen[2][b"n"] = n.tolist()
        names = list(seen[0])
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())] + [pa.array([seen[h][f] for f in part], pa.int64()) for h in range(3)], names=["f", "n", "toxic", "poor"])
        seen.clear()
        names.clear()
        tidy()

    counts = sample.mapInArrow(count, "f binary, n long, toxic long, poor long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "poor")])
    counts = counts.where((F.col("n") >= SUPPORT) | (F.col("f") == F.lit(b"n")))  # the total counts however small
    counts = scratch.write(counts, "counts", files=few_files(named))
    total = counts.where(F.col("f") == F.lit(b"n")).agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]).first()
    if not total["n"]:
        scratch.drop("sample", "counts")
        return Model({}, np.zeros((0, 2)), np.full(2, -6.0))
    picked: dict[bytes, int] = {}
    for head in HEADS:
        rate = (total[head] + 0.5) / (total["n"] + 1)
        z = (F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        for r in counts.where((F.col("f") != F.lit(b"n")) & (F.abs(z) >= SIGNIFICANT)).orderBy(F.abs(z).desc(), "f").limit(FEATURES).select("f").collect():
            picked.setdefault(bytes(r["f"]), len(picked))

    def vectors(batches):
        for whole in batches:
            for part in slices(whole, "t"):
                at = [sorted(i for f in features(t) if (i := picked.get(f)) is not None) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32()))], names=["toxic", "poor", "at"])
        tidy()

    table = sample.mapInArrow(vectors, "toxic boolean, poor boolean, at array<int>").toArrow()
    scratch.drop("sample", "counts")
    at = table.column("at").combine_chunks()
    cols, starts = at.values.to_numpy(), at.offsets.to_numpy()
    row = np.repeat(np.arange(len(at)), np.diff(starts))
    weights, bias = np.zeros((len(picked), 2)), np.zeros(2)
    for h, head in enumerate(HEADS):
        y = table.column(head).to_numpy(zero_copy_only=False).astype(float)
        w, b, m, v, mb, vb = np.zeros(len(picked)), 0.0, np.zeros(len(picked)), np.zeros(len(picked)), 0.0, 0.0
        for step in range(1, 301):  # Adam on the full sample, with an L2 penalty
            z = np.bincount(row, w[cols], len(y)) + b
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g, gb = np.bincount(cols, error[row], len(w)) / len(y) + PENALTY * w, error.mean()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            k, c = 1 - 0.9**step, 1 - 0.999**step
            w -= 0.05 * (m / k) / (np.sqrt(v / c) + 1e-9)
            b -= 0.05 * (mb / k) / (np.sqrt(vb / c) + 1e-9)
        weights[:, h], bias[h] = w, b
    return Model(picked, weights, bias)


_FIELDS = [T.StructField("toxic_logit", T.DoubleType()), T.StructField("poor_logit", T.DoubleType())]


def evidence(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds each document's own log-odds of being toxic and of being poor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES for each head

    def make():
        own = shared.value

        def work(texts):
            z = np.array([own.logits(t) for t in texts]).reshape(-1, 2)
            return [pa.array(z[:, 0]), pa.array(z[:, 1])]

        return work

    return map_text(docs, make, _FIELDS, text_col, carry)


def _logit(p):
    return F.log(p / (1 - p))


def _prior_strength(sites: DataFrame, mean: dict[str, float]) -> dict[str, float]:
    """For each head the strength of a beta prior whose mean and variance are those of the sites' means."""
    spread = sites.agg(*[(F.sum(F.col("n") * (F.col(h) / F.col("n") - mean[h]) ** 2) / F.sum("n")).alias(h) for h in HEADS]).first()
    return {h: float(min(max(mean[h] * (1 - mean[h]) / max(spread[h] or 0.0, 1e-9) - 1, 5.0), 1e6)) for h in HEADS}


def site_posteriors(sites: DataFrame, levels: list[list[str]]) -> tuple[DataFrame, dict[str, float]]:
    """The finest level's sites with their posterior shares (site_toxic, site_poor), and the global shares.

    sites holds for each site of the finest level its documents (n) and the sum
    of each head's probabilities.  A level's columns hold those of the level
    above, toward whose posterior it is shrunk; the first is shrunk toward the
    global share.  What comes to the driver is a few sums.
    """
    top = sites.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    mean = {h: min(max((top[h] or 0.0) / max(1, top["n"] or 0), 1e-4), 1 - 1e-4) for h in HEADS}
    above = None
    for k, level in enumerate(levels):
        own = sites.groupBy(*level).agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS])
        strength = _prior_strength(own, mean)
        own = own.join(above, levels[k - 1]) if above is not None else own.withColumns({f"prior_{h}": F.lit(mean[h]) for h in HEADS})
        shrunk = {h: (F.col(h) + strength[h] * F.col(f"prior_{h}")) / (F.col("n") + strength[h]) for h in HEADS}
        above = own.select(*level, *[shrunk[h].alias(f"prior_{h}") for h in HEADS])
    return above.withColumnsRenamed({f"prior_{h}": f"site_{h}" for h in HEADS}), mean


_NEW = ["toxic_logit", "poor_logit", "site_toxic", "site_poor", "bad_probability", "accepted"]


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds toxic_logit, poor_logit, site_toxic, site_poor, bad_probability and accepted.

    host and path name columns; a null is a site of its own.  Null and empty
    texts are judged by style and site alone.  Every row is judged, repeated
    ones alike; an empty table gives no rows.  Columns of the same name in docs
    are replaced.  bad_probability is that of being toxic or poor; a document is
    accepted below a half.  The evidence is worked out once and written with
    the carried columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    model = model or train(docs, labels, id_col, text_col)
    site = docs.withColumns({"__host": F.coalesce(quoted(host).cast("string"), F.lit("\x00")), "__path": F.coalesce(quoted(path).cast("string"), F.lit("\x00"))})
    kept = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in _NEW]
    own = scratch.write(evidence(site, model, text_col, [*kept, "__host", "__path"]), "evidence", compression="zstd")
    p = {h: 1 / (1 + F.exp(-F.col(f"{h}_logit"))) for h in HEADS}
    sites = scratch.write(own.groupBy("__host", "__path").agg(F.count("*").alias("n"), *[F.sum(p[h]).alias(h) for h in HEADS]), "sites", files=few_files(docs))
    posterior, mean = site_posteriors(sites, [["__host"], ["__host", "__path"]])
    posterior = scratch.write(posterior, "posteriors", files=few_files(docs))
    if posterior.count() <= BROADCAST_SITES:
        judged = own.join(F.broadcast(posterior), ["__host", "__path"])
    else:  # a site may hold a third of all documents
        dealt = own.withColumn("__salt", F.pmod(F.xxhash64(*_NEW[:2], *[quoted(c) for c in kept if docs.schema[c].dataType.typeName() != "map"]), F.lit(SALTS)))
        copies = posterior.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        judged = dealt.join(copies, ["__host", "__path", "__salt"])
    odds = {h: F.col(f"{h}_logit") - float(np.log(mean[h] / (1 - mean[h]))) + _logit(F.col(f"site_{h}")) for h in HEADS}
    bad = 1 - 1 / ((1 + F.exp(odds["toxic"])) * (1 + F.exp(odds["poor"])))
    out = judged.withColumn("bad_probability", bad).withColumn("accepted", F.col("bad_probability") < 0.5)
    return out.select(*[quoted(c) for c in kept], *_NEW)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    names = {c: f"__d_{c}" for c in docs.columns}
    judged = classify(docs.withColumnsRenamed(names), labels, host="__d_source", path="__d_lang", id_col="__d_doc_id", text_col="__d_text", **options)
    return judged.where("accepted").select(*[quoted(v).alias(k) for k, v in names.items()])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's posterior of being toxic or poor, and whether it is accepted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classify(docs, labels, carry=["doc_id"])
