"""Near-duplicate embeddings by a hierarchical navigable small-world graph for each shard.

Equal vectors are one class.  Classes are dealt to shards by a hash; each shard
builds its graph and widens its beam until an audit passes: vectors planted at
the threshold from some of its own must find them.  The vectors of every shard
then query the graphs of all shards, in blocks.  A block holds some of its
queries against brute force and widens the beam further while their recall is
too low; a query's own beam is widened while it is full of links, and one that
is full at the widest is compared with the whole shard.  Links are confirmed by
cosine in double precision, counted where they are found, and leave a block as
the spanning forest of its links.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import fsio
from tidewater.llm.common import Scratch, bound_batches, quoted, tidy
from tidewater.llm.components import connected_components

THRESHOLD = 0.95
#: Shards at least, the vectors that one shard should hold, and the bytes that it may hold.
SHARDS, SHARD_ROWS, SHARD_BYTES = 6, 65_536, 64 << 20
#: Pairs of shards that a task compares once there are many.
PAIRS = 16
LINKS, BUILD_BEAM, FIRST_BEAM, LAST_BEAM = 12, 32, 16, 256
#: Planted queries for a graph, and real ones of a block, that are audited, and the recall that passes.
AUDIT, RECALL = 512, 0.99
#: Pairs whose cosines are worked out at once.
COSINES = 1 << 16


class Graph:
    """Layers of links over unit vectors; layer 0 holds all nodes, each next one about 1 in LINKS."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(5)
        level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(LINKS)).astype(int), 4)
        order = np.argsort(-level, kind="stable")
        self.layers = [np.full((n, 2 * LINKS if lv == 0 else LINKS), -1, np.int32) for lv in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            part = order[at : at + min(256, at)]
            self._insert(part, level, order[:at])
            at += len(part)

    def _insert(self, part: np.ndarray, level: np.ndarray, there: np.ndarray) -> None:
        start = np.full(len(part), self.entry)
        for lv in range(len(self.layers) - 1, -1, -1):
            ids, sims = self._search(self.x[part], start, BUILD_BEAM, lv)
            start = ids[:, 0]
            own = np.flatnonzero(level[part] >= lv)
            if not len(own):
                continue
            mates = self.x[part[own]] @ self.x[part[own]].T  # the batch's own members are candidates too
            for k, q in enumerate(own):
                near = np.concatenate((ids[q][ids[q] >= 0], part[own[np.argsort(-mates[k])[: LINKS + 1]]]))
                near = np.unique(near[near != part[q]])
                self._link(int(part[q]), near, lv)

    def _choose(self, node: int, near: np.ndarray, most: int) -> np.ndarray:
        """Nearest candidates that no chosen one is nearer to; the nearest others fill the rest."""
        sims = self.x[near] @ self.x[node]
        near = near[np.argsort(-sims, kind="stable")][: 3 * most]
        sims = self.x[near] @ self.x[node]
        between = self.x[near] @ self.x[near].T
        good: list[int] = []
        for i in range(len(near)):
            if len(good) < most and (not good or between[i, good].max() < sims[i]):
                good.append(i)
        rest = [i for i in range(len(near)) if i not in set(good)][: most - len(good)]
        return near[good + rest]

    def _link(self, node: int, near: np.ndarray, lv: int) -> None:
        links = self.layers[lv]
        before = links[node][links[node] >= 0]  # mates of the batch that chose this node
        chosen = self._choose(node, np.union1d(near, before), LINKS)
        links[node] = -1
        links[node, : len(chosen)] = chosen
        for other in chosen.tolist():
            row = links[other]
            free = np.flatnonzero(row < 0)
            if node in row:
                continue
            if len(free):
                row[free[0]] = node
            else:
                kept = self._choose(other, np.append(row, node), len(row))
                row[:] = -1
                row[: len(kept)] = kept

    def _search(self, q: np.ndarray, start: np.ndarray, beam: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of all queries at once: the best nodes found, by falling similarity; -1 where there are fewer."""
        m, links = len(q), self.layers[lv]
        row = np.arange(m)
        seen = np.zeros((m, len(self.x) + 1), bool)  # the last column stands for no node
        seen[:, -1] = True
        seen[row, start] = True
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -2.0, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start])
        done = np.ones((m, beam), bool)
        done[:, 0] = False
        live = row
        while len(live):
            pick = np.argmax(np.where(done[live], -3.0, sims[live]), axis=1)
            near = links[ids[live, pick]].astype(np.int64)
            done[live, pick] = True
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            s = np.where(new, np.einsum("ijk,ik->ij", self.x[near], q[live]), -2.0).astype(np.float32)
            all_s = np.concatenate((sims[live], s), axis=1)
            all_i = np.concatenate((ids[live], np.where(new, near, -1)), axis=1)
            all_d = np.concatenate((done[live], ~new), axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_d))
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def plant(self, least: float) -> int:
        """The beam with which vectors planted just above the threshold find the vectors that they were planted from."""
        rng = np.random.default_rng(3)
        own = rng.permutation(len(self.x))[:AUDIT]
        x = self.x[own]
        side = rng.normal(size=x.shape).astype(np.float32)
        side -= np.einsum("ij,ij->i", side, x)[:, None] * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        t = min(1.0, least + 0.002)
        q = (t * x + np.sqrt(1 - t * t) * side).astype(np.float32)
        beam = FIRST_BEAM
        while beam < LAST_BEAM:
            found = 0
            for k in range(0, len(q), 256):
                ids, sims = self._from_top(q[k : k + 256], beam)
                found += int(((ids == own[k : k + 256, None]).any(axis=1) | (sims[:, -1] >= least)).sum())  # a full beam is widened
            if found >= RECALL * len(own):
                break
            beam *= 2
        return beam

    def _from_top(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry)
        for lv in range(len(self.layers) - 1, 0, -1):
            start = self._search(q, start, 1, lv)[0][:, 0]
        return self._search(q, start, beam, 0)

    def found(self, q: np.ndarray, least: float, beam: int, full: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs with a similarity of `least` or more, some queries at a time.

        Beams full of links are widened; queries whose widest beam is full go to `full`, for `compared`.
        """
        for k in range(0, len(q), 256):
            todo, own = np.arange(k, min(len(q), k + 256)), beam
            while len(todo):
                if own > LAST_BEAM:
                    full.append(todo)
                    break
                ids, sims = self._from_top(q[todo], own)
                over = sims[:, -1] >= least
                a, b = np.nonzero((sims >= least) & ~over[:, None])
                yield todo[a], ids[a, b]
                todo, own = todo[over], own * 2

    def compared(self, q: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of some queries, by brute force, some queries at a time."""
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            a, b = np.nonzero(q[part] @ self.x.T >= least)
            yield part[a], b

    def audit(self, q: np.ndarray, least: float, beam: int) -> int:
        """The beam, `beam` at least, with which the audited queries reach RECALL.

        AUDIT queries, chosen at random, are compared with brute force; the recall
        is the mean over those that have links, for few and for many links apart,
        without a vector's hit on itself.
        """
        seen = np.random.default_rng(7).permutation(len(q))[:AUDIT]
        while beam <= LAST_BEAM:
            shares: dict[bool, list[float]] = {False: [], True: []}
            for k in range(0, len(seen), 64):
                part = seen[k : k + 64]
                true = q[part] @ self.x.T >= least
                if q is self.x:
                    true[np.arange(len(part)), part] = False
                met, got, full = true.sum(axis=1), np.zeros(len(part), np.int64), []
                if met.any():
                    for a, b in self.found(q[part], least, beam, full):
                        got += np.bincount(a[true[a, b]], minlength=len(part))
                    for own in full:
                        got[own] = met[own]
                    for n, m in zip(got[met > 0].tolist(), met[met > 0].tolist()):
                        shares[m >= FIRST_BEAM].append(n / m)
            if all(not x or sum(x) / len(x) >= RECALL for x in shares.values()):
                break
            beam *= 2
        return beam


class _Forest:
    """The components of a block as labels, and the links that joined them."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, one: int, others: np.ndarray) -> None:
        own, there = self.label[one], self.label[others]
        if (there != own).any():
            new, at = np.unique(there, return_index=True)
            self.edges += [(one, int(x)) for x in others[at[new != own]]]
            self.label[np.isin(self.label, new)] = own


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _stored(root: str, dim: int, shard: int) -> str:
    return f"{root}/{dim}-{shard:06d}.npz"


def _build(root: str, threshold: float):
    """Builds the graph of a shard and stores it with the vectors, as they came, their ids and numbers of copies."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        graph = Graph(_unit(x))
        beam = graph.plant(threshold - 1e-3)
        out = io.BytesIO()
        layers = {f"layer{k}": g for k, g in enumerate(graph.layers)}
        np.savez(out, x=x, i=table.column("rep").to_numpy(), c=table.column("copies").to_numpy(), entry=graph.entry, beam=beam, **layers)
        fsio.put(_stored(root, dim, shard), out.getvalue())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64())})

    return run


class _Shard:
    def __init__(self, root: str, dim: int, shard: int):
        own = np.load(io.BytesIO(fsio.get(_stored(root, dim, shard))))
        self.x, self.ids, self.copies = own["x"], own["i"], own["c"]
        self.graph = Graph.__new__(Graph)
        self.graph.x, self.graph.entry, self.beam = _unit(self.x), int(own["entry"]), int(own["beam"])
        self.graph.layers = [own[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in own.files))]


def _cosine(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of x[a] with y[b] in double precision, a block of pairs at a time."""
    out = np.empty(len(a))
    for k in range(0, len(a), COSINES):
        p, q = x[a[k : k + COSINES]].astype(np.float64), y[b[k : k + COSINES]].astype(np.float64)
        out[k : k + COSINES] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
    return out


def _links(root: str, threshold: float):
    """For two shards: how many vectors each vector is linked with, and a forest of the links."""

    def run(batches):
        one, held = None, None
        for batch in batches:
            for dim, sa, sb in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (dim, sa):
                    one, held = _Shard(root, dim, sa), (dim, sa)
                two = one if sa == sb else _Shard(root, dim, sb)
                ids, counts, edges = _block(one, two, threshold)
                at = np.flatnonzero(counts)
                first = np.concatenate((ids[at], ids[edges[:, 0]]))
                second = np.concatenate((np.full(len(at), -1), ids[edges[:, 1]]))
                n = np.concatenate((counts[at], np.full(len(edges), -1)))
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second.astype(np.int64)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])
        tidy()

    return run


def _block(one: _Shard, two: _Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of both shards' vectors, each one's number of links with vectors of the other, and the forest as a matrix of two columns.

    Pairs are held some queries at a time.  Within one shard a link may be found
    from either end, so those of queries whose beams were not full, LAST_BEAM
    each at most, are kept and counted once; the others' are counted by brute force.
    """
    least, same = threshold - 1e-3, one is two
    split = 0 if same else len(one.ids)  # where the second shard's vectors begin
    ids = one.ids if same else np.concatenate((one.ids, two.ids))
    copies = one.copies if same else np.concatenate((one.copies, two.copies))
    counts, exact, forest = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), _Forest(len(ids))
    q, graph, full, kept = two.graph.x, one.graph, [], [np.zeros((2, 0), np.int64)]

    def links(a, b):
        if same:
            a, b = a[a != b], b[a != b]
        near = _cosine(two.x, one.x, a, b) >= threshold
        a, b = a[near], b[near]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for x, others in zip(a[starts].tolist(), np.split(b, starts[1:])):
            forest.add(split + x, others)
        return a + split, b

    def count(a, b):
        np.add.at(counts, a, copies[b])

    for a, b in graph.found(q, least, graph.audit(q, least, one.beam), full):
        a, b = links(a, b)
        if same:
            kept.append(np.stack((a, b)))
        else:
            count(a, b)
            count(b, a)
    rows = np.concatenate(full) if full else np.zeros(0, np.int64)
    exact[rows + split] = same
    for a, b in graph.compared(q, rows, least):
        a, b = links(a, b)
        count(a, b)
        if same:
            kept.append(np.stack((b, a))[:, ~exact[b]])
        else:
            count(b, a)
    if same:
        a, b = np.concatenate(kept, axis=1)
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        a, b = np.unique(np.stack((a, b))[:, ~exact[a]], axis=1)
        count(a, b)
    return ids, counts, np.array(forest.edges, np.int64).reshape(-1, 2)


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row: vec_id, n_links (other rows), component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite numbers, and
    rows without an id, are linked with nothing; neither are vectors of
    different lengths.  Equal vectors are linked.  Ids are integers; a repeated
    row counts as one more vector of the same id.  A cosine just at the threshold
    is a link.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "hnsw")
    kind = vectors.schema[vector_col].dataType
    kept_as = "array<float>" if isinstance(kind, T.ArrayType) and kind.elementType == T.FloatType() else "array<double>"
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast(kept_as).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    good = good.withColumns({"f1": F.xxhash64(F.lit(1), "v"), "f2": F.xxhash64(F.lit(2), "v")})  # 128 bits stand for a vector
    by_class = good.groupBy("f1", "f2")
    sizes = F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max(F.size("v")).alias("dim")
    classes = scratch.write(by_class.agg(*sizes), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    each = min(SHARD_ROWS, max(4096, SHARD_BYTES // (4 * max(1, size["dim"] or 1))))
    shards = max(SHARDS, -(-size["n"] // each))
    root = scratch.path("graphs")
    dealt = by_class.agg(*sizes, F.first("v").alias("v")).select("v", "rep", "copies", "dim", F.pmod("f1", F.lit(shards)).alias("shard"))
    built = dealt.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build(root, threshold), "dim int, shard long")
    built = scratch.write(built, "built")
    # the blocks of queries of every shard with every graph, each pair of shards once; tasks read both from the shared folder
    asked = built.select("dim", F.col("shard").alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), "shard")).alias("sa"))
    pairs = asked.join(built.withColumnRenamed("shard", "sa"), ["dim", "sa"], "left_semi").select("dim", "sa", "sb")
    blocks = shards * (shards + 1) // 2
    dealt = pairs.repartition(blocks) if blocks <= 4096 else pairs.repartition(blocks // PAIRS, "dim", "sa", F.floor(F.col("sb") / PAIRS)).sortWithinPartitions("dim", "sa", "sb")
    found = scratch.write(dealt.mapInArrow(_links(root, threshold), "a long, b long, n long"), "found")
    counts = found.where("b = -1 and n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    links = found.where("n = -1").select("a", "b")
    parts = scratch.write(connected_components(links, scratch), "parts")
    whole = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    placed = good.select("vec_id", "f1", "f2").join(whole, ["f1", "f2"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("root").alias("root"))
    out = rows.select("vec_id").join(placed, "vec_id", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.95 or more."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
