"""Size-tiered compaction of document shards under a versioned manifest.

Arrivals are appended as small immutable runs.  Where enough runs of one size
tier have gathered they are merged, without a shuffle, into one run of files of
the target size.  A manifest names the live runs; a new version appears by a
rename that fails if the version exists, so readers see whole versions and a
lost executor costs only tasks of the write in progress.  Runs that were merged
away stay until the versions that name them expire.  The rename is atomic on
HDFS and on local disks; an object store needs a committer with that promise.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, fs_delete, quoted, without

FANOUT, TARGET_BYTES, ARRIVALS = 4, 64 << 20, 16
#: Versions that stay readable while runs are merged.
RETAIN = 2


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.fanout, self.target_bytes = spark, root, fanout, target_bytes
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self.fs.listStatus(self._path("manifests")) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the last by default; before the first commit an empty one."""
        seen = self.versions()
        if not seen and version is None:
            return {"version": 0, "runs": []}
        path = self._path(f"manifests/v{version or seen[-1]}.json").toString()
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"])

    def commit(self, runs: list[dict], after: int) -> dict:
        """Publishes the version that follows `after`; fails if another writer has."""
        made = {"version": after + 1, "runs": runs}
        mine = self._path(f"manifests/.pending-{after + 1}-{self.jvm.java.util.UUID.randomUUID().toString()}")
        out = self.fs.create(mine, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(mine, self._path(f"manifests/v{after + 1}.json"), options)
        return made

    def describe(self, path: str, level: int) -> dict:
        files = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return {"path": path, "level": level, "bytes": sum(b for _, b in files), "files": [{"name": n, "bytes": b} for n, b in sorted(files)]}

    def tier(self, run: dict, least: int) -> int:
        return int(math.log(max(1.0, run["bytes"] / max(1, least)), self.fanout) + 0.5)

    def add(self, path: str) -> None:
        """Commits a run that is already written below the root."""
        now = self.manifest()
        self.commit([*now["runs"], self.describe(path, 0)], now["version"])

    def append(self, df: DataFrame, name: str) -> None:
        """Writes an arrival as one immutable run and commits it."""
        df.write.parquet(f"{self.root}/{name}")
        self.add(name)

    def compact(self, retain: int = RETAIN) -> int:
        """Merges while any tier has `fanout` runs; returns the number of merges.  The last `retain` versions stay whole."""
        merges = 0
        while True:
            now = self.manifest()
            least = min((r["bytes"] for r in now["runs"] if r["bytes"]), default=1)
            tiers: dict[int, list[dict]] = {}
            for r in now["runs"]:
                tiers.setdefault(self.tier(r, least), []).append(r)
            full = next((sorted(v, key=lambda r: r["bytes"])[: self.fanout] for _, v in sorted(tiers.items()) if len(v) >= self.fanout), None)
            if full is None:
                return merges
            name = f"runs/merged-{now['version'] + 1}"
            files = max(1, -(-sum(r["bytes"] for r in full) // self.target_bytes))
            self._rows(full).coalesce(files).write.parquet(f"{self.root}/{name}")
            merged = self.describe(name, 1 + max(r["level"] for r in full))
            gone = {r["path"] for r in full}
            self.commit([r for r in now["runs"] if r["path"] not in gone] + [merged], now["version"])
            self.expire(retain)
            merges += 1

    def expire(self, retain: int) -> None:
        """Drops all versions but the last `retain`, and then the runs that no other version names."""
        seen = self.versions()
        old = [self.manifest(v) for v in seen[: max(0, len(seen) - max(1, retain))]]
        live = {r["path"] for v in seen[len(old) :] for r in self.manifest(v)["runs"]}
        for m in old:
            self.fs.delete(self._path(f"manifests/v{m['version']}.json"), False)
        for path in {r["path"] for m in old for r in m["runs"]} - live:
            fs_delete(self.spark, f"{self.root}/{path}")

    def _rows(self, runs: list[dict]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/{runs[0]['path']}").schema
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version's runs, with the run and the shard file that hold each; columns of these names are replaced."""
        runs = [r for r in self.manifest(version)["runs"] if r["files"]]
        if not runs:
            return None
        parts = F.split(F.input_file_name(), "/")
        df = self._rows(runs)
        return df.select(*[quoted(c) for c in without(df, ["shard_run", "shard_file"])], F.element_at(parts, -2).alias("shard_run"), F.element_at(parts, -1).alias("shard_file"))

    def files(self) -> DataFrame:
        """The shard files of the last version: shard_run, shard_file, bytes."""
        rows = [(r["path"].rsplit("/", 1)[-1], f["name"], f["bytes"]) for r in self.manifest()["runs"] for f in r["files"]]
        return self.spark.createDataFrame(rows, "shard_run string, shard_file string, bytes long")


def compact_arrivals(docs: DataFrame, root: str, arrivals: int = ARRIVALS, id_col: str = "doc_id") -> ShardStore:
    """Appends docs as `arrivals` arrivals, compacting after each tier fills; all rows stay, repeated and null ones too.

    An empty table leaves a store without runs.  Every column of docs is kept, whatever its name.
    """
    store = ShardStore(docs.sparkSession, root)
    own = "arrival"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    docs.withColumn(own, F.pmod(F.xxhash64(quoted(id_col)), F.lit(arrivals))).write.partitionBy(own).parquet(f"{root}/arrivals")
    for k in range(arrivals):
        if store.fs.exists(store._path(f"arrivals/{own}={k}")):
            store.add(f"arrivals/{own}={k}")
            if (k + 1) % FANOUT == 0:
                store.compact()
    store.compact()
    return store


def op9_compact_shards(spark, sf_dir: str) -> DataFrame:
    """Each document as it is read back after all arrivals were appended and compacted, and whether its shard is one that the manifest names and near the target size at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = compact_arrivals(docs, Scratch(spark, "shards").root)
    rows = store.read()
    if rows is None:
        rows = docs.limit(0).withColumns({"shard_run": F.lit(""), "shard_file": F.lit("")})
    text = F.coalesce("text", F.lit(""))
    named = rows.join(F.broadcast(store.files()), ["shard_run", "shard_file"], "left")  # a row for each shard file
    return named.select("doc_id", F.octet_length(text).cast("long").alias("text_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.col("bytes").isNotNull().alias("in_manifest"), (F.col("bytes") <= 2 * store.target_bytes).alias("within_target"))
