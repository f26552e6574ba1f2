"""Shards under a versioned manifest, with size-tiered compaction.

Arrivals are appended as small immutable shards.  A compaction takes runs of shards of similar size, packs each run to a
file of the target size, and commits a manifest that names the new files instead of the old ones.  A manifest is
written under a temporary name and renamed into place, which fails if that version exists; a writer that comes second
starts from the version that was first.  A compaction deletes nothing, so every version can be read until vacuum() drops
it; a lost driver or executor leaves files that no version names, never a half-made state, and vacuum() sweeps them.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Target size of a file, and how many times larger than the one below a size tier is.
TARGET_BYTES, FANOUT = 32 << 20, 4
#: Versions that vacuum() keeps, seconds before it takes a file without a version for an orphan, and attempts at a commit.
KEEP, GRACE, ATTEMPTS = 2, 24 * 3600, 20


class ShardStore:
    """Shards and manifests in one folder of any file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- manifests

    def versions(self) -> list[int]:
        """The versions that are kept, in order."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Shards of a version: [{"file": ..., "bytes": ...}], by file. ValueError for a version that is not kept."""
        version = self.version() if version is None else version
        if not version:
            return []
        if version not in self.versions():
            raise ValueError(f"version {version} is not kept")
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["shards"]

    def commit(self, shards: list[dict], base: int) -> int:
        """Version base + 1, or FileExistsError if another writer was first."""
        version = base + 1
        final, draft = (self._path(f"{self.root}/manifest/{n}") for n in (f"v{version:08d}.json", f".draft-{uuid.uuid4().hex}"))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "shards": sorted(shards, key=lambda s: s["file"])}).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"version {version} is taken") from e
            raise
        return version

    # -- shards

    def append(self, arrivals: DataFrame, shard_rows: int) -> int:
        """Append an arrival as shards of at most shard_rows rows; an empty one adds an empty shard at most."""
        new = self._write(arrivals, shard_rows)
        return self._commit_on_latest(lambda shards: shards + new)

    def _commit_on_latest(self, change) -> int:
        """Commit change(shards of the latest version), anew whenever another writer was first; the version stays if change gives None."""
        for _ in range(ATTEMPTS):
            base = self.version()
            shards = change(self.manifest(base))
            if shards is None:
                return base
            try:
                return self.commit(shards, base)
            except FileExistsError:
                continue
        raise FileExistsError(f"other writers were first {ATTEMPTS} times")

    def _write(self, rows: DataFrame, shard_rows: int = 0) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/{folder}")
        found = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        return [{"file": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen()} for s in found if s.getPath().getName().endswith(".parquet")]

    def tier(self, size: int) -> int:
        """0 for shards within a tier of the target size or over it, which stay; larger numbers for smaller shards."""
        return 0 if 2 * size > self.target else max(1, math.ceil(math.log(self.target / max(size, 1), self.fanout)))

    def compact(self) -> int:
        """Merge every tier that has two small shards or more, then commit; the version stays if there is nothing to do.

        What others append meanwhile is kept; if another compaction has taken one of the shards, this one is given up.
        """
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest():
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = [run for tier, run in sorted(tiers.items()) if tier and len(run) > 1]
        if not runs:
            return self.version()
        merged, old = [s for run in runs for s in self._merge(run)], {s["file"] for run in runs for s in run}
        return self._commit_on_latest(lambda shards: [s for s in shards if s["file"] not in old] + merged if old <= {s["file"] for s in shards} else None)

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> list[str]:
        """Drop all versions but the latest `keep`, then the files that no kept version names; returns these files.

        Manifests go first, so no version ever names a missing file.  Files that no dropped version named either belong
        to a writer at work or to a lost one: they go once they are `grace` seconds old.
        """
        if keep < 1:
            raise ValueError("at least one version is kept")
        versions = self.versions()
        live, dropped = ({s["file"] for v in part for s in self.manifest(v)} for part in (versions[-keep:], versions[:-keep]))
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        now, gone = self._jvm.java.lang.System.currentTimeMillis(), []
        for folder in ("data", "manifest"):
            if not self._fs.exists(self._path(f"{self.root}/{folder}")):
                continue
            found = self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
            while found.hasNext():
                status = found.next()
                path = status.getPath()
                name = f"data/{path.getParent().getName()}/{path.getName()}"
                if folder == "manifest":
                    stale = path.getName().startswith(".draft-") and now - status.getModificationTime() >= grace * 1000
                else:
                    stale = name not in live and (name in dropped or now - status.getModificationTime() >= grace * 1000)
                if stale:
                    self._fs.delete(path, False)
                    gone.append(name if folder == "data" else f"manifest/{path.getName()}")
        return sorted(gone)

    def _merge(self, run: list[dict]) -> list[dict]:
        """Files of about the target size with a run's rows. The scan packs whole small files into splits of that size, and each split is written as one file: no row is shuffled."""
        session = self.spark.newSession()
        for key, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{key}", str(value))
        rows = session.read.parquet(*[f"{self.root}/{s['file']}" for s in run])
        return self._write(rows)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version that is kept, the latest unless named."""
        shards = self.manifest(version)
        if not shards:
            raise ValueError("no version is committed")
        return self.spark.read.parquet(*[f"{self.root}/{s['file']}" for s in shards])


def shard_documents(docs: DataFrame, root: str | None = None, arrivals: int = 3, shard_rows: int = 1_000, target_bytes: int = TARGET_BYTES, keep: int | None = None) -> DataFrame:
    """Append docs in `arrivals` batches, compact after each, and tell for each row where it is now.

    keep: how many versions stay after each compaction; all unless given.

    Returns a row for each row: doc_id, shard (the file's number in the manifest), shard_rows, shard_bytes and version.
    Rows are dealt to arrivals by a hash of doc_id; null ids and texts, repeated rows and any other columns are stored as
    they are.  An empty table gives an empty result.  Which shard a row lies in depends on how the input is split.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes)
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k), shard_rows)
        store.compact()
        if keep:
            store.vacuum(keep)
    version = store.version()
    shards = store.manifest(version)
    listed = spark.createDataFrame([(s["file"].rpartition("/")[2], i, s["bytes"]) for i, s in enumerate(shards)], "_file string, shard int, shard_bytes long")
    rows = store.read(version).select("doc_id", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("shard_rows"))
    about = listed.join(sizes, "_file")
    return rows.join(about, "_file").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
