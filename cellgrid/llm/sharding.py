"""Size-tiered sharding: small immutable shards, merged by size, under a versioned manifest.

An arrival is appended as shards that are never changed again. Compaction looks at the manifest's
sizes: shards of one size tier (a tier is FANOUT times the one below) are merged, once there are
FANOUT of them, into files of the target size. Merging needs no shuffle: Spark's file scan packs
small files into splits of the target size, and each split is written as one file. A version of the
manifest is written aside and then renamed to its number without overwriting, which fails if another
writer took it, so readers see a whole version or the one before. That rename is atomic on HDFS and
local file systems; on an object store without atomic rename, versions need its conditional put.

The first arrival settles the store's columns; later ones must have the same names and types, in any
order. All rows are kept as they are, nulls, ties, repeated rows and long texts too. An empty arrival
adds no rows, and an empty store reads as no rows of its columns. Columns may have any names: what
the store adds is read from file metadata, and `sharded` gives its own two columns names that are free.

Shards live in runs, a folder for each arrival or merge. A reader is given a run's folder where all of
its files are live, and file names only where a merge took some of them. `vacuum` removes the shards
that no spared version names, those of writers that never committed included, and old manifests.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 4
SMALLEST_TIER = 1 << 20
TARGET_BYTES = 128 << 20
#: Files that no manifest names are taken for a lost writer's after this time.
GRACE_SECONDS = 24 * 3600

_MANIFEST = "file string, bytes long, rows long, tier int, run string, run_files long"


def _plain(path: Column) -> Column:
    """A path with one slash after its scheme, as some readers give it and others do not."""
    return F.regexp_replace(path, "^([a-zA-Z][a-zA-Z0-9+.-]*):/+", "$1:/")


class ShardStore:
    """Shards and manifests under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """The committed versions."""
        at = self._path("manifest")
        if not self._files().exists(at):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{version:09d}")

    def schema(self) -> StructType:
        """The columns that the first arrival settled."""
        found = self.spark.read.text(f"{self.root}/schema").first()
        return StructType.fromJson(json.loads(found.value))

    def _rename(self, aside: str, name: str) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(self._path(aside), self._path(name), no_overwrite)

    def _settle(self, arrival: DataFrame) -> DataFrame:
        """`arrival` in the order of the store's columns, which the first arrival settles."""
        if not self._files().exists(self._path("schema")):
            plain = StructType([type(f)(f.name, f.dataType, True) for f in arrival.schema])
            aside = f"_schema-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(plain.json(),)], "value string").coalesce(1).write.text(f"{self.root}/{aside}")
            try:
                self._rename(aside, "schema")
            except Exception:  # another writer settled them first
                if not self._files().exists(self._path("schema")):
                    raise
        own = self.schema()
        if sorted(arrival.dtypes) != sorted((f.name, f.dataType.simpleString()) for f in own):
            raise ValueError(f"the store has the columns {own.simpleString()}")
        return arrival.select(*(arrival[f"`{n}`"] for n in own.names))

    def commit(self, entries: DataFrame, version: int) -> int:
        """Makes `entries` the version after `version`; raises if that exists already."""
        aside = f"manifest/_next-{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(f"{self.root}/{aside}")
        self._rename(aside, f"manifest/{version + 1:09d}")
        return version + 1

    def _written(self, df: DataFrame, folder: str, by: str | None = None) -> DataFrame:
        """Writes shards and returns their manifest entries."""
        run = f"{folder}-{uuid.uuid4().hex}"
        path = f"{self.root}/shards/{run}"
        if by is None:
            df.write.parquet(path)
        else:
            apart = f"_by_{uuid.uuid4().hex}"  # in the folders' names only; hashed, as a value may be no name
            df.withColumn(apart, F.hex(F.xxhash64(by))).write.partitionBy(apart).parquet(path)
        found = self._scan([path])
        meta = found.metadataColumn("_metadata")
        seen = found.select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"))
        entries = seen.groupBy("file", "bytes").agg(F.count("*").alias("rows"))
        total = F.broadcast(entries.agg(F.count("*").alias("run_files")))  # one row
        return entries.crossJoin(total).select("file", "bytes", "rows", self._tier("bytes").alias("tier"), F.lit(run).alias("run"), "run_files")

    def _scan(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema()).option("recursiveFileLookup", "true")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema())

    def _tier(self, size: str):
        return F.greatest(F.lit(0), F.floor(F.log(F.col(size) / SMALLEST_TIER) / math.log(self.fanout))).cast("int")

    def append(self, arrival: DataFrame, by: str | None = None) -> int:
        """Adds an arrival's rows; `by` names a column whose values arrive in shards of their own."""
        arrival = self._settle(arrival)
        version = self.version()
        return self.commit(self.manifest(version).unionByName(self._written(arrival, "arrival", by)), version)

    def compact(self) -> int:
        """Merges every tier that has enough shards below the target size; returns the version then current."""
        version = self.version()
        now = self.manifest(version)
        small = now.filter(F.col("bytes") < 0.75 * self.target)
        full = small.groupBy("tier").agg(F.count("*").alias("n")).filter(f"n >= {self.fanout}")
        merged = small.join(full, "tier", "left_semi").select(*now.columns)
        out = now.join(merged.select("file"), "file", "left_anti")
        changed = False
        for tier in sorted(r.tier for r in full.select("tier").collect()):
            out = out.unionByName(self._merged(merged.filter(F.col("tier") == tier), f"tier{tier}"))
            changed = True
        return self.commit(out.select(*now.columns), version) if changed else version

    def _merged(self, entries: DataFrame, folder: str) -> DataFrame:
        """Writes the rows of files anew, a file for each split of the target size, and returns the entries."""
        wanted = {"maxPartitionBytes": str(self.target), "openCostInBytes": "0", "minPartitionNum": "1"}
        conf = self.spark.conf
        before = {k: conf.get(f"spark.sql.files.{k}", None) for k in wanted}
        try:
            for k, v in wanted.items():
                conf.set(f"spark.sql.files.{k}", v)
            return self._written(self._scan(self._paths(entries)), folder)
        finally:
            for k, v in before.items():
                conf.set(f"spark.sql.files.{k}", v) if v is not None else conf.unset(f"spark.sql.files.{k}")

    def _paths(self, entries: DataFrame) -> list[str]:
        """Folders of the runs that `entries` hold whole, and the file names of the others."""
        live = entries.groupBy("run").agg(F.count("*").alias("n"), F.max("run_files").alias("all"))
        whole = [f"{self.root}/shards/{r.run}" for r in live.filter("n = all").select("run").collect()]
        return whole + [r.file for r in entries.join(live.filter("n < all").select("run"), "run", "left_semi").select("file").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless named."""
        return self._scan(self._paths(self.manifest(version)))

    def vacuum(self, keep: int = 1, grace_seconds: int = GRACE_SECONDS) -> list[str]:
        """Removes the shards that none of the newest `keep` versions names, and older manifests; returns the files.

        A file that no version names may belong to a writer at work, so it goes only after the grace period.
        """
        versions = self.versions()
        if not versions:
            return []
        spared, older = versions[-keep:], versions[:-keep]
        named = lambda some: self._union(some).select(_plain(F.col("file")).alias("name")).distinct()
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/shards")
        there = there.select("path", _plain(F.col("path")).alias("name"), "modificationTime")
        left = there.join(named(spared), "name", "left_anti").join(named(older).withColumn("old", F.lit(True)), "name", "left")
        lost = F.col("modificationTime") <= F.timestamp_seconds(F.lit(time.time() - grace_seconds))
        gone = []
        for row in left.filter(F.coalesce("old", F.lit(False)) | lost).select("path").toLocalIterator():
            self._files().delete(self._jvm.org.apache.hadoop.fs.Path(row.path), False)
            gone.append(row.path)
        for version in older:
            self._files().delete(self._path(f"manifest/{version:09d}"), True)
        return gone

    def _union(self, versions: list[int]) -> DataFrame:
        out = self.manifest(0)
        for version in versions:
            out = out.unionByName(self.manifest(version))
        return out


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def sharded(docs: DataFrame, root: str, by: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """`docs` appended to a new store and compacted: all columns, and `shard` and `shard_bytes` of where each row lies.

    Where `docs` has a column of such a name, underscores follow the added one's until it is free.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes)
    store.append(docs, by)
    store.compact()
    rows = store.read()
    names = [_free(n, docs.columns) for n in ("shard", "shard_bytes")]
    if not store.manifest().take(1):
        return rows.select("*", F.lit(None).cast("string").alias(names[0]), F.lit(None).cast("long").alias(names[1]))
    meta = rows.metadataColumn("_metadata")
    return rows.select("*", meta["file_name"].alias(names[0]), meta["file_size"].alias(names[1]))
