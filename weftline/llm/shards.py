"""Size-tiered shards: small immutable appends, merges of similar sizes, and an atomically committed manifest.

Layout below one root: data/<commit>/... Parquet files that never change, manifests/v<number>.json. A
manifest lists all live shards with their bytes, rows, arrival and tier, and the columns of the store; the
highest version is the store. A commit writes a temporary file and renames it to the next version without
overwriting, so of two writers that start from one version one gets Conflict: appends then commit again on top
of the other's version, merges too if all shards they merged are still live, else their files go. A call of
append() is one version, so it is visible whole or not at all. A commit checks that the files it adds exist.

vacuum() deletes what versions that it drops have named and kept ones don't. Files that no version names may
belong to a writer that has not committed yet; they go only when older than a stated grace period, so data of a
job or executor lost midway is cleared in the end and a live writer's is not.

A shard's tier is the logarithm (base FAN_IN) of its bytes over the smallest size; shards near the target
size are finished. A tier with FAN_IN shards or more is merged by one job, which reads its files and writes
ceil(bytes / target) files without a shuffle: partitions are coalesced, never dealt out anew.

Everything is DataFrame work or calls of Hadoop's file system in the driver's JVM; no Python runs on executors.

Cases: nulls, empty and very long texts and repeated rows are kept as they are. The store's columns are the
union of all appends' in order of arrival, null where a shard lacks one; a column that comes again with another
type is refused (ValueError), as names that differ in case only are. An empty table commits a version without
shards; reading a store without shards needs a schema (or an earlier append's) and gives an empty DataFrame.
Columns named as the store's own helper column are kept, the helper gets another name.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    #: Shards of a tier that are merged at least; also the base of tiers.
    FAN_IN = 4

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, smallest_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.smallest = spark, root.rstrip("/"), target_bytes, smallest_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- files -------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of the Parquet files below a folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        found, it = [], self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            status = it.next()
            name = status.getPath().toString()
            if name.endswith(".parquet") and "/_temporary/" not in name:
                found.append((name, status.getLen()))
        return sorted(found)

    def _manifest_name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the latest by default; version 0 is the empty store."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        stream = self._fs.open(self._path(self._manifest_name(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict], why: str, schema: dict | None = None, added: list[dict] = ()) -> int:
        """Makes `shards` the live ones of version base + 1, or raises Conflict; `added`: those whose files must be there."""
        missing = [s["path"] for s in added if not self._fs.exists(self._path(s["path"]))]
        if missing:
            raise FileNotFoundError(f"{len(missing)} files of the commit are gone, the first is {missing[0]}")
        body = json.dumps({"version": base + 1, "parent": base, "why": why, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])})
        temp = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temp, self._path(self._manifest_name(base + 1)), none)
        except Exception as e:
            self._fs.delete(temp, False)
            if base + 1 in self.versions():
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.FAN_IN))) if size > self.smallest else 0

    def _shards(self, folder: str, arrival: int) -> list[dict]:
        """Entries for all files of a folder; rows come from the files' footers."""
        files = self._list(folder)
        if not files:
            return []
        counts = {r["path"]: r["n"] for r in self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()}
        inside = lambda p: p.split(folder.rsplit("/", 1)[-1], 1)[1]  # noqa: E731  two arrivals may hold files of one name
        rows = {inside(p): n for p, n in counts.items()}
        return [{"path": p, "bytes": b, "rows": rows.get(inside(p), 0), "arrival": arrival, "tier": self.tier(b)} for p, b in files]

    # -- operations --------------------------------------------------------------------------------------

    def _merged_schema(self, known: dict | None, new: StructType) -> dict:
        """The store's columns and a new append's; every column may be null."""
        fields = list(StructType.fromJson(known).fields) if known else []
        names = {f.name.lower(): f for f in fields}
        for f in new.fields:
            old = names.get(f.name.lower())
            if old is None:
                fields.append(StructField(f.name, f.dataType, True))
                names[f.name.lower()] = fields[-1]
            elif (old.name, old.dataType) != (f.name, f.dataType):
                raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not fit the store's {old.name} {old.dataType.simpleString()}")
        return json.loads(StructType(fields).json())

    def append(self, df: DataFrame, arrival: Column | None = None, rows_per_shard: int = 20_000) -> int:
        """Adds rows as small shards and returns the version; arrival (a column of small whole numbers) parts them.

        All arrivals of a call are written by one job and committed by one version.
        """
        self._merged_schema(self.manifest()["schema"], df.schema)  # refused before anything is written
        helper = "append_arrival"
        while helper.lower() in {c.lower() for c in df.columns}:
            helper += "_"
        folder = f"{self.root}/data/append-{uuid.uuid4().hex}"
        dealt = df.withColumn(helper, F.coalesce(arrival if arrival is not None else F.lit(0), F.lit(0)).cast("int"))
        dealt.write.option("maxRecordsPerFile", rows_per_shard).partitionBy(helper).parquet(folder)
        new = [s | {"arrival": int(s["path"].split(f"{helper}=")[1].split("/")[0])} for s in self._shards(folder, 0)]
        while True:
            base = self.manifest()
            with contextlib.suppress(Conflict):
                return self.commit(base["version"], base["shards"] + new, "append", self._merged_schema(base["schema"], df.schema), new)

    def plan(self, shards: list[dict]) -> dict[int, list[dict]]:
        """Tiers that are due: shards below half the target, FAN_IN of similar size or more."""
        by_tier = defaultdict(list)
        for s in shards:
            if 2 * s["bytes"] < self.target:
                by_tier[s["tier"]].append(s)
        return {t: group for t, group in sorted(by_tier.items()) if len(group) >= self.FAN_IN}

    def compact(self) -> list[int]:
        """Merges tiers until none is due; returns the versions it committed."""
        made = []
        while True:
            base = self.manifest()
            due = self.plan(base["shards"])
            if not due:
                return made
            old, new = [], []
            for t, group in due.items():
                files = max(1, round(sum(s["bytes"] for s in group) / self.target))
                folder = f"{self.root}/data/merge-{uuid.uuid4().hex}"
                self._reader(base["schema"]).parquet(*(s["path"] for s in group)).coalesce(files).write.parquet(folder)
                merged = [s | {"tier": max(s["tier"], t + 1)} for s in self._shards(folder, -1)]
                if sum(s["rows"] for s in merged) != sum(s["rows"] for s in group):
                    raise RuntimeError("a merge changed the number of rows")
                old += group
                new += merged
            why = f"merge of tiers {', '.join(map(str, due))}"
            while True:
                gone = {s["path"] for s in old}
                live = [s for s in base["shards"] if s["path"] not in gone]
                if len(live) + len(gone) != len(base["shards"]):  # another merge came first: start over
                    for s in new:
                        self._fs.delete(self._path(s["path"]), False)
                    break
                try:
                    made.append(self.commit(base["version"], live + new, why, base["schema"], new))
                    break
                except Conflict:
                    base = self.manifest()

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400.0) -> int:
        """Drops all versions but the last `keep` with the files that only they name; returns how many files went.

        Files that no version names go if they are older than grace_seconds: longer than any writer takes between
        writing its files and committing them. Readers of a dropped version fail.
        """
        versions = self.versions()
        kept, dropped = versions[-keep:], versions[:-keep]
        named = {s["path"] for v in kept for s in self.manifest(v)["shards"]}
        expired = {s["path"] for v in dropped for s in self.manifest(v)["shards"]} - named
        oldest = time.time() - grace_seconds
        gone = []
        for p, _ in self._list(f"{self.root}/data"):
            if p in named:
                continue
            if p in expired or self._fs.getFileStatus(self._path(p)).getModificationTime() / 1000 < oldest:
                gone.append(p)
        for p in gone:
            self._fs.delete(self._path(p), False)
        for v in dropped:
            self._fs.delete(self._path(self._manifest_name(v)), False)
        return len(gone)

    def _reader(self, schema: dict | StructType | None):
        if isinstance(schema, dict):
            schema = StructType.fromJson(schema)
        return self.spark.read.schema(schema) if schema else self.spark.read

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version."""
        at = self.manifest(version)
        paths = [s["path"] for s in at["shards"]]
        schema = schema or at["schema"]
        if not paths:
            return self.spark.createDataFrame([], StructType.fromJson(schema) if isinstance(schema, dict) else schema or StructType([]))
        return self._reader(schema).parquet(*paths)
