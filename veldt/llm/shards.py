"""A store of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small shards. Shards of similar size form a tier;
when a tier has enough of them they are merged into shards of the target
size. A version lists the shards that make up the store; it is published by a
rename that fails if another writer has published the same number.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    size: int
    since: int  # version that made it
    arrival: int  # the first version whose rows it holds
    rows: int = 0


class Conflict(RuntimeError):
    """Another writer has published this version or taken away a shard being merged."""


def _below_data(path: str) -> str:
    return path.rsplit("data/", 1)[-1]


def _file() -> Column:
    """Of a row that is read: its shard's path below data/. Files of one job have one name in several folders."""
    return F.substring_index(F.input_file_name(), "/data/", -1)


#: What read() tells of each row's shard.
OWN = ("shard", "shard_size", "since", "arrival")


def _free(name: str, columns: list[str]) -> str:
    """The name, or one with more underscores, that no column has in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class ShardStore:
    """Versions v1, v2, ... in `folder`, a path of any file system that Spark knows.

    small: bytes of an appended shard, before compression, at most about;
    target: bytes of a merged shard, about. fanout: shards of a tier that
    start a merge; a tier spans sizes within this factor. Shards of half the
    target or more are finished.
    """

    def __init__(self, spark: SparkSession, folder: str, small: int = 4 << 20, target: int = 32 << 20, fanout: int = 4):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.small, self.target, self.fanout = small, target, fanout
        jvm = spark._jvm
        self._path = lambda p="": jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}" if p else self.folder)
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifest"))

    # versions

    def latest(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifest"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"shards": [], "schema": None}
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self._manifest(self.latest() if version is None else version)["shards"]]

    def _publish(self, version: int, shards: list[Shard], schema: str | None) -> int:
        jvm = self.spark._jvm
        draft, final = self._path(f"manifest/draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the version is there
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from None
            raise
        return version

    def commit(self, added: list[Shard], removed: list[Shard], schema: str | None = None, attempts: int = 10) -> int:
        """Publishes a version with these changes to the latest one; tries again after other writers' commits."""
        for _ in range(attempts):
            version = self.latest()
            manifest = self._manifest(version)
            now = [Shard(**x) for x in manifest["shards"]]
            gone = {s.path for s in removed}
            if not gone <= {s.path for s in now}:
                raise Conflict("a shard to be replaced is no longer there")
            try:
                return self._publish(version + 1, [s for s in now if s.path not in gone] + [replace(s, since=version + 1, arrival=s.arrival or version + 1) for s in added], schema or manifest["schema"])
            except Conflict:
                continue
        raise Conflict(f"no commit in {attempts} attempts")

    # data

    def _files(self, folder: str) -> list[tuple[str, int]]:
        found, rest = [], [self._path(folder)]
        while rest:
            for f in self._fs.listStatus(rest.pop()):
                if f.isDirectory():
                    rest.append(f.getPath())
                elif f.getPath().getName().endswith(".parquet"):
                    found.append((f.getPath().toString(), f.getLen()))
        root = self._fs.makeQualified(self._path()).toString().rstrip("/") + "/"
        return sorted((self._fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(p)).toString().removeprefix(root), n) for p, n in found)

    def _row_bytes(self, rows: DataFrame) -> float:
        """Bytes of a row before compression, on average: of its strings and binaries, and 8 for each other column."""
        sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in rows.schema]
        return rows.agg(F.avg(sum(sizes, F.lit(0)))).first()[0] or 1.0

    def append(self, rows: DataFrame) -> int:
        """Writes rows as small shards, in the partitions they come in, without a shuffle; no rows make no shard."""
        folder = f"data/{uuid.uuid4().hex}"
        most = max(1, int(self.small / self._row_bytes(rows)))
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(f"{self.folder}/{folder}")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{folder}")
        counts = {r["file"]: r["rows"] for r in kept.groupBy(_file().alias("file")).agg(F.count("*").alias("rows")).collect()}
        files = [(p, n, counts.get(_below_data(p), 0)) for p, n in self._files(folder)]
        return self.commit([Shard(p, n, 0, 0, rows) for p, n, rows in files if rows], [], rows.schema.json())

    def plan(self) -> list[list[Shard]]:
        """Runs to merge: the shards of each tier that has `fanout` of them, cut where the target is reached."""
        tiers: list[list[Shard]] = []
        for s in sorted((s for s in self.shards() if s.size < self.target / 2), key=lambda s: (s.size, s.path)):
            if tiers and s.size <= self.fanout * tiers[-1][0].size:
                tiers[-1].append(s)
            else:
                tiers.append([s])
        runs: list[list[Shard]] = []
        for tier in tiers:
            if len(tier) < self.fanout:
                continue
            run: list[Shard] = []
            for s in sorted(tier, key=lambda s: (s.arrival, s.path)):
                if run and sum(x.size for x in run) + s.size > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [run for run in runs if len(run) > 1]

    def compact(self) -> int:
        """Merges what plan() names, all runs in one job, and commits; returns the version (unchanged if nothing is due).

        Each run becomes one shard. A run holds target bytes at most, so a
        task's work is bounded; the inputs stay for readers of older versions
        until vacuum().
        """
        runs = self.plan()
        if not runs:
            return self.latest()
        merged = [s for run in runs for s in run]
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._read(merged)
        file, run_of = _free("shard_file", rows.columns), _free("shard_run", rows.columns)
        of = self.spark.createDataFrame([(_below_data(s.path), k) for k, run in enumerate(runs) for s in run], f"{file} string, {run_of} int")
        # of: one row for each shard of the plan, whatever the shards hold; a run lies in one partition, so it makes one file of its folder
        rows = rows.withColumn(file, _file()).join(F.broadcast(of), file).drop(file).repartition(len(runs), run_of)
        rows.write.option("compression", "zstd").partitionBy(run_of).parquet(f"{self.folder}/{folder}")
        made = []
        for p, size in self._files(folder):
            run = runs[int(p.rsplit("/", 2)[-2].removeprefix(f"{run_of}="))]
            made.append(Shard(p, size, 0, min(s.arrival for s in run), sum(s.rows for s in run)))
        if len(made) != len(runs):
            raise RuntimeError(f"{len(runs)} runs made {len(made)} files")
        return self.commit(made, merged)

    def vacuum(self, keep: int = 2, spare_seconds: int = 86_400) -> int:
        """Deletes files that only versions before the last `keep` list; returns how many.

        Files that no version lists may belong to a commit under way: they go
        when they are older than spare_seconds.
        """
        latest = self.latest()
        listed = {v: {s.path for s in self.shards(v)} for v in range(1, latest + 1)}
        used = set().union(*[listed[v] for v in listed if v > latest - keep])
        old = set().union(*listed.values()) - used
        before = time.time() - spare_seconds
        gone = [p for p, _ in self._files("data") if p in old or p not in used and self._fs.getFileStatus(self._path(p)).getModificationTime() / 1000 < before]
        for p in gone:
            self._fs.delete(self._path(p), False)
        return len(gone)

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with shard (its path), shard_size, since and arrival of each; none if it has no shard.

        A stored column of one of these names comes back as stored_<name>.
        """
        manifest = self._manifest(self.latest() if version is None else version)
        shards = [Shard(**x) for x in manifest["shards"]]
        own = "shard string, shard_size long, since int, arrival int"
        schema = StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType()
        rows = self._read(shards) if shards else self.spark.createDataFrame([], schema)
        rows = rows.withColumnsRenamed({c: _free(f"stored_{c}", rows.columns) for c in rows.columns if c.lower() in OWN})
        file = _free("shard_file", rows.columns)
        listed = self.spark.createDataFrame([(_below_data(s.path), s.path, s.size, s.since, s.arrival) for s in shards], f"{file} string, {own}")
        return rows.withColumn(file, _file()).join(listed, file).drop(file)
