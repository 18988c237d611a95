"""Tables of versions: a merge rewrites the buckets it touches and then names a new version.

    <table>/buckets=<n>                 how many buckets there are
    <table>/data/<write>/bucket=<b>/    rows of a bucket, as one merge left them
    <table>/versions/<number>           lines: bucket and write of each bucket that has rows

A version is a file that a rename puts in place and that is never changed, so
readers see the old version or the new one, and a merge that fails leaves the
old one. Buckets without new keys keep their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made this version first."""


class VersionedTable:
    """Rows known by keys, in buckets by a hash of the keys."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        """buckets: of a new table; a table that is there keeps its own."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self._paths, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._files = self._paths(self.path).getFileSystem(self._conf)
        found = self._names(self.path, "buckets=")
        self.buckets = int(found[0].removeprefix("buckets=")) if found else buckets

    def _names(self, folder: str, prefix: str = "") -> list[str]:
        if not self._files.exists(self._paths(folder)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._files.listStatus(self._paths(folder))) if n.startswith(prefix) and not n.startswith((".", "_")))

    @property
    def version(self) -> int:
        """The newest version; 0 for a table that nothing was merged into."""
        return max((int(n) for n in self._names(f"{self.path}/versions")), default=0)

    def _writes(self, version: int) -> dict[int, str]:
        """The write that has each bucket's rows; at most as many as buckets."""
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/versions/{version:08d}").collect()
        return {int(b): w for b, w in (r["value"].split(" ") for r in lines)}

    def _read(self, writes: dict[int, str]) -> DataFrame | None:
        folders = [f"{self.path}/data/{w}/bucket={b}" for b, w in sorted(writes.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        number = self.version if version is None else version
        rows = self._read(self._writes(number))
        if rows is None:
            raise FileNotFoundError(f"{self.path} has no version {number}")
        return rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, order: Sequence[str] = ()) -> int:
        """Adds rows and returns the version; of equal keys the last row stays.

        New rows come after old ones; among the new ones `order` tells which
        is last, ties by all columns, so that a stage run again keeps the same
        row; maps can't be compared and are refused. Columns `bucket` and
        `is_new` are the table's own. Only buckets that new keys fall into are read and written. NULL
        keys are equal to each other. Without new rows nothing happens.
        Raises Conflict if another writer made the version meanwhile.
        """
        before = self.version
        old_writes = self._writes(before)
        write = uuid.uuid4().hex
        staged = f"{self.path}/data/{write}"
        marked = new.withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in marked.select("bucket").distinct().collect()]  # at most as many as buckets
        if not touched:
            return before
        old = self._read({b: w for b, w in old_writes.items() if b in touched})
        rows = marked.withColumn("is_new", F.lit(True))
        if old is not None:
            rows = rows.unionByName(old.withColumns({"bucket": self._bucket(), "is_new": F.lit(False)}), allowMissingColumns=True)
        columns = [c for c in rows.columns if c not in ("bucket", "is_new")]
        # the largest of these is the last row; each task leaves one row of a key before the keys meet
        last = F.struct("is_new", *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"))
        kept = rows.groupBy("bucket", *[F.col(k).alias(f"key_{i}") for i, k in enumerate(self.keys)]).agg(F.max(last).alias("last")).select("bucket", "last.row.*")
        kept.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.option("compression", "zstd").partitionBy("bucket").parquet(staged)
        self._publish(before + 1, old_writes | dict.fromkeys(touched, write))
        return before + 1

    def _publish(self, number: int, writes: dict[int, str]) -> None:
        jvm, at = self.spark._jvm, self._paths
        if not self._names(self.path, "buckets="):
            self._files.mkdirs(at(f"{self.path}/buckets={self.buckets}"))
        self._files.mkdirs(at(f"{self.path}/versions"))
        staged, final = at(f"{self.path}/.version-{uuid.uuid4().hex}"), at(f"{self.path}/versions/{number:08d}")
        out = self._files.create(staged, False)
        out.write(bytearray("".join(f"{b} {w}\n" for b, w in sorted(writes.items())).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, final, options)  # fails if the version is there
        except Exception as e:
            self._files.delete(staged, False)
            if self._files.exists(final):
                raise Conflict(f"version {number} of {self.path} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions but the last `keep`, and writes that none of these names; how many writes went.

        For quiet times: it would take a merge under way for one that failed.
        """
        numbers = [int(n) for n in self._names(f"{self.path}/versions")][-keep:]
        named = {w for n in numbers for w in self._writes(n).values()}
        for n in self._names(f"{self.path}/versions")[:-keep]:
            self._files.delete(self._paths(f"{self.path}/versions/{n}"), False)
        gone = [w for w in self._names(f"{self.path}/data") if w not in named]
        for w in gone:
            self._files.delete(self._paths(f"{self.path}/data/{w}"), True)
        return len(gone)
