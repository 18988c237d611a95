"""Sinks: readers see whole tables only.

A table is written beside its place and put there by renames. Between the two
renames of an overwrite a reader finds no table; if the second one fails, the
old table is put back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import VersionedTable


def _swap(df: DataFrame, staged: str, final: str) -> None:
    """Puts a finished folder in the place of another by renames."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(conf)
    old = f"{final.rstrip('/')}.old-{uuid.uuid4().hex}"
    if fs.exists(path(final)):
        fs.rename(path(final), path(old))
    fs.mkdirs(path(final).getParent())
    if not fs.rename(path(staged), path(final)):
        if fs.exists(path(old)):
            fs.rename(path(old), path(final))
        raise OSError(f"cannot publish {final}")
    fs.delete(path(old), True)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header in a folder; one file only for tables known to be small."""
    staged = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    (df.coalesce(1) if one_file else df).write.option("header", True).csv(staged)
    _swap(df, staged, path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    staged = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    if partition_by:
        df = df.repartition(*[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    _swap(df, staged, path)


def merge_append(new: DataFrame, path: str, keys: list[str], order: tuple[str, ...] = (), buckets: int = 16) -> DataFrame:
    """Adds rows to a versioned table and returns it; of equal keys the last new row by `order` stays."""
    table = VersionedTable(new.sparkSession, path, keys, buckets)
    table.merge(new, order)
    return table.read()


def patch_manifest(entries: DataFrame, path: str) -> DataFrame:
    """Adds entries (name, length, sha256, note) to a manifest; an entry of the same name is replaced, all others stay."""
    return merge_append(entries.select("name", "length", "sha256", "note"), path, ["name"])
