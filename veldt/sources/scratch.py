"""A folder for tables that live as long as the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir; removed when the interpreter ends.

    Without that setting a temporary folder takes its place, in local mode
    only: executors elsewhere would not see it.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = Path(tempfile.mkdtemp(prefix="veldt-")).as_uri()
        _FOLDERS[app] = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: later jobs read it instead of making it again, also after executors were lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
