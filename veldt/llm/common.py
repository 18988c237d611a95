"""Table access, lineage cuts and small expressions that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

import veldt

_FOLDERS: dict[str, str] = {}

#: Executors get this package's functions with the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(veldt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir.

    Where that setting is missing a temporary folder takes its place, in local
    mode only: executors elsewhere would not see it. The folder is removed when the interpreter ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = Path(tempfile.mkdtemp(prefix="veldt-")).as_uri()
        _FOLDERS[app] = f"{base.rstrip('/')}/veldt-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def literal(df: DataFrame) -> Column:
    """The value of a one-row, one-column DataFrame as a literal.

    Unlike a scalar subquery it may stand inside higher-order functions, and
    unlike F.lit it holds the value in Spark's own binary form: it is built in
    the JVM, sent once to an executor for each stage, and plans don't print it.
    """
    jvm = df.sparkSession._jvm
    value = df._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    kind = df._jdf.schema().apply(0).dataType()
    expression = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


#: Bits of a member filter: at most 8 MB of them.
MOST_BITS = 1 << 26


def member_filter(ids: DataFrame, column: str) -> Column:
    """A condition on `column` that holds for every id of ids, and for few others.

    A bitmap with one hash and 16 bits an id or more, up to MOST_BITS; beyond
    that more others pass, and none of the ids is lost. It spares a join the
    shuffle of rows that have no partner.
    """
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    words = ids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one(at)).alias("bits"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(words, "word", "left")
    rows = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    bitmap = literal(every.agg(F.transform(rows, lambda x: x["bits"]).alias("bitmap")))
    return F.get(bitmap, F.shiftright(at, 6).cast("int")).bitwiseAND(one(at)) != 0
