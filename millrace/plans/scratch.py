"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/millrace/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet under the scratch root and read it back: later actions survive lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Call it when no result that was made from them will be read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(_folder(spark))
    p.getFileSystem(conf).delete(p, True)
