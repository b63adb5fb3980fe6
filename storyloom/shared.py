"""Tables and checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders chosen for sessions that name none, by application.
_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset: a temporary folder in local mode (tests), else a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        if spark.sparkContext.master.startswith("local["):
            _DIRS[app] = "file://" + tempfile.mkdtemp(prefix="storyloom-")
        else:
            _DIRS[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_storyloom"
        spark.sparkContext.setCheckpointDir(_DIRS[app])
    return _DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/storyloom/{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(delete_path, spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path by Hadoop's file system; a stopped session leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM is gone at exit
        pass


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: this cuts the lineage,
    and a lost executor costs no more than its running tasks.

    Rows of many megabytes need file_rows, the most that a file holds: a file's rows are in memory together while it is
    written (sizes are first looked at after a hundred rows) and when a batch of it is read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").option("maxRecordsPerFile", file_rows).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._storyloom_path = path
    return written


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, its rows dealt anew by a key if fewer of its partitions hold any than the cluster has cores.

    A file of one large row group is one task, whatever its size; what is expensive for each row should not be. Which
    partitions hold rows is read without reading any column, and where enough do, nothing is shuffled. By a key, as
    rows dealt in turn are all sorted first in the task that reads them; to eight tasks a core, so that each is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if held >= cores else df.repartition(8 * cores, key)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, which nothing may read any more."""
    delete_path(df.sparkSession, df._storyloom_path)
