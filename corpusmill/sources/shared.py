"""Tables in the folder that driver and executors share: spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without the setting; one temporary folder a session is made then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder name below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def temporary(spark: SparkSession, uri: str) -> str:
    """`uri`, a folder (made if it isn't there) that is removed when the application ends."""
    filesystem, path = _file_system(spark, uri)
    filesystem.mkdirs(path)
    filesystem.deleteOnExit(path)
    return uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The table is there until discard() or the application's end.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    temporary(spark, path)
    written = spark.read.schema(schema).parquet(path)
    written.written_to_ = path
    return written


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing will read any more."""
    filesystem, path = _file_system(df.sparkSession, df.written_to_)
    filesystem.delete(path, True)
