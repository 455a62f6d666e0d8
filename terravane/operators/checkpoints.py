"""Writing intermediates of iterative operators to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir; only a local master may leave that unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{where or tempfile.gettempdir()}/terravane-steps-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs tasks after this alone."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, parts: int, dealt: bool = False) -> DataFrame:
    """As cut, dealt into parts by key, unless it is so already: what is then joined or grouped by key reads it where it lies and does not move it."""
    spark, path, table = df.sparkSession, f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}", f"terravane_{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(parts, key)).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone; its files lie in the shared folder and the plan knows them
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of what cut() or bucketed() returned, where nothing reads them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what cut() wrote in this application, once its results have been consumed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
