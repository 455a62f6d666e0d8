"""Plumbing the operators share: the cluster's shared folder, written intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of Arrow data handed to a Python worker at once; they bound a worker's memory whatever the rows' width.
ARROW_BATCH_BYTES, ARROW_BATCH_ROWS = 3 << 20, 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes; long texts would otherwise come ten thousand rows at a time.

    Results are lazy, so the two session options stay set; smaller values of the caller's are left as they are.
    """
    for key, most in (("maxBytesPerBatch", ARROW_BATCH_BYTES), ("maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may leave it unset: executors elsewhere would not see the driver's disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/terravane-checkpoints"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediates."""
    return f"{shared_dir(spark)}/terravane-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. A lost executor costs only tasks after this."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete what written() wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            remove(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediates of this application, once its results have been consumed."""
    remove(spark, run_dir(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def one_row(docs: DataFrame, *keys) -> DataFrame:
    """One row for each value of the keys, the one of greatest hash; rows are combined before the shuffle."""
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    rows = docs.select(*named, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    luck = F.xxhash64(*[F.col("_row")[c] for c in docs.columns])
    return rows.groupBy(*[f"_key{i}" for i in range(len(keys))]).agg(F.max_by("_row", luck).alias("_row"))


def held_out(doc_id):
    """True where crc32 of the id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ascii_lower(text):
    """Lower-case A-Z only; other letters keep their case. All-ASCII text takes Spark's own lower()."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
