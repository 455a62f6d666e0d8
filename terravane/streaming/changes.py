"""The change log as a stream: tailing, debounced batches, windows with late data, deduplication, incremental apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail(events: DataFrame, after: int, most: int = 50) -> DataFrame:
    """Events after an id, oldest first."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(most)


def prune(events: DataFrame, keep: int = 500) -> DataFrame:
    """The newest events; the cut is one number, found by a take-ordered."""
    edge = events.orderBy(F.desc("event_id")).limit(keep).agg(F.min("event_id").alias("edge"))
    return events.join(F.broadcast(edge), F.col("event_id") >= F.col("edge"), "left_semi")  # one row


def debounce(events: DataFrame, keys: list[str], gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Batches of changes that follow each other within gap: keys, start, end, changes."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("changes")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def windowed(events: DataFrame, keys: list[str], size: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def apply_batches(changes: DataFrame, apply, checkpoint: str):
    """Run apply(batch, number) for each micro-batch until the input is drained; the checkpoint folder makes reruns start where they stopped."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_last(events: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest events of each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("event_id")))
    return events.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def poll_intervals(polls: DataFrame, key: str, order: str, least: float = 1.0, most: float = 10.0, growth: float = 1.5) -> DataFrame:
    """key, order, interval: how long to wait after each poll (key, order, changed): the least after a change, else `growth` times the wait before.

    A wait after k polls without a change is the least times growth to the k, so a running count of them suffices.
    """
    w = W.partitionBy(key).orderBy(order)
    last = F.last(F.when(F.col("changed"), F.col("_n")), ignorenulls=True).over(w)
    p = polls.withColumn("_n", F.row_number().over(w))
    quiet = F.col("_n") - F.coalesce(last, F.lit(0))
    return p.select(key, order, F.least(F.lit(most), F.lit(least) * F.pow(F.lit(growth), quiet)).alias("interval"))
