"""Fusion of candidate channels, deduplication, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from .graph import lookup, reach_both_ways


def absorb(channels: dict[str, DataFrame]) -> DataFrame:
    """query_id, id, a column a channel (the greatest value) and the sorted names of the channels that found it."""
    out = None
    for name, df in channels.items():
        values = [F.col("value") if c == name else F.lit(None).cast("double") for c in channels]
        row = df.select("query_id", "id", *[v.alias(c) for v, c in zip(values, channels)], F.lit(name).alias("channel"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in channels], F.array_sort(F.collect_set("channel")).alias("channels"))


def normalised(df: DataFrame, column: str = "score") -> DataFrame:
    """value: the column over its greatest in the query."""
    most = F.max(column).over(W.partitionBy("query_id"))
    return df.select("query_id", "id", F.when(most > 0, F.col(column) / most).otherwise(0.0).alias("value"))


def provenance_bonus(edges: DataFrame, first: int = 20) -> DataFrame:
    """id, bonus: the best bonus among the first outbound edges of each node, the surest first."""
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("confidence"), "target_id", "type", "provenance"))
    some = edges.withColumn("r", rank).where(F.col("r") <= first)
    return some.groupBy(F.col("source_id").alias("id")).agg(F.max(lookup(V.PROVENANCE_BONUS, F.col("provenance"), 0.0)).alias("bonus"))


def fuse(candidates: DataFrame, entities: DataFrame, importance: DataFrame, communities: DataFrame, bonus: DataFrame, features: list[str]) -> DataFrame:
    """Weighted sum of features, centrality, kind prior, community affinity and bonus: score, rank, contributions.

    Features without a weight count nothing. Of equally frequent communities the least is the dominant one.
    """
    c = candidates.join(entities.select("id", "kind"), "id")
    c = c.join(importance.select("id", F.col("value").alias("importance")), "id", "left").join(communities.select("id", "community"), "id", "left").join(bonus, "id", "left")
    size = F.count("community").over(W.partitionBy("query_id", "community"))
    c = c.withColumn("size", size)
    c = c.withColumn("dominant", F.min(F.struct(-F.col("size"), "community")).over(W.partitionBy("query_id"))["community"])
    most = F.max("importance").over(W.partitionBy("query_id"))
    parts = {f: F.coalesce(F.col(f), F.lit(0.0)) * V.FUSION_WEIGHTS.get(f, 0.0) for f in features}
    parts["centrality"] = F.when(most > 0, F.coalesce("importance", F.lit(0.0)) / most).otherwise(0.0) * V.FUSION_WEIGHTS["centrality"]
    parts["kind_prior"] = lookup(V.KIND_PRIORS, F.col("kind"), V.OTHER_PRIOR) * V.FUSION_WEIGHTS["kind_prior"]
    parts["community_affinity"] = F.when(F.col("community") == F.col("dominant"), V.FUSION_WEIGHTS["community_affinity"]).otherwise(0.0)
    parts["provenance"] = F.coalesce("bonus", F.lit(0.0))
    total = sum(parts.values(), F.lit(0.0))
    c = c.withColumn("score", F.round(total, 6)).withColumn("contributions", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.round(v, 6))]))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def explained(ranked: DataFrame) -> DataFrame:
    """ranked with its contributions as an array, the largest in size first."""
    by = lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).otherwise(1)
    return ranked.withColumn("because", F.array_sort(F.map_entries("contributions"), by))


def first_wins(lists: list[DataFrame], key: str, cap: int) -> DataFrame:
    """Result lists (key, position) one after another; a key stays where it came first; the first cap of all."""
    out = None
    for i, df in enumerate(lists):
        df = df.select(key, F.lit(i).alias("list"), "position")
        out = df if out is None else out.unionByName(df)
    first = out.groupBy(key).agg(F.min(F.struct("list", "position")).alias("at")).select(key, "at.list", "at.position")
    return first.orderBy("list", "position", key).limit(cap)


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, reciprocal_rank, precision at k of ranked (query_id, id, rank) against relevant (query_id, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    got = hits.groupBy("query_id").agg(F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("shown"))
    want = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    r = want.join(got, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return r.select("query_id", F.round(found / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("shown") > 0, found / F.col("shown")).otherwise(0.0), 6).alias("precision"))


def proximity(edges: DataFrame, seed: str, hops: int = 2) -> DataFrame:
    """id, value: 1 - distance / (hops + 1) of every node within hops of the seed, whichever way edges point."""
    at = edges.sparkSession.createDataFrame([(seed,)], "id string")
    return reach_both_ways(edges, at, hops).select(F.col("node").alias("id"), F.round(1 - F.col("distance") / (hops + 1), 6).alias("value"))
