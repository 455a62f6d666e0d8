"""Communities by modularity: Louvain's moves and contraction, and Leiden's refinement, in rounds of joins.

A level moves nodes to the neighbouring community of greatest gain until modularity no longer rises, then communities
become the nodes of a smaller weighted graph. Nodes that move at once may spoil each other's gains, so only a part of
them, by a hash of node, round and seed, moves in a round; a round that does not raise modularity is taken back and
tried with smaller parts. Modularity therefore never falls.

Leiden starts from Louvain's communities. Each level is refined first: within its community every node begins alone
and moves only inside it, and parts that hang together by no edge are split. The refined parts are contracted, with
the communities as their first labels, so that a badly connected community can come apart in the next moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .graph import components

LEVELS, ROUNDS, PARTS = 10, 40, 8  #: At most; PARTS: the smallest part of the nodes that moves is one in so many.
LEAST = 1e-9  #: What a gain must exceed, beyond the noise of sums.


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, w of undirected edges (a, b, weight) in both directions; a loop has twice its weight."""
    e = edges.select("a", "b", F.col("weight").cast("double").alias("w")).where("a is not null and b is not null and w > 0")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return e.repartition("a").groupBy("a", "b").agg(F.sum("w").alias("w"))


def community_weights(both: DataFrame, labels: DataFrame) -> DataFrame:
    """community, total (weight of its nodes' edge ends), inner (of those whose other end is in it)."""
    own, other = labels.select(F.col("id").alias("a"), "community"), labels.select(F.col("id").alias("b"), F.col("community").alias("d"))
    inner = F.when(F.col("community") == F.col("d"), F.col("w")).otherwise(0.0)
    return both.join(own, "a").join(other, "b").groupBy("community").agg(F.sum("w").alias("total"), F.sum(inner).alias("inner"))


def modularity(both: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (id, community) on both_ways() edges."""
    row = community_weights(both, labels).agg(F.sum("inner"), F.sum(F.col("total") * F.col("total")), F.sum("total")).first()
    return 0.0 if not row[2] else row[0] / row[2] - resolution * row[1] / row[2] ** 2


def moved(both: DataFrame, labels: DataFrame, chosen, resolution: float, within: DataFrame | None = None) -> DataFrame:
    """labels after the chosen nodes (a condition on id) went to their best community; within (id, bound) keeps them inside a bound."""
    weight = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    own = labels.join(weight, "id")
    total = own.groupBy("community").agg(F.sum("k").alias("total"))
    all_ = weight.agg(F.sum("k").alias("all"))  # one row
    inside = both.where("a <> b")
    if within is not None:
        inside = inside.join(within.select(F.col("id").alias("a"), "bound"), "a").join(within.select(F.col("id").alias("b"), F.col("bound").alias("other")), "b").where("bound = other")
    near = inside.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("near"))
    ways = own.where(chosen).select("id", F.col("community").alias("now"), "k")
    ways = ways.join(near, "id").unionByName(ways.select("id", "now", "k", F.col("now").alias("community"), F.lit(0.0).alias("near")))
    ways = ways.groupBy("id", "now", "k", "community").agg(F.sum("near").alias("near")).join(total, "community").crossJoin(F.broadcast(all_))
    stays = F.col("community") == F.col("now")
    gain = F.round(F.col("near") - resolution * F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("all"), 9)
    best = ways.groupBy("id").agg(F.min(F.struct((-gain).alias("loss"), (~stays).alias("goes"), F.col("community").alias("to"))).alias("best"))
    return labels.join(best, "id", "left").select("id", F.coalesce("best.to", "community").alias("community"))


def settled(both: DataFrame, labels: DataFrame, resolution: float, seed: int, within: DataFrame | None = None) -> tuple[DataFrame, float]:
    """labels when no part of the nodes raises modularity any more, and their modularity."""
    now, parts, idle, spoilt = modularity(both, labels, resolution), 2, 0, False
    for n in range(ROUNDS):
        chosen = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n // parts)), F.lit(parts)) == n % parts
        new = cut(moved(both, labels, chosen, resolution, within), "labels")
        if new.join(labels, ["id", "community"], "left_anti").isEmpty():
            idle += 1
        elif (then := modularity(both, new, resolution)) > now + LEAST:
            labels, now, idle, spoilt = new, then, 0, False
        else:
            idle, spoilt = idle + 1, True
        if idle >= parts:  # every part has been tried
            if not spoilt or parts >= PARTS:
                break
            parts, idle, spoilt = parts * 2, 0, False
    return labels, now


def contracted(both: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities."""
    own, other = labels.select(F.col("id").alias("a"), F.col("community").alias("c")), labels.select(F.col("id").alias("b"), F.col("community").alias("d"))
    return cut(both.join(own, "a").join(other, "b").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w")), "graph")


def alone(both: DataFrame) -> DataFrame:
    return both.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct()


def followed(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """labels (id, community) with the label that each community got as a node."""
    return labels.join(upper.select(F.col("id").alias("community"), F.col("community").alias("to")), "community").select("id", F.col("to").alias("community"))


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """id, community (its least id) of every end of undirected edges (a, b, weight)."""
    both = cut(both_ways(edges), "graph")
    labels, graph = cut(alone(both), "labels"), both
    for level in range(LEVELS):
        start = alone(graph)
        new, _ = settled(graph, start, resolution, seed + level)
        if new.join(start, ["id", "community"], "left_anti").isEmpty():
            break
        labels = cut(followed(labels, new), "labels")
        graph = contracted(graph, new)
    return least_named(labels)


def least_named(labels: DataFrame) -> DataFrame:
    least = labels.groupBy("community").agg(F.min("id").alias("least"))
    return cut(labels.join(least, "community").select("id", F.col("least").alias("community")), "communities")


def hanging_together(both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels whose communities are split where no edge joins their parts; this never lowers modularity."""
    own, other = labels.select(F.col("id").alias("a"), F.col("community").alias("c")), labels.select(F.col("id").alias("b"), F.col("community").alias("d"))
    inner = both.where("a <> b").join(own, "a").join(other, "b").where("c = d").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    part = components(inner).toDF("id", "part")
    return cut(labels.join(part, "id", "left").select("id", F.coalesce("part", "id").alias("community")), "parts")


def leiden(edges: DataFrame, resolution: float = 1.0, seed: int = 0, start: DataFrame | None = None) -> DataFrame:
    """id, community (its least id): every community hangs together, and modularity is at least that of start, louvain()'s by default."""
    both = cut(both_ways(edges), "graph")
    best = hanging_together(both, louvain(edges, resolution, seed) if start is None else start)
    for level in range(LEVELS):
        before = modularity(both, best, resolution)
        bound = best.select("id", F.col("community").alias("bound"))
        parts, _ = settled(both, alone(both), resolution, seed + 100 + level, bound)
        parts = hanging_together(both, parts)
        graph = contracted(both, parts)
        first = cut(parts.join(best.withColumnRenamed("community", "bound"), "id").groupBy(F.col("community").alias("id")).agg(F.min("bound").alias("community")), "labels")
        new, _ = settled(graph, first, resolution, seed + 200 + level)
        new = hanging_together(both, cut(followed(parts, new), "labels"))
        if modularity(both, new, resolution) <= before + LEAST:
            break
        best = new
    return least_named(best)
