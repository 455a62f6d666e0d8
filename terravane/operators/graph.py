"""Graph operators over an edges table (source_id, target_id, type, provenance, confidence).

All are joins and aggregations on keys. Iterative ones write each round's small state to the shared folder, so
plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from . import label_blocks
from .checkpoints import bucketed, cut, discard


def lookup(pairs: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key], F.lit(other))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge as seen from either end: node, other and the edge's columns."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *rest)
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *rest)
    return out.unionByName(back)


def met(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """both_ways() of the edges that have an end in frontier (node), with its columns; edges that meet few nodes are not moved."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    ends = lambda a, b, e: e.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).join(frontier, "node")
    return ends("source_id", "target_id", edges).unionByName(ends("target_id", "source_id", edges.where("source_id <> target_id")))


def select_edges(edges: DataFrame, types=None, provenances=None) -> DataFrame:
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    if provenances is not None:
        edges = edges.where(F.col("provenance").isin(*provenances))
    return edges


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in nodes (id); two semi-joins on keys instead of one on an OR."""
    n = nodes.select("id").distinct()
    out = edges.join(n, F.col("source_id") == F.col("id"), "left_semi")
    return out.unionByName(edges.join(n, F.col("target_id") == F.col("id"), "left_semi")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def undirected(edges: DataFrame, provenances=("extracted", "resolved", "inferred"), semantic: float | None = None) -> DataFrame:
    """a < b and the largest confidence of the edges between them."""
    e = select_edges(edges, provenances=provenances).where(F.col("type") != V.SEMANTIC_EDGE_TYPE)
    if semantic is not None:  # semantic edges from a similarity on take part too
        e = e.unionByName(edges.where((F.col("type") == V.SEMANTIC_EDGE_TYPE) & (F.col("confidence") >= semantic)))
    e = e.where("source_id <> target_id")
    return e.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.max("confidence").alias("weight"))


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The n surest outbound edges of each node."""
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("confidence"), "target_id", "type", "provenance"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= n)


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, fanout: int = 25, total: int = 150) -> DataFrame:
    """Bounded breadth-first expansion, edges taken either way: node, distance, parent, trail, evidence.

    trail multiplies, along the way, each edge's confidence by what its provenance is worth, held between 0 and 1;
    evidence is the trail over the distance. A node looks at its 2 * fanout surest edges and gives at most fanout new nodes; the surest parent wins; total
    bounds the nodes found, nearest first.
    """
    surest = W.partitionBy("node").orderBy(F.desc("confidence"), "other", "type", "provenance")
    kept = cut(edges.select("source_id", "target_id", "type", "provenance", "confidence"), "edges")
    worth = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * lookup(V.PATH_FACTOR, F.col("provenance"), V.OTHER_FACTOR)))
    reached = seeds.select(F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(1.0).alias("trail")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = met(kept, frontier.select("node", "trail")).withColumn("r", F.row_number().over(surest)).where(F.col("r") <= 2 * fanout)
        step = step.join(reached.select(F.col("node").alias("other")), "other", "left_anti")
        one = F.row_number().over(W.partitionBy("node", "other").orderBy("r"))
        step = step.withColumn("one", one).where("one = 1")
        step = step.withColumn("f", F.row_number().over(W.partitionBy("node").orderBy("r"))).where(F.col("f") <= fanout)
        best = step.groupBy("other").agg(F.min(F.struct(-F.col("confidence"), "node", (F.col("trail") * worth).alias("trail"))).alias("p"))
        frontier = cut(best.select(F.col("other").alias("node"), F.lit(hop).alias("distance"), F.col("p.node").alias("parent"), F.col("p.trail").alias("trail")), "frontier")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    reached = reached.withColumn("evidence", F.round(F.when(F.col("distance") > 0, F.col("trail") / F.col("distance")).otherwise(1.0), 6)).withColumn("trail", F.round("trail", 6))
    seeds_, found = reached.where("distance = 0"), reached.where("distance > 0").orderBy("distance", "node").limit(total)
    return seeds_.unionByName(found)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Directed breadth-first distances from each seed: seed, node, distance."""
    out = cut(edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other")), "out")
    return breadth_first(lambda frontier: frontier.join(out, "node"), seeds, depth)


def reach_both_ways(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """As reach, whichever way edges point; they are kept once."""
    out = cut(edges.select("source_id", "target_id"), "out")
    return breadth_first(lambda frontier: met(out, frontier), seeds, depth)


def breadth_first(step_from, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, distance, where step_from gives frontier (seed, node) with the nodes (other) one step on, repeats included."""
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        step = step_from(frontier.select("seed", "node")).select("seed", F.col("other").alias("node")).distinct()
        frontier = cut(step.join(reached, ["seed", "node"], "left_anti").withColumn("distance", F.lit(hop)), "reach")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def edge_cost() -> Column:
    return F.when(F.col("type") == V.SEMANTIC_EDGE_TYPE, V.SEMANTIC_COST).otherwise(lookup(V.EDGE_COST, F.col("provenance"), V.OTHER_COST))


def shortest_paths(edges: DataFrame, source: str, hops: int = 4) -> DataFrame:
    """Cheapest path of at most hops edges from source to each node, edges taken either way: node, cost, path.

    Relaxation by joins; of equal costs the path that is least in order wins.
    """
    kept = cut(edges.select("source_id", "target_id", edge_cost().alias("c")), "costs")  # of parallel edges the cheapest path takes the cheapest
    best = edges.sparkSession.createDataFrame([(source, 0.0, [source])], "node string, cost double, path array<string>")
    frontier = best
    for _ in range(hops):
        step = met(kept, frontier).where(~F.array_contains("path", F.col("other")))
        step = step.select(F.col("other").alias("node"), F.round(F.col("cost") + F.col("c"), 6).alias("cost"), F.concat("path", F.array("other")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("p")).select("node", "p.cost", "p.path")
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        best = both.groupBy("node").agg(F.min(F.struct("cost", "path", ~F.col("old"))).alias("p")).select("node", "p.cost", "p.path", F.col("p.col3").alias("new"))
        best = cut(best, "best")
        frontier, best = best.where("new").drop("new"), best.drop("new")
    return best


def impact(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Dependents of the seeds by inbound dependency edges: id, distance, impact (test, document, direct or transitive)."""
    back = select_edges(edges, V.IMPACT_EDGE_TYPES).select(F.col("target_id").alias("id"), F.col("source_id").alias("by")).distinct()
    known = cut(entities.select("id", "kind"), "known")
    back = cut(back.join(known.select(F.col("id").alias("by")), "by", "left_semi"), "back")
    reached = seeds.select("id", F.lit(0).alias("distance")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(back, "id").select(F.col("by").alias("id")).distinct()
        frontier = cut(step.join(reached, "id", "left_anti").withColumn("distance", F.lit(hop)), "impact")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    kind = F.when(F.col("kind") == "test", "test").when(F.col("kind").isin("document", "section"), "document")
    return reached.where("distance > 0").join(known, "id").select("id", "distance", kind.when(F.col("distance") == 1, "direct").otherwise("transitive").alias("impact"))


def tests_of(edges: DataFrame, entities: DataFrame, targets: DataFrame, most: int = 20) -> DataFrame:
    """Tests linked to targets (id, path): by `tests` edges, or else test entities whose path holds the target's file stem."""
    linked = incident(select_edges(edges, ("tests",)), targets)
    ends = both_ways(linked).join(targets.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"), F.col("other").alias("test_id")).distinct()
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rest = targets.join(ends, "id", "left_anti").select("id", F.lower(stem).alias("stem")).where("stem <> ''")
    tests = entities.where("kind = 'test'").select(F.col("id").alias("test_id"), F.lower("path").alias("test_path"))
    # A stem inside a path shares each of its pieces of three characters with it: an equi-join on the one that fewest paths have, then the check.
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n))))
    pieces = F.filter(F.concat(*[grams(F.col("test_path"), n) for n in (3, 2, 1)]), lambda x: x != "")
    t = cut(tests.distinct().withColumn("gram", F.explode(F.array_distinct(pieces))), "pieces")
    common = t.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = rest.withColumn("gram", F.explode(grams(F.col("stem"), 3))).join(common, "gram", "left")
    rarest = asked.groupBy("id", "stem").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    r = rarest.where("m.n > 0").select("id", "stem", "m.gram")  # a piece that no path has rules the stem out
    hit = r.join(t, "gram").where(F.contains("test_path", F.col("stem"))).select("id", "test_id").distinct()
    hit = hit.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("test_id"))).where(F.col("n") <= most).drop("n")
    return ends.withColumn("how", F.lit("edge")).unionByName(hit.withColumn("how", F.lit("path")))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least node reachable, by least labels with pointer jumping."""
    both = both_ways(edges).where("node <> other").select("node", "other").distinct()
    both = cut(both, "links")
    labels = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        told = cut(labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")), "told")
        up = told.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        labels = cut(told.join(up, "component").select("node", "old", F.least("component", "upper").alias("component")), "labels")
        done = labels.where("old <> component").isEmpty()
        labels = labels.drop("old")
        if done:
            return labels.withColumnRenamed("node", "id")


PART_EDGES = 1_000_000  #: Edges of a part of a graph.


def is_number(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("long", "integer", "short", "byte")


def parts_of(spark, edges: int) -> int:
    return max(spark.sparkContext.defaultParallelism, edges // PART_EDGES + 1)


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, rank after `rounds` rounds, or fewer where the ranks move by less than tolerance in all; parallel edges count
    once with their largest confidence, dangling rank is shared by all.

    Ids that are no numbers are numbered once. Shares lie dealt by source, so a round moves ranks and what edges pass on, added up.
    """
    spark, e = edges.sparkSession, edges.select("source_id", "target_id", "confidence")
    parts, nodes = parts_of(spark, e.count()), None
    # With all edges of a source together, weights, totals and the source's number need no other shuffle.
    e = e.repartition(parts, "source_id").groupBy("source_id", "target_id").agg(F.greatest(F.lit(0.001), F.max("confidence")).alias("w"))
    e = e.withColumn("share", F.when(F.col("source_id").isNotNull(), F.col("w") / F.sum("w").over(W.partitionBy("source_id"))).otherwise(0.0)).drop("w")
    if is_number(edges, "source_id") and is_number(edges, "target_id"):
        share = e.select(F.col("source_id").cast("long").alias("a"), F.col("target_id").cast("long").alias("b"), "share")
    else:
        e = cut(e, "weights")
        nodes = cut(e.select("source_id").unionByName(e.select(F.col("target_id").alias("source_id"))).where("source_id is not null").distinct().select(F.col("source_id").alias("id"), F.monotonically_increasing_id().alias("n")), "nodes")
        number = lambda end, to: nodes.select(F.col("id").alias(end), F.col("n").alias(to))
        share = e.join(number("source_id", "a"), "source_id", "left").join(number("target_id", "b"), "target_id", "left").select("a", "b", "share")
    share = bucketed(share, "shares", "a", parts)
    ends = share.select(F.col("b").alias("n"), "share", F.lit(True).alias("d")).unionByName(share.select(F.col("a").alias("n"), F.lit(0.0).alias("share"), F.lit(False).alias("d")).distinct())
    ends = cut(ends.groupBy("n").agg(F.sum("share").alias("v"), F.every("d").alias("dangling")), "ends")
    rank = in_rounds(share, ends, rounds, alpha, tolerance) if tolerance is not None else by_walks(share, ends, rounds, alpha)
    discard(share)
    return rank.select(F.col("n").alias("id"), "rank") if nodes is None else rank.join(nodes, "n", "left").select("id", "rank")


def passed_on(share: DataFrame, ranks: DataFrame) -> DataFrame:
    """n, v: what nodes get of ranks (n, v) over shares (a, b, share)."""
    return share.join(ranks.where("v <> 0").select(F.col("n").alias("a"), "v").hint("shuffle_hash"), "a").groupBy(F.col("b").alias("n")).agg(F.sum(F.col("share") * F.col("v")).alias("v"))


def by_walks(share: DataFrame, ends: DataFrame, rounds: int, alpha: float) -> DataFrame:
    """n, rank. Ranks are sums over walks: v[j] is what reaches a node by walks of j edges if all start with one, and after a round rank is
    a sum of multiples of v[j], the same for all nodes. So a round moves edges only where walks of its length still go on.
    """
    first = ends.agg(F.count(F.lit(1)), F.count(F.when(F.col("dangling"), 1)), F.sum(F.when(F.col("n").isNotNull(), F.col("v")))).first()
    n, lost, held, walks = first[0], [float(first[1])], first[2] or 0.0, [None, ends]
    while len(walks) <= rounds and held:
        nxt = cut(passed_on(share, walks[-1].where("n is not null")), "walks")
        all_, kept = nxt.agg(F.sum("v"), F.sum(F.when(F.col("n").isNotNull(), F.col("v")))).first()
        lost.append(held - (all_ or 0.0))  # shares of a node's edges add up to one
        walks.append(nxt)
        held = kept or 0.0
    lost.append(held)  # not asked for unless nothing goes on
    times = [1.0 / max(1, n)]
    for _ in range(rounds):
        spread = (1 - alpha) / max(1, n) + alpha * sum(t * d for t, d in zip(times, lost)) / max(1, n)
        times = [spread] + [alpha * t for t in times]
    terms = ends.select("n", (F.lit(times[0]) + (F.lit(times[1]) if rounds else F.lit(0.0)) * F.when(F.col("n").isNotNull(), F.col("v")).otherwise(0.0)).alias("rank"))
    for j in range(2, len(walks)):
        terms = terms.unionByName(walks[j].where("n is not null").select("n", (F.lit(times[j]) * F.col("v")).alias("rank")))
    return terms.groupBy("n").agg(F.sum("rank").alias("rank"))


def in_rounds(share: DataFrame, ends: DataFrame, rounds: int, alpha: float, tolerance: float) -> DataFrame:
    """n, rank, until the ranks move by less than tolerance in all."""
    n = ends.count()
    rank = ends.select("n", "dangling", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = passed_on(share, rank.select("n", F.col("rank").alias("v")))
        new = rank.withColumnRenamed("rank", "old").join(got, "n", "left").crossJoin(F.broadcast(lost))  # one row
        new = cut(new.select("n", "dangling", ((1 - alpha) / n + alpha * (F.coalesce("v", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "old"), "rank")
        rank = new.drop("old")
        if (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < n * tolerance:
            break
    return rank.select("n", "rank")


def importance(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """id, value: PageRank, or the degree of entities that have none."""
    rank = pagerank(edges, 100, tolerance=1e-6).select("id", F.col("rank").alias("r"))
    return entities.select("id").join(rank, "id", "left").join(degrees(edges).select("id", "degree"), "id", "left").select("id", F.coalesce("r", F.col("degree").cast("double"), F.lit(0.0)).alias("value"))


SOURCES = 5000  #: Sources that betweenness is estimated from; with no more nodes than these it is exact.


def folded(pairs: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(pairs, nodes, scores): a graph without its hanging trees, what its nodes stand for, and what all nodes owe to hanging trees.

    pairs (a, b, ...) are simple edges; held (id, s, t) says for how many sources and nodes each node stands. A node with
    one neighbour is taken off and added to it, round by round; of two that have only each other the greater goes. On the way to
    and from what a node has been given, all paths pass that node, so its share of them is by numbers alone: the pairs
    of a source and a node that lie in different branches at it, the rest of its component being one more branch.
    """
    zero = lambda *c: [F.lit(0.0).alias(x) for x in c]
    held, taken = cut(held.select("id", F.col("s").cast("double"), F.col("t").cast("double"), *zero("cs", "ct", "cst")), "held"), []
    while True:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("parent")), F.struct(F.col("b").alias("id"), F.col("a").alias("parent")))).alias("e")).select("e.*")
        ends = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).where("n = 1")
        ends = ends.groupBy(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b")).agg(F.max("id").alias("id"))
        leaves = cut(ends.withColumn("parent", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a"))).join(held, "id"), "leaves")
        if leaves.isEmpty():
            break
        taken.append(leaves)
        pairs = cut(pairs.join(leaves.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        gain = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("s").alias("gs"), F.sum("t").alias("gt"), F.sum(F.col("s") * F.col("t")).alias("gst"))
        more = [(F.col(c) + F.coalesce(g, F.lit(0.0))).alias(c) for c, g in (("s", "gs"), ("t", "gt"), ("cs", "gs"), ("ct", "gt"), ("cst", "gst"))]
        held = cut(held.join(leaves.select("id"), "id", "left_anti").join(gain, "id", "left").select("id", *more), "held")
    if not taken:
        return pairs, held.select("id", "s", "t"), None
    part = held.withColumn("part", F.col("id"))
    if not pairs.isEmpty():
        own = components(pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")))
        part = held.join(own, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    part = cut(part, "parts")
    whole = part.groupBy("part").agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    scored = known = cut(part.where("ct > 0").join(whole, "part").drop("part"), "known")
    for leaves in reversed(taken):  # a node is in the component of the one it was given to
        inner = leaves.where("ct > 0").select("id", "parent", "s", "t", "cs", "ct", "cst")
        found = cut(inner.join(known.select(F.col("id").alias("parent"), "all_s", "all_t"), "parent").select(*known.columns), "known")
        scored = known = known.unionByName(found)
    rest_s, rest_t = F.col("all_s") - F.col("s"), F.col("all_t") - F.col("t")
    return pairs, held.select("id", "s", "t"), scored.select("id", ((F.col("cs") + rest_s) * (F.col("ct") + rest_t) - F.col("cst") - rest_s * rest_t).alias("score"))


def betweenness(weighted: DataFrame, sources: int = SOURCES, rounds: int | None = None) -> DataFrame:
    """id, betweenness of undirected a, b, weight (a distance of 1 / weight), the share of shortest paths that pass a node.

    Paths are counted from at most `sources` nodes, those of least hash, and the sums scaled to all; the standard error of a node's
    value is at most half of the square root of 1 / sources. Hanging trees are taken off first (folded), so a tree takes a row a node. In what
    is left, a row is a source and a node it reaches. Distances settle by rounds of joins in
    which nearer ways are passed on; path counts then go forward and dependencies back along the pairs of nodes that lie on shortest
    paths, by the number of a path's edges. A source's rows are spread by node. Parallel edges count once with their greatest
    weight; `rounds` bounds the edges of a path, which otherwise has as many as it takes; no tree is taken off then.
    """
    near = weighted.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
    step = F.round(1.0 / F.greatest("weight", F.lit(1e-9)), 9).alias("step")
    pairs = cut(near.select("a", "b", step), "pairs")
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    n = nodes.count()
    chosen = cut(nodes.orderBy(F.xxhash64("id"), "id").limit(sources).select("id", F.lit(1.0).alias("s")), "chosen")
    held, hung = nodes.join(chosen, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"), F.lit(1.0).alias("t")), None
    if rounds is None:
        pairs, held, hung = folded(pairs, held)
    total = None if pairs.isEmpty() else dependencies(pairs, held, rounds)
    total = hung if total is None else total if hung is None else total.unionByName(hung)
    scale = n / max(1, min(n, sources)) / ((n - 1) * (n - 2) if n > 2 else 1)
    score = total.groupBy("id").agg(F.sum("score").alias("score")) if total is not None else nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    return nodes.join(score, "id", "left").select("id", F.round(F.coalesce("score", F.lit(0.0)) * scale, 6).alias("betweenness"))


def dependencies(pairs: DataFrame, held: DataFrame, rounds: int | None) -> DataFrame:
    """id, score: the share of shortest paths of pairs (a, b, step) that pass a node, where held (id, s, t) stands for s sources and t nodes."""
    near = cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "step").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "step")), "near")
    chosen = held.where("s > 0").join(near.select(F.col("node").alias("id")), "id", "left_semi")
    far = cut(chosen.select(F.col("id").alias("s"), F.col("id").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("new")), "far")
    done = 0
    while (rounds is None or done < rounds) and not far.where("new").isEmpty():
        ways = far.where("new").join(near, "node").select("s", F.col("other").alias("node"), F.round(F.col("d") + F.col("step"), 9).alias("d"), F.lit(True).alias("new"))
        both = far.withColumn("new", F.lit(False)).unionByName(ways)
        best = both.groupBy("s", "node").agg(F.min(F.struct("d", "new")).alias("m"))  # what is known comes before its equals
        far, done = cut(best.select("s", "node", "m.d", "m.new"), "far"), done + 1
    # Pairs (v before w) that lie on shortest paths from s.
    ahead = far.select("s", F.col("node").alias("v"), F.col("d").alias("dv")).join(near.select(F.col("node").alias("v"), F.col("other").alias("w"), "step"), "v")
    ahead = ahead.join(far.select("s", F.col("node").alias("w"), F.col("d").alias("dw")), ["s", "w"]).where(F.abs(F.col("dv") + F.col("step") - F.col("dw")) < 1e-8)
    links = cut(ahead.select("s", "v", "w"), "links")
    # Path counts by number of edges: a pass brings what ends in each node on to the next ones.
    front = cut(chosen.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "front")
    counts = front
    while not front.isEmpty():
        front = cut(front.join(links, ["s", "v"]).groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths")), "front")
        counts = counts.unionByName(front)
    counts = cut(counts.groupBy("s", "v").agg(F.sum("paths").alias("paths")), "counts")
    share = links.join(counts.withColumnRenamed("paths", "pv"), ["s", "v"]).join(counts.select("s", F.col("v").alias("w"), F.col("paths").alias("pw")), ["s", "w"])
    share = cut(share.select("s", "v", "w", (F.col("pv") / F.col("pw")).alias("share")), "share")
    # A node's dependency is the sum over its successors of share * (1 + theirs): terms go back edge by edge.
    told = counts.select("s", F.col("v").alias("w")).join(held.select(F.col("id").alias("w"), "t"), "w").join(held.select(F.col("id").alias("s"), F.col("s").alias("times")), "s")
    front = cut(told.select("s", "w", (F.col("t") * F.col("times")).alias("part")), "front")
    total = None
    while not front.isEmpty():
        front = cut(front.join(share, ["s", "w"]).groupBy("s", F.col("v").alias("w")).agg(F.sum(F.col("share") * F.col("part")).alias("part")), "front")
        own = front.where("s <> w").groupBy(F.col("w").alias("id")).agg(F.sum("part").alias("score"))
        total = own if total is None else total.unionByName(own)
    return total if total is not None else held.select("id", F.lit(0.0).alias("score")).limit(0)


def edges_at(edges: DataFrame, nodes: DataFrame, direction: str = "both", types=None, provenances=None, limit: int = 500) -> DataFrame:
    """node, other and the columns of the edges at each of nodes (id), the surest `limit` of each; outbound, inbound or both."""
    e = select_edges(edges, types, provenances)
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    seen = {"outbound": e.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.lit("outbound").alias("direction"), *rest), "inbound": e.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.lit("inbound").alias("direction"), *rest)}
    out = seen[direction] if direction != "both" else seen["outbound"].unionByName(seen["inbound"].where("node <> other"))
    out = out.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("confidence"), "other", "type", "provenance", "direction"))
    return out.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """All edges from a to b of each of pairs (a, b)."""
    p = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")).distinct()
    return edges.join(p, ["source_id", "target_id"])


def along(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges that lie on paths (path, an array of nodes), whichever way they point: what a view highlights."""
    steps = paths.select(F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as x, path[i] as y))")).alias("s")).where("s.x is not null and s.y is not null")
    ends = steps.select(F.least("s.x", "s.y").alias("_a"), F.greatest("s.x", "s.y").alias("_b")).distinct()
    return edges.withColumn("_a", F.least("source_id", "target_id")).withColumn("_b", F.greatest("source_id", "target_id")).join(ends, ["_a", "_b"], "left_semi").drop("_a", "_b")


def with_paths(found: DataFrame, hops: int = 4) -> DataFrame:
    """found (node, distance, parent) with path, from the seed to the node by parents."""
    paths = found.where("distance = 0").select("node", F.array("node").alias("path"))
    out = paths
    for hop in range(1, hops + 1):
        step = found.where(F.col("distance") == hop).select("node", "parent")
        paths = step.join(paths.select(F.col("node").alias("parent"), "path"), "parent").select("node", F.concat("path", F.array("node")).alias("path"))
        out = out.unionByName(paths)
    return found.join(out, "node")


def membership(members: DataFrame, communities: DataFrame) -> DataFrame:
    """Members with their community's label and size, on community, mode and algorithm."""
    return members.join(communities, ["community_id", "mode", "algorithm"])


def replace_communities(kept: DataFrame, mode: str, algorithm: str, fresh: DataFrame) -> DataFrame:
    """kept without the rows of a mode and algorithm, and fresh in their place."""
    return kept.where(~((F.col("mode") == mode) & (F.col("algorithm") == algorithm))).unionByName(fresh)


def detected(communities: DataFrame, mode: str) -> DataFrame:
    """community_id (`mode-00000`, the largest first), id, size from id, community; a single community of several nodes tells nothing and is left out."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    if sizes.limit(2).count() < 2 and communities.limit(2).count() > 1:
        sizes = sizes.limit(0)
    named = numbered(sizes, F.desc("size"), F.col("community").asc()).withColumn("community_id", F.concat(F.lit(mode + "-"), F.lpad(F.col("number").cast("string"), 5, "0")))
    return communities.join(named, "community").select("community_id", "id", "size")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with number, their place in an order; each range of rows is sorted in a task of its own."""
    spark = rows.sparkSession
    part = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    part = cut(part.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order))), "numbered")
    before, starts = 0, []
    for r in sorted(part.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each range
        starts.append((r["_part"], before))
        before += r["n"]
    at = F.broadcast(spark.createDataFrame(starts, "_part int, _before long"))
    return part.join(at, "_part").withColumn("number", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def label_communities(weighted: DataFrame, rounds: int = 5) -> DataFrame:
    """Deterministic label propagation on undirected a, b, weight: id, community.

    Each round a node takes the label of most weight among its neighbours, the least of equal ones, if that
    is smaller than its own; in even rounds (the first is round 0) whatever its order. Ids that are no numbers are numbered in
    their order; rounds are those of label_blocks.
    """
    if is_number(weighted, "a") and is_number(weighted, "b"):
        nodes, pairs = None, weighted.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"))
    else:
        weighted = cut(weighted, "weights")
        # Nodes are numbered in their order, so rounds move and compare numbers.
        ends = weighted.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        nodes = cut(numbered(ends, F.col("id").asc()).select("id", F.col("number").alias("n")), "nodes")
        number = lambda end: nodes.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"))
        pairs = weighted.join(number("a"), "a").join(number("b"), "b").select(F.col("a_n").alias("a"), F.col("b_n").alias("b"), F.col("weight").cast("double").alias("weight"))
    pairs = cut(pairs, "pairs")
    blocks = prime(max(pairs.sparkSession.sparkContext.defaultParallelism, 2 * pairs.count() // label_blocks.BLOCK_EDGES + 1))
    if rounds:
        blocks = label_blocks.packed(pairs, blocks)
        labels = cut(label_blocks.propagated(blocks, rounds), "communities")
        discard(blocks)
    else:
        labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    if nodes is None:
        return labels.select(F.col("node").alias("id"), F.col("label").alias("community"))
    named = nodes.select(F.col("n").alias("label"), F.col("id").alias("community"))
    return labels.join(nodes.withColumnRenamed("n", "node"), "node").join(named, "label").select("id", "community")


def prime(least: int) -> int:
    """The first prime from least on, so that numbers with a common step are spread over all remainders."""
    return next(p for p in range(max(2, least), 2 * least + 3) if all(p % i for i in range(2, int(p**0.5) + 1)))


def collapse(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between communities of members (id, community): edges, the largest confidence, a structural type before a semantic one."""
    m = members.select("id", "community")
    e = edges.join(m.select(F.col("id").alias("source_id"), F.col("community").alias("a")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("community").alias("b")), "target_id").where("a <> b")
    first = F.min(F.struct((F.col("type") == V.SEMANTIC_EDGE_TYPE).alias("semantic"), "type")).alias("f")
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("bundled"), F.max("confidence").alias("confidence"), first).select("a", "b", "bundled", "confidence", F.col("f.type").alias("type"))


def meta_nodes(nodes: DataFrame) -> DataFrame:
    """community, degree (its members), importance (their sum) of nodes (id, community, importance)."""
    return nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("importance"), 6).alias("importance"))


def parent_cycles(entities: DataFrame, rounds: int = 12) -> DataFrame:
    """Entities whose parents lead back to them, by pointer doubling: id. rounds covers chains of 2**rounds."""
    up = cut(entities.where("parent_id is not null").select("id", F.col("parent_id").alias("up")), "parents")
    for _ in range(rounds):
        if up.isEmpty():
            break
        # A chain that ends drops out; what stays after enough doublings is on a cycle or leads to one.
        nxt = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select("id", F.col("upper").alias("up"))
        up = cut(nxt, "parents")
    return up.select(F.col("up").alias("id")).distinct()


def global_graph(entities: DataFrame, edges: DataFrame, importance: DataFrame, nodes: int = 3000, most: int = 12000) -> DataFrame:
    """Edges among the most important nodes (importance: id, value), the surest first."""
    top = importance.orderBy(F.desc("value"), "id").limit(nodes).select("id")
    e = edges.join(top, F.col("source_id") == F.col("id"), "left_semi").join(top, F.col("target_id") == F.col("id"), "left_semi")
    return e.orderBy(F.desc("confidence"), "source_id", "target_id", "type", "provenance").limit(most)


def directories(entities: DataFrame, cap: int = 200) -> DataFrame:
    """First path segments with their number of entities and the first cap of them by id."""
    seg = F.split("path", "/")[0]
    rows = entities.select(seg.alias("directory"), "id")
    rank = F.row_number().over(W.partitionBy("directory").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= cap).groupBy("directory").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("entities")).join(few, "directory")
