"""Cases of the fifth round's findings."""

import random

from pyspark.sql import functions as F

from terravane.operators import graph, label_blocks
from terravane.plans import property_graph

EDGE = "source_id string, target_id string, confidence double"


def plain_pagerank(edges, rounds=10, alpha=0.85):
    best = {}
    for a, b, c in edges:
        best[a, b] = max(best.get((a, b), 0.001), c or 0.0)
    ids, total = {x for e in best for x in e}, {}
    for (a, _), w in best.items():
        total[a] = total.get(a, 0.0) + w
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(rank[i] for i in ids if i not in total)
        new = dict.fromkeys(ids, (1 - alpha) / len(ids) + alpha * lost / len(ids))
        for (a, b), w in best.items():
            new[b] += alpha * w / total[a] * rank[a]
        rank = new
    return rank


def random_edges(seed=5):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(40)}", f"n{rng.randrange(60)}", rng.choice([0.5, 1.0, 0.2, None])) for _ in range(150)] + [("n3", "n3", 1.0), ("x", "y", 0.5)]


def test_pagerank_of_any_graph(spark):
    edges = random_edges()
    df = spark.createDataFrame(edges, EDGE)
    numbers = df.select(*[F.when(F.col(c).startswith("n"), F.substring(c, 2, 9).cast("long")).otherwise(F.ascii(c).cast("long") + 1000).alias(c) for c in ("source_id", "target_id")], "confidence")
    for rounds in (0, 1, 10):
        want = plain_pagerank(edges, rounds)
        got = {r["id"]: r["rank"] for r in graph.pagerank(df, rounds).collect()}
        assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-13
        coded = {r["id"]: r["rank"] for r in graph.pagerank(numbers, rounds).collect()}
        assert coded.keys() == {int(i[1:]) if i[0] == "n" else ord(i) + 1000 for i in want} and abs(coded[3] - want["n3"]) < 1e-13
    settled, want = {r["id"]: r["rank"] for r in graph.pagerank(df, 100, tolerance=1e-4).collect()}, plain_pagerank(edges, 100)
    assert set(settled) == set(want) and max(abs(settled[i] - want[i]) for i in want) < 1e-3


def test_pagerank_moves_no_text_of_edges_and_stops_where_walks_end(spark, monkeypatch):
    passed, plans = graph.passed_on, []

    def seen(share, ranks):
        out = passed(share, ranks)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "passed_on", seen)
    edges, name = property_graph.coded_edges(spark, "/root/testdata/sf0.001")
    assert {t for c, t in edges.dtypes if c.endswith("_id")} == {"bigint"}
    got = graph.pagerank(edges).select(name(F.col("id")).alias("id"), "rank")
    want = plain_pagerank([tuple(r) for r in property_graph.edges(spark, "/root/testdata/sf0.001").select("source_id", "target_id", "confidence").collect()])
    found = {r["id"]: r["rank"] for r in got.collect()}
    assert set(found) == set(want) and max(abs(found[i] - want[i]) for i in want) < 1e-13
    assert len(plans) == 4  # the longest walk has four edges; the last finds nothing
    assert all("ShuffledHashJoin" in p and p.count("Exchange hashpartitioning(a") == 1 and "Bucketed: true" in p for p in plans)


def test_numbers_of_ids_are_in_the_order_of_their_text(spark, tmp_path):
    for t in ("nation", "customer", "supplier", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(30).write.parquet(f"{tmp_path}/{t}.parquet")
    keys = [0, 1, 9, 10, 19, 100, 2, 20, 999_999_999_999_999, 123_456, None]
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rows = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").join(orders.drop("o_orderkey").limit(1)).select(*orders.columns)
    for more in ([], [10**15], [-1]):  # numbers hold 15 digits and no sign
        rows.unionByName(rows.limit(len(more)).withColumn("o_orderkey", F.lit((more or [0])[0]).cast("long"))).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        coded, name = property_graph.coded_edges(spark, str(tmp_path))
        plain = property_graph.edges(spark, str(tmp_path))
        assert dict(coded.dtypes)["source_id"] == ("string" if more else "bigint")
        ends = [r[0] for r in coded.select(F.explode(F.array("source_id", "target_id")).alias("c")).distinct().orderBy(F.col("c").asc_nulls_first()).select(name(F.col("c"))).collect()]
        assert ends == [r[0] for r in plain.select(F.explode(F.array("source_id", "target_id")).alias("c")).distinct().orderBy(F.col("c").asc_nulls_first()).collect()]
        cols = ("source_id", "target_id", "type", "provenance")
        same = coded.select(name(F.col("source_id")).alias("source_id"), name(F.col("target_id")).alias("target_id"), *cols[2:], "confidence").groupBy(*cols).agg(F.max("confidence").alias("confidence"))
        assert sorted(map(str, same.collect())) == sorted(map(str, plain.collect()))


def plain_labels(pairs, rounds):
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {i: i for i in near}
    for r in range(rounds):
        new = {}
        for i, ends in near.items():
            votes = {}
            for j, w in ends:
                votes.setdefault(label[j], []).append(w)
            total = {v: round(sum(w for w in ws if w is not None), 6) if any(w is not None for w in ws) else float("-inf") for v, ws in votes.items()}
            vote = min(total, key=lambda v: (-total[v], v))
            new[i] = vote if r % 2 == 0 or vote < label[i] else label[i]
        label = new
    return label


def test_labels_of_any_graph_in_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(-20, 300), 2))) for _ in range(900)} | {(5, i) for i in range(400, 600)})
    pairs = [(a, b, rng.choice([0.9, 0.95, 1.0, 0.1 + 0.2, 0.3, None])) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long, weight double")
    monkeypatch.setattr(label_blocks, "BLOCK_EDGES", 50)
    for rounds in (0, 1, 2, 5):
        want = plain_labels(pairs, rounds)
        assert {r["id"]: r["community"] for r in graph.label_communities(df, rounds).collect()} == want
    named = [(f"n{a}", f"n{b}", w) for a, b, w in pairs]  # in another order
    assert {r["id"]: r["community"] for r in graph.label_communities(spark.createDataFrame(named, "a string, b string, weight double"), 5).collect()} == plain_labels(named, 5)
    assert graph.label_communities(df.limit(0)).count() == 0


def test_a_round_of_labels_moves_one_to_a_block_and_no_edges(spark):
    pairs = [(0, i, 1.0) for i in range(1, 2001)] + [(i, i + 1, 0.5) for i in range(1, 2000)]
    blocks = label_blocks.packed(spark.createDataFrame(pairs, "a long, b long, weight double"), 7)
    assert blocks.count() == 7
    whole = label_blocks.propagated(blocks, 4)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 4 and plan.count("Exchange hashpartitioning(block") == 3
    sent = blocks.groupBy("block").applyInArrow(lambda t: label_blocks.one_round(0, False)(t), "block long, sender long, labels binary").collect()
    by_hand = len({(i, j % 7) for a, b, _ in pairs for i, j in ((a, b), (b, a))})
    assert sum(len(r["labels"]) // 8 for r in sent if r["sender"] >= 0) == by_hand < len(pairs) * 2
    assert {r["node"]: r["label"] for r in whole.collect()} == plain_labels(pairs, 4)
