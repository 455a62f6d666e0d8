"""Cases of the fourth round's findings."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from terravane import registry
from terravane.functions import identity as I
from terravane.functions import text as T
from terravane.operators import bindings, context, extraction, graph, memory, ranking, resolve, term_index, vector
from terravane.operators.checkpoints import cut
from terravane.plans import queries_text


def test_note_cut_at_a_line_break_keeps_the_word_before_it(spark):
    text = "aaaa bbb\n" + "c" * 200
    cut = lambda text: context.attach_notes(spark.createDataFrame([(1, 0, 0, text)], "`group` int, rank int, id int, text string"), 28 + 3 + 80).first()["text"]
    assert cut("aaaa bbb cc\n" + "c" * 200) == "aaaa bbb cc\n"
    assert cut(text) == "aaaa bbb\n"


def intents(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    return [tuple(r) for r in rows.orderBy("i").select(T.plan_context(F.col("q"), 3500)["intent"], T.detect_intent(F.col("q"))).collect()]


def test_words_of_patterns_have_ascii_edges_and_end_at_the_very_end(spark):
    assert intents(spark, "ein ütest des", "hello\n", "name\n", "tEst", "teſt") == [("test", "tests"), ("explain", "semantic"), ("explain", "semantic"), ("test", "tests"), ("test", "tests")]


def test_image_sizes_above_two_bytes(spark, tmp_path):
    keys = spark.range(65530, 65545).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"))
    keys.write.parquet(f"{tmp_path}/part.parquet")
    got = {r["k"]: (r["width"], r["height"]) for r in registry.QUERIES["media_image_size"](spark, str(tmp_path)).collect()}
    assert got == {k: (7, k) if k % 4 < 3 else (None, None) for k in range(65530, 65545)}


def test_blanks_before_a_last_line_separator_stay(spark):
    texts = ["a  ", "a \u0085", "v a v\n\x0b", " a \r\n b \r"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(I.normalize_representation(F.col("t"))).collect()] == ["a  ", "a \u0085", "v a v", "a\n b"]


def test_references_of_a_common_name_cost_one_row_each(spark):
    """2,000 symbols and 2,000 references of one name in one file: no join makes their pairs."""
    symbols = spark.range(2000).select(F.format_string("s%04d", "id").alias("id"), F.lit("run").alias("name"), F.lit("q").alias("qualified_name"), F.lit("a.py").alias("path"), F.lit("python").alias("language"), F.lit("m").alias("module"))
    refs = spark.range(2000).select(F.format_string("r%04d", "id").alias("ref_id"), F.format_string("s%04d", "id").alias("source_id"), F.lit("run").alias("name"), F.lit("a.py").alias("path"), F.lit("python").alias("language"), F.lit("m").alias("module"))
    got = resolve.resolve(refs, symbols)
    rows = {r["ref_id"]: r for r in got.collect()}
    assert {(r["outcome"], r["tier"], r["target_id"]) for r in rows.values()} == {("ambiguous", 2, None)}
    assert rows["r0003"]["candidates"] == [f"s{i:04d}" for i in range(9) if i != 3]
    assert rows["r1999"]["candidates"] == [f"s{i:04d}" for i in range(8)]
    nodes, made = [got._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        made += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 2 * 2000


def test_relevant_documents_are_found_without_a_text_for_every_word(spark):
    """A text of 20,000 words took a copy of itself for each word; items of fewer than eight words were found in texts as short alone."""
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "a b c d e f g h i j"), (3, ""), (4, None), (5, "x y")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "c d e"), (3, "x y z"), (4, "--"), (5, None), (6, "c d f")], "item_id int, text string")
    assert sorted(map(tuple, queries_text.relevant(docs, items).collect())) == [(1, 1), (2, 2), (4, 3)]


def test_a_large_batch_is_indexed_in_pieces_with_the_same_postings():
    texts = [[f"w{(i * j) % 97}" for j in range(1 + 40 * (i % 9))] for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["id", "t0"])

    def postings(parts):
        rows = [r for p in parts for r in term_index.block_rows(p, np.ones(1), 0, 128).to_pylist()]
        return sorted((r["term"], *x) for r in rows for x in zip(r["ids"], r["lengths"], r["tfs"], map(tuple, r["places"])))

    old, term_index.PIECE = term_index.PIECE, 10_000
    try:
        parts = list(term_index.pieces(batch, 128))
    finally:
        term_index.PIECE = old
    assert sum(p.num_rows for p in parts) == 1000 and max(sum(map(len, p.column(1).to_pylist())) for p in parts) <= 10_000
    assert postings(parts) == postings([batch])


def test_closure_of_a_dense_graph_keeps_sets_not_pairs(spark, monkeypatch):
    """300 names that all reach 200 definitions through 40 names that import each other: no written step holds the 60,000 pairs."""
    rows = []

    def counted(df, name):
        out = cut(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(bindings, "cut", counted)
    hub = [(f"h{i}", "x", f"h{(i * 3 + j) % 40}", "x") for i in range(40) for j in range(6)]
    out = [(f"h{i % 40}", "x", f"d{i}", "y") for i in range(200)]
    first = [(f"s{i}", "x", f"h{i % 40}", "x") for i in range(300)]
    b = spark.createDataFrame(hub + out + first, "path string, alias string, target_path string, target_name string")
    got = bindings.closure(spark.createDataFrame([(f"s{i}", "x") for i in range(300)], "path string, name string"), b, spark.createDataFrame([(f"d{i}", "y") for i in range(200)], "path string, name string"))
    assert got.count() == got.distinct().count() == 300 * 200
    assert max(rows) < 2000


def plain_knn(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    return {(ids[i], ids[j], n + 1) for i in range(len(x)) for n, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k])}


def vectors_with_copies(spark):
    x = np.random.default_rng(5).standard_normal((260, 16))
    x[:70], x[70:90] = x[0], x[0] + 1e-9  # copies, and near copies that tie to six places
    rows = spark.createDataFrame([(i * 7 % 260, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    return rows, plain_knn([i * 7 % 260 for i in range(260)], x, 5)


def test_blocks_of_all_pairs_do_not_grow_with_the_rows(spark, monkeypatch):
    assert vector.blocks(600_000) == vector.blocks(100_000) == 16 and vector.blocks(2000) == 1
    monkeypatch.setattr(vector, "BLOCK_ROWS", 16)
    rows, want = vectors_with_copies(spark)
    got = vector.all_knn(rows.withColumnRenamed("id", "query_id"), rows, 5, same=True)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_all_vectors_meet_once_for_both_their_rows(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 16)
    rows, want = vectors_with_copies(spark)
    assert {(r["query_id"], r["id"], r["rank"]) for r in vector.own_knn(rows, 5).collect()} == want
    monkeypatch.setattr(vector, "TILE", 32)
    cells, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: (cells.append(out.size), matmul(a, b, out=out))[1])
    found = sorted((r["id"], r["vector"]) for r in rows.collect())
    x, ids = vector.unit(pd.Series([v for _, v in found])), np.array([i for i, _ in found])
    i, j, _ = vector.nearest_both(x, None, 5, ids, None)[0].found()
    assert set(zip(ids[i], ids[j])) == {w[:2] for w in want}
    assert sum(cells) <= 260 * (260 + 32) / 2


def test_vectors_that_repeat_an_id_are_no_partners_of_each_other(spark):
    rows = spark.createDataFrame([(i // 3, [1.0, float(i % 7)]) for i in range(30)], "id long, vector array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(vector.own_knn(rows, 4)) == key(vector.all_knn(rows.withColumnRenamed("id", "query_id"), rows, 4, same=True))
    assert vector.own_knn(rows.limit(1), 4).count() == vector.own_knn(rows.limit(0), 4).count() == 0


def test_large_buckets_are_met_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(vector, "BUCKET_ROWS", 32)
    rows, want = vectors_with_copies(spark)
    got = vector.approximate_knn(rows.withColumnRenamed("id", "query_id"), rows, 5, tables=3, bits=1)
    found = {(r["query_id"], r["id"]) for r in got.collect()}
    whole = {w[:2] for w in want}
    copies = {(r["id"]) for r in rows.collect() if r["id"] in {i * 7 % 260 for i in range(90)}}
    assert {p for p in whole if p[0] in copies} == {p for p in found if p[0] in copies}
    assert len(found & whole) > 0.6 * len(whole)


def written_by(monkeypatch, module):
    """What a module writes from here on: (name, rows, types)."""
    seen = []

    def kept(df, name):
        out = cut(df, name)
        seen.append((name, out.count(), sorted(t for _, t in out.dtypes)))
        return out

    monkeypatch.setattr(module, "cut", kept)
    return seen


def test_searches_from_few_nodes_keep_an_edge_once(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{i}", f"b{i % 7}", "calls", "resolved", 0.9) for i in range(40)] + [("a0", "a0", "calls", "resolved", 0.9)], "source_id string, target_id string, type string, provenance string, confidence double")
    seed = spark.createDataFrame([("a0",)], "id string")
    for run in (lambda: graph.expand(edges, seed), lambda: ranking.proximity(edges, "a0"), lambda: graph.shortest_paths(edges, "a0", 2)):
        seen = written_by(monkeypatch, graph)
        assert run().count() > 5
        assert seen[0][1] == edges.count()
    near = {r["id"]: r["value"] for r in ranking.proximity(edges, "a0").collect()}
    assert near == {"a0": 1.0, "b0": round(2 / 3, 6)} | {f"a{i}": round(1 / 3, 6) for i in range(7, 40, 7)}


def test_rounds_of_labels_move_numbers_in_the_order_of_ids(spark, monkeypatch):
    seen = written_by(monkeypatch, graph)
    pairs = spark.createDataFrame([("b", "c", 1.0), ("a", "z", 1.0), ("c", "z", 0.5)], "a string, b string, weight double")
    got = {r["id"]: r["community"] for r in graph.label_communities(pairs, 1).collect()}
    assert got == {"a": "z", "z": "a", "b": "c", "c": "b"}
    assert {t for name, _, types in seen if name in ("pairs", "communities") for t in types} == {"bigint", "double"}


def test_files_of_one_partition_are_parsed_in_many_tasks(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(extraction, "cut", lambda df, name: (parts.append(df.rdd.getNumPartitions()), cut(df, name))[1])
    files = spark.createDataFrame([(f"f{i}.py", "python", f"def g{i}():\n    h()\n") for i in range(50)], "path string, language string, text string").coalesce(1)
    assert extraction.symbols(files).count() == 50
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_betweenness_of_trees_takes_a_row_a_node(spark, monkeypatch):
    seen = written_by(monkeypatch, graph)
    tree = spark.createDataFrame([(f"n{i}", f"n{(i - 1) // 6}", 1.0) for i in range(1, 400)] + [("x", "y", 1.0)], "a string, b string, weight double")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(tree).collect()}
    assert max(rows for _, rows, _ in seen) <= 402
    below = lambda i: 1 + sum(below(j) for j in range(6 * i + 1, 6 * i + 7) if j < 400)

    def pairs(i):
        branches = [below(j) for j in range(6 * i + 1, 6 * i + 7) if j < 400]
        branches.append(399 - sum(branches))
        return sum(branches) ** 2 - sum(b * b for b in branches)

    assert got == {f"n{i}": round(pairs(i) / 401 / 400, 6) for i in range(400)} | {"x": 0.0, "y": 0.0}


def test_hanging_trees_change_no_betweenness(spark):
    rng = __import__("random").Random(7)
    ring = [(f"c{i}", f"c{(i + 1) % 7}", rng.choice([1.0, 0.5])) for i in range(7)] + [("c0", "c3", 1.0)]
    trees = [(f"t{i}", rng.choice([f"c{i % 7}", f"t{rng.randrange(i)}" if i else "c1"]), 0.25) for i in range(40)] + [("u", "v", 1.0), ("v", "w", 1.0)]
    df = spark.createDataFrame(ring + trees, "a string, b string, weight double")
    plain, got = ({r["id"]: r["betweenness"] for r in graph.betweenness(df, 20, rounds).collect()} for rounds in (1000, None))
    assert set(got) == set(plain) and len(got) == 50 and max(abs(got[i] - plain[i]) for i in got) < 2e-6


def test_words_of_a_note_are_cut_once(spark):
    notes = spark.createDataFrame([
        (1, "Checks: ONAND\ttioning!", ["x"], "k"), (2, "valid session ion", ["x"], "k"), (3, "retest contest", ["x"], "k"), (4, None, ["Checks"], "k"), (5, "", None, "test"),
        (6, "tion", None, None), (7, "session checksum", [], ""), (8, "onan d", ["onandé"], "k"), (9, "éonand onandé", ["x"], "k"), (10, "validations_x", ["tioning2"], "k"), (11, "test_onand", ["y"], "k"),
    ], "id int, content string, tags array<string>, kind string")
    got = memory.lexical_score(notes, "checks the onand tioning")
    assert {r["id"]: r["lexical"] for r in got.collect()} == {1: 1.2, 2: 0.333333, 4: 0.416667, 5: 0.416667, 6: 0.333333, 7: 0.333333, 8: 0.416667, 9: 0.333333, 10: 0.75, 11: 0.666667}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract_all" not in plan
    assert memory.lexical_score(notes, "the of").count() == 0
    asked = memory.lexical_score(spark.createDataFrame([(1, "a session of 12"), (2, "sess")], "id int, content string").withColumn("tags", F.array(F.lit("t"))).withColumn("kind", F.lit("k")), "session_id 12")
    assert {r["id"]: r["lexical"] for r in asked.collect()} == {1: 1.0}


def test_a_row_goes_to_eight_tasks_whatever_the_rows(spark):
    assert vector.lines(10_256) == vector.lines(102_564) == vector.lines(615_384)
    for rows in (10, 3000, 100_000, 1_000_000):
        n, d = vector.lines(rows)
        met = [(i, (i + a) % n, (i + b) % n) for i in range(n) for a in d for b in d if a != b]
        assert len({m[1:] for m in met}) == len(met) == n * (n - 1)  # any two blocks on one line
        assert d[0] == 0 and rows * len(d) <= 2 * vector.MOST_ROWS * n
    assert len(vector.lines(100_000)[1]) == 8


def test_rows_of_single_precision_are_moved_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 16)
    x = np.random.default_rng(6).standard_normal((200, 8)).astype(np.float32)
    x[::3] = x[0]  # copies in all blocks, whose ids are in no order of the blocks
    ids = [f"v{i * 11 % 200:03}" for i in range(200)]
    rows = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, vector array<float>")
    got = vector.own_knn(rows, 7)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == plain_knn(ids, x.astype(float), 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan


def test_a_task_goes_on_with_the_best_of_its_blocks(monkeypatch):
    monkeypatch.setattr(vector, "TILE", 16)
    x = np.random.default_rng(7).standard_normal((300, 16))
    x[:120], x[120:140] = x[0], x[0] + 1e-9
    ids = np.random.default_rng(8).permutation(300)
    for place in (np.zeros(300, int), ids // 60, np.arange(300) % 5):
        got = vector.best_of_line(pd.DataFrame({"id": ids, "place": place, "vector": list(x)}), 6)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(u @ u.T, 6)
        for i, off, near in zip(got["query_id"], got["off"], got["id"]):
            at = np.flatnonzero(ids == i)[0]
            free = np.flatnonzero((ids != i) & ((place != place[at]) | (place[at] == 0)))
            want = sorted((vector.ONE - round(s[at, j] * 1e6), ids[j]) for j in free)[:6]
            assert list(zip(off, near)) == want
        assert set(got["query_id"]) == set(ids)


def test_semantic_edges_decide_no_more_pairs_than_the_budget_needs(spark, monkeypatch):
    def passed(pairs, want, degree):
        held, got = {}, []
        for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if len(got) < want and held.get(a, 0) < degree and held.get(b, 0) < degree:
                got.append((a, b, s))
                held[a], held[b] = held.get(a, 0) + 1, held.get(b, 0) + 1
        return got

    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b), round(float(rng.integers(600, 990)) / 1000, 3)) for a in range(120) for b in range(a + 1, 120) if rng.random() < 0.3]
    near = spark.createDataFrame(pairs, "query_id int, id int, similarity double")
    rows, cut_ = [], vector.cut_lineage

    def counted(df, name):
        out = cut_(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(vector, "cut_lineage", counted)
    got = vector.semantic_edges(near, 120, 0.5)
    assert got.count() == 72 and sorted(map(tuple, got.collect())) == sorted(passed(pairs, 72, 8))
    assert max(n for name, n in rows if name != "pairs") < 2 * 72 + 40 < len(pairs) / 5
    for nodes, degree in ((600, 3), (300, 5)):  # the first pairs don't use the budget up
        want = passed(pairs, int(0.6 * nodes), degree)
        assert sorted(map(tuple, vector.semantic_edges(near, nodes, 0.5, degree=degree).collect())) == sorted(want)
    assert vector.semantic_edges(near, 120, 0.995).count() == 0
