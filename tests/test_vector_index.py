"""The kept vector index: recall, exact searches by bounds, deltas, odd rows and what a search reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import vector
from terravane.operators.vector_index import VectorIndex, reach

SCHEMA = "id long, vector array<double>"


def data(n=1200, d=16, centres=30, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, d))
    hot = rng.random(n) < 1 / 3  # a third of all rows lies in one place
    at = np.where(hot, 0, rng.integers(0, centres, n))
    return [(i, [float(x) for x in base[at[i]] + rng.standard_normal(d) * 0.25]) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    return df, VectorIndex.fitted(df, lists=24)


def plain(rows, queries, k, same=False):
    out = []
    for q, v in queries:
        cos = lambda x: round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6)
        near = sorted((-cos(x), i) for i, x in rows if not (same and i == q))[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(near, 1)]
    return out


def test_recall_and_exact_results(spark, made):
    df, index = made
    asked = [r for r in data() if r[0] % 10 == 0]
    want = plain(data(), asked, 5, same=True)
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    some = {(r["query_id"], r["id"]) for r in index.search_all(q, 5, probes=3, same=True).collect()}
    assert len(some & {x[:2] for x in want}) >= 0.9 * len(want)
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in index.search_all(q, 5, probes=2, exact=True, same=True).collect())
    assert [x[2] for x in got] == [x[1] for x in want]
    assert all(abs(x[3] - y[2]) < 2e-6 for x, y in zip(got, want))


def test_one_query(spark, made):
    df, index = made
    v = data()[7][1]
    want = [(r["id"], r["similarity"]) for r in vector.knn(df, v, 10).collect()]
    assert [(r["id"], r["similarity"]) for r in index.search(v, 10, probes=1, exact=True).orderBy(F.desc("similarity"), "id").collect()] == want
    few = df.where("id % 200 = 3").select("id")
    near = index.search(v, 10, probes=1, within=few)  # fewer than ten in any list: all are looked at
    assert {r["id"] for r in near.collect()} == {r["id"] for r in few.collect()}


def test_a_search_reads_its_lists_alone(made):
    index = made[1]
    plan = index.rows([3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:300] and "EqualTo(list,3)" in plan
    assert index.rows([3]).count() < index.rows().count() == 1200


def test_deltas(spark, made):
    df, index = made
    other = spark.createDataFrame([(5000, data()[7][1]), (7, [-x for x in data()[7][1]])], SCHEMA)
    later = index.remove(spark.createDataFrame([(7,), (9,)], "id long")).add(other)
    rows = [r for r in data() if r[0] not in (7, 9)] + [(r["id"], r["vector"]) for r in other.collect()]
    got = later.search(data()[7][1], 6, probes=2, exact=True).orderBy(F.desc("similarity"), "id").collect()
    assert [r["id"] for r in got] == [x[1] for x in plain(rows, [(-1, data()[7][1])], 6)]
    assert later.rows().count() == 1200 and index.rows().count() == 1200


def test_odd_rows(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [float("inf"), 0.0])]
    index = VectorIndex.fitted(spark.createDataFrame(odd, SCHEMA))
    assert sorted(r["id"] for r in index.search([1.0, 1.0], 9).collect()) == [7, 7, 8]
    assert index.search([1.0], 3).count() == 0 and index.search([0.0, 0.0], 3).count() == 0
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, None)], "query_id int, vector array<double>")
    assert sorted(r["id"] for r in index.search_all(q, 9).collect()) == [7, 7, 8]
    none = VectorIndex.fitted(spark.createDataFrame([], SCHEMA))
    assert none.search([1.0], 3).count() == 0 and none.search_all(q, 3).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(1)
    x, c, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((3, 500, 5)))
    assert (np.sum(x * q, 1) <= reach(np.sum(c * q, 1), np.sum(x * c, 1)) + 1e-9).all()


def test_the_facade_keeps_it(spark, tmp_path):
    from terravane.plans.service import Repository

    root = tmp_path / "tree"
    root.mkdir()
    for name in ("alpha", "beta"):
        (root / f"{name}.py").write_text(f"def load_session_{name}(token):\n    'Load the stored session of a token'\n\n\ndef unrelated_{name}():\n    'Draw a chart'\n")
    repo = Repository(spark, str(tmp_path / "store"))
    repo.update(str(root))
    first = repo.nearest()
    assert first.rows().count() == repo.table("vectors").count() and len(first.segments) == 1
    assert repo.graph_stage() == 2
    made = repo.table("edges").where("type = 'semantically_related'")
    assert made.count() > 0 and {r["provenance"] for r in made.collect()} == {"semantic"}
    (root / "beta.py").write_text("def other():\n    'Draw a chart'\n")
    assert repo.update(str(root)) == 3
    later = repo.nearest()
    assert len(later.segments) == 2 and later.model == first.model
    assert sorted(r["id"] for r in later.rows().collect()) == sorted(r["id"] for r in repo.table("vectors").collect())
    known = {r["id"] for r in repo.table("entities").collect()}
    kept = repo.table("edges").where("type = 'semantically_related'").collect()
    assert all({r["source_id"], r["target_id"]} <= known for r in kept)
    names = {r["name"] for r in repo.related(repo.resolve("load_session_alpha"), 2).join(repo.table("entities"), "id").collect()}
    assert len(names) == 2 and "load_session_alpha" not in names
