"""The kept lexical index: bounds, deltas, phrases and what a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import lexical
from terravane.operators.term_index import TermIndex

WEIGHTS = {"title": 4.0, "body": 1.0}


def rows(n, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    return [(i, " ".join(word() for _ in range(2)), " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, title string, body string")


QUERIES = [(q, t) for q, words in enumerate((["w1", "w2", "w250"], ["w7", "w8", "w9", "w1"], ["zzz"], ["w3", "w299", "w41"])) for t in words]


def plain(data, queries, k, keep=lambda i: True, match="or"):
    """Scores by counting words."""
    import math

    docs = {i: (title.split(), body.split()) for i, title, body in data}
    mean = sum(len(a) + len(b) for a, b in docs.values()) / len(docs)
    tf = lambda d, p: sum(w * sum(c[i : i + len(p)] == p for i in range(len(c) - len(p) + 1)) for w, c in zip((4.0, 1.0), d))
    out = []
    for q in sorted({q for q, _ in queries}):
        asked = [p for p in dict.fromkeys(tuple(t.split()) if isinstance(t, str) else tuple(t) for x, t in queries if x == q)]
        score, hit = {}, {}
        for p in asked:
            f = {i: n for i, d in docs.items() if (n := tf(d, list(p)))}
            idf = max(math.log((len(docs) - len(f) + 0.5) / (len(f) + 0.5)), 1e-6)
            for i, n in f.items():
                size = sum(map(len, docs[i]))
                score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))
                hit[i] = hit.get(i, 0) + 1
        score = {i: s for i, s in score.items() if keep(i)}
        if match == "and_or" and any(hit[i] == len(asked) for i in score):
            score = {i: s for i, s in score.items() if hit[i] == len(asked)}
        out += [(q, i, round(s, 6), hit[i]) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


def answer(df):
    return [(r["query_id"], r["id"], round(r["score"], 6), r["matched"]) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("direct", [0, 10**9])
@pytest.mark.parametrize("match", ["or", "and_or"])
def test_bounds_leave_results_alone(spark, direct, match):
    data = rows(900)
    index = TermIndex.of(frame(spark, data), "id", WEIGHTS)
    asked = spark.createDataFrame(QUERIES, "query_id int, term string")
    assert answer(index.search(asked, 5, match=match, direct=direct)) == plain(data, QUERIES, 5, match=match)
    keep = frame(spark, data).where("id % 7 = 3")
    assert answer(index.search(asked, 5, keep, match, direct)) == plain(data, QUERIES, 5, lambda i: i % 7 == 3, match)


@pytest.mark.parametrize("direct", [0, 10**9])
def test_phrases_stand_in_one_column(spark, direct):
    data = rows(400, 3) + [(1000, "w1 w2", "w3"), (1001, "w1", "w2 w1 w2 w1 w2"), (1002, None, None)]
    data = [(i, a or "", b or "") for i, a, b in data]
    index = TermIndex.of(frame(spark, data), "id", WEIGHTS)
    phrases = [(0, ["w1", "w2"]), (0, ["w1"]), (1, ["w1", "w2", "w1"]), (2, ["w1", "w1"])]
    asked = spark.createDataFrame(phrases, "query_id int, terms array<string>")
    assert answer(index.search(asked, 6, direct=direct)) == plain(data, phrases, 6)


@pytest.mark.parametrize("direct", [0, 10**9])
def test_added_and_removed_documents(spark, direct):
    old, new = rows(500), [(i + 300, a, b) for i, a, b in rows(400, 2)]
    index = TermIndex.of(frame(spark, old), "id", WEIGHTS)
    index = index.remove(frame(spark, old).where("id >= 300")).add(frame(spark, new), "id")
    now = [r for r in old if r[0] < 300] + new
    asked = spark.createDataFrame(QUERIES, "query_id int, term string")
    assert answer(index.search(asked, 7, direct=direct)) == plain(now, QUERIES, 7)
    assert sorted(r["id"] for r in index.documents().collect()) == [r[0] for r in now]
    fresh = TermIndex.of(frame(spark, now), "id", WEIGHTS)
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, fresh.terms().collect()))


def test_a_search_reads_the_folders_of_its_terms(spark):
    index = TermIndex.of(frame(spark, rows(900)), "id", WEIGHTS)
    got = index._rows({"w250": spark.range(1).select(F.pmod(F.xxhash64(F.lit("w250")), F.lit(16)).cast("int")).first()[0]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,w250)" in plan.replace("In(term, [w250])", "EqualTo(term,w250)")
    assert {r[0].split("bucket=")[1].split("/")[0] for r in got.select(F.input_file_name()).distinct().collect()} and got.count() < index._all().count() / 50


def test_empty_documents_and_no_hits(spark):
    none = TermIndex.of(frame(spark, []), "id", WEIGHTS)
    asked = spark.createDataFrame(QUERIES, "query_id int, term string")
    assert none.search(asked, 3).count() == 0 and none.documents().count() == 0
    one = lexical.bm25(frame(spark, [(1, "", "")]), asked, "id", WEIGHTS, 3)
    assert one.count() == 0
