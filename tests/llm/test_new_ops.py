"""Vector codes, periodic runs and substring removal against brute force, and on edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import periodic_runs, substring_dedup, vector_codes

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
BASE = fixtures.rows()[0][2:]


def rows_of(spark, pairs):
    return fixtures.frame(spark, [(i, t, *BASE) for i, t in pairs])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def plain_codes(rows):
    """{id: code, error} and all components, every part compared with every entry."""
    kept = {i: [[int(np.floor(4096 * float(x))) for x in v][p * len(v) // 8 : (p + 1) * len(v) // 8] for p in range(8)] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    books = [[kept[i][p] for i in sorted(kept)[:16]] for p in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(6):
        for p in range(8):
            of = {}
            for parts in kept.values():
                of.setdefault(near(parts[p], books[p])[1], []).append(parts[p])
            books[p] = [[sum(c) // len(c) for c in zip(*of[e])] if e in of else old for e, old in enumerate(books[p])]
    found = {i: [near(part, books[p]) for p, part in enumerate(parts)] for i, parts in kept.items()}
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, [x for b in books for e in b for x in e]


VECTORS = "vec_id long, embedding array<float>, label int, n long, code string, error long, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16).round(1)], None if i % 7 == 0 else i % 3) for i in range(300, 0, -1)]
    rows += [(0, None, 1), (301, [float("nan")] + [0.0] * 15, 1), (302, [None] + [0.0] * 15, 1), (303, [float("inf")] * 16, 2), (304, [1.0] * 8, 2), (305, [], 0), (306, [1e30] * 16, 0)]
    got, books = vector_codes.compress(spark, vectors(spark, rows).repartition(5))
    want, flat = plain_codes([(i, v) for i, v, _ in rows if v is not None and len(v) == 16 and i != 306])
    got = by_vec(got)
    assert {i: (r["code"].hex(), r["error"]) for i, r in got.items()} == want and books.ravel().tolist() == flat
    labels = {i: label for i, _, label in rows}
    for i, r in got.items():
        assert r["label_error"] == sum(e for j, (_, e) in want.items() if labels[j] == labels[i])


def by_vec(df):
    return {r["vec_id"]: r for r in df.collect()}


def test_vector_codes_edges(spark):
    none, books = vector_codes.compress(spark, vectors(spark, []))
    assert none.count() == 0 and books.size == 0
    few, books = vector_codes.compress(spark, vectors(spark, [(4, [0.5] * 8, 1), (4, [0.5] * 8, 1), (None, [1.0] * 8, None), (9, [-0.00001] * 8, 2)]))
    assert sorted((r["vec_id"] or 0, r["code"].hex(), r["error"], r["label_error"]) for r in few.collect()) == [(0, "02" * 8, 0, 0), (4, "00" * 8, 0, 0), (4, "00" * 8, 0, 0), (9, "01" * 8, 0, 0)]
    assert books[0].tolist() == [[2048], [-1], [4096]]
    with pytest.raises(ValueError):
        vector_codes.compress(spark, vectors(spark, [(1, [1.0] * 9, 1)]))


def test_labels_are_summed_by_broadcast_and_by_shuffle(spark):
    rows = spark.createDataFrame([(i, 7 if i < 300 else i, b"x", i) for i in range(400)], "vec_id long, label int, code binary, error long")
    got = by_vec(vector_codes.with_label_errors(rows))
    assert len(got) == 400 and all(r["label_error"] == (sum(range(300)) if i < 300 else i) for i, r in got.items())


def test_tree_equals_all_entries():
    rng = np.random.default_rng(2)
    for width, span in ((1, 4), (3, 3), (8, 2), (8, 4000)):
        entries = rng.integers(-span, span, (16, width))
        entries[9] = entries[3]  # equal entries: the lower index
        x = rng.integers(-span - 1, span + 1, (4000, width))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        which, best = vector_codes.Tree(entries).nearest(x)
        assert (which == far.argmin(1)).all() and (best == far.min(1)).all()


def plain_runs(words):
    """Runs by comparing words at every period, smallest period first."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_op12(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(120):  # runs in runs, runs that touch and overlap
        t = []
        while len(t) < 150:
            t += rng.integers(0, 3, rng.integers(1, 9)).astype(str).tolist() * int(rng.integers(1, 9))
        texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    data = [*enumerate(fixtures.texts(), 1000), *enumerate(texts), (None, texts[0]), (7, texts[1]), (7, texts[1])]
    data = [(i, t) for i, t in data if t is None or len(t) < 20000]
    got = periodic_runs.digest(periodic_runs.runs_of(rows_of(spark, data).repartition(3), periodic_runs.rewritten)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_op12(i, t))) for i, t in data)
    assert sum(r["n_runs"] for r in got) > 300 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in data) > 5
    assert periodic_runs.digest(periodic_runs.runs_of(fixtures.empty(spark))).count() == 0


def test_runs_of_unequal_words_are_searched_again(spark, monkeypatch):
    """Hashes that all collide give the same runs, by the words."""
    words = [*"abcabcabcabcab", *"xyzwv", *"dddddddd"]
    want = plain_runs(words)
    assert want and [tuple(map(int, r)) for r in zip(*periodic_runs.word_by_word(words))] == [(s, s + n, p) for s, n, p in want]


def test_periodic_runs_blocks_and_long_texts(spark):
    rng = np.random.default_rng(6)
    words = rng.integers(0, 50000, 260000).astype(str).tolist()
    words[1000:9000] = words[1000:2000] * 8
    words[150000:150090] = ["same"] * 90
    got = periodic_runs.runs_of(rows_of(spark, [(2, " ".join(words))])).first()
    assert [tuple(r) for r in got["runs"]] == [(1000, 8000, 1000), (150000, 90, 1)]
    assert got["collapsed"].split(" ") == words[:2000] + words[9000:150001] + words[150090:]


def plain_op13(rows, window=13):
    least = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(map(repr, out))


def answer(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect())


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [str(x) for x in rng.integers(0, 400, n)]
    passages = [word(n) for n in (13, 14, 20, 60, 12)]
    data = list(enumerate(fixtures.texts(), 5000))
    for i in rng.permutation(160).tolist():
        t = word(int(rng.integers(0, 60)))
        for p in rng.permutation(5)[:3]:
            a = int(rng.integers(0, 8))
            t += passages[p][a:] + word(int(rng.integers(0, 9))) + passages[p][: len(passages[p]) - a]
        data.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    data += [(None, data[50][1]), (999, data[60][1]), (999, data[60][1])]
    want = plain_op13(data)
    for hot in (64, 3):  # by pieces alone, and with common anchors dealt by window
        assert answer(substring_dedup.remove_repeats(spark, rows_of(spark, data).repartition(4), least_hot=hot)) == want
    assert substring_dedup.remove_repeats(spark, fixtures.empty(spark)).count() == 0


def test_substring_dedup_repeated_ids(spark):
    words = [str(i) for i in range(60)]
    data = [(1, " ".join(words[:20])), (5, " ".join([*"abc", *words[2:18]])), (5, "x y z v w " + " ".join(words[:8])), (5, "few")]
    got = sorted((r["n_words"], [tuple(x) for x in r["spans"]]) for r in substring_dedup.remove_repeats(spark, rows_of(spark, data)).collect())
    assert got == [(1, []), (13, [(3, 13)]), (19, [(3, 19)]), (20, [])]


def test_a_common_passage_is_dealt_by_window(spark):
    rng = np.random.default_rng(10)
    passage = [str(x) for x in rng.integers(0, 9, 40)]
    data = [(i, " ".join([f"a{i}b", *passage, f"c{i}d", f"e{i // 2}"])) for i in range(400)]
    rows = rows_of(spark, data).repartition(3)
    texts = rows.select("doc_id", "text")
    assert len(substring_dedup.common_anchors(texts, 13, 7, 64)) > 3
    assert answer(substring_dedup.remove_repeats(spark, rows)) == plain_op13(data)


def test_substring_dedup_long_text(spark):
    rng = np.random.default_rng(11)
    long = rng.integers(0, 9000, 260000).astype(str).tolist()
    data = [(1, " ".join(long[70000:70030])), (2, " ".join(long)), (3, " ".join(["x", *long[200000:200500], "y"]))]
    assert answer(substring_dedup.remove_repeats(spark, rows_of(spark, data))) == plain_op13(data)


def test_automaton_matches_are_maximal():
    rng = np.random.default_rng(12)
    for _ in range(40):
        refs = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(4)]
        shard = substring_dedup.Automaton()
        for r in refs:
            shard.add(r)
        text = rng.integers(0, 3, 40).tolist()
        have = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        covered = {x for i in range(40) for j in range(i + 4, 41) if tuple(text[i:j]) in have for x in range(i, j)}
        spans = list(shard.matches(text, 4))
        assert all(tuple(text[i:j]) in have for i, j in spans)
        assert {x for i, j in spans for x in range(i, j)} == covered
