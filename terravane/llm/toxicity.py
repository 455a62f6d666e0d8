"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity is an ordered grade 0, 1 .. K. The model has one weight a word, shared by all thresholds, and
increasing thresholds t1 < .. < tK: P(grade >= k) = sigmoid(w . x - tk), with x the log of one plus a word's
count. The output is the expected severity, the sum of these probabilities, and the probability of any.

Labels that hold more than two values are the grades. Where they hold 0 and 1 only, the rows labelled 1 are
graded by how many marked words they hold: 2 where there are more than in the median of such rows, else 1. Which
words are marked is a matter of association with the label in the other half of the sample (rows
are halved by a hash of the id), so a row's grade depends neither on its own words' weights nor on the model.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, half of them positives where there are
enough). A word has a weight if it stands in LEAST_ROWS rows and its share among positive rows exceeds that among
the others by LEAST_Z deviations; words are counted in Spark, and the driver gets the words that pass and the
sample's counts of them.

Defined results: null or empty text has no words and gets the constants' severity; without a positive label all get
0; of an id's several labels the largest counts, null and negative ones don't; rows that repeat an id, or have none,
are scored each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, held_out, prepare, written
from .optimise import Adam, sigmoid
from .words import text_words

SAMPLE_ROWS = 12_000  #: Labelled rows the model is fitted on, at most; half of them positives.
LEAST_ROWS, LEAST_Z, HALF_Z = 8, 7.0, 5.0
STEPS, RATE, DECAY = 400, 0.05, 1e-5
LINE = 0.5


def bags(rows: DataFrame) -> DataFrame:
    """doc_id, grade, half and the distinct words of each row's whole text with their counts, as blobs."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            parts = [(i + row, h) for i, _, h, row in text_words(batch.column(3))]
            row, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(h))).astype(np.int32)
            cut = np.searchsorted(row[first], np.arange(n + 1))
            words = [h[first[x:y]].tobytes() for x, y in zip(cut[:-1], cut[1:])]
            counts = [count[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "grade", "half", "words", "counts"])

    return rows.select("doc_id", "grade", "half", "text").mapInArrow(run, "doc_id long, grade int, half int, words binary, counts binary")


def word_rows(found: DataFrame) -> DataFrame:
    """(word, half, bad, n): in how many rows, and how many graded ones, each word stands; counted by batch, then by word."""

    def run(batches):
        for batch in batches:
            words = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            if not words:
                continue
            h = np.concatenate(words)
            kind = np.repeat(batch.column(2).to_numpy() * 2 + (batch.column(1).to_numpy() > 0), [len(w) for w in words])
            for half in (0, 1):
                w, at = np.unique(h[kind // 2 == half], return_inverse=True)
                bad = np.bincount(at, kind[kind // 2 == half] % 2, len(w)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), half, np.int32)), pa.array(bad), pa.array(np.bincount(at, minlength=len(w)).astype(np.int64))], ["word", "half", "bad", "n"])

    return found.mapInArrow(run, "word long, half int, bad long, n long").groupBy("word", "half").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def deviations(bad, n, all_bad: int, all_good: int):
    """By how many deviations the word's share among graded rows exceeds that among the others."""
    share = n / max(1, all_bad + all_good)
    spread = F.sqrt(F.greatest(share * (1 - share) * (1 / max(1, all_bad) + 1 / max(1, all_good)), F.lit(1e-12)))
    return (bad / max(1, all_bad) - (n - bad) / max(1, all_good)) / spread


def choose(found: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words that have a weight, and those that are marked by either half."""
    sizes = {(r["half"], r["bad"]): r["n"] for r in found.groupBy("half", (F.col("grade") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda half, bad: sizes.get((half, bad), 0)
    halves = [F.struct(*[F.sum(F.when(F.col("half") == k, F.col(c))).alias(c) for c in ("bad", "n")]).alias(f"h{k}") for k in (0, 1)]
    rows = word_rows(found).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), *halves)
    ok = F.coalesce((F.col("n") >= LEAST_ROWS) & (deviations(F.col("bad"), F.col("n"), size(0, True) + size(1, True), size(0, False) + size(1, False)) >= LEAST_Z), F.lit(False))
    marks = [F.coalesce((F.col(f"h{k}.n") >= LEAST_ROWS / 2) & (deviations(F.col(f"h{k}.bad"), F.col(f"h{k}.n"), size(k, True), size(k, False)) >= HALF_Z), F.lit(False)) for k in (0, 1)]
    got = rows.select("word", ok.alias("ok"), *[m.alias(f"m{k}") for k, m in enumerate(marks)]).where("ok or m0 or m1").toPandas()
    pick = lambda c: np.sort(got.loc[got[c].astype(bool), "word"].to_numpy(np.int64).view(np.uint64))
    return pick("ok"), [pick("m0"), pick("m1")]


def known(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(h), bool)
    return words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h


def chosen_cells(found: DataFrame, words: np.ndarray, marked: list[np.ndarray]) -> DataFrame:
    """doc_id, grade, the chosen words of each row with their counts, and how many of its words the other half marks."""
    held = found.sparkSession.sparkContext.broadcast((words, marked))

    def run(batches):
        words, marked = held.value
        for batch in batches:
            w, c, marks = [], [], []
            for half, h, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32)
                ok = known(words, h)
                w.append(h[ok].tobytes())
                c.append(n[ok].tobytes())
                marks.append(int(n[known(marked[1 - half], h)].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.binary()), pa.array(c, pa.binary()), pa.array(marks, pa.int64())], ["doc_id", "grade", "words", "counts", "marks"])

    return found.mapInArrow(run, "doc_id long, grade int, words binary, counts binary, marks long")


class Model:
    """Word hashes in order with their weights, and the thresholds."""

    def __init__(self, words: np.ndarray, grades: int):
        self.words, self.w = np.sort(words), np.zeros(len(words))
        self.cuts = np.arange(grades, dtype=float) * 2 + 1

    def sparse(self, h: np.ndarray, row: np.ndarray, count: np.ndarray | None, rows: int):
        """(row, word, value) of known words."""
        if not len(self.words) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[at] == h
        cell, back = np.unique(row[ok] * len(self.words) + at[ok], return_inverse=True)
        n = np.bincount(back, None if count is None else count[ok], len(cell))
        return cell // len(self.words), cell % len(self.words), np.log1p(n)

    def line(self, cells, rows: int) -> np.ndarray:
        r, c, v = cells
        return np.bincount(r, self.w[c] * v, rows)

    def above(self, line: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K."""
        return sigmoid(line[:, None] - self.cuts[None, :])

    def fit(self, cells, grade: np.ndarray, weight: np.ndarray) -> None:
        """Weighted likelihood of the grades; thresholds are a first one and positive gaps."""
        rows, k, n = len(grade), len(self.cuts), len(self.w)
        theta = np.concatenate((self.w, self.cuts[:1], np.zeros(k - 1)))
        opt = Adam(len(theta), RATE)
        r, c, v = cells
        at = np.arange(rows)
        for _ in range(STEPS):
            self.w = theta[:n]
            self.cuts = theta[n] + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(theta[n + 1 :])))))
            p = np.concatenate((np.ones((rows, 1)), self.above(self.line(cells, rows)), np.zeros((rows, 1))), axis=1)
            prob = np.maximum(p[at, grade] - p[at, grade + 1], 1e-9)
            d = p * (1 - p)
            up, down = d[at, grade] / prob, d[at, grade + 1] / prob
            slope = -(up - down) * weight  # of minus the log likelihood, by the line
            g_cut = np.zeros(k)
            for j in range(1, k + 1):
                g_cut[j - 1] = np.sum(weight * (np.where(grade == j, up, 0) - np.where(grade + 1 == j, down, 0)))
            tail = np.cumsum(g_cut[::-1])[::-1]
            g = np.concatenate((np.bincount(c, slope[r] * v, n) + DECAY * self.w * weight.sum(), tail[:1], tail[1:] * sigmoid(theta[n + 1 :])))
            theta = theta + opt.step(g / weight.sum())
        self.w = theta[:n]
        self.cuts = theta[n] + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(theta[n + 1 :])))))


def train(words: np.ndarray, bags: list[np.ndarray], counts: list[np.ndarray], grade: np.ndarray, weight: np.ndarray) -> Model | None:
    """A model from bags of the chosen words with grades; weight undoes the sampling of negatives."""
    if not len(grade) or not (grade > 0).any():
        return None
    row = np.repeat(np.arange(len(bags)), [len(w) for w in bags])
    model = Model(words, int(grade.max()))
    model.fit(model.sparse(np.concatenate(bags), row, np.concatenate(counts), len(grade)), grade, weight)
    return model


def graded(grade: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0/1 labels as grades 0, 1, 2 by the number of marked words; labels of more values as they are."""
    bad = grade > 0
    if not bad.any() or grade.max() > 1:
        return grade
    return np.where(bad & (marks > np.median(marks[bad])), 2, grade)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from about `rows` labelled documents that are not held out."""
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & (F.col("toxic") >= 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("grade"))
    marked = marked.where("doc_id is not null")
    sizes = {r["bad"]: r["n"] for r in marked.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {bad: min(1.0, rows / 2 / max(1, n)) for bad, n in sizes.items()}
    luck = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1_000_000
    picked = marked.where(luck < F.when(F.col("grade") > 0, F.lit(share.get(True, 0.0))).otherwise(F.lit(share.get(False, 0.0))))
    picked = written(picked.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")), "picked")
    near = F.broadcast if picked.count() <= 2 * rows else lambda x: x
    found = written(bags(docs.select(F.col("doc_id").cast("long"), F.col("text")).join(near(picked), "doc_id")), "bags")
    words, marks = choose(found)
    got = chosen_cells(found, words, marks).toPandas().sort_values(["doc_id", "marks", "counts"])
    discard(picked, found)
    bag, counts = ([np.frombuffer(x, kind) for x in got[c]] for c, kind in (("words", np.uint64), ("counts", np.int32)))
    grade = got["grade"].to_numpy(np.int64)
    weight = np.where(grade > 0, 1 / max(share.get(True, 1.0), 1e-9), 1 / max(share.get(False, 1.0), 1e-9))
    return train(words, bag, counts, graded(grade, got["marks"].to_numpy()), weight)


def severities(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, severity (expected grade), score (probability of any), grade (the likeliest) and toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for (i, j), parts in groupby(text_words(batch.column(2)), key=lambda x: x[:2]):
                rows = j - i
                if m is None:
                    p = np.zeros((rows, 1))
                else:
                    some = [(h[ok], row[ok]) for _, _, h, row in parts for ok in [known(m.words, h)]]
                    p = m.above(m.line(m.sparse(*(np.concatenate(x) for x in zip(*some)), None, rows), rows))
                full = np.concatenate((np.ones((rows, 1)), p, np.zeros((rows, 1))), axis=1)
                grade = (full[:, :-1] - full[:, 1:]).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(p.sum(1)), pa.array(p[:, 0].copy()), pa.array(grade.astype(np.int32)), pa.array(p[:, 0] >= LINE)],
                    ["doc_id", "held_out", "severity", "score", "grade", "toxic"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, severity double, score double, grade int, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    return severities(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
