"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1; unlabelled is all web text that is not held out, whatever its labels: a
mixture of good and bad documents in an unknown proportion, the class prior. The model is additive over binned
numbers about a text's form and words; a word weighs by how much more often it stands in trusted positives than in
all text, as the half of the corpus says in which the text is not.

The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)): the second part estimates the risk
on bad documents and cannot be negative, so where it would be, steps are taken against it. With squared loss it needs
no more than first and second moments of the binned numbers, and these, like the counts of words and the quantiles,
are sums over all documents made in Spark; no sample of them is drawn. The moments tell positives from unlabelled
too: where that score says a region holds much of the positives and as little as possible else, the share of
unlabelled rows in it over that of the positives bounds the prior from above, and the least such bound is the
estimate. The output is made a probability by the same risk with logistic loss, over histograms of all rows.

Of trusted positives at most about POSITIVES are used, chosen by a hash of the id. Defined results: null or empty text
has numbers of zero and is scored as such; without any positive label every score is 0.5; rows that repeat an id, or
have none, are scored each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, prepare, written
from .features import NAMES, TABLE_BITS, features, fold, places
from .optimise import Adam, sigmoid
from .words import text_words

POSITIVES = 20_000  #: Trusted positives that are learned from, about.
BINS, STEPS, RATE, DECAY = 12, 400, 0.02, 1e-4
SMOOTH = 5.0  #: Documents added to a word's counts.
LINE = 0.7
SLICES = 16  #: Parts in which tasks' sums are added up.
HISTOGRAM = np.linspace(-3, 3, 601)


def added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that tasks yield in SLICES parts (part, blob of float64); size numbers reach the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "blob"])

    got = {r["part"]: np.frombuffer(r["blob"]) for r in rows.repartition(SLICES, "part").mapInArrow(run, "part int, blob binary").collect()}
    edges = np.linspace(0, size, SLICES + 1).astype(int)
    return np.concatenate([got.get(p, np.zeros(b - a)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])


def sliced(total: np.ndarray) -> pa.RecordBatch:
    edges = np.linspace(0, len(total), SLICES + 1).astype(int)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["part", "blob"])


def word_table(docs: DataFrame) -> np.ndarray:
    """2 x places: the weight of each hashed word by either half, from (held_out, pos, text) rows that are not held out."""
    size = 1 << TABLE_BITS

    def run(batches):
        total, rows = np.zeros((2, 2, size)), np.zeros((2, 2))  # half, positive or any
        for batch in batches:
            texts, pos = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            half = np.array([fold((t.as_py() or "").encode()) for t in texts], dtype=np.int64)
            for k in (0, 1):
                rows[k] += (half == k) @ pos, (half == k).sum()
            for i, _, h, row in text_words(texts):
                cell = np.unique(row * size + places(h))  # a word once for each document
                of, at = i + cell // size, cell % size
                for k in (0, 1):
                    own = half[of] == k
                    total[k, 1] += np.bincount(at[own], minlength=size)
                    total[k, 0] += np.bincount(at[own & pos[of]], minlength=size)
        yield sliced(np.concatenate((total.reshape(-1), rows.reshape(-1))))

    got = added(docs.where("not held_out").select("pos", "text").mapInArrow(run, "part int, blob binary"), 4 * size + 4)
    count, rows = got[: 4 * size].reshape(2, 2, size), got[4 * size :].reshape(2, 2)
    rate = [(count[:, k] + SMOOTH) / (rows[:, k, None] + 2 * SMOOTH) for k in (0, 1)]
    return np.where(count[:, 1] > 0, np.log(rate[0] / rate[1]), 0.0)  # an unseen word weighs nothing


class Model:
    """Additive weights over bins of each number, and the line that makes their sum a probability."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.base = np.concatenate(([0], np.cumsum([len(e) + 1 for e in edges])))
        self.w = np.zeros(self.base[-1] + 1)  # the last is the constant
        self.slope, self.shift = 1.0, 0.0

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") + self.base[i] for i, e in enumerate(self.edges)], axis=1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.w)))
        np.put_along_axis(out, self.places(x), 1.0, axis=1)
        out[:, -1] = 1.0
        return out

    def line(self, x: np.ndarray) -> np.ndarray:
        return self.w[self.places(x)].sum(1) + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.line(x) + self.shift)


def quantiles(found: DataFrame) -> list[np.ndarray]:
    """Bin edges of each number over all rows that are not held out."""
    at = [i / BINS for i in range(1, BINS)]
    r = found.where("not held_out").agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 10_000).alias(f"q{i}") for i in range(len(NAMES))]).first()
    return [np.unique(np.array(r[f"q{i}"] or [0.0])) for i in range(len(NAMES))]


def numbers(batch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))


def moments(found: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and second moments of the binned numbers, over the positives and over all rows that are not held out."""
    d = len(model.w)

    def run(batches):
        second = np.zeros((2, d, d))
        for batch in batches:
            x, pos = model.binned(numbers(batch)), batch.column(0).to_numpy(zero_copy_only=False)
            second[1] += x.T @ x
            second[0] += x[pos].T @ x[pos]
        yield sliced(second.reshape(-1))

    got = added(found.where("not held_out").select("pos", "x").mapInArrow(run, "part int, blob binary"), 2 * d * d).reshape(2, d, d)
    (ap, au) = (m / max(1.0, m[-1, -1]) for m in got)  # the constant's own moment is the number of rows
    return ap[-1], ap, au[-1], au


def histograms(found: DataFrame, model: Model) -> np.ndarray:
    """Rows of the positives and of all that are not held out, by their line."""
    n = len(HISTOGRAM) + 1

    def run(batches):
        total = np.zeros((2, n))
        for batch in batches:
            at, pos = np.searchsorted(HISTOGRAM, model.line(numbers(batch))), batch.column(0).to_numpy(zero_copy_only=False)
            total += np.bincount(at[pos], minlength=n), np.bincount(at, minlength=n)
        yield sliced(total.reshape(-1))

    return added(found.where("not held_out").select("pos", "x").mapInArrow(run, "part int, blob binary"), 2 * n).reshape(2, n)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least ratio of the unlabelled rows' to the positives' share above a score, over scores that leave nine tenths of the positives.

    Further up the ratio tells how well the model knows its own positives.
    """
    p, u = (np.cumsum(x[::-1]) / max(1.0, x.sum()) for x in (pos, unl))
    some = slice(int((p >= 0.9).argmax()), int((p >= 0.98).argmax()) + 1)
    return float(min(0.999, max(0.01, (u[some] / np.maximum(p[some], 1e-9)).min())))


def risk_weights(bp, ap, bu, au, prior: float) -> np.ndarray:
    """The weights of least non-negative risk with squared loss, from the moments."""
    d = len(bp)
    w = np.linalg.solve(0.5 * au + DECAY * np.eye(d), prior * bp - 0.5 * bu)
    second = lambda a, b, w: (1 + 2 * w @ b + w @ a @ w) / 4  # mean of (1 + line)**2 / 4
    opt = Adam(d, RATE)
    for _ in range(STEPS):
        bad = second(au, bu, w) - prior * second(ap, bp, w)
        if bad >= 0:
            break
        w = w - opt.step(0.5 * (bu + au @ w) - prior * 0.5 * (bp + ap @ w))  # against the negative part
    return w


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of least non-negative logistic risk over the histograms."""
    z = np.concatenate((HISTOGRAM[:1], (HISTOGRAM[1:] + HISTOGRAM[:-1]) / 2, HISTOGRAM[-1:]))
    p, u = pos / max(1.0, pos.sum()), unl / max(1.0, unl.sum())
    theta, opt = np.array([4.0, 0.0]), Adam(2, 0.05)
    for _ in range(STEPS):
        s = sigmoid(theta[0] * z + theta[1])
        bad = (u - prior * p) @ -np.log(1 - s + 1e-12)
        slope = lambda g: np.array([g @ z, g.sum()])  # noqa: B023, E731
        theta = theta + opt.step(prior * slope(p * (s - 1)) + (1 if bad >= 0 else -1) * slope((u - prior * p) * s) + 1e-4 * theta)
    return float(max(theta[0], 0.0)), float(theta[1])


def fit(found: DataFrame) -> tuple[Model, float]:
    """The model and the class prior, from the numbers (pos, x) of all rows that are not held out."""
    model = Model(quantiles(found))
    bp, ap, bu, au = moments(found, model)
    model.w = np.linalg.solve(ap + au + DECAY * np.eye(len(bp)), bp - bu)
    prior = class_prior(*histograms(found, model))
    model.w = risk_weights(bp, ap, bu, au, prior)
    model.slope, model.shift = calibrate(*histograms(found, model), prior)
    return model, prior


def measure(docs: DataFrame, labels: DataFrame, rows: int = POSITIVES) -> DataFrame | None:
    """The numbers of every document, with pos for the trusted positives; None without any."""
    good = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select(F.col("doc_id").cast("long").alias("_good")).distinct()
    luck = F.pmod(F.xxhash64("_good", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    good = written(good.where(F.col("_good").isNotNull() & (luck < min(1.0, rows / max(1, good.count())))), "positives")
    n = good.count()
    if not n:
        return None
    near = F.broadcast if n <= 2 * rows else lambda x: x
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    base = base.join(near(good), F.col("doc_id") == F.col("_good"), "left").select("doc_id", "held_out", F.col("_good").isNotNull().alias("pos"), "text")
    return written(features(base, word_table(base)), "form")


def scores(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted from numbers."""
    held = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = held.value.score(batch.column(2).flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= LINE).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    found = measure(docs, labels)
    if found is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    return scores(found, fit(found)[0])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
