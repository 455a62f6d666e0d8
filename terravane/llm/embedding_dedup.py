"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A vector is normalised and rotated by a seeded random rotation; its code is the signs of the result, and its
stored factor f is the inner product of the code's own unit vector with it. For another rotated vector q,
<code, q> / f is an unbiased estimate of the inner product, and lies within EPSILON * sqrt((1 - f*f) /
(f*f * (D - 1))) of it but for a vanishing share of rotations. q is held as PLANES bit planes of dithered
numbers, which adds an error of no bias, so the estimate is made of ANDs and bit counts. A pair whose upper
bound is under the threshold is done; the others are recomputed exactly, in double precision, so no link is
below the threshold.

Pairs are looked for in bands of code bits of further rotations. With b bits a band, two vectors at the
threshold share a band with probability (1 - angle / pi)**b; b grows with the logarithm of the number of
vectors, so buckets stay small, and the number of bands is what recall TARGET asks. What is dealt to the
buckets is codes; a pair counts in the first band it shares, and only members that are left with an open pair
there are sent once more, with their vectors. A bucket of more than BLOCK members is dealt as pairs of blocks,
every pair of blocks in one task, so no bucket is cut off and none is held whole. Pairs stay inside a task: it
sends each vector's number of links and the least vector it reaches there.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null
vec_id, link with nothing; vectors of different length do not link; identical vectors are one class with a
multiplicity. Of a vec_id that repeats with different vectors the one of greatest hash
stands for all its rows; rows that repeat id and vector each count as a vector. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, parts, prepare, written
from .components import connected_components

THRESHOLD, TARGET, EPSILON = 0.95, 0.998, 4.0
BUCKET, BLOCK = 24, 2048
PLANES = 4  #: Bit planes of a query's quantised coordinates.
PAIR_WORDS = 1 << 20  #: Words of code bits compared at once.
SEED = 991


def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation, the same everywhere for the same dimension and number."""
    if (dim, number) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng((SEED, dim, number)).standard_normal((dim, dim)))
        _ROTATIONS[dim, number] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, number]


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def shape(count: int, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors."""
    bits = max(1, round(math.log2(max(2.0, count / BUCKET))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - target) / math.log(1 - hit))) if hit < 1 else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(out, ((0, 0), (0, -out.shape[1] % 8)))).view(np.uint64)


class Codes:
    """Of unit vectors: sign codes, their factors and bounds, bit planes of the quantised rotated vectors, and band bits."""

    def __init__(self, dim: int, code, planes, numbers, bands):
        self.dim, self.code, self.planes, self.numbers, self.bands = dim, code, planes, numbers, bands
        # factor, least coordinate, step of its quantisation, and sum of the quantised coordinates
        self.factor, self.low, self.step, self.sum = (numbers[:, i].astype(np.float64) for i in range(4))
        self.ones = np.bitwise_count(code).sum(1, dtype=np.int64)

    @classmethod
    def of(cls, v: np.ndarray, bits: int, bands: int) -> Codes:
        dim = v.shape[1]
        r = v @ rotation(dim, 0)
        factor = np.abs(r).sum(1) / math.sqrt(dim)
        low = r.min(1)
        step = np.maximum((r.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
        dither = np.random.default_rng((SEED, dim)).random(dim)
        level = np.clip(np.floor((r - low[:, None]) / step[:, None] + dither), 0, (1 << PLANES) - 1).astype(np.uint8)
        planes = np.stack([packed((level >> p) & 1 > 0) for p in range(PLANES)], axis=1)
        signs = np.concatenate([v @ rotation(dim, n + 1) > 0 for n in range(-(-bits * bands // dim))], axis=1)[:, : bits * bands]
        keys = (signs.reshape(len(v), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.uint32)
        return cls(dim, packed(r > 0), planes, np.stack([factor, low, step, low * dim + step * level.sum(1, dtype=np.int64)], axis=1).astype(np.float32), keys)

    def blobs(self) -> np.ndarray:
        """A row of bytes for each vector."""
        n = len(self.code)
        flat = [x.reshape(n, -1).view(np.uint8) for x in map(np.ascontiguousarray, (self.code, self.planes, self.numbers, self.bands))]
        return np.concatenate(flat, axis=1)

    @classmethod
    def from_blobs(cls, raw: np.ndarray, dim: int) -> Codes:
        words = -(-dim // 64)
        cuts = np.cumsum([8 * words, 8 * words * PLANES, 16])
        a, b, c, d = (np.ascontiguousarray(x) for x in np.split(raw, cuts, axis=1))
        return cls(dim, a.view(np.uint64), b.view(np.uint64).reshape(len(raw), PLANES, words), c.view(np.float32), d.view(np.uint32))

    def upper(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of i and j, and the half widths of their bounds."""
        both = np.bitwise_count(self.code[i][:, None, :] & self.planes[j]).sum(2, dtype=np.int64) @ (1 << np.arange(PLANES))
        root, f = math.sqrt(self.dim), self.factor[i]
        est = (2 * (self.low[j] * self.ones[i] + self.step[j] * both) - self.sum[j]) / root / f
        width = np.sqrt(np.maximum(0.0, 1 - f * f) / (f * f * max(1, self.dim - 1))) + self.step[j] / 2 / f
        return est, EPSILON * width

    def open(self, i: np.ndarray, j: np.ndarray, band: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs need their vectors: the upper bound reaches the threshold, and this is the first band they share."""
        est, width = self.upper(i, j)
        at = np.flatnonzero(est + width >= threshold)
        return at[(self.bands[i[at]] == self.bands[j[at]]).argmax(1) == band[i[at]]]


def near_runs(lo: np.ndarray, hi: np.ndarray, words: int):
    """Index pairs (i, j), lo[i] <= j < hi[i], in slices of about PAIR_WORDS words of codes."""
    n = np.maximum(hi - lo, 0)
    total = np.cumsum(n)
    most, i = max(1, PAIR_WORDS // words), 0
    while i < len(n):
        e = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        c = n[i:e]
        a = np.repeat(np.arange(i, e), c)
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + lo[a]
        i = e


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index each of n reaches by the pairs."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def vectors_of(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


ROW = "key long, band int, dim int, rep long, blob binary"


def banded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """A row for each vector and band with its codes; key is a hash of dimension, band and the band's bits."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            dims = np.array([len(x) for x in vectors])
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                codes = Codes.of(unit(vectors_of(vectors.take(at), int(dim))), bits, bands)
                rep, raw = batch.column(0).take(at), codes.blobs()
                blob = pa.array([x.tobytes() for x in raw], pa.binary())
                for b in range(bands):
                    n = len(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.bands[:, b].astype(np.int64)), pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, dim, np.int32)), rep, blob], ["key", "band", "dim", "rep", "blob"])

    return classes.select("rep", "vector").mapInArrow(run, ROW).withColumn("key", F.xxhash64("dim", "band", "key"))


def by_group(batches, names):
    """Tables of whole groups (equal names) of sorted batches, each of as many groups as a batch completes."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = [held.column(c).to_numpy() for c in names]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        if len(cut):
            yield held.slice(0, cut[-1] + 1).combine_chunks()
            held = held.slice(cut[-1] + 1).combine_chunks()
    if held is not None:
        yield held


GROUP = ["dim", "key", "bi", "bj"]


def partners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a table sorted by GROUP and block the range of rows it is compared with."""
    cols = [table.column(c).to_numpy() for c in (*GROUP, "block")]
    new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    group = np.cumsum(new) - 1
    cross = cols[2] != cols[3]
    lo, hi = np.arange(len(new)) + 1, ends[group]
    left = cross & (cols[4] == cols[2])
    size = np.bincount(group[left], minlength=len(starts))
    lo = np.where(left, starts[group] + size[group], lo)
    return lo, np.where(cross & ~left, 0, hi)


OPEN = "dim int, key long, band int, bi int, bj int, block int, rep long"


def open_members(rows: DataFrame, threshold: float) -> DataFrame:
    """Members of groups (rows sorted by GROUP, block) that are left with an open pair there."""

    def run(batches):
        for table in by_group(batches, GROUP):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = table.filter(pa.array(dims == dim)).combine_chunks()
                blob = t.column("blob").combine_chunks()
                raw = np.frombuffer(blob.buffers()[2], np.uint8)[np.frombuffer(blob.buffers()[1], np.int32)[blob.offset] :]
                codes = Codes.from_blobs(raw[: len(t) * len(blob[0].as_py())].reshape(len(t), -1), int(dim))
                band, some = t.column("band").to_numpy(), np.zeros(len(t), bool)
                for i, j in near_runs(*partners(t), codes.code.shape[1] * PLANES):
                    at = codes.open(i, j, band, threshold)
                    some[i[at]] = some[j[at]] = True
                if some.any():
                    yield from t.select([c.split()[0] for c in OPEN.split(", ")]).filter(pa.array(some)).to_batches()

    names = [*GROUP, "band", "block", "rep", "blob"]
    return rows.select(*names).sortWithinPartitions(*GROUP, "block").mapInArrow(run, OPEN)


def links_of(rows: DataFrame, bits: int, bands: int, threshold: float) -> DataFrame:
    """(rep, links, least) of each vector for each group that has links of it; rows sorted by GROUP, block, with their vectors."""

    def run(batches):
        for table in by_group(batches, GROUP):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = table.filter(pa.array(dims == dim)).combine_chunks()
                v = unit(vectors_of(t.column("vector").combine_chunks(), int(dim)))
                codes, band = Codes.of(v, bits, bands), t.column("band").to_numpy()
                rep, weight = t.column("rep").to_numpy(), t.column("weight").to_numpy()
                links, label = np.zeros(len(t), np.int64), [[], []]
                for i, j in near_runs(*partners(t), max(1, codes.code.shape[1] * PLANES)):
                    at = codes.open(i, j, band, threshold)
                    i, j = i[at], j[at]
                    ok = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
                    i, j = i[ok], j[ok]
                    links += np.bincount(i, weight[j], len(t)).astype(np.int64) + np.bincount(j, weight[i], len(t)).astype(np.int64)
                    low = least_reached(len(t), i, j)  # a forest instead of all pairs
                    up = np.flatnonzero(low != np.arange(len(t)))
                    label[0].append(up)
                    label[1].append(low[up])
                some = np.flatnonzero(links)
                if len(some):
                    order = np.lexsort((rep, np.zeros(len(t))))
                    place = np.empty(len(t), np.int64)
                    place[order] = np.arange(len(t))
                    least = rep[order][least_reached(len(t), place[np.concatenate(label[0])], place[np.concatenate(label[1])])[place]]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(least[some])], ["rep", "links", "least"])

    return rows.select(*GROUP, "band", "block", "rep", "weight", "vector").sortWithinPartitions(*GROUP, "block").mapInArrow(run, "rep long, links long, least long")


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    prepare(spark)
    n = parts(spark)
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    plain = F.transform(e, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), fine.alias("fine"), plain.alias("plain"))
    hashed = rows.select("vec_id", F.when(F.col("fine"), F.xxhash64("plain")).alias("h1"), F.when(F.col("fine"), F.xxhash64(F.lit(7), "plain")).alias("h2"), "embedding")
    keyed = written(hashed.select("vec_id", "h1", "h2"), "vectors")
    ends = [f(F.struct("h1", "h2")).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    twice = written(keyed.where("h1 is not null").groupBy("vec_id").agg(*ends).where("lo <> hi").drop("lo"), "twice")
    if not twice.isEmpty():  # ids with several vectors: that of greatest hash stands for them
        own = F.col("hi").isNull() | (F.struct("h1", "h2") == F.col("hi"))
        lead = [F.coalesce(F.col(f"hi.{c}"), c).alias(c) for c in ("h1", "h2")]
        hashed = hashed.join(twice, "vec_id", "left").select("vec_id", F.when(F.col("h1").isNotNull(), lead[0]).alias("h1"), F.when(F.col("h1").isNotNull(), lead[1]).alias("h2"), F.when(own, F.col("embedding")).alias("embedding"))
        keyed = written(hashed.select("vec_id", "h1", "h2"), "vectors")
        hashed = hashed.where("embedding is not null")
    classes = hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min_by("embedding", "vec_id").cast("array<double>").alias("vector"))
    classes = written(classes, "classes")
    bits, bands = shape(classes.count(), threshold)
    rows = written(banded(classes, bits, bands), "bands")
    large = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "large")
    few = F.broadcast if large.count() <= 100_000 else lambda x: x  # a bucket in BLOCK rows at most
    one = lambda name: F.lit(0).alias(name)
    cold = rows.join(few(large), "key", "left_anti").select("*", one("bi"), one("bj"), one("block")).repartition(n, "key")
    hot = rows.join(few(large), "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    left = open_members(cold, threshold)
    if not large.isEmpty():
        left = left.unionByName(open_members(hot.repartition(n, "key", "bi", "bj"), threshold))
    left = written(left, "open")
    discard(rows)
    asked = left.join(classes.select("rep", "weight", "vector"), "rep").repartition(n, "key", "bi", "bj")
    found = written(links_of(asked, bits, bands, threshold), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    named = classes.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("least")), "named")
    discard(left, large, found, classes)
    out = keyed.join(named, ["h1", "h2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: All pairs, brute force; for small tables.
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, embedding, [coalesce(x::DOUBLE, 0.0) for x in embedding] AS e FROM embeddings),
v1 AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v1 x JOIN v1 y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE x.n > 0 AND y.n > 0 AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
r AS (SELECT vec_id, vec_id AS o FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY ALL),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY ALL)
SELECT vec_id, coalesce(d.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
