"""Nearest neighbours by cosine, and semantic edges.

All-pairs search runs over blocks: vectors are dealt into blocks, each pair of blocks meets in one task as two
matrices, and a task returns the k best of each row only; a window merges the k best of all blocks. Neither
pairs nor a whole side are ever in one place. A side has 16 blocks up to a million rows, so what is shuffled grows with
the rows; the arithmetic is that of all pairs. Where all rows are compared among themselves (own_knn), blocks and tasks
are the points and lines of a projective plane: 57 blocks, eight of which meet in each of 57 tasks, any two in just one.
A row goes to eight tasks, and a pair's cosine serves both its rows.
"""

from __future__ import annotations

import copy
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values as V
from ..functions.vectors import cosine, l2_normalize, norm
from .checkpoints import cut as cut_lineage
from .graph import numbered

BLOCK_ROWS = 2048
SIDE_BLOCKS, MOST_ROWS, MOST_PARTS = 16, 65536, 2000
ONE, NONE = 1_000_001, (1 << 21) - 1  #: In keys of partners: what a cosine's millionths are taken from, and no partner.
TILE = 2048  #: Rows of a side whose cosines are held at a time.
BUCKET_ROWS = 16384  #: Rows of a bucket, or of several small ones, that meet in a task of approximate_knn.


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id") -> DataFrame:
    """id, similarity of the k vectors nearest to one query, JVM-side; a take-ordered per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col("vector"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def blocks(rows: int) -> int:
    """A side of all-pairs search has SIDE_BLOCKS blocks, but for few rows (blocks of BLOCK_ROWS) and very many (of MOST_ROWS)."""
    size = min(MOST_ROWS, max(BLOCK_ROWS, -(-rows // SIDE_BLOCKS)))
    return max(1, -(-rows // size))


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.tolist()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray, other: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and their cosines to six places: the k greatest of each row of x, of equal ones the first rows of y.

    x and y are of unit length; rows with ids that are equal (own, other) are left out if same. Cosines in single precision, with
    more room than their error, leave out what cannot be among the best so far; what stays is worked out in double precision.
    """
    room = np.float32(2e-6 + 2.5e-7 * x.shape[1])
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    out = []
    for r in range(0, len(x), 1024):
        xa, xa32, ids = x[r : r + 1024], x32[r : r + 1024], own[r : r + 1024]
        i, j, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = np.full(len(xa), -np.inf, np.float32)
        for c in range(0, len(y), 4096):
            rough = xa32 @ y32[c : c + 4096].T
            if c == 0 and k < rough.shape[1]:  # k and itself
                least = np.partition(rough, rough.shape[1] - k - 1, axis=1)[:, -k - 1] - room
            a, b = np.divmod(np.flatnonzero(rough >= least[:, None]), rough.shape[1])
            if not len(a):
                continue
            if 8 * len(a) > rough.size:  # many that are as good: all are worked out
                exact = np.round(xa @ y[c : c + 4096].T, 6)
                if same:
                    exact[ids[:, None] == other[None, c : c + 4096]] = -np.inf
                b = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                a, v = np.repeat(np.arange(len(xa)), b.shape[1]), np.take_along_axis(exact, b, 1).reshape(-1)
                b = b.reshape(-1)
            else:
                v = np.concatenate([np.einsum("ij,ij->i", xa[a[n : n + 65536]], y[c + b[n : n + 65536]]) for n in range(0, len(a), 65536)])
                v = np.round(v, 6)
            keep = np.isfinite(v) & ((ids[a] != other[c + b]) if same else True)
            i, j, sim = np.concatenate([i, a[keep]]), np.concatenate([j, c + b[keep]]), np.concatenate([sim, v[keep]])
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, sim, place = i[place < k], j[place < k], sim[place < k], place[place < k]
            full = i[place == k - 1]
            worst = sim[place == k - 1]
            least[full] = np.where(worst >= 1, np.inf, worst - room)  # rows of y come in order: nothing later is before a cosine of one
        out.append((i + r, j, sim))
    return tuple(np.concatenate(part) for part in zip(*out))


def best_of(a: pd.DataFrame, b: pd.DataFrame, k: int, same: bool) -> pd.DataFrame | None:
    """query_id, id, similarity: of rows (id, vector) of a, the k nearest of b."""
    if not len(a) or not len(b):
        return None
    b = b.sort_values("id")
    (x, own), (y, other) = ((unit(f["vector"]), f["id"].to_numpy()) for f in (a, b))
    (x, own), (y, other) = ((m[fine], ids[fine]) for m, ids in ((x, own), (y, other)) for fine in [np.isfinite(m).all(axis=1)])
    if not len(x) or not len(y):
        return None
    i, j, sim = nearest(x, y, k, own, other, same)
    return pd.DataFrame({"query_id": own[i], "id": other[j], "similarity": sim})


def marked(mask: np.ndarray) -> np.ndarray:
    """Flat places of what holds in a matrix of which little does, looked through eight at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


class Best:
    """The k best partners of each of n rows so far, of m: whole numbers of the cosine to six places, greatest first, and the partner's number."""

    def __init__(self, n: int, m: int, k: int, room: float):
        self.bits = m.bit_length()
        self.keys, self.k, self.room = np.full((n, k), NONE << self.bits), k, room
        self.least = np.full(n, -np.inf, np.float32)  #: what a rough cosine must reach
        self.ones = np.full(n, m)  #: the number of the last partner where all have a cosine of one

    def part(self, rows: slice) -> Best:
        """Of some rows; what is added to it is added to the whole."""
        some = copy.copy(self)
        some.keys, some.least, some.ones = self.keys[rows], self.least[rows], self.ones[rows]
        return some

    def bound(self, rows: slice, first: int) -> np.ndarray:
        """What rough cosines to partners numbered from first on must reach; after partners at a cosine of one, no later one is taken."""
        return np.where(self.ones[rows] < first, np.float32(np.inf), self.least[rows])

    def add(self, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
        """Number j as a partner of row i at cosine v."""
        if not len(i):
            return
        whole = self.bits + NONE.bit_length()
        both = np.sort(i << whole | (ONE - np.rint(v * 1e6).astype(np.int64)) << self.bits | j)
        i = both >> whole
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rows, group = i[start], np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(i)]))
        place = np.arange(len(i)) - start[group]
        few = place < self.k
        keys = np.full((len(rows), 2 * self.k), NONE << self.bits)
        keys[:, : self.k] = self.keys[rows]
        keys[group[few], self.k + place[few]] = both[few] & (1 << whole) - 1
        keys.sort(axis=1)
        self.keys[rows] = keys[:, : self.k]
        worst = keys[:, self.k - 1] >> self.bits
        bound = np.where(worst == NONE, -np.inf, (ONE - worst) / 1e6 - self.room)
        self.least[rows] = np.maximum(self.least[rows], bound)
        ones = np.flatnonzero(worst <= 1)
        self.ones[rows[ones]] = keys[ones, self.k - 1] & (1 << self.bits) - 1

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, n = np.nonzero(self.keys >> self.bits != NONE)
        key = self.keys[i, n]
        return i, key & (1 << self.bits) - 1, (ONE - (key >> self.bits)) / 1e6


def bounded(rough: np.ndarray, own: np.ndarray, other: np.ndarray, best: Best, rows: slice) -> None:
    """A first bound of rows that have none: their k-th cosine to some of the others."""
    few = max(512, 8 * best.k)
    if best.k <= min(few, rough.shape[1]) and np.isneginf(best.least[rows]).any():
        some = np.where(own[:, None] == other[None, :few], -np.inf, rough[:, :few])
        best.least[rows] = np.maximum(best.least[rows], np.partition(some, some.shape[1] - best.k, axis=1)[:, -best.k] - np.float32(best.room))


def firsts(exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k greatest finite values to six places, the first of equal ones: rows, columns, values."""
    n = exact.shape[1]
    key = np.where(np.isneginf(exact), 2.0**40, np.rint(exact * -1e6)).astype(np.int64) * n + np.arange(n)
    key = key if k >= n else np.partition(key, k - 1, axis=1)[:, :k]
    i, c = np.nonzero(key < 2**39 * n)
    value, j = np.divmod(key[i, c], n)
    return i, j, -value / 1e6


def room_for(dimensions: int) -> float:
    """More than a rough cosine may be off."""
    return 2e-6 + 2.5e-7 * dimensions


def nearest_both(x: np.ndarray, y: np.ndarray | None, k: int, own: np.ndarray, other: np.ndarray | None, sofar: tuple | None = None) -> list[Best]:
    """As nearest() of x among y and of y among x, without rows of one id; each pair's rough cosine is worked out once. Without y, of x among itself.

    sofar, to go on after other rows: the best of x and of y, and the rising numbers of their rows.
    """
    alone, x32 = y is None, x.astype(np.float32)
    y, y32, other = (x, x32, own) if alone else (y, y.astype(np.float32), other)
    if sofar is None:
        bx = Best(len(x), len(y), k, room_for(x.shape[1]))
        sofar = bx, bx if alone else Best(len(y), len(x), k, bx.room), np.arange(len(x)), np.arange(len(y))
    bx, by, xn, yn = sofar
    cells = min(TILE, len(x)) * min(TILE, len(y))
    held, hits = np.empty(cells, np.float32), np.empty(cells, bool)
    for r in range(0, len(x), TILE):
        xa, ids, rows = x[r : r + TILE], own[r : r + TILE], slice(r, r + TILE)
        for c in range(r if alone else 0, len(y), TILE):
            yb, others, cols = y[c : c + TILE], other[c : c + TILE], slice(c, c + TILE)
            twice = not (alone and c == r)  # else the square holds each pair both ways
            rough = np.matmul(x32[rows], y32[cols].T, out=held[: len(xa) * len(yb)].reshape(len(xa), len(yb)))
            mask = hits[: rough.size].reshape(rough.shape)
            bounded(rough, ids, others, bx, rows)
            if twice:
                bounded(rough.T, others, ids, by, cols)
            lx, ly = bx.bound(rows, yn[c]), by.bound(cols, xn[r]) if twice else np.full(len(yb), np.inf, np.float32)
            at = marked(np.greater_equal(rough, min(lx.min(), ly.min()), out=mask))
            if len(at) > rough.size // 64:  # one bound for all leaves too much
                at = marked(np.logical_or(rough >= lx[:, None], rough >= ly[None, :], out=mask))
            if 8 * len(at) > rough.size:  # many that are as good: all are worked out
                exact = xa @ yb.T
                exact[ids[:, None] == others[None, :]] = -np.inf
                i, j, v = firsts(exact, k)
                bx.add(r + i, yn[c + j], v)
                if twice:
                    j, i, v = firsts(np.ascontiguousarray(exact.T), k)
                    by.add(c + j, xn[r + i], v)
                continue
            i, j = np.divmod(at, rough.shape[1])
            near = rough.reshape(-1)[at]
            fits = (near >= lx[i], near >= ly[j])
            wanted = (fits[0] | fits[1]) & (ids[i] != others[j])
            i, j, fits = i[wanted], j[wanted], [f[wanted] for f in fits]
            v = [np.einsum("ij,ij->i", xa[i[n : n + 65536]], yb[j[n : n + 65536]]) for n in range(0, len(i), 65536)]
            v = np.concatenate(v) if v else np.empty(0)
            bx.add(r + i[fits[0]], yn[c + j[fits[0]]], v[fits[0]])
            if twice:
                by.add(c + j[fits[1]], xn[r + i[fits[1]]], v[fits[1]])
    return [bx] if alone else [bx, by]


def best_of_line(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, off, id: of the rows (id, place, vector) of a line the k best among all its blocks but their own; the first block's also among itself.

    off and id are lists, best first; off is in millionths, from a cosine of ONE.
    """
    frame = frame.sort_values(["place", "id"], kind="stable")
    x = unit(frame["vector"])
    fine = np.isfinite(x).all(axis=1)
    x, ids, place = x[fine], frame["id"].to_numpy()[fine], frame["place"].to_numpy()[fine]
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    best = Best(len(x), len(x), k, room_for(x.shape[1]))
    blocks_at = [(p, slice(*np.searchsorted(place, [p, p + 1]))) for p in np.unique(place)]
    for n, (p, a) in enumerate(blocks_at):
        for q, b in blocks_at[n:]:
            mine = best.part(a)
            if q > p:
                nearest_both(x[a], x[b], k, ids[a], ids[b], (mine, best.part(b), number[a], number[b]))
            elif p == 0:
                nearest_both(x[a], None, k, ids[a], None, (mine, mine, number[a], number[a]))
    off, partner = best.keys >> best.bits, ids[order[np.minimum(best.keys & (1 << best.bits) - 1, len(ids) - 1)]] if len(ids) else best.keys
    count = (off != NONE).sum(axis=1)
    some = np.flatnonzero(count)
    lists = lambda m: [m[i, : count[i]] for i in some]
    return pd.DataFrame({"query_id": ids[some], "off": pd.Series(lists(off.astype(np.int32)), dtype=object), "id": pd.Series(lists(partner), dtype=object)})


def difference_set(q: int) -> list[int]:
    """q + 1 numbers below n = q * q + q + 1, 0 among them, whose differences mod n are all of 1 to n - 1 once each; q is a prime."""
    n = q * q + q + 1
    for a, b, c in product(range(q), repeat=3):  # where a recurrence of full period is zero (Singer)
        s, zeros = (0, 0, 1), []
        for i in range(n):
            if s[0] == 0:
                zeros.append(i)
            s = s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q
        if len(zeros) == q + 1 and len({(x - y) % n for x in zeros for y in zeros}) == n:
            return zeros
    raise ValueError(f"{q} is not a prime")


def lines(rows: int) -> tuple[int, list[int]]:
    """n blocks and d: line i holds the blocks i + d mod n. Any two blocks are on one line, and block i is the first of line i alone.

    A line has eight of 57 blocks, but for few rows (one block; three of seven) and very many (where eight would be over 2 * MOST_ROWS).
    """
    if rows <= BLOCK_ROWS:
        return 1, [0]
    q = 2 if rows <= 4 * BLOCK_ROWS else 7
    while rows * (q + 1) > 2 * MOST_ROWS * (q * q + q + 1):
        q = next(m for m in range(q + 1, 2 * q + 1) if all(m % i for i in range(2, m)))
    return q * q + q + 1, difference_set(q)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def all_knn(queries: DataFrame, vectors: DataFrame, k: int, same: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest vectors (id, vector) of every query (query_id, vector), itself left out if same."""
    nq, nv = blocks(queries.count()), blocks(vectors.count())
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    queries, vectors = queries.repartition("query_id"), vectors.repartition("id")  # copies are made in many tasks, whatever the files
    q = queries.select(number("query_id", nq).alias("qb"), other(nv).alias("vb"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("vector").cast("array<double>"))
    v = vectors.select(other(nq).alias("qb"), number("id", nv).alias("vb"), F.lit(1).alias("side"), "id", F.col("vector").cast("array<double>"))
    kind = dict(queries.dtypes)["query_id"]

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        found = best_of(frame[frame["side"] == 0], frame[frame["side"] == 1], k, same)
        return pd.DataFrame({"query_id": [], "id": [], "similarity": []}) if found is None else found

    dealt = q.unionByName(v).repartition(min(MOST_PARTS, 3 * nq * nv), "qb", "vb")
    return ranked(dealt.groupBy("qb", "vb").applyInPandas(best, f"query_id {kind}, id {kind}, similarity double"), k)


def own_knn(vectors: DataFrame, k: int) -> DataFrame:
    """As all_knn of all vectors (id, vector) among themselves, each left out of its own: two rows meet once, for both."""
    n, places = lines(vectors.count())
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    single = isinstance(vectors.schema["vector"].dataType.elementType, T.FloatType)  # moved as they are, and made double in the tasks
    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    dealt = vectors.repartition("id").select("id", vector.alias("vector"), F.posexplode(F.array(*map(F.lit, places))).alias("place", "step"))
    dealt = dealt.select(F.pmod(own - F.col("step"), F.lit(n)).alias("line"), "place", "id", "vector")
    dealt = dealt.repartitionById(n, F.col("line")).drop("line")  # a line a task: hashes would put two in one
    kind = dict(vectors.dtypes)["id"]

    def best(frames):
        if frames := [f for f in frames if len(f)]:
            yield best_of_line(pd.concat(frames, ignore_index=True), k)

    found = dealt.mapInPandas(best, f"query_id {kind}, off array<int>, id array<{kind}>")
    # A row's lists of partners come together once, as lists.
    merged = found.repartition("query_id").groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("off", "id"))).alias("found"))
    best = merged.select("query_id", F.posexplode(F.slice(F.array_sort("found"), 1, k)).alias("n", "at"))
    return best.select("query_id", F.col("at.id").alias("id"), ((F.lit(ONE) - F.col("at.off")) / F.lit(1e6)).alias("similarity"), (F.col("n") + 1).alias("rank"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """a < b that are among each other's neighbours, with their similarity."""
    n = neighbours.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity")
    return n.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("similarity")).where("n = 2").drop("n")


def threshold(neighbours: DataFrame, floor: float = 0.55, share: float = 0.85) -> DataFrame:
    """One row: the median of the best similarities and the threshold derived from it."""
    best = neighbours.groupBy("query_id").agg(F.max("similarity").alias("best"))
    at = numbered(best.where("best is not null"), F.col("best").asc())  # the middle is found by place, not gathered in one task
    n = at.count()
    middle = at.where(F.col("number").isin((n - 1) // 2, n // 2)).agg(F.avg("best").alias("m"))
    row = middle.select(F.round("m", 6).alias("median_best"))
    return row.withColumn("threshold", F.round(F.greatest(F.lit(floor), F.lit(share) * F.coalesce("median_best", F.lit(0.0))), 6))


def semantic_edges(neighbours: DataFrame, nodes: int, cut: float, degree: int = 8, budget: float = 0.6, bonus: float = 0.01) -> DataFrame:
    """source, target, similarity: candidates over cut, mutual ones favoured, taken greedily under a degree cap at both ends and a budget.

    A pass over all pairs from best to worst would end with the budget. So the best pairs are decided first, whole
    thousandths of the score at a time and twice as many as the budget has room for, then the next ones, until it is used up.
    """
    want = max(1, int(budget * nodes))
    pairs = neighbours.where(F.col("similarity") >= cut).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity")
    pairs = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("a", "b", "similarity", (F.col("similarity") + F.when(F.col("n") == 2, bonus).otherwise(0.0)).alias("score"))
    pairs = cut_lineage(pairs.withColumn("step", F.floor(F.col("score") * 1000)), "pairs")
    steps = sorted(pairs.groupBy("step").count().collect(), reverse=True)  # two thousand at most, as cosines are
    order = (F.desc("score"), F.asc("a"), F.asc("b"))
    taken, got = pairs.drop("step").limit(0), 0
    while steps and got < want:
        some, rows = [], 0
        while steps and rows < 2 * (want - got):
            step, n = steps.pop(0)
            some, rows = [*some, step], rows + n
        left = pairs.where(F.col("step").between(some[-1], some[0])).drop("step")
        won = greedy(held_by(left, taken) if got else left, degree, order)
        taken = won.union(taken) if got else won
        got += won.count()
    return taken.orderBy(*order).limit(want).select(F.col("a").alias("source"), F.col("b").alias("target"), "similarity")


def held_by(pairs: DataFrame, won: DataFrame) -> DataFrame:
    """pairs with held_a and held_b, raised by the pairs that their ends have in won."""
    gain = won.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("gain"))
    none = F.lit(0).cast("long")
    for end in ("a", "b"):
        held = f"held_{end}"
        had = F.col(held) if held in pairs.columns else none
        pairs = pairs.withColumn(held, had).join(gain.withColumnRenamed("node", end), end, "left").withColumn(held, F.col(held) + F.coalesce("gain", none)).drop("gain")
    return pairs


def greedy(pairs: DataFrame, degree: int, order: tuple) -> DataFrame:
    """Of pairs (a, b, similarity, score, and held_a, held_b if their ends have some) those that a pass in order takes under a degree cap.

    The choice is made in rounds over all nodes at once: an undecided pair is taken if it is among the best its
    two ends still have room for, since no better pair can fill that room; a node that is full drops the rest of
    its pairs. The best undecided pair is always taken, so the rounds end, with exactly what a pass over all pairs
    from best to worst takes. Pairs are spread by node; no task holds more than a node's pairs, which are at most
    its neighbours'.
    """
    free = (F.col("held_a") < degree) & (F.col("held_b") < degree)
    plain = ["a", "b", "similarity", "score"]
    left = pairs if "held_a" in pairs.columns else pairs.withColumns({"held_a": F.lit(0).cast("long"), "held_b": F.lit(0).cast("long")})
    left, taken = cut_lineage(left.where(free).select(*plain, "held_a", "held_b"), "undecided"), pairs.select(*plain).limit(0)
    while not left.isEmpty():
        ends = F.array(*[F.struct(F.col(end).alias("node"), F.col(f"held_{end}").alias("held")) for end in ("a", "b")])
        room = F.row_number().over(W.partitionBy("at.node").orderBy(*order)) + F.col("at.held") <= degree
        told = left.withColumn("at", F.explode(ends)).withColumn("room", room).groupBy(*left.columns).agg(F.every("room").alias("take"))
        told = cut_lineage(told, "told")
        won = told.where("take").select(*plain)
        taken = taken.union(won)
        left = cut_lineage(held_by(told.where("not take").drop("take"), won).where(free).select(*left.columns), "undecided")
    return taken


def norm_check(vectors: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """By dimension: vectors, those off unit norm, and the least and greatest norm."""
    n = vectors.select(F.size("vector").alias("dimensions"), norm(F.col("vector")).alias("n"))
    return n.groupBy("dimensions").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.abs(F.col("n") - 1) > tolerance).alias("off_norm"), F.round(F.min("n"), 4).alias("least"), F.round(F.max("n"), 4).alias("greatest"))


def hashing_embedding(text, dimensions: int = 64):
    """A deterministic embedding without a model: signed hashed word counts, normalised; a column expression."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hits = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).alias("i"), F.when(F.pmod(F.xxhash64(F.lit(1), w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(hits, lambda h: h["i"] == d), F.lit(0.0), lambda a, h: a + h["s"]))
    return l2_normalize(raw)


def related(vectors: DataFrame, of, vector: list[float], edges: DataFrame, k: int) -> DataFrame:
    """id, similarity, linked: the k vectors nearest to that of an entity, itself left out, and whether an edge leads to them from it."""
    return linked(knn(vectors.where(F.col("id") != of), vector, k), of, edges)


def linked(near: DataFrame, of, edges: DataFrame) -> DataFrame:
    """near (id, similarity) with linked: whether an edge leads to it from an entity."""
    out = edges.where(F.col("source_id") == of).select(F.col("target_id").alias("id"), F.lit(True).alias("linked")).distinct()
    return near.join(out, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def space_fingerprint(settings: dict) -> str:
    """Hash of the canonical JSON of all that an embedding space depends on."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def without_semantic(edges: DataFrame) -> DataFrame:
    """Edges before semantic ones are worked out anew."""
    return edges.where(F.col("type") != V.SEMANTIC_EDGE_TYPE)


def approximate_knn(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 24, bits: int | None = None, seed: int = 11) -> DataFrame:
    """As all_knn, of the vectors that share a bucket with the query in one of `tables` random-hyperplane tables.

    Work grows with the buckets, not with the square of the vectors; bits grow with the number of vectors. Recall is
    for the caller to measure against all_knn; the rows of a bucket meet in a task, and the best k of each query leave it.
    """
    n = vectors.count()
    first = vectors.select(F.size("vector").alias("d")).first()
    if first is None:
        return all_knn(queries, vectors, k)
    bits = bits or max(1, (n // 64).bit_length())
    planes = np.random.default_rng(seed).standard_normal((tables * bits, first["d"]))

    def keys(frames):
        for frame in frames:
            if len(frame):
                sign = (np.stack(frame["vector"].tolist()) @ planes.T > 0).reshape(len(frame), tables, bits)
                frame["keys"] = list((sign @ (1 << np.arange(bits))) * tables + np.arange(tables))
                yield frame[["id", "vector", "keys"]]

    kind = dict(vectors.dtypes)["id"]
    schema = f"id {kind}, vector array<double>, keys array<long>"
    of = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(keys, schema)
    rows = of(queries.withColumnRenamed("query_id", "id").repartition("id")).withColumn("side", F.lit(0)).unionByName(of(vectors.repartition("id")).withColumn("side", F.lit(1)))
    rows = cut_lineage(rows, "keys").withColumn("key", F.explode("keys")).drop("keys")
    # A bucket of few rows goes with others; one of many is met block by block, as in all_knn.
    large = rows.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("nq"), F.count_if(F.col("side") == 1).alias("nv")).where(F.col("nq") + F.col("nv") > BUCKET_ROWS)
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BUCKET_ROWS)).cast("int")
    large = F.broadcast(cut_lineage(large.select("key", parts("nq").alias("nq"), parts("nv").alias("nv")), "large"))  # a row for BUCKET_ROWS of the table's keys
    bins = max(1, -(-2 * n * tables // BUCKET_ROWS))
    rows = rows.join(large, "key", "left")
    own = lambda c: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    all_ = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    few = rows.where("nq is null").select((-1 - F.pmod(F.xxhash64("key"), F.lit(bins))).alias("bin"), F.lit(0).alias("qb"), F.lit(0).alias("vb"), "key", "side", "id", "vector")
    asks = rows.where("nq is not null and side = 0").select(F.col("key").alias("bin"), own("nq").alias("qb"), F.explode(all_("nv")).alias("vb"), "key", "side", "id", "vector")
    told = rows.where("nq is not null and side = 1").select(F.col("key").alias("bin"), F.explode(all_("nq")).alias("qb"), own("nv").alias("vb"), "key", "side", "id", "vector")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "id"])
        x = unit(frame["vector"])
        fine = np.isfinite(x).all(axis=1)
        x, ids, key, side = x[fine], *(frame[c].to_numpy()[fine] for c in ("id", "key", "side"))
        out = []
        for rows in np.split(np.arange(len(x)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            a, b = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(a) and len(b):
                i, j, sim = nearest(x[a], x[b], k, ids[a], ids[b], True)
                out.append((ids[a][i], ids[b][j], sim))
        return pd.DataFrame(dict(zip(("query_id", "id", "similarity"), map(np.concatenate, zip(*out)) if out else ([], [], []))))

    dealt = few.unionByName(asks).unionByName(told).repartition(min(MOST_PARTS, max(bins, 12)), "bin", "qb", "vb")
    found = dealt.groupBy("bin", "qb", "vb").applyInPandas(best, f"query_id {kind}, id {kind}, similarity double")
    # A vector may be found in several tables; with all of a query's rows together once, nothing moves again.
    return ranked(found.repartition("query_id").groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), k)
