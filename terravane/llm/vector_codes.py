"""Compression of vectors to codes of integer codebooks, each round's nearest entries found in broadcast kd-trees.

A vector's components become integers floor(4096 * x) and are cut into PARTS equal parts. Each part position has a
codebook of up to ENTRIES entries, which starts as that part of the vectors with the smallest ids. A round
broadcasts a kd-tree for each codebook; tasks assign every part to its nearest entry by branch and bound and send
one row of integer sums and counts for each entry and component, which are added up; an entry becomes the floor of
its parts' mean, one that no part chose stays. Every number is an integer, so neither the order of rows nor their
partitions change a result.

A tree's node holds the box of its entries. A node is left out only where its box is farther than the best entry so
far; one that is just as near is visited, as it may hold an entry of the same distance and a lower index, which wins.

What goes to the driver in a round is PARTS * ENTRIES * width sums, whatever the number of vectors. The table is
read anew in each round and never shuffled; after the last, a row of id, label, code and error is written.

Defined results: vectors that are null or hold null or non-finite components are dropped; so are vectors whose length is
not that of most (ties: the longest), and vectors with a component so large that an error might not fit a long
(over 32,000 at 64 components). That length must be a multiple of PARTS, or a ValueError is raised. Rows that repeat an id
are each coded and counted; of an id's different vectors the least is the one that may start a codebook; a null id comes
last. Null labels are equal. A label's sum that exceeds a long is given as the greatest long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, prepare, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 2  #: Entries of a tree's leaf.
MOST = 2**63 - 1


class Tree:
    """A kd-tree over the entries of one codebook: boxes halved across their widest side."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.entries, self.index = entries, np.arange(len(entries)) if index is None else index
        own = entries[self.index]
        self.low, self.high = (own.min(0), own.max(0)) if len(own) else (own.sum(0), own.sum(0))
        wide = self.high - self.low
        self.sides = None
        if len(own) > LEAF and len(wide) and wide.max() > 0:
            order = np.argsort(own[:, wide.argmax()], kind="stable")
            half = len(order) // 2
            self.sides = tuple(Tree(entries, np.sort(self.index[o])) for o in (order[:half], order[half:]))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row of x to the box."""
        return (np.maximum(np.maximum(self.low - x, x - self.high), 0) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of x, the lower index in a tie."""
        best, which = np.full(len(x), MOST), np.full(len(x), len(self.entries))
        self._visit(x, np.arange(len(x)), best, which)
        return which, best

    def _visit(self, x, rows, best, which):
        if not len(rows):
            return
        if self.sides is None:
            for e in self.index:
                d = ((x[rows] - self.entries[e]) ** 2).sum(1)
                wins = (d < best[rows]) | ((d == best[rows]) & (e < which[rows]))
                best[rows[wins]], which[rows[wins]] = d[wins], e
            return
        left, right = self.sides
        bl, br = left.bound(x[rows]), right.bound(x[rows])
        for mine, (near, bn), (far, bf) in ((bl <= br, (left, bl), (right, br)), (bl > br, (right, br), (left, bl))):
            for side, bound in ((near, bn), (far, bf)):
                near_enough = bound[mine] <= best[rows[mine]]  # equal bounds are visited
                side._visit(x, rows[mine][near_enough], best, which)


def most(dim: int) -> int:
    """Integers up to this keep a vector's squared distances within a long."""
    return math.isqrt(MOST // max(1, dim)) // 2


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that are coded, and their vectors' length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    sound = lambda limit: F.coalesce(F.forall("vector", lambda x: F.abs(x.cast("double")) <= limit), F.lit(False))
    sizes = rows.where(sound(1.7976931348623157e308)).groupBy(F.size("vector").alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = first["dim"] if first else 0
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components cannot be cut into {PARTS} equal parts")
    return rows.where(sound((most(dim) - 1) / SCALE) & (F.size("vector") == dim)), dim


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors as rows of PARTS parts of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), PARTS, width)


def first_codebooks(kept: DataFrame, width: int) -> np.ndarray:
    """(PARTS, entries, width): the parts of the vectors of the smallest ids."""
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    if not ids:
        return np.zeros((PARTS, 0, width), np.int64)
    own = F.col("vec_id").isin([i for i in ids if i is not None])
    own = own | F.col("vec_id").isNull() if None in ids else own
    rows = kept.where(own).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("vec_id")).collect()
    return np.floor(SCALE * np.array([r["vector"] for r in rows], np.float64)).astype(np.int64).reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def assigned(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of each row."""
    found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    spark, (_, entries, width) = kept.sparkSession, books.shape
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])

    def add(batches):
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            x = integers(batch.column(0), width)
            which, _ = assigned(trees.value, x)
            for p in range(PARTS):
                count[p] += np.bincount(which[:, p], minlength=entries)
                np.add.at(total[p], which[:, p], x[:, p])
        p, e, i = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
        used = count[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in (p, e, i, count[p, e], total.ravel())], ["part", "entry", "place", "n", "total"])

    sums = kept.select("vector").mapInArrow(add, "part int, entry int, place int, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in sums.collect():  # PARTS * ENTRIES * width rows at most
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    trees.unpersist()
    return out


def fitted(kept: DataFrame, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds, as (PARTS, entries, width)."""
    books = first_codebooks(kept, dim // PARTS)
    for _ in range(rounds if books.size else 0):
        books = moved(kept, books)
    return books


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (bytes, an entry's index for each part) and error of every row."""
    trees = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    width = books.shape[2]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            which, far = assigned(trees.value, integers(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.tobytes() for w in which.astype(np.uint8)], pa.binary()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error) with label_error, the sum over equal labels, nulls together.

    Sums are combined before the shuffle. Labels that hold more than an eighth of a shuffle partition's rows, 8 times
    the number of partitions at most, are looked up by broadcast; the others are joined by shuffle.
    """
    spark = rows.sparkSession
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    line = max(1, (sums.agg(F.sum("n")).first()[0] or 0) // (8 * parts(spark)))
    first = rows.join(F.broadcast(sums.where(F.col("n") > line)), F.col("label").eqNullSafe(F.col("of")), "left")
    own = ["vec_id", "label", "code", "error"]
    cold = first.where("n is null").select(*own).join(sums.where(F.col("n") <= line), F.col("label").eqNullSafe(F.col("of")))
    return first.where("n is not null").select(*own, "label_error").unionByName(cold.select(*own, "label_error"))


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (bytes), error and label_error of every row that is coded, and the codebooks."""
    prepare(spark)
    kept, dim = kept_vectors(vectors, id_col, vector_col, label_col)
    books = fitted(kept, dim)
    return with_label_errors(written(coded(kept, books), "codes")), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle() -> str:
    """The rounds one after another, each part compared with every entry."""
    far = "list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, len(a) + 1)])::BIGINT"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // 8) + 1 : (part + 1) * (len(e) // 8)] AS a FROM (SELECT *, unnest(range(8)) AS part FROM v))",
        "c0 AS MATERIALIZED (SELECT part, entry, a AS b FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 16) USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(a) AS a, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM (SELECT vec_id, p.part, a, entry, {far} AS d FROM p JOIN c{k} c ON p.part = c.part) GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM a{k}) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, b) AS b FROM c{k} LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY ALL) USING (part, entry))")
    last = ROUNDS
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM c{last}))")
    steps.append(f"r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"


ORACLE = oracle()
