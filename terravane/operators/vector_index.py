"""A kept vector index: vectors in lists by their nearest centroid, so that a search reads the lists near its query.

Centroids are fitted by k-means on SAMPLE rows at most, those whose id's hash is low; every row is indexed. The lists'
number grows with the root of the rows up to MOST, and their centroids take WIDTH bytes at most, so they go to every
task. Rows lie in folders of their list and are sorted by it. A segment holds the rows that came together and, for each list, how
many there are and the least cosine of one to the centroid. An update adds a segment and names removed rows.

A search looks through the lists of the nearest centroids, `probes` of them. An exact one then takes the k-th
similarity found and reads of the other lists those that may hold a better row: a row is at least as far from the
query as the centroid is, less the list's widest angle. Similarities are computed from the vectors themselves.

Rows whose vector is null, zero, not finite or of another length than most at the time of the fit have no similarity and are left out.
An empty table gives an index that holds nothing. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, norm
from .checkpoints import cut, shared
from .vector import BLOCK_ROWS, knn

SAMPLE = 65_536  #: Rows that centroids are fitted on, about.
MOST = 4096  #: Lists at most.
WIDTH = 64 << 20  #: Bytes of all centroids at most.
LEAST = 4096  #: Rows up to which there is one list.
FOLDERS = 64  #: Folders of a segment.
PROBES = 16  #: Lists that a search reads first.
LISTED = 1000  #: Lists up to which a scan names them.
SLACK = 1e-5  #: Similarities are rounded to six digits, angles near nothing to fewer.
CHUNK = 1024  #: Rows a task compares with all centroids at once.


def usable(vector, width: int):
    """Whether a vector has a direction and the index's length."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & finite & (norm(v) > 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class VectorIndex:
    """An index below root, as of a model (its centroids), its live segments and removed rows (segment, id)."""

    def __init__(self, spark: SparkSession, root: str, model: str, segments: Sequence[str] = (), removed: DataFrame | None = None, kind: str = "string"):
        """kind is the type of the rows' ids."""
        self.spark, self.root, self.model, self.segments, self.removed, self.kind = spark, root.rstrip("/"), model, tuple(segments), removed, kind
        self._centroids = None

    @classmethod
    def fitted(cls, vectors: DataFrame, root: str | None = None, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """An index of vectors (id, vector) below root, or in the shared folder for questions of this application."""
        spark = vectors.sparkSession
        root = root or f"{shared(spark)}/vectors-{uuid.uuid4().hex}"
        sizes = vectors.where("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        width, rows = (sizes["d"], sizes["count"]) if sizes else (0, 0)
        lists = lists or (1 if rows <= LEAST else int(np.ceil(rows**0.5)))
        lists = max(1, min(lists, MOST, WIDTH // (8 * max(1, width)), rows))
        centres = np.zeros((1, width))
        if lists > 1:
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.functions import array_to_vector

            low = (F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(float(1 << 63))) < min(1.0, sample / rows)
            some = vectors.where(low & usable(F.col("vector"), width)).select(array_to_vector(l2_normalize(F.col("vector"))).alias("features"))
            some = cut(some, "sample")
            found = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(some).clusterCenters() if not some.isEmpty() else []
            centres = unit(found) if len(found) else centres
        model = uuid.uuid4().hex
        held = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(held, "list int, vector array<double>").coalesce(1).write.parquet(f"{root}/centroids/{model}")
        return cls(spark, root, model, kind=vectors.schema["id"].dataType.simpleString()).add(vectors)

    def centroids(self) -> np.ndarray:
        """One row a list; MOST rows and WIDTH bytes at most."""
        if self._centroids is None:
            rows = self.spark.read.parquet(f"{self.root}/centroids/{self.model}").orderBy("list").collect()
            self._centroids = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
        return self._centroids

    def _with(self, segments: Sequence[str], removed: DataFrame | None) -> VectorIndex:
        out = VectorIndex(self.spark, self.root, self.model, segments, removed, self.kind)
        out._centroids = self._centroids
        return out

    def add(self, vectors: DataFrame) -> VectorIndex:
        """With one more segment, of vectors (id, vector); what no kept index names does no harm."""
        centres, segment = self.centroids(), uuid.uuid4().hex
        sent = self.spark.sparkContext.broadcast(centres)

        def assign(frames):
            c = sent.value
            for frame in frames:
                for at in range(0, len(frame), CHUNK):
                    part = frame.iloc[at : at + CHUNK]
                    s = unit(part["vector"]) @ c.T
                    yield part.assign(list=s.argmax(axis=1).astype("int32"), near=s.max(axis=1))

        own = vectors.where(usable(F.col("vector"), centres.shape[1])).select("id", F.col("vector").cast("array<double>").alias("vector"))
        rows = own.mapInPandas(assign, f"id {self.kind}, vector array<double>, list int, near double")
        rows = rows.withColumn("segment", F.lit(segment)).withColumn("folder", F.col("list") % FOLDERS)
        # A list with most of the rows is a large part of its folder: the rebalance splits it.
        rows.hint("rebalance", "folder").sortWithinPartitions("folder", "list", "id").write.partitionBy("segment", "folder").mode("append").parquet(f"{self.root}/rows")
        stats = self._read([segment]).groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.min("near").alias("least"))
        stats.withColumn("segment", F.lit(segment)).coalesce(1).write.partitionBy("segment").mode("append").parquet(f"{self.root}/stats")
        return self._with((*self.segments, segment), self.removed)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Without the rows of ids (id) in the segments there are; a later segment may hold them again."""
        if not self.segments:
            return self
        gone = ids.select(F.explode(F.array(*map(F.lit, self.segments))).alias("segment"), F.col("id").cast(self.kind).alias("id")).distinct()
        return self._with(self.segments, gone if self.removed is None else self.removed.unionByName(gone).distinct())

    def _read(self, segments: Sequence[str], lists: Sequence[int] | None = None) -> DataFrame:
        at = f"id {self.kind}, vector array<double>, list int, near double, segment string, folder int"
        try:
            rows = self.spark.read.schema(at).parquet(f"{self.root}/rows")
        except Exception as e:  # nothing was ever added
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], at)
        rows = rows.where(F.col("segment").isin(*segments))
        if lists is not None and len(lists) <= LISTED:
            rows = rows.where(F.col("folder").isin(*sorted({i % FOLDERS for i in lists})) & F.col("list").isin(*lists))
        return rows

    def rows(self, lists: Sequence[int] | None = None, within: DataFrame | None = None) -> DataFrame:
        """id, vector, list of live rows, of the given lists alone; within (id) bounds them further."""
        rows = self._read(self.segments, lists)
        if self.removed is not None:
            rows = rows.join(self.removed, ["segment", "id"], "left_anti")
        if within is not None:
            rows = rows.join(within.select("id"), "id", "left_semi")
        return rows.select("id", "vector", "list")

    def lists(self) -> pd.DataFrame:
        """list, rows, least of the segments together, removed rows still counted; MOST rows at most."""
        if not self.segments:
            return pd.DataFrame({"list": [], "rows": [], "least": []})
        stats = self.spark.read.schema("list int, rows long, least double, segment string").parquet(f"{self.root}/stats")
        stats = stats.where(F.col("segment").isin(*self.segments)).groupBy("list").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"))
        return stats.orderBy("list").toPandas()

    def search(self, query: list[float], k: int, probes: int = PROBES, within: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """id, similarity of the k rows nearest to one query. Where the lists looked at hold fewer than k, all are."""
        known = self.lists()
        if len(query) != self.centroids().shape[1] or not np.isfinite(query).all() or not np.any(query):
            return self.rows([], within).select("id", F.lit(0.0).alias("similarity")).limit(0)
        known["cos"] = (unit([query]) @ self.centroids().T)[0][known["list"].astype(int)]
        known = known.sort_values(["cos", "list"], ascending=[False, True])
        first, rest = known.iloc[:probes], known.iloc[probes:]
        best = cut(knn(self.rows(first["list"].astype(int).tolist(), within), query, k), "near")
        if not len(rest):
            return best
        got = [r["similarity"] for r in best.select("similarity").collect()]  # k at most
        if len(got) == k:
            if not exact:
                return best
            rest = rest[reach(rest["cos"], rest["least"]) + SLACK >= min(got)]
        if not len(rest):
            return best
        more = knn(self.rows(rest["list"].astype(int).tolist(), within), query, k)
        return cut(best.unionByName(more).orderBy(F.desc("similarity"), "id").limit(k), "near")

    def search_all(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False, same: bool = False) -> DataFrame:
        """query_id, id, similarity, rank: the k rows nearest to each query (query_id, vector), itself left out if same.

        A query meets a list in blocks of BLOCK_ROWS rows a side, and each meeting gives the k best alone. Queries that find fewer than
        k rows look through all lists. query_id must not repeat.
        """
        centres, known = self.centroids(), self.lists()
        kind = queries.schema["query_id"].dataType.simpleString()
        own = queries.where(usable(F.col("vector"), centres.shape[1])).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        own = cut(own, "queries")
        numbers, least = known["list"].to_numpy(np.int64), known["least"].to_numpy(np.float64)
        sent = self.spark.sparkContext.broadcast((centres[numbers], numbers, least))

        def near(frames):
            c, numbers, least = sent.value
            for frame in frames:
                for at in range(0, len(frame), CHUNK):
                    part = frame.iloc[at : at + CHUNK]
                    s = unit(part["vector"]) @ c.T
                    order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                    chosen = np.zeros(s.shape, bool)
                    np.put_along_axis(chosen, order, True, 1)
                    # A query looks through its nearest lists first; of the others those count whose bound reaches what it found.
                    floor = part["floor"].to_numpy() if "floor" in part else None
                    take = chosen if floor is None else ~chosen & (reach(s, least[None, :]) + SLACK >= floor[:, None])
                    q, i = np.nonzero(take)
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "list": numbers[i].astype("int32")})

        schema = f"query_id {kind}, list int"
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
        found = cut(best(self._meet(own, own.mapInPandas(near, schema), known, k, same)), "found")
        if len(known) <= probes:
            return found
        kth = found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
        left = own.join(kth, "query_id", "left" if exact else "left_anti")
        left = cut(left.withColumn("floor", F.coalesce("floor", F.lit(-2.0)) if exact else F.lit(-2.0)), "left")
        more = self._meet(own, left.mapInPandas(near, schema), known, k, same)
        return best(found.drop("rank").unionByName(more))

    def _meet(self, queries: DataFrame, asked: DataFrame, known: pd.DataFrame, k: int, same: bool) -> DataFrame:
        """query_id, id, similarity: of every asked list's blocks the k rows nearest to a query."""
        asked = cut(asked, "asked")
        counts = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST rows at most
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.kind}, similarity double"
        if not counts:
            return self.spark.createDataFrame([], kinds)
        held = dict(zip(known["list"].astype(int), known["rows"].astype(int)))
        plan = [(i, -(-n // BLOCK_ROWS), -(-held[i] // BLOCK_ROWS)) for i, n in sorted(counts.items())]
        plan = F.broadcast(self.spark.createDataFrame(plan, "list int, q_parts int, v_parts int"))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(plan, "list").select("list", deal("query_id", "q_parts").alias("qp"), every("v_parts").alias("vp"), "query_id").join(queries, "query_id")
        v = self.rows(sorted(counts)).join(plan, "list").select("list", every("q_parts").alias("qp"), deal("id", "v_parts").alias("vp"), "id", "vector")

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
            b = b.sort_values("id")
            s = np.round(unit(a["vector"]) @ unit(b["vector"]).T, 6)
            if same:
                s[a["query_id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
            n = min(k, s.shape[1])
            top = np.argsort(-s, axis=1, kind="stable")[:, :n]
            out = pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), n), "id": b["id"].to_numpy()[top.reshape(-1)], "similarity": np.take_along_axis(s, top, 1).reshape(-1)})
            return out[np.isfinite(out["similarity"])]

        keys = ["list", "qp", "vp"]
        return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(best, kinds)


def reach(cosine, least):
    """The greatest cosine to a query that a row may have whose list's centroid has `cosine` to the query and `least` to its farthest row."""
    gap = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(0, gap))
