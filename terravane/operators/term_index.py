"""A kept lexical index: postings by term in blocks of documents, with positions and what bounds a block's gains.

A segment holds the documents that came together. They are numbered off into ranges of RANGE documents; a row of the index
is the block of one term in one range: how many documents have it, its greatest weighted frequency, its smallest document
length, and each document's id, length, frequency and positions. Rows lie in folders of a hash of the term and are sorted by it, so a
search reads the folders and row groups of the terms it asks for. The block of the empty term lists all documents.

The best k are found from bounds. A block's gain is at most that of its greatest frequency in its shortest document;
blocks are aligned by range, so a range's bound for a question is the sum over its terms. The documents of the
rarest words are scored first. After that only ranges whose bound reaches the k-th score found there are looked at, and of a
question's terms, least bound first, those that together do not reach it are left aside: a document that has no other
cannot be among the best. What the others and the rest's bounds leave is scored in full. Where the blocks' numbers add up to
few postings, all are scored at once, which takes fewer steps; results are the same.

An update adds a segment and names removed documents; nothing that stands is written again. Numbers of documents of
removed ones are taken off from the blocks of their ranges alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions.text import TERM
from .checkpoints import cut, shared

RANGE = 128  #: Documents of a range.
BUCKETS = 16  #: Folders of a segment.
PIECE = 500_000  #: Tokens that a task holds as arrays at a time; more only for one document that has more.
LISTED = 1000  #: Terms up to which a search names them in its scan; more are joined.
ALL = 2**31 - 1  #: A k from which nothing is left out.
FIRST = 4  #: Times k the documents of a question's rarest words that are scored first.
DIRECT = 50_000_000  #: Postings of all questions' words up to which bounds are not looked at.
SLACK = 2e-6  #: Scores are rounded to six digits.
COLUMN = 1 << 40  #: A position is its column's number times this, and its place there.
AT = ["segment", "range"]
BLOCKS = "term string, range long, n int, tf_max double, length_min int, length_sum long, ids array<{kind}>, lengths array<int>, tfs array<double>, places array<array<long>>"


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its files make fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_columns(docs: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """id and the folded tokens of each column, t0, t1 and so on."""
    from .lexical import fold

    folded = docs.select(F.col(id_col).alias("id"), *[fold(F.col(c)).alias(f"f{i}") for i, c in enumerate(columns)])
    return folded.select("id", *[F.regexp_extract_all(f"f{i}", F.lit(TERM), F.lit(0)).alias(f"t{i}") for i in range(len(columns))])


def blocks_of(tokens: DataFrame, weights: Sequence[float], size: int = RANGE) -> DataFrame:
    """term, range, n, tf_max, length_min, length_sum and its documents' ids, lengths, tfs and places of every block."""

    def build(batches):
        done = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, size):
                yield block_rows(piece, np.asarray(weights, np.float64), done, size)
                done += -(-piece.num_rows // size)

    return tokens.mapInArrow(build, BLOCKS.format(kind=tokens.schema["id"].dataType.simpleString()))


def pieces(batch: pa.RecordBatch, size: int):
    """A batch in runs of whole ranges of about PIECE tokens; a range of longer documents is cut, as at the end of a batch."""
    tokens = sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in range(1, batch.num_columns))
    start = 0
    while start < batch.num_rows:
        fit = max(1, int(np.searchsorted(np.cumsum(tokens[start:]), PIECE, "right")))
        fit = fit // size * size or fit
        yield batch.slice(start, fit)
        start += fit


def block_rows(batch: pa.RecordBatch, weights: np.ndarray, done: int, size: int) -> pa.RecordBatch:
    n = batch.num_rows
    values, rows, places, length = [], [], [], np.zeros(n, np.int64)
    for c in range(len(weights)):
        column = batch.column(c + 1)
        many = np.diff(column.offsets.to_numpy())
        values.append(column.flatten())
        rows.append(np.repeat(np.arange(n), many))
        places.append(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + c * COLUMN)
        length += many
    values = [*values, pa.array([""] * n, values[0].type)]  # the block of all documents
    coded = pa.concat_arrays(values).dictionary_encode()
    code = coded.indices.to_numpy()
    row, place = np.concatenate([*rows, np.arange(n)]), np.concatenate([*places, np.full(n, -1)])
    weight = np.where(place < 0, 0.0, weights[np.maximum(place, 0) // COLUMN])
    order = np.lexsort((place, row, code, row // size))
    code, row, place, weight = code[order], row[order], place[order], weight[order]
    posting = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1]))))
    tf, pc, pr = np.add.reduceat(weight, posting), code[posting], row[posting]
    block = np.flatnonzero(np.concatenate(([True], (pc[1:] != pc[:-1]) | (pr[1:] // size != pr[:-1] // size))))
    many = np.diff(np.append(block, len(pr)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(posting, len(code)), pa.int32()), pa.array(place))
    cuts = pa.array(np.append(block, len(pr)), pa.int32())
    inside = lambda x: pa.ListArray.from_arrays(cuts, x)
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(pc[block])), pa.array(done + pr[block] // size), pa.array(many, pa.int32()), pa.array(np.maximum.reduceat(tf, block)),
            pa.array(np.minimum.reduceat(length[pr], block), pa.int32()), pa.array(np.add.reduceat(length[pr], block)),
            inside(batch.column(0).take(pa.array(pr))), inside(pa.array(length[pr], pa.int32())), inside(pa.array(tf)), inside(lists),
        ],
        ["term", "range", "n", "tf_max", "length_min", "length_sum", "ids", "lengths", "tfs", "places"],
    )


def bucket(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TermIndex:
    """An index below root, as of its live segments and removed documents (segment, range, id, length)."""

    def __init__(self, spark: SparkSession, root: str, weights: dict[str, float], segments: Sequence[str] = (), removed: DataFrame | None = None, buckets: int = BUCKETS, kind: str = "string"):
        """kind is the type of the documents' ids."""
        self.spark, self.root, self.weights, self.segments, self.removed, self.buckets, self.kind = spark, root.rstrip("/"), weights, tuple(segments), removed, buckets, kind

    def _with(self, segments: Sequence[str], removed: DataFrame | None) -> TermIndex:
        return TermIndex(self.spark, self.root, self.weights, segments, removed, self.buckets, self.kind)

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, weights: dict[str, float]) -> TermIndex:
        """An index of docs in the shared folder, for questions of this application."""
        spark = docs.sparkSession
        return cls(spark, f"{shared(spark)}/terms-{uuid.uuid4().hex}", weights, kind=docs.schema[id_col].dataType.simpleString()).add(docs, id_col)

    def add(self, docs: DataFrame, id_col: str) -> TermIndex:
        """With one more segment, of docs; what is not yet named by an index that is kept does no harm."""
        segment = uuid.uuid4().hex
        own = spread(docs.select(id_col, *self.weights))
        rows = blocks_of(token_columns(own, id_col, list(self.weights)), list(self.weights.values()))
        rows = rows.withColumn("segment", F.lit(segment)).withColumn("bucket", bucket("term", self.buckets))
        # A term that most documents have is a large part of its bucket: the rebalance splits it.
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.partitionBy("segment", "bucket").mode("append").parquet(self.root)
        return self._with((*self.segments, segment), self.removed)

    def remove(self, ids: DataFrame) -> TermIndex:
        """Without the documents of ids (id), which are named but not yet cut out of their blocks."""
        if not self.segments:
            return self
        gone = self.documents().join(ids.select("id"), "id", "left_semi").select(*AT, "id", "length")
        gone = cut(gone if self.removed is None else self.removed.select(*AT, "id", "length").unionByName(gone), "removed")
        return self._with(self.segments, gone)

    def documents(self) -> DataFrame:
        """id, length, segment and range of every live document."""
        return self._live(self._exploded(self._rows())).select("id", "length", *AT)

    def terms(self) -> DataFrame:
        """term, documents, weight of every term of live documents."""
        rows = self._all().where(F.col("term") != "")
        return self._live(self._exploded(rows)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("weight"))

    def _all(self) -> DataFrame:
        rows = self.spark.read.schema(f"{BLOCKS.format(kind=self.kind)}, segment string, bucket int").parquet(self.root)
        return rows.where(F.col("segment").isin(*self.segments))

    def _rows(self, terms: dict[str, int] | DataFrame | None = None) -> DataFrame:
        """Blocks of the terms, all documents' by default. Terms with their buckets prune folders and are pushed to the scan; a table of (term) is joined."""
        rows = self._all()
        if terms is None:
            return rows.where((F.col("bucket") == bucket(F.lit(""), self.buckets)) & (F.col("term") == ""))
        if isinstance(terms, dict):
            return rows.where(F.col("bucket").isin(*set(terms.values())) & F.col("term").isin(*terms))
        return rows.join(terms.select("term", bucket("term", self.buckets).alias("bucket")), ["bucket", "term"], "left_semi")

    def _exploded(self, rows: DataFrame) -> DataFrame:
        zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"))
        return rows.select("term", *AT, F.inline(zipped).alias("id", "length", "tf"))

    def _live(self, entries: DataFrame) -> DataFrame:
        return entries if self.removed is None else entries.join(self.removed.select(*AT, "id"), [*AT, "id"], "left_anti")

    def search(self, queries: DataFrame, k: int, keep: DataFrame | None = None, match: str = "or", direct: int = DIRECT) -> DataFrame:
        """query_id, id, score, matched, rank of the k best documents of each query (query_id, and term or terms, a phrase).

        keep (id) are the documents that may be found; they leave the statistics alone. match: `or`, or `and_or` for
        all phrases where some document that may be found has them, else any.
        """
        from .lexical import fold

        phrase = F.col("terms") if "terms" in queries.columns else F.array("term")
        q = cut(queries.select("query_id", F.transform(phrase, fold).alias("terms")).withColumn("key", F.array_join("terms", " ")).distinct(), "asked")
        asked = q.select("key", "terms").distinct().select("key", F.size("terms").alias("m"), F.posexplode("terms").alias("j", "term"))
        some = asked.select("term", "m", bucket("term", self.buckets).alias("bucket")).distinct().limit(LISTED + 1).collect()
        listed = len(some) <= LISTED
        rows = self._rows({r["term"]: r["bucket"] for r in some} if listed else asked.select("term").distinct())
        heads = cut(rows.select("term", *AT, "n", "tf_max", "length_min"), "heads")
        total, mean = self._statistics()
        phrases = self._phrases(rows, heads, asked.where("m > 1")) if not listed or any(r["m"] > 1 for r in some) else None
        df = self._numbers(rows, heads, asked.where("m = 1"))
        df = df if phrases is None else df.unionByName(phrases.groupBy("key").agg(F.count(F.lit(1)).alias("df")))
        idf = df.select("key", F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(V.LEAST_IDF)).alias("idf"))

        def gain(tf, length):
            return F.col("idf") * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length / mean))

        words = cut(q.where(F.size("terms") == 1).select("query_id", "key", F.col("terms")[0].alias("term")).join(idf, "key"), "words")
        found = None if phrases is None else q.join(phrases.join(idf, "key").select("key", *AT, "id", gain(F.col("tf"), F.col("length")).alias("gain")), "key").select("query_id", "key", *AT, "id", "gain")
        def hits(where: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
            """query_id, segment, range, id, gain of what where's ranges or documents, all by default, have of the questions' phrases, or of some keys (query_id, key)."""
            on = [c for c in ("query_id", *AT, "id") if where is not None and c in where.columns]
            own, more = words, found
            if keys is not None:
                own, more = own.join(keys, ["query_id", "key"], "left_semi"), more if more is None else more.join(keys, ["query_id", "key"], "left_semi")
            due = own.join(where.select(*on), "query_id") if on else own
            postings = self._live(self._exploded(rows if not on else rows.join(where.select(*AT).distinct(), AT, "left_semi")))
            out = due.join(postings, ["term", *on[1:]]).select("query_id", *AT, "id", gain(F.col("tf"), F.col("length")).alias("gain"))
            return out if more is None else out.unionByName((more.join(where.select(*on), on, "left_semi") if on else more).drop("key"))

        def scored(where: DataFrame | None) -> DataFrame:
            """query_id, id, score, matched of the documents in where."""
            out = hits(where).groupBy("query_id", "id").agg(F.round(F.sum("gain"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
            return out if keep is None else out.join(keep.select("id"), "id", "left_semi")

        best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        at, done = ["query_id", *AT], None
        need = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        if k >= ALL or (words.join(heads, "term").agg(F.sum("n")).first()[0] or 0) <= direct:
            out = scored(None)
            if match == "and_or":
                out = cut(out, "scores")
                most = out.groupBy("query_id").agg(F.max("matched").alias("most")).join(need, "query_id").select("query_id", F.when(F.col("most") == F.col("need"), F.col("need")).otherwise(1).alias("least"))
                out = out.join(most, "query_id").where("matched >= least").drop("least")
            return best(out)
        bounds = words.join(heads, "term").select("query_id", "key", *AT, gain(F.col("tf_max"), F.col("length_min")).alias("bound"))
        bounds = bounds if found is None else bounds.unionByName(found.groupBy("query_id", "key", *AT).agg(F.max("gain").alias("bound")))
        bounds = cut(bounds, "bounds")
        ranges = bounds.groupBy("query_id", *AT).agg(F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("keys"))

        if match == "and_or":  # ranges where every phrase has a block, first
            every = scored(ranges.join(need, "query_id").where(F.col("keys") == F.col("need"))).join(need, "query_id").where(F.col("matched") == F.col("need")).drop("need")
            done = cut(best(every), "all")
            bounds, ranges = (df.join(done.select("query_id").distinct(), "query_id", "left_anti") for df in (bounds, ranges))
        # documents of the rarest words
        rare = words.join(df, "key").withColumn("reach", F.sum("df").over(W.partitionBy("query_id").orderBy("df", "key"))).where(F.col("reach") - F.col("df") < FIRST * k)
        rare = hits(None, rare.select("query_id", "key")).select(*at, "id").distinct().join(ranges.select("query_id").distinct(), "query_id", "left_semi")
        some = best(scored(cut(rare, "rare")))
        line = some.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score") - SLACK)).alias("line"))
        most = bounds.groupBy("query_id", "key").agg(F.max("bound").alias("bound")).join(line, "query_id", "left")
        most = most.withColumn("reach", F.sum("bound").over(W.partitionBy("query_id").orderBy("bound", "key"))).withColumn("aside", F.coalesce(F.col("reach") < F.col("line"), F.lit(False)))
        lines = most.groupBy("query_id", "line").agg(F.coalesce(F.sum(F.when(F.col("aside"), F.col("bound"))), F.lit(0.0)).alias("rest"))
        open_ = F.col("line").isNull()
        due = ranges.join(lines.select("query_id", "line"), "query_id").where(open_ | (F.col("bound") >= F.col("line")))
        near = hits(cut(due.select(*at), "due"), most.where(~F.col("aside")).select("query_id", "key")).groupBy(*at, "id").agg(F.sum("gain").alias("gain"))
        near = cut(near.join(lines, "query_id").where(open_ | (F.col("gain") + F.col("rest") >= F.col("line"))).select(*at, "id"), "near")
        out = best(scored(near))
        return out if done is None else done.unionByName(out)

    def _statistics(self) -> tuple[int, float]:
        """Number of live documents and their mean length."""
        row = self._rows().agg(F.sum("n"), F.sum("length_sum")).first()
        gone = self.removed.agg(F.count(F.lit(1)), F.sum("length")).first() if self.removed is not None else (0, 0)
        n = (row[0] or 0) - gone[0]
        return n, ((row[1] or 0) - (gone[1] or 0)) / n if n else 1.0

    def _numbers(self, rows: DataFrame, heads: DataFrame, asked: DataFrame) -> DataFrame:
        """key, df of single words: the blocks' numbers, less the removed documents of their ranges."""
        n = heads.groupBy("term").agg(F.sum("n").alias("n"))
        if self.removed is not None:
            gone = self._exploded(rows.join(self.removed.select(*AT).distinct(), AT, "left_semi")).join(self.removed.select(*AT, "id"), [*AT, "id"], "left_semi")
            n = n.unionByName(gone.groupBy("term").agg((-F.count(F.lit(1))).alias("n"))).groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
        return asked.join(n, "term").select("key", F.col("n").alias("df"))

    def _phrases(self, rows: DataFrame, heads: DataFrame, asked: DataFrame) -> DataFrame:
        """key, segment, range, id, length, tf of the documents that have a phrase: its tokens in a row, in one column."""
        whole = asked.join(heads, "term").groupBy("key", "m", *AT).agg(F.count(F.lit(1)).alias("n")).where("n = m").select("key", *AT)
        parts = asked.join(rows.join(whole.select(*AT).distinct(), AT, "left_semi"), "term").join(whole, ["key", *AT], "left_semi")
        parts = self._live(parts.select("key", "m", "j", *AT, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("length"), F.col("places").alias("places"))).alias("id", "length", "places")))
        start = parts.select("key", "m", *AT, "id", "length", F.explode("places").alias("p"), "j").groupBy("key", "m", *AT, "id", "length", (F.col("p") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        weight = F.element_at(F.array(*map(F.lit, map(float, self.weights.values()))), (F.col("start") / COLUMN).cast("int") + 1)
        return cut(start.where("n = m").groupBy("key", *AT, "id", "length").agg(F.sum(weight).alias("tf")), "phrases")
