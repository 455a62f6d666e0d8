"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch meets it in a sort-merge anti-join on the digest, of
which only the batch is shuffled: digests the index lacks are new, their rows are appended with the batch's
count; digests it has are appended as further sightings. So a digest's rows in the index give the largest doc_id
and the number of rows of all batches, in whatever order they came. Texts are equal when identical after
lower-casing A-Z only; null text counts as empty. Of equal texts the row with the largest doc_id stays.

A table is read in batches of descending doc_id, so what the anti-join lets pass in a batch is what stays.

Defined results: null ids order lowest; rows that repeat an id and a text are all marked as kept or not by their
id, and stage() keeps one of them, that of greatest hash; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, one_row, parts, remove, written

#: A digest that holds more than one row in HOT_SHARE is hot; there are at most HOT_SHARE such digests, whatever the input.
HOT_SHARE = 1000
BATCHES = 3  #: Batches a table is read in.


def sha(text):
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row; other columns, of whatever name, are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), sha(F.col(text_col)).alias("text_sha256"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest; counts are combined before the shuffle, so a hot digest costs a row per task."""
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """The persistent index; buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets or parts(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def sightings(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """One row per digest over all batches: the largest doc_id and the number of rows. Bucketed, so nothing is shuffled."""
        return self.sightings().groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unseen(self, found: DataFrame) -> DataFrame:
        """Rows of found whose digest the index lacks: the sort-merge anti-join."""
        if not self.exists():
            return found
        return found.join(self.sightings().where("first").select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, found: DataFrame) -> DataFrame:
        """Add a batch of groups; the rows of those whose digest the index lacked."""
        found = written(found, "batch")
        new = written(self.unseen(found).withColumn("first", F.lit(True)), "new-digests")
        rows = new
        if self.exists():
            rows = rows.unionByName(found.join(self.sightings().where("first").select("text_sha256").hint("merge"), "text_sha256", "left_semi").withColumn("first", F.lit(False)))
        (
            rows.repartition(self.buckets, "text_sha256").write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
            .format("parquet").mode("append" if self.exists() else "overwrite").saveAsTable(self.table)
        )
        discard(found)
        return new.drop("first")

    def drop(self) -> None:
        """Remove the table; nothing that is still to be computed may read it."""
        if self.exists():
            at = self.spark.sql(f"describe formatted {self.table}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"drop table {self.table}")
            remove(self.spark, at)


def batches(rows: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """rows (doc_id) in n ranges of doc_id, largest first; null ids are in the last."""
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if ends[0] is None or n == 1:
        return [rows]
    cuts = [ends[1] - (ends[1] - ends[0] + 1) * i // n for i in range(1, n)]
    at = lambda lo, hi: F.lit(True) if lo is None and hi is None else (F.col("doc_id") > lo) if hi is None else (F.col("doc_id") > lo) & (F.col("doc_id") <= hi)
    out = [rows.where(at(lo, hi)) for lo, hi in zip(cuts, [None, *cuts])]
    return [*out, rows.where((F.col("doc_id") <= cuts[-1]) | F.col("doc_id").isNull())]


def survivors(rows: DataFrame, index: DigestIndex) -> list[DataFrame]:
    """Bring rows (doc_id, text_sha256) into the index, largest ids first; the digests each batch was first to bring."""
    return [index.append(groups(b)) for b in batches(rows)]


def with_groups(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Join each row with its digest's index row. Hot digests, at most HOT_SHARE of them, are looked up by broadcast."""
    total = index.agg(F.sum("group_size")).first()[0] or 0
    line = max(1, total // HOT_SHARE)
    hot = F.broadcast(index.where(F.col("group_size") > line).withColumn("hot", F.lit(True)))
    first = rows.join(hot, "text_sha256", "left")
    cold = first.where("hot is null").select("doc_id", "text_sha256").join(index.where(F.col("group_size") <= line), "text_sha256")
    return first.where("hot").drop("hot").unionByName(cold)


def deduplicate(docs: DataFrame, index: DigestIndex, keep_index: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the index holds the digests of docs afterwards.

    keep_id and group_size are those of all rows the index has seen, these and earlier ones.
    """
    rows = written(digests(docs), "digests")
    discard(*survivors(rows, index))
    seen = written(index.read(), "groups")
    if not keep_index:
        index.drop()
    return with_groups(rows, seen).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir), DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}"), keep_index=False)


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with their columns; of rows that repeat an id and a text, one."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    kept = survivors(written(digests(docs), "digests"), index)
    keep = kept[0]
    for more in kept[1:]:
        keep = keep.unionByName(more)
    index.drop()
    named = lambda i, digest: F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("none")))
    keep = keep.select(named(F.col("keep_id"), F.col("text_sha256")).alias("_key0"))
    rows = one_row(docs, named(docs["doc_id"], sha(docs["text"])))
    return rows.join(keep.hint("merge"), "_key0", "left_semi").select("_row.*")  # on the key that the rows are dealt by already
