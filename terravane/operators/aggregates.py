"""Counts, facets, fingerprints and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import numbered


def facets(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """facet, value, n for several columns in one pass; null counts as unknown."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for name, c in columns.items()])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def root_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """root_id, what, name, n: entities by kind and edges by type; an edge belongs to its source's root."""
    e = entities.groupBy("root_id", F.lit("entity").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    own = edges.join(entities.select(F.col("id").alias("source_id"), "root_id"), "source_id")
    return e.unionByName(own.groupBy("root_id", F.lit("edge").alias("what"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """One row: number of rows and greatest value, joined by a colon."""
    return rows.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.round(F.max(column)).cast("long").cast("string")).alias("fingerprint"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def community_labels(members: DataFrame) -> DataFrame:
    """community, size, label (its most frequent parent folder, the least of equal ones) and whether it is a largest one. members: community, path."""
    term = F.element_at(F.split("path", "/"), -2)
    terms = members.where(F.contains("path", F.lit("/"))).groupBy("community", term.alias("term")).agg(F.count(F.lit(1)).alias("n"))
    best = terms.groupBy("community").agg(F.min(F.struct(-F.col("n"), "term")).alias("b")).select("community", F.col("b.term").alias("label"))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.agg(F.max("size").alias("top"))
    return sizes.join(best, "community", "left").crossJoin(F.broadcast(top)).select("community", "size", "label", (F.col("size") == F.col("top")).alias("dominant"))  # one row


def community_terms(members: DataFrame) -> DataFrame:
    """community, label: the most frequent parent folder and the most frequent name of its members (community, path, name), the least of equal ones."""

    def most(column, name: str) -> DataFrame:
        n = members.select("community", column.alias("x")).where(F.coalesce("x", F.lit("")) != "").groupBy("community", "x").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("community").agg(F.min(F.struct(-F.col("n"), "x")).alias("m")).select("community", F.col("m.x").alias(name))

    folder = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), -2))
    both = members.select("community").distinct().join(most(folder, "folder"), "community", "left").join(most(F.col("name"), "named"), "community", "left")
    return both.select("community", F.trim(F.concat_ws(" ", "folder", "named")).alias("label"))


def percentile_nearest(values: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row: the value at the rounded place of the fraction in order. Values are ordered range by range, never in one task."""
    some = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    at = numbered(some, F.col("value").asc())
    place = round((at.count() - 1) * fraction)
    return at.where(F.col("number") == place).agg(F.max("value").alias("value"))


def note_status(notes: DataFrame, when) -> DataFrame:
    """One row: notes (id, scope, valid_to), those current at a moment, those superseded, and the current ones of each scope."""
    current = F.col("valid_to").isNull() | (F.col("valid_to") > when)
    return notes.agg(
        F.count(F.lit(1)).alias("revisions"), F.count_if(current).alias("current"), F.count_if(~current).alias("superseded"),
        F.count_if(current & (F.col("scope") == "user")).alias("user_notes"), F.count_if(current & (F.col("scope") == "project")).alias("project_notes"),
    )


def unresolved_breakdown(unresolved: DataFrame, actionable: DataFrame, key: str) -> DataFrame:
    """One row: references without a target in all, those an entity could satisfy, and the external rest."""
    marked = unresolved.select(key).join(actionable.select(key, F.lit(1).alias("known")).distinct(), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("known").alias("actionable"), F.count_if(F.col("known").isNull()).alias("external"))


def dominant(rows: DataFrame, key: str) -> DataFrame:
    """One row: the most frequent value of a column and its count, the least of equal ones."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(1)
