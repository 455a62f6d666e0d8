"""Point lookups over entities, compact references, and orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexical import exact_matches


def by_ids(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id").distinct(), "id", "left_semi")


def by_name(entities: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """Entities of each of names (name), the shortest path first: name, id, rank."""
    e = entities.join(names.select("name").distinct(), "name", "left_semi")
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.char_length(F.coalesce("path", F.lit(""))), "id"))
    return e.withColumn("rank", rank).where(F.col("rank") <= limit).select("name", "id", "rank")


def by_qualified_name(entities: DataFrame, suffix: str, limit: int = 50) -> DataFrame:
    """Entities whose qualified name is the suffix or ends with it after a dot, the shortest first."""
    q = F.col("qualified_name")
    return entities.where((q == suffix) | F.endswith(q, F.lit("." + suffix))).orderBy(F.char_length(F.coalesce(q, F.lit(""))), "id").limit(limit)


def by_paths(entities: DataFrame, paths: DataFrame) -> DataFrame:
    return entities.join(paths.select("path").distinct(), "path", "left_semi")


def file_entities(entities: DataFrame) -> DataFrame:
    """path, id of the entity that stands for each file: a file or document, the least id of several."""
    return entities.where(F.col("kind").isin("file", "document", "module")).groupBy("path").agg(F.min("id").alias("id"))


def children(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Entities whose parent is one of parents (id)."""
    return entities.join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def resolved(entities: DataFrame, references: DataFrame) -> DataFrame:
    """ref, id of what each reference names: an id, else the first of its exact matches. References that name nothing have no row."""
    r = references.select("ref").distinct()
    own = r.join(entities.select(F.col("id").alias("ref")), "ref", "left_semi").select("ref", F.col("ref").alias("id"), F.lit(0).alias("rank"))
    found = own.unionByName(exact_matches(entities, r, 1).select("ref", "id", "rank"))
    return found.groupBy("ref").agg(F.min(F.struct("rank", "id")).alias("m")).select("ref", "m.id")


def reference() -> Column:
    """A compact reference to an entity: its label is the qualified name, else the name."""
    return F.struct("id", F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), F.col("name")).alias("label"), "kind", "path", "qualified_name", "language")


def roots_first(roots: DataFrame) -> DataFrame:
    """The primary root, then the others by name."""
    return roots.orderBy(F.desc("is_primary"), "name", "id")


def numeric_first(value: Column) -> list[Column]:
    """An order in which values that are numbers come first, by size, and the rest by text."""
    number = F.try_to_number(value, F.lit("9" * 18)).cast("long")
    return [number.isNull(), number, value]


def badge(features: dict[str, Column]) -> Column:
    """The strongest kind of evidence a result has, in this order; lexical where there is none."""
    shown = (("exact_name", "exact"), ("exact_path", "exact"), ("lexical", "lexical"), ("semantic", "semantic"), ("graph_expanded", "graph-expanded"), ("graph_expansion", "graph-expanded"))
    out = F.lit("lexical")
    for name, label in reversed(shown):
        if name in features:
            out = F.when(F.coalesce(features[name], F.lit(0.0)) != 0, label).otherwise(out)
    return out
