"""Integrity checks as a table: check, ok, failures, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import parent_cycles


def safe_path(path: Column) -> Column:
    """Relative, without .. segments and NUL characters."""
    return ~(F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, r"[/\\]"), "..") | F.contains(path, F.lit("\0")) | path.rlike(r"^[A-Za-z]:"))


def orphan_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is no entity, with which end."""
    ids = entities.select("id")
    lost = lambda end: edges.join(ids, F.col(end) == F.col("id"), "left_anti").withColumn("missing", F.lit(end))
    return lost("source_id").unionByName(lost("target_id"))


def actionable(unresolved: DataFrame, entities: DataFrame) -> DataFrame:
    """Unresolved references that an entity's name in the same root (or none in both) could satisfy."""
    e = entities.select(F.col("name").alias("_name"), F.col("root_id").alias("_root")).distinct()
    return unresolved.join(e, (F.col("name") == F.col("_name")) & F.col("root_id").eqNullSafe(F.col("_root")), "left_semi")


#: Columns that the tables of an index have at least, and the format they are written in.
SCHEMA = {
    "entities": ("id", "root_id", "kind", "language", "name", "qualified_name", "path", "parent_id"),
    "edges": ("source_id", "target_id", "type", "provenance", "confidence"),
}
FORMAT = 1


def doctor(entities: DataFrame, edges: DataFrame, embeddings: DataFrame, fts_ids: DataFrame, tolerance: float = 0.02, stale: DataFrame | None = None, written_format: int | None = None) -> DataFrame:
    """All checks in one table. embeddings: entity_id, vector; fts_ids: id.

    With written_format (that of the stored tables) their format and columns are checked, too; with stale (the rows
    incremental.stale_paths gives), whether the index is fresh.
    """
    ids = entities.select("id")
    size = F.size("vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    common = embeddings.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    count = F.count(F.lit(1)).alias("failures")
    checks = [
        ("orphan_edges", "error", orphan_edges(edges, entities)),
        ("orphan_embeddings", "warning", embeddings.join(ids, F.col("entity_id") == F.col("id"), "left_anti")),
        ("parent_cycles", "error", parent_cycles(entities)),
        ("fts_orphans", "warning", fts_ids.join(ids, "id", "left_anti")),
        ("fts_missing", "warning", ids.join(fts_ids, "id", "left_anti")),
        ("vector_dimensions", "error", embeddings.join(F.broadcast(common), size == F.col("d"), "left_anti")),  # one row
        ("vector_norms", "warning", embeddings.where(F.abs(norm - 1) > tolerance)),
        ("path_safety", "error", entities.where(F.col("path").isNotNull() & ~safe_path(F.col("path")))),
        ("span_bounds", "error", entities.where((F.col("start_line") < 0) | (F.col("end_line") < F.col("start_line"))) if "start_line" in entities.columns else entities.limit(0)),
    ]
    spark = entities.sparkSession
    if written_format is not None:
        lost = [(c,) for name, df in (("entities", entities), ("edges", edges)) for c in SCHEMA[name] if c not in df.columns]
        checks += [("schema", "error", spark.createDataFrame(lost, "c string")), ("format", "error", spark.range(int(written_format != FORMAT)))]
    if stale is not None:
        checks.append(("freshness", "warning", stale))
    rows = [df.agg(count).select(F.lit(n).alias("check"), (F.col("failures") == 0).alias("ok"), "failures", F.lit(s).alias("severity")) for n, s, df in checks]
    return reduce(DataFrame.unionByName, rows)
