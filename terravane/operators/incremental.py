"""Change plans between snapshots, merges and reuse by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_update(known: DataFrame, found: DataFrame, key: str = "path", hash_col: str = "content_hash", force: bool = False) -> DataFrame:
    """key, change: added, changed, unchanged or removed; the content's hash decides."""
    both = known.select(key, F.col(hash_col).alias("old"), F.lit(True).alias("k")).join(found.select(key, F.col(hash_col).alias("new"), F.lit(True).alias("f")), key, "full")
    same = F.col("old").eqNullSafe(F.col("new")) & F.lit(not force)
    return both.select(key, F.when(F.col("k").isNull(), "added").when(F.col("f").isNull(), "removed").when(same, "unchanged").otherwise("changed").alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert, but an edge that was there keeps all but its confidence, metadata and update time."""
    keys = ["source_id", "target_id", "type", "provenance", "resolver"]
    fresh = [c for c in ("confidence", "metadata", "updated_at") if c in old.columns]
    held = old.alias("o").join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in fresh]), keys)
    held = held.select(*[F.col(f"_{c}").alias(c) if c in fresh else F.col(c) for c in old.columns])
    return held.unionByName(old.join(new.select(*keys), keys, "left_anti")).unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete_nodes(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without ids, and edges with neither end in ids."""
    gone = ids.select("id").distinct()
    e = edges.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti")
    return entities.join(gone, "id", "left_anti"), e


def delete_unresolved(unresolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Unresolved references without those of the given sources (id)."""
    return unresolved.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti")


def stale_paths(listed: DataFrame, known: DataFrame, most: int = 100, verify: bool = False) -> DataFrame:
    """path, why of files that differ from what is known: missing, new, or changed in size, time or, if verify, hash; the first `most` by path."""
    cols = ["size", "mtime"] + (["content_hash"] if verify else [])
    j = known.select("path", F.struct(*cols).alias("k")).join(listed.select("path", F.struct(*cols).alias("l")), "path", "full")
    why = F.when(F.col("l").isNull(), "missing").when(F.col("k").isNull(), "new").when(~F.col("k").eqNullSafe(F.col("l")), "changed")
    return j.select("path", why.alias("why")).where("why is not null").orderBy("path").limit(most)


def to_embed(inputs: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose key no stored vector has."""
    return inputs.join(stored.select(*keys).distinct(), keys, "left_anti")


def freshness(listed: DataFrame, known: DataFrame) -> DataFrame:
    """One row: files that are missing, changed in size or time, or new."""
    j = known.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.lit(1).alias("k")).join(listed.select("path", "size", "mtime", F.lit(1).alias("l")), "path", "full")
    return j.agg(
        F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("k").isNull()).alias("new"),
        F.count_if((F.col("k") == 1) & (F.col("l") == 1) & ((F.col("s") != F.col("size")) | (F.col("m") != F.col("mtime")))).alias("changed"),
    )
