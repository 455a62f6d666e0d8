"""Filters of searches and of graph views, as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search_filter(kinds=None, languages=None, roots=None, path_prefixes=None, provenances=None) -> Column:
    """All facets given must hold, any value of a facet will do; provenances test only rows that carry some (graph_provenance)."""
    parts = [F.col(c).isin(*v) for c, v in (("kind", kinds), ("language", languages), ("root_id", roots)) if v]
    if path_prefixes:
        parts.append(reduce(lambda a, b: a | b, (F.startswith("path", F.lit(p)) for p in path_prefixes)))
    if provenances:
        parts.append(F.col("graph_provenance").isNull() | (F.size("graph_provenance") == 0) | F.arrays_overlap("graph_provenance", F.array(*map(F.lit, provenances))))
    return both(parts)


#: What each single-choice facet keeps.
ONLY = {
    "tests": lambda: F.col("kind") == "test",
    "docs": lambda: F.col("kind").isin("document", "section"),
    "media": lambda: F.col("kind").isin("image", "audio", "video"),
    "source": lambda: ~F.col("kind").isin("document", "section", "image", "audio", "video"),
}


def node_facets(kinds=None, languages=None, roots=None, text: str | None = None, root_prefix: str | None = None, community: str | None = None, only: str | None = None, hide_generated: bool = False, hide_external: bool = False) -> Column:
    """Facets left alone pass everything; text is looked for in name, path, kind and language. The hiding ones need is_generated and is_external."""
    parts = [F.coalesce(~F.col(c), F.lit(True)) for c, on in (("is_generated", hide_generated), ("is_external", hide_external)) if on]
    parts += [F.startswith(F.coalesce("path", F.lit("")), F.lit(root_prefix))] if root_prefix else []
    parts += [F.col("community").eqNullSafe(F.lit(community))] if community is not None else []
    parts += [ONLY[only]()] if only else []
    parts += [F.col(c).isin(*v) for c, v in (("kind", kinds), ("language", languages), ("root_id", roots)) if v]
    if text:
        parts.append(F.contains(F.lower(F.concat_ws(" ", "name", "path", "kind", "language")), F.lit(text.lower())))
    return both(parts)


def edge_facets(types=None, provenances=None, similarity: float | None = None) -> Column:
    """The similarity floor binds semantic edges only."""
    parts = [F.col(c).isin(*v) for c, v in (("type", types), ("provenance", provenances)) if v]
    if similarity is not None:
        parts.append((F.col("type") != V.SEMANTIC_EDGE_TYPE) | (F.col("confidence") >= similarity))
    return both(parts)


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    n = nodes.select("id").distinct()
    return edges.join(n, F.col("source_id") == F.col("id"), "left_semi").join(n, F.col("target_id") == F.col("id"), "left_semi")


def watched(path: Column) -> Column:
    """Whether a change of a path concerns the index."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit(".git"), F.lit(".terravane"), F.lit("node_modules")))


def needs_embedding(kind: Column, docstring: Column) -> Column:
    """Containers never; files and modules with a docstring of some length; all else."""
    return F.when(kind.isin(*V.CONTAINER_KINDS), False).when(kind.isin("file", "module"), F.char_length(F.coalesce(docstring, F.lit(""))) > 20).otherwise(True)
