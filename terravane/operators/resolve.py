"""Tiered name resolution: each tier is an equi-join, the narrowest tier with a candidate wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.representation import module_candidates


def same_language(a: Column, b: Column) -> Column:
    """Equal, both unknown, or two dialects that call each other."""
    pairs = F.array(*[F.lit(x + "|" + y) for p in V.DIALECTS for x, y in (p, p[::-1])])
    return a.eqNullSafe(b) | F.coalesce(F.array_contains(pairs, F.concat_ws("|", a, b)) & a.isNotNull() & b.isNotNull(), F.lit(False))


def least_of(symbols: DataFrame, *keys: str, most: int) -> DataFrame:
    """The keys and ids, the least `most` targets of each; lists are cut in each task before they are merged."""
    part = symbols.groupBy(*keys, F.pmod(F.xxhash64("target"), F.lit(64)).alias("_p")).agg(F.slice(F.array_sort(F.collect_set("target")), 1, most).alias("ids"))
    return part.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, path: the file that declares each imported module (ref_id, importer, module), by where it may lie.

    Leading dots go up from the importer's folder; the module's place beside the importer comes before that at the
    root, and a suffix before the next. Modules that no file declares have no row.
    """
    dots = F.char_length(F.regexp_extract("module", r"^(\.*)", 1))
    folder = F.filter(F.split(F.regexp_extract("importer", r"^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    up = F.slice(folder, 1, F.greatest(F.lit(0), F.size(folder) - (dots - 1)))
    bare = F.regexp_replace("module", r"^\.+", "")
    absolute = F.array_join(F.filter(F.concat(up, F.array(bare)), lambda x: x != ""), ".")
    rows = imports.select("ref_id", F.when(dots > 0, F.lit("")).otherwise(F.col("importer")).alias("at"), F.when(dots > 0, absolute).otherwise(bare).alias("target"))
    rows = rows.select("ref_id", F.posexplode(module_candidates(F.col("at"), F.col("target"))).alias("place", "path"))
    hit = rows.join(files.select("path").distinct(), "path")
    return hit.groupBy("ref_id").agg(F.min(F.struct("place", "path")).alias("m")).select("ref_id", "m.path")


def unresolved_rows(references: DataFrame) -> DataFrame:
    """id, source_id, name, path, line, type of references to record as unresolved: neither builtins nor parts of self or this."""
    own = F.coalesce(F.col("qualifier"), F.lit("")).isin("self", "this") | F.col("name").isin(*V.BUILTIN_NAMES)
    key = F.concat_ws(":", "path", F.col("line").cast("string"), "name", "type")
    return references.where(~own).select(F.concat(F.lit("unres:"), F.left(F.sha2(key.cast("binary"), 256), F.lit(24))).alias("id"), "source_id", "name", "path", "line", "type")


def resolve(references: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """ref_id, outcome (resolved, ambiguous, unresolved), tier, target_id, candidates.

    references: ref_id, source_id, name, path, language, module (null unless imported); symbols: id, name,
    qualified_name, path, language, module. Tiers: 1 qualified name in the file, 2 name in the file, 3 name in the
    imported module, 4 name in the same language, 5 name in a companion dialect. The source is no candidate.
    Every tier's symbols are gathered by its key first, the least most + 1 of each (one may be the source), so a common
    name costs its references one row a tier and language; at most `most` candidates are listed.
    """
    r = references.where(~F.col("name").isin(*V.BUILTIN_NAMES))
    s = symbols.select(F.col("id").alias("target"), F.col("name").alias("s_name"), "qualified_name", F.col("path").alias("s_path"), F.col("language").alias("s_lang"), F.col("module").alias("s_module"))
    named = r.withColumn("leaf", F.element_at(F.split("name", r"\."), -1))
    few = lambda *keys: least_of(s, *keys, most=most + 1)
    pick = lambda df, tier: df.select("ref_id", F.lit(tier).alias("tier"), F.array_remove("ids", F.col("source_id")).alias("ids"))
    leaf, place, module = F.col("leaf") == F.col("s_name"), F.col("path") == F.col("s_path"), F.col("module") == F.col("s_module")
    language = same_language(F.col("language"), F.col("s_lang"))
    tiers = [
        pick(r.join(few("qualified_name", "s_path"), (F.col("name") == F.col("qualified_name")) & place), 1),
        pick(named.join(few("s_name", "s_path"), leaf & place), 2),
        pick(named.join(few("s_name", "s_module", "s_lang"), leaf & module).where(language), 3),
        pick(named.join(few("s_name", "s_lang"), leaf & F.col("language").eqNullSafe(F.col("s_lang"))), 4),
        pick(named.join(few("s_name", "s_lang"), leaf & language), 5),
    ]
    found = tiers[0]
    for t in tiers[1:]:
        found = found.unionByName(t)
    g = found.where(F.size("ids") > 0).groupBy("ref_id").agg(F.collect_list(F.struct("tier", "ids")).alias("xs")).withColumn("tier", F.array_min(F.col("xs.tier")))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("xs", lambda x: x["tier"] == F.col("tier")), lambda x: x["ids"]))))
    g = g.select("ref_id", "tier", F.size(ids).alias("n"), F.slice(ids, 1, most).alias("candidates"))
    out = r.select("ref_id").join(g, "ref_id", "left")
    return out.select(
        "ref_id", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"),
        "tier", F.when(F.col("n") == 1, F.col("candidates")[0]).alias("target_id"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )
