"""What imported names stand for: the closure of a module-export graph, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .graph import numbered
from .resolve import module_files

ROUNDS = 64  #: Re-exports in a row that are followed.
BITS = 64  #: Definitions of a word.
MAX_BROADCAST = 100_000  #: Definitions up to which they are broadcast.


def targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, alias, target_path, target_name, place: where a file's bindings lead.

    imports: path (the importer), alias, module, and name, which is null where the module itself is bound and `*` where
    all its names are (alias `*`, target_name null). A name may also be a module inside the one named; that is a second
    way, of place 1, with no target_name. Modules that no file declares lead nowhere.
    """
    rows = imports.select("path", "alias", "module", "name").distinct()
    rows = cut(rows.withColumn("ref_id", F.sha2(F.to_json(F.struct("path", "alias", "module", "name")), 256)), "imports")
    own = F.concat(F.regexp_replace("module", r"([^.])$", "$1."), F.col("name"))
    ways = rows.select("ref_id", F.lit(0).alias("place"), F.col("path").alias("importer"), "module").unionByName(
        rows.where("name <> '*'").select("ref_id", F.lit(1).alias("place"), F.col("path").alias("importer"), own.alias("module")))
    keyed = ways.withColumn("ref_id", F.concat_ws(":", "ref_id", "place"))
    at = module_files(keyed, files).select(F.split("ref_id", ":")[0].alias("ref_id"), F.split("ref_id", ":")[1].cast("int").alias("place"), F.col("path").alias("target_path"))
    name = F.when((F.col("place") == 0) & (F.col("name") != "*"), F.col("name"))
    return at.join(rows, "ref_id").select("path", "alias", "target_path", name.alias("target_name"), "place").distinct()


def closure(starts: DataFrame, bindings: DataFrame, definitions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """path, name, def_path, def_name: the definitions that a name (path, name) of a file leads to.

    definitions (path, name) end a way. A name that its file does not define is followed through the file's bindings
    (path, alias, target_path, target_name) of it, and where there are none through its `*` bindings.

    First each name that some start reaches is followed once, which gives the steps between names. Then the
    definitions reached are numbered, and sets of them, 64 a word, go back over the steps; each round sends what the last one
    added alone, so cycles end. Names that no step leads to take part in the last round only. Pairs are made at the end.
    """
    at, key = ["at_path", "at_name"], ["at_path", "at_name", "target_path", "target_name"]
    named = bindings.where("alias <> '*' and target_name is not null").select(F.col("path").alias("at_path"), F.col("alias").alias("at_name"), "target_path", "target_name").distinct()
    stars = bindings.where("alias = '*'").select(F.col("path").alias("at_path"), "target_path").distinct()
    ends = definitions.select(F.col("path").alias("at_path"), F.col("name").alias("at_name")).distinct()
    starts = cut(starts.select(F.col("path").alias("at_path"), F.col("name").alias("at_name")).distinct(), "names")
    new, seen, steps = starts, starts, None
    for _ in range(rounds):
        open_ = new.join(ends, at, "left_anti")
        by_name = open_.join(named, at).select(*key)
        by_star = open_.join(named.select(*at), at, "left_anti").join(stars, "at_path").select("at_path", "at_name", "target_path", F.col("at_name").alias("target_name"))
        found = cut(by_name.union(by_star).distinct(), "steps")
        steps = found if steps is None else steps.union(found)
        new = cut(found.select(F.col("target_path").alias("at_path"), F.col("target_name").alias("at_name")).distinct().join(seen, at, "left_anti"), "names")
        if new.isEmpty():
            break
        seen = seen.union(new)
    ends = numbered(ends.join(seen, at, "left_semi"), *map(F.asc, at)).select(*at, F.floor(F.col("number") / BITS).alias("word"), (F.col("number") % BITS).cast("int").alias("bit"))
    ends = cut(ends, "ends")
    own = ends.groupBy(*at, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    if steps is None:
        steps = starts.select(*at, F.col("at_path").alias("target_path"), F.col("at_name").alias("target_name")).limit(0)
    to = steps.select(F.col("target_path").alias("at_path"), F.col("target_name").alias("at_name")).distinct()
    inner = cut(steps.join(to, at, "left_semi"), "inner")
    back = lambda ways, sets: ways.join(sets.toDF("target_path", "target_name", "word", "bits"), ["target_path", "target_name"]).groupBy(*at, "word").agg(F.bit_or("bits").alias("bits"))
    known = new = own
    for _ in range(rounds - 1):
        got = back(inner, new).join(known.withColumnRenamed("bits", "had"), [*at, "word"], "left")
        new = cut(got.select(*at, "word", F.expr("bits & ~coalesce(had, 0L)").alias("bits")).where("bits <> 0"), "sets")
        if new.isEmpty():
            break
        known = cut(known.union(new).groupBy(*at, "word").agg(F.bit_or("bits").alias("bits")), "known")
    reached = known if rounds < 1 else back(steps.join(starts, at, "left_semi"), known)
    reached = reached.union(own.join(starts, at, "left_semi"))  # an end has no steps
    table = ends.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("at_path").alias("def_path"), F.col("at_name").alias("def_name"))).alias("ends"))
    table = F.broadcast(table) if ends.count() <= MAX_BROADCAST else table
    rows = reached.join(table, "word").select(*at, F.explode(F.filter("ends", lambda x: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])) != 0)).alias("x"))
    return rows.select(F.col("at_path").alias("path"), F.col("at_name").alias("name"), "x.def_path", "x.def_name")
