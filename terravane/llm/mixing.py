"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a seeded hash into blocks of about BLOCK_ROWS. Its target is split into
passes over all its blocks and a rest, which takes blocks in order until it is spent; the block in which that
happens is taken in hash order, its last document in part. The blocks of all passes and of the rest are the
source's units, their number its quota. A binary tree over the output shards splits the quotas: at each node
the left half's units are drawn without replacement from what the node has, so a shard gets an exact number of
each source's units, and all shards a like mixture. The tree is drawn for GROUPS groups of sources first, then
within each group for its sources, whose draws are conditional on the group's. A seeded permutation of a
source's units then gives each shard units that no other has. What a document gives to the mix is the sum over
the drawn units of its block; a shard orders its documents by a seeded hash.

The driver holds GROUPS x shards numbers, whatever the input; sources and documents never leave the executors.

Defined results: null text has no words; a null source is a source, the last; documents without words are
taken 0 words; rows alike in id, source and text are taken alike: where the rest ends among them, each gives the
same number of words. Rows without an id are dealt by their text. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, parts, written

WEIGHTS = (3, 1, 2)
BUDGET_HALVES, MOST = 3, 2  #: The mix has 3 halves of all words; a source gives at most twice its own.
SEED = 20240317
BLOCK_ROWS = 4096  #: Documents a block has on average.
SUPER = 1024  #: Blocks whose words are summed before a source's blocks are.
GROUPS = 64  #: Groups of sources the tree is drawn for first.
MAX_BROADCAST = 100_000  #: Rows up to which a plan of sources or units is broadcast; beyond it is joined by a shuffle.
SALTS = 32  #: Parts of a source's rows in such a join.
WORD = r"[^\x20\x09-\x0D]+"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw of any size: NumPy's where its range allows, else inversion of the distribution from its mode outwards."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high, n = max(0, draws - bad), min(draws, good), good + bad
    log = math.lgamma
    choose = lambda a, b: log(a + 1) - log(b + 1) - log(a - b + 1)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(n, draws))
    left = rng.random() - p
    x = y = mode
    px = py = p
    while left > 0 and (x > low or y < high):
        if y < high:
            py *= (good - y) * (draws - y) / ((y + 1) * (bad - draws + y + 1))
            y += 1
            if (left := left - py) <= 0:
                return y
        if x > low:
            px *= x * (bad - draws + x) / ((good - x + 1) * (draws - x + 1))
            x -= 1
            if (left := left - px) <= 0:
                return x
    return mode


def draw(rng: np.random.Generator, has: list[int], take: int) -> list[int]:
    """How many of each kind are among take units drawn without replacement: the multivariate draw as a chain of plain ones."""
    pool, out = sum(has), []
    for n in has:
        pool -= n
        got = min(n, take) if pool <= 0 else hypergeometric(rng, n, pool, take) if n and take else 0
        out.append(got)
        take -= got
    return out


def split_tree(quotas: list[int], totals: list[int], *seed: int) -> list[list[int]]:
    """Units of each kind for each shard (shards x kinds); shard s has totals[s] units, columns sum to the quotas."""
    out: list[list[int]] = [[] for _ in totals]
    nodes = [(0, len(totals), list(quotas))]
    while nodes:
        lo, hi, has = nodes.pop()
        if hi - lo == 1:
            out[lo] = has
            continue
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng((SEED, *seed, lo, hi)), has, sum(totals[lo:mid]))
        nodes += [(lo, mid, left), (mid, hi, [a - b for a, b in zip(has, left)])]
    return out


def permuted(number: int, quota: int) -> tuple[int, int]:
    """(step, start) of the bijection u -> (step * u + start) mod quota on a source's units."""
    rng = np.random.default_rng((SEED, number, quota))
    step = int(rng.integers(1, max(2, quota)))
    while math.gcd(step, quota) > 1:
        step = step % quota + 1
    return step, int(rng.integers(0, max(1, quota)))


def numbered(sized: DataFrame) -> DataFrame:
    """number (by code point, null last), source, source_size and rows of every source; nothing is sorted in one task."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = [F.col("source").asc_nulls_last()]
    found = found.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id())
    found = written(found.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order))), "sources")
    before, starts = 0, []
    for r in sorted(found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each shuffle partition
        starts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    return found.join(starts, "part").select((F.col("before") + F.col("place") - 1).alias("number"), "source", "source_size", "rows")


def targets(sources: DataFrame) -> DataFrame:
    """sources with target: in the proportion of the weights, none above MOST times its size, the excess reshared.

    Each round sums the sources that are full at the present share, until no more are; the sums are of whole numbers.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("weight", w)
    share, full = 0.0, -1
    while True:
        over = F.lit(share) * F.col("weight") > MOST * F.col("source_size")
        r = s.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("size"), F.sum(F.when(over, F.col("weight"))).alias("wf")).first()
        if r["n"] == full:
            break
        full, rest = r["n"], (r["w"] or 0) - (r["wf"] or 0)
        if not rest:
            break
        share = (BUDGET_HALVES * r["all"] - 2 * MOST * (r["size"] or 0)) / 2 / rest
    return s.withColumn("target", F.when(F.lit(share) * F.col("weight") > MOST * F.col("source_size"), (MOST * F.col("source_size")).cast("double")).otherwise(F.lit(share) * F.col("weight")))


def few(df: DataFrame) -> bool:
    return df.count() <= MAX_BROADCAST


def of_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined with plan, a row for each source; one source may hold a third of the rows."""
    plan = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few(plan):
        return rows.join(F.broadcast(plan), same).drop("_source")
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("chance", F.lit(SALTS)).cast("int")).join(plan, same & (F.col("salt") == F.col("_salt"))).drop("_source", "_salt", "salt")


def rest_edges(at: DataFrame, plan: DataFrame) -> DataFrame:
    """number, edge (the block in which the rest is spent) and before (the words of the blocks that come before it)."""
    sums = at.groupBy("number", "block").agg(F.sum("size").alias("words")).withColumn("over", F.floor(F.col("block") / SUPER))
    sums = written(sums, "sums")
    up_to = lambda *by: F.sum("words").over(W.partitionBy("number", *by[:-1]).orderBy(by[-1])) - F.col("words")
    top = sums.groupBy("number", "over").agg(F.sum("words").alias("words")).withColumn("before", up_to("over"))
    top = top.join(plan.select("number", "rest"), "number").where("before <= rest").groupBy("number").agg(F.max_by(F.struct("over", "before", "rest"), "over").alias("t")).select("number", "t.*")
    inner = sums.join(top.withColumnRenamed("before", "ahead"), ["number", "over"])
    inner = inner.withColumn("before", F.col("ahead") + up_to("over", "block")).where("before <= rest")
    return inner.groupBy("number").agg(F.max_by(F.struct("block", "before"), "block").alias("e")).select("number", F.col("e.block").alias("edge"), F.col("e.before").alias("before"))


UNITS = "number long, shard int, at long, n long, step long, start long, quota long"


def drawn(quotas: DataFrame, shards: int) -> DataFrame:
    """The tree's draw (number, shard, at, n): shard has the n units of a source from place at on, of its permuted units."""
    grouped = quotas.where("quota > 0").withColumn("group", F.pmod(F.xxhash64("number"), F.lit(GROUPS)).cast("int"))
    got = {r["group"]: r["quota"] for r in grouped.groupBy("group").agg(F.sum("quota").alias("quota")).collect()}  # GROUPS rows at most
    has = [got.get(g, 0) for g in range(GROUPS)]
    total = sum(has)
    even = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    table = split_tree(has, even, GROUPS)
    shares = {g: [row[g] for row in table] for g in got}

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number")
        numbers, has, group = frame["number"].tolist(), frame["quota"].tolist(), int(frame["group"].iloc[0])
        at, out = [0] * len(has), []
        turns = [permuted(n, q) for n, q in zip(numbers, has)]
        for shard, row in enumerate(split_tree(has, shares[group], group)):
            for i, n in enumerate(row):
                if n:
                    out.append((numbers[i], shard, at[i], n, *turns[i], has[i]))
                    at[i] += n
        return pd.DataFrame(out, columns=[c.split()[0] for c in UNITS.split(", ")])

    return grouped.select("group", "number", "quota").groupBy("group").applyInPandas(within, UNITS)


def chance():
    """The seeded hash that deals a row; rows alike in id, source and text have the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"), F.lit(SEED))


def mixed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, chance, block, copies of every document.

    copies lists (shard, place, words): the parts of the mix that the document's drawn units give; their words sum to taken.
    """
    spark = docs.sparkSession
    shards = shards or parts(spark)
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.alias("size"), chance().alias("chance")), "sized")
    plan = targets(numbered(sized))
    due = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(due / F.greatest("source_size", F.lit(1)))).otherwise(0)).withColumn("rest", due - F.col("passes") * F.col("source_size"))
    plan = written(plan.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)).drop("rows", "weight"), "plan")
    at = of_source(sized, plan).withColumn("block", F.pmod("chance", F.col("blocks")))
    edges = written(rest_edges(at, plan), "edges")
    quotas = plan.join(edges, "number").withColumn("quota", F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, F.col("edge") + 1).otherwise(0))
    # Place p of a source's permutation holds unit u with step * u + start = p; unit u is block u % blocks of pass u / blocks.
    places = drawn(quotas.select("number", "quota"), shards).withColumn("p", F.explode(F.expr("sequence(at, at + n - 1)")))
    inverse = F.pandas_udf(lambda a, m: pd.Series([pow(int(x), -1, int(y)) if y > 1 else 0 for x, y in zip(a, m)]), "long")
    unit = F.expr("pmod(cast(back as decimal(20,0)) * pmod(p - start, quota), cast(quota as decimal(20,0)))").cast("long")
    units = places.withColumn("back", inverse("step", "quota")).withColumn("u", unit).join(plan.select("number", "blocks"), "number")
    units = units.select("number", (F.col("u") % F.col("blocks")).alias("block"), F.floor(F.col("u") / F.col("blocks")).alias("pass"), "shard")
    units = written(units.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("units")), "units")  # MOST + 1 to a block at most
    # In the block in which the rest ends, rows alike share what is due to them evenly.
    near = F.broadcast if few(edges) else lambda x: x
    inside = at.join(near(edges.join(plan.select("number"), "number")), "number").where("block = edge and rest > 0 and size > 0")
    alike = inside.groupBy("number", "chance", "size", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum(F.col("size") * F.col("n")).over(W.partitionBy("number").orderBy("chance", "size").rowsBetween(W.unboundedPreceding, -1))
    alike = alike.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(run, F.lit(0))).where("left > 0")
    alike = alike.select("number", "chance", "size", F.least("size", F.floor(F.col("left") / F.col("n"))).alias("part"))
    out = at.join(near(edges.select("number", "edge")), "number")
    out = out.join(F.broadcast(units) if few(units) else units, ["number", "block"], "left").join(alike, ["number", "chance", "size"], "left")
    words = F.when((F.col("edge") == F.col("block")), F.coalesce("part", F.lit(0))).otherwise(F.col("size"))
    copy = lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64("chance", x["pass"], F.lit(SEED + 1)).alias("place"), F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(words).cast("long").alias("words"))
    copies = F.coalesce(F.filter(F.transform("units", copy), lambda x: x["words"] > 0), F.array().cast("array<struct<shard:int,place:long,words:long>>"))
    out = out.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "chance", "block", "copies")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in the columns of docs: a row for each copy of a document; where words are cut, the text's first ones.

    A partition holds whole shards, each in the order of its places. Rows alike in id, source and text give the same
    copies; documents of which no word is taken, among them those without words or text, are not in the mix. Extra columns
    keep their names and values, an empty table gives none, and a very long text is one row of one task.
    """
    taken = mixed(docs).where(F.size("copies") > 0).select(F.col("doc_id").alias("_doc_id"), F.col("chance").alias("_chance"), "size", "copies")
    taken = taken.groupBy("_doc_id", "_chance").agg(F.max("size").alias("_size"), F.max("copies").alias("_copies"))
    # Each row goes as one column, so that columns of whatever name stay what they are.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"), chance().alias("_here"))
    rows = rows.join(taken, F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_here") == F.col("_chance"))).withColumn("_part", F.explode("_copies"))
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("_part.words").cast("int")), "")
    text = F.when(F.col("_part.words") >= F.col("_size"), F.col("_row.text")).otherwise(lead)
    out = rows.withColumn("_row", F.col("_row").withField("text", text)).repartition(parts(spark), F.col("_part.shard")).sortWithinPartitions("_part.shard", "_part.place")
    return out.select("_row.*")
