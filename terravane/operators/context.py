"""Packing evidence under a token budget, and evidence cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def pack(items: DataFrame, budget: int, reserve: int = 120) -> DataFrame:
    """group, rank, id, cost, kept: items (group, rank, id, cost) taken in order of rank; one too dear is skipped, later ones may fit.

    The fold is an aggregate over each group's ordered array, so it stays JVM-side; a group is one request's bounded result list.
    """
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))
    most = F.lit(max(0, budget - reserve)).cast("long")

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= most
        return F.struct((s["used"] + F.when(fits, x["cost"]).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(s["kept"], F.array(fits)).alias("kept"))

    rows = items.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("cost").cast("long").alias("cost")))).alias("xs"))
    rows = rows.withColumn("kept", F.aggregate("xs", state, step)["kept"])
    return rows.select("group", F.explode(F.arrays_zip("xs", "kept")).alias("z")).select("group", "z.xs.rank", "z.xs.id", "z.xs.cost", "z.kept")


def evidence_key(field: Column, item: Column) -> Column:
    """Hash of a field's name and an item's canonical JSON."""
    return F.sha2(F.concat(field, F.lit("\0"), item).cast("binary"), 256)


def encode_cursor(keys: Column, most: int = 512) -> Column:
    """The last keys as base64url JSON."""
    text = F.base64(F.to_json(F.slice(keys, F.greatest(F.lit(1), F.size(keys) - most + 1), most)).cast("binary"))
    return F.translate(F.regexp_replace(text, r"[\r\n=]", ""), "+/", "-_")


def decode_cursor(cursor: Column) -> Column:
    """Keys of a cursor; anything that is not one gives none."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def undelivered(items: DataFrame, delivered: DataFrame, session: str, key: str) -> DataFrame:
    """Items whose key their session has not had yet, each key once, the earliest."""
    new = items.join(delivered, [session, key], "left_anti")
    cols = [c for c in new.columns if c not in (session, key)]
    return new.groupBy(session, key).agg(F.min(F.struct(*cols)).alias("x")).select(session, key, "x.*")


def excerpt(text: Column, start_line: Column, lines: int = 60, most: int = 2400) -> Column:
    """Lines of a text from a 1-based line on, cut at most characters."""
    return F.left(F.array_join(F.slice(F.split(text, "\n"), F.greatest(F.lit(1), start_line), lines), "\n"), F.lit(most))


def without_contained(spans: DataFrame) -> DataFrame:
    """group, start, end, text of the spans whose text is in no span kept before, by start and then the longer first."""
    order = F.struct("start", (-F.col("end")).alias("back"), "text")
    rows = spans.groupBy("group").agg(F.array_sort(F.collect_list(order)).alias("xs"))
    none = F.slice("xs", 1, 0)
    kept = F.aggregate("xs", none, lambda s, x: F.when(F.exists(s, lambda y: F.contains(y["text"], x["text"])), s).otherwise(F.concat(s, F.array(x))))
    rows = rows.select("group", F.explode(kept).alias("x"))
    return rows.select("group", "x.start", (-F.col("x.back")).alias("end"), "x.text")


def attach_notes(notes: DataFrame, budget: int, reserve: int = 80, overhead: int = 28) -> DataFrame:
    """group, rank, id, text, cost of the notes (group, rank, id, text) that fit the budget, in order of rank.

    A note costs its tokens and an overhead. The first that does not fit whole is cut after a word, or after a line
    break that ends the cut (`\\z`, as `$` also stands before a last line break); later ones go.
    """
    most = F.lit(max(0, budget - reserve))
    cost = (estimate_tokens(F.col("text")) + overhead).cast("long")
    w = W.partitionBy("group").orderBy("rank", "id")
    n = notes.select("group", "rank", "id", "text", cost.alias("cost")).withColumn("before", F.coalesce(F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = most - F.col("before")
    short = F.rtrim(F.regexp_replace(F.left("text", F.greatest(F.lit(0), (room - overhead) * 4).cast("int")), r"[^\t\n\f\r ]*\z", ""))
    n = n.where(room > overhead).withColumn("text", F.when(F.col("cost") <= room, F.col("text")).otherwise(short)).where("text <> ''")
    return n.select("group", "rank", "id", "text", (estimate_tokens(F.col("text")) + overhead).cast("long").alias("cost"))


def linked_tests(targets: DataFrame, links: DataFrame, tests: DataFrame, most_targets: int = 8, most_tests: int = 8, chars: int = 800) -> DataFrame:
    """test_id, text, cost of the tests linked to the first targets (id, rank): each test once, by the best target's rank."""
    first = targets.where(F.col("rank") <= most_targets).join(links, "id").groupBy("test_id").agg(F.min("rank").alias("rank"))
    first = first.orderBy("rank", "test_id").limit(most_tests)
    return first.join(tests, "test_id").select("test_id", "rank", F.left("text", F.lit(chars)).alias("text"), estimate_tokens(F.left("text", F.lit(chars))).alias("cost"))
