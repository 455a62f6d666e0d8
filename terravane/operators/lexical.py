"""Lexical retrieval: postings, weighted BM25 over phrases, boolean match, exact match."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions.identity import normalize_path
from ..functions.text import TERM, terms
from .checkpoints import cut
from .term_index import TermIndex, token_columns


def folding() -> tuple[str, str]:
    """Letters with marks and what they fold to, by their decomposition; the marks themselves fold to nothing."""
    pairs = []
    for c in map(chr, (*range(0x80, 0x250), *range(0x1E00, 0x1F00))):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(map(unicodedata.combining, d[1:])):
            pairs.append((c, d[0]))
    return "".join(p[0] for p in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p[1] for p in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(plain) == F.char_length(plain), plain).otherwise(F.translate(plain, *folding()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0))


def phrases_of(question: Column) -> Column:
    """The phrases of a question: each word's tokens in a row, so that `user_id` asks for user and id side by side; stop words go."""
    stop = F.array(*map(F.lit, V.STOPWORDS))
    words = F.filter(F.split(fold(question), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(TERM), F.lit(0))), lambda p: F.size(p) > 0))


def tokenised(docs: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    """id, length and the tokens of each weighted column; every text is cut once, and the result written."""
    t = token_columns(docs, id_col, list(weights))
    return cut(t.withColumn("length", sum((F.size(f"t{i}") for i in range(len(weights))), F.lit(0))), "tokens")


def postings(docs: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    """id, term, tf (weighted over columns) and length (tokens of all columns): the index that is kept with a snapshot."""
    t = tokenised(docs, id_col, weights)
    return occurrences(t, weights).groupBy("id", "length", "term").agg(F.sum("w").alias("tf"))


def occurrences(t: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id, length, w, term of every token."""
    each = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(f"t{i}").alias("ts")) for i, w in enumerate(weights.values())])
    return t.select("id", "length", F.explode(each).alias("c")).select("id", "length", "c.w", F.explode("c.ts").alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, weights: dict[str, float], k: int, keep: Column | None = None, match: str = "or") -> DataFrame:
    """query_id, id, score, matched, rank of the k best documents of each query (query_id, and term or terms, a phrase).

    keep tells which documents may be found; it is applied before the k best are taken and leaves the statistics alone.
    match: `or`, or `and_or` for all phrases where some document that may be found has them, else any. The documents are
    indexed first; keep a TermIndex where more questions follow.
    """
    kept = None if keep is None else docs.where(F.coalesce(keep, F.lit(False))).select(F.col(id_col).alias("id"))
    return TermIndex.of(docs, id_col, weights).search(queries, k, kept, match)


def and_or(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents that hold all terms of a query; where none does, those that hold any. One pass with a window."""
    q = queries.select("query_id", "term").distinct()
    need = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    d = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    hit = d.join(q, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("matched"))
    full = hit.join(need, "query_id").withColumn("all", F.max(F.col("matched") == F.col("need")).over(W.partitionBy("query_id")))
    return full.where(~F.col("all") | (F.col("matched") == F.col("need"))).select("query_id", "id", "matched", F.when(F.col("all"), "and").otherwise("or").alias("mode"))


def exact_matches(entities: DataFrame, references: DataFrame, most: int = 50) -> DataFrame:
    """ref, id, exact_name, exact_path: equi-joins of each way a reference can name an entity, merged by the greatest.

    A path, which holds a slash or ends as source files do, names the entity that has it (1.0) or one whose path ends
    with it after a slash (0.8); otherwise the qualified name (1.0) or the last dotted segment as a bare name (0.9).
    Dots and slashes before a path don't count.
    """
    r = references.select("ref", F.trim("ref").alias("r"))
    code = "|".join(V.LANGUAGE_EXTENSIONS)
    is_path = F.col("r").contains("/") | F.lower("r").rlike(rf"\.({code})$")
    r = r.withColumn("r", F.when(is_path, normalize_path(F.regexp_replace("r", r"^[./\\]+", ""))).otherwise(F.col("r"))).withColumn("is_path", is_path)
    is_path = F.col("is_path")
    paths, names = r.where(is_path), r.where(~is_path)
    tail = F.slice(F.split("path", "/"), -1, 1)[0]
    e = entities.select("id", "name", "qualified_name", "path", tail.alias("tail"))
    zero = F.lit(0.0)
    found = [
        paths.join(e, F.col("r") == F.col("path")).select("ref", "id", zero.alias("n"), F.lit(1.0).alias("p")),
        paths.withColumn("leaf", F.element_at(F.split("r", "/"), -1)).join(e, F.col("leaf") == F.col("tail")).where(F.endswith("path", F.concat(F.lit("/"), F.col("r")))).select("ref", "id", zero.alias("n"), F.lit(0.8).alias("p")),
        names.join(e, F.col("r") == F.col("qualified_name")).select("ref", "id", F.lit(1.0).alias("n"), zero.alias("p")),
        names.withColumn("leaf", F.element_at(F.split("r", r"\."), -1)).join(e, F.col("leaf") == F.col("name")).select("ref", "id", F.lit(0.9).alias("n"), zero.alias("p")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.groupBy("ref", "id").agg(F.max("n").alias("exact_name"), F.max("p").alias("exact_path"))
    rank = F.row_number().over(W.partitionBy("ref").orderBy(F.desc(F.greatest("exact_name", "exact_path")), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most)


def term_stats(docs: DataFrame, text: Column) -> DataFrame:
    """term, df, cf of every term."""
    d = docs.select(F.monotonically_increasing_id().alias("d"), text.alias("t")).select("d", F.explode(terms(F.col("t"))).alias("term"))
    d = d.groupBy("d", "term").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
