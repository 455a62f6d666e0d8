"""Bi-temporal notes: revisions, lexical score, visibility, preferences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions.text import has_secret, holds_forms, matches_forms, preferences, preferences_conflict, query_terms, term_forms, word_line


def history(versions: DataFrame, key: str, start: str, version: str) -> DataFrame:
    """versions with valid_to, superseded_by and current: each interval ends where the next of its key begins."""
    w = W.partitionBy(key).orderBy(start, version)
    return versions.withColumn("valid_to", F.lead(start).over(w)).withColumn("superseded_by", F.lead(version).over(w)).withColumn("current", F.col("superseded_by").isNull())


def as_of(revisions: DataFrame, start: str, when) -> DataFrame:
    """Revisions that hold at a moment."""
    return revisions.where((F.col(start) <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def merge(current: DataFrame, incoming: DataFrame, key: str, payload: list[str], start: str) -> DataFrame:
    """Apply incoming (key, payload, start) to versions: an unchanged payload adds nothing, a changed one a version that starts later than the last."""
    last = current.groupBy(key).agg(F.max_by(F.struct(*payload), start).alias("p"), F.max(start).alias("s"))
    new = incoming.join(last, key, "left").where(F.col("p").isNull() | ~F.struct(*payload).eqNullSafe(F.col("p")))
    new = new.withColumn(start, F.greatest(F.col(start), F.coalesce(F.col("s") + 1, F.col(start)))).select(*current.columns)
    return current.unionByName(new)


def forget(versions: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return versions.join(ids.select(key).distinct(), key, "left_anti")


def visible(notes: DataFrame, scope: str, project: str | None) -> DataFrame:
    """Notes of a scope: user, project, or all that a project sees."""
    user, own = F.col("scope") == "user", (F.col("scope") == "project") & F.col("project_key").eqNullSafe(F.lit(project))
    return notes.where({"user": user, "project": own}.get(scope, user | own))


def lexical_score(notes: DataFrame, query: str) -> DataFrame:
    """id, lexical: matched share of the query's words, more for a word of a tag or the kind, and for the words in a row."""
    q = query_terms(F.lit(query))
    asked = notes.sparkSession.sql("SELECT 1").select(q.alias("q"), F.transform(q, term_forms).alias("forms")).first()
    if not asked["q"]:
        return notes.select("id", F.lit(0.0).alias("lexical")).limit(0)
    label = F.array_union(F.coalesce(F.transform("tags", lambda t: F.lower(t)), F.array().cast("array<string>")), F.array(F.lower("kind")))
    n = notes.select("id", F.lower(F.coalesce("content", F.lit(""))).alias("plain"), label.alias("label"))
    # Only texts that hold the first letters of some form are cut into words.
    heads = dict.fromkeys(v[:5] for forms in asked["forms"] for v in forms)
    n = n.select("id", "label", F.when(reduce(lambda a, b: a | b, [F.contains("plain", F.lit(h)) for h in heads]), word_line(F.col("plain"))).otherwise("").alias("line"))
    points = [F.when(matches_forms(F.array(*map(F.lit, forms)), F.col("label")), 1.25).when(holds_forms(forms, F.col("line")), 1.0).otherwise(0.0) for forms in asked["forms"]]
    phrase = F.contains("line", F.lit(f" {' '.join(asked['q'])} ")) & F.lit(len(points) > 1)
    score = reduce(lambda a, b: a + b, points) / len(points) + F.when(phrase, 0.2).otherwise(0.0)
    # Not a filter: that would be moved below the steps before it, and work out the words anew for each place it looks at them.
    return n.select("id", F.explode(F.filter(F.array(F.round(score, 6)), lambda x: x > 0)).alias("lexical"))


def hybrid_score(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """id, score, lexical, similarity. Where some word match is strong, vectors are not asked; weak rows of both go.

    A note that no vector found keeps its words' score whole.
    """
    strong = lexical.agg(F.coalesce(F.max("lexical") >= V.STRONG_WORDS, F.lit(False)).alias("strong"))
    rows = lexical.join(semantic, "id", "full").crossJoin(F.broadcast(strong))  # one row
    sim = F.when(F.col("strong") | (F.col("similarity") < V.LEAST_SIMILARITY), None).otherwise(F.col("similarity"))
    rows = rows.select("id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), sim.alias("similarity"), "strong")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("similarity", F.lit(0.0)) - V.SIMILARITY_START) / V.SIMILARITY_SPAN))
    both = V.WORDS_SHARE * F.col("lexical") + V.VECTOR_SHARE * scaled
    score = F.when(F.col("strong") | F.col("similarity").isNull(), F.col("lexical")).otherwise(both)
    keep = (F.col("lexical") >= V.LEAST_WORDS) | (F.coalesce("similarity", F.lit(0.0)) >= V.ENOUGH_SIMILARITY)
    return rows.where(keep).select("id", F.round(score, 6).alias("score"), "lexical", "similarity")


def captured_preferences(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages' columns and statement: the lasting preferences each states, without those that hold a secret."""
    return messages.withColumn("statement", F.explode(preferences(F.col(text)))).where(~has_secret(F.col("statement")))


def normalised_content(content: Column) -> Column:
    """White space collapsed, lower case: what makes two notes the same."""
    return F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))


def note_hash(content: Column) -> Column:
    return F.sha2(normalised_content(content).cast("binary"), 256)


def problem(content: Column, scope: Column, kind: Column, tags: Column) -> Column:
    """Why a note cannot be stored, or null."""
    body = F.trim(F.coalesce(content, F.lit("")))
    return (
        F.when(~F.coalesce(scope, F.lit("")).isin(*V.NOTE_SCOPES), "scope").when(~F.coalesce(kind, F.lit("")).isin(*V.NOTE_KINDS), "kind").when(body == "", "empty")
        .when(F.char_length(body) > V.NOTE_CHARS, "long").when(F.coalesce(has_secret(body), F.lit(False)), "secret")
        .when(F.size(tags) > V.NOTE_TAGS, "tags").when(F.exists(tags, lambda t: F.char_length(t) > V.NOTE_TAG_CHARS), "tag")
    )


NOTE = ["id", "scope", "project_key", "kind", "content", "content_hash", "tags", "provenance", "valid_from", "updated_at"]


def add_notes(notes: DataFrame, incoming: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(notes, closed revisions) after adding incoming (scope, project_key, kind, content, tags, provenance).

    A note is known by scope, project and normalised content. An unknown one gets an id of these; a known one whose
    kind or tags differ, or that has no provenance yet and is given one, starts a new revision and closes the old one.
    Of incoming rows that are the same note the one least in order counts.
    """
    key = ["scope", "project_key", "content_hash"]
    new = incoming.withColumn("content", F.trim("content")).withColumn("project_key", F.when(F.col("scope") == "user", "").otherwise(F.coalesce("project_key", F.lit("")))).withColumn("content_hash", note_hash(F.col("content")))
    new = new.groupBy(*key).agg(F.min(F.struct("kind", "tags", "provenance", "content")).alias("n"))
    both = notes.select(*key, F.struct(*notes.columns).alias("o")).join(new, key, "full")
    given = F.coalesce("n.provenance", F.lit(""))
    held = F.coalesce("o.provenance", F.lit(""))
    provenance = F.when((given != "") & (held == ""), given).otherwise(held)
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & (~F.col("o.kind").eqNullSafe(F.col("n.kind")) | ~F.col("o.tags").eqNullSafe(F.col("n.tags")) | (provenance != held))
    start = F.greatest(F.lit(now).cast("long"), F.col("o.valid_from") + 1)
    fresh = F.col("o").isNull()
    pick = lambda c: F.when(fresh | changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    both = both.withColumn("changed", changed)
    out = both.select(
        F.when(fresh, F.concat(F.lit("mem_"), F.left(F.sha2(F.concat_ws("\x1f", *key).cast("binary"), 256), F.lit(20)))).otherwise(F.col("o.id")).alias("id"), "scope", "project_key", pick("kind").alias("kind"),
        F.when(fresh, F.col("n.content")).otherwise(F.col("o.content")).alias("content"), "content_hash", pick("tags").alias("tags"), F.when(fresh, given).when(F.col("changed"), provenance).otherwise(held).alias("provenance"),
        F.when(fresh, F.lit(now).cast("long")).when(F.col("changed"), start).otherwise(F.col("o.valid_from")).alias("valid_from"), F.when(fresh, F.lit(now).cast("long")).when(F.col("changed"), start).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    closed = both.where("changed").select("o.id", "o.content", "o.kind", "o.tags", "o.provenance", "o.valid_from", start.alias("valid_to"))
    return out.select(*NOTE), closed


def best_first() -> list[Column]:
    """The order of found notes: score, words, vector (none lowest), the project's own first, the latest, the content."""
    return [F.desc("score"), F.desc("lexical"), F.coalesce("similarity", F.lit(-1.0)).desc(), (F.col("scope") == "project").desc(), F.desc("updated_at"), F.lower("content").desc(), F.col("id")]


def recent(notes: DataFrame, limit: int) -> DataFrame:
    return notes.orderBy(F.desc("updated_at"), "id").limit(limit)


def contradicted(notes: DataFrame, statements: DataFrame) -> DataFrame:
    """Pairs (id, statement_id) of a stored preference and a new statement of the same scope and project that take opposite sides.

    Candidates meet in an equi-join on the pair of opposed words and the side each takes.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("own"), F.lit(b).alias("other")) for i, p in enumerate(V.OPPOSED_WORDS) for a, b in (p, p[::-1])])

    def taking(df: DataFrame, text: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\w'-]+"), F.lit(0))
        return df.withColumn("w", words).withColumn("s", F.explode(sides)).where(F.array_contains("w", F.col("s.own")) & ~F.array_contains("w", F.col("s.other")))

    a = taking(notes, "content").select("id", "scope", "project_key", F.col("content").alias("old"), "s.pair", "s.own", "s.other")
    b = taking(statements, "statement").select("statement_id", "scope", "project_key", "statement", "s.pair", F.col("s.other").alias("own"))
    return a.join(b, ["scope", "project_key", "pair", "own"]).where(preferences_conflict(F.col("old"), F.col("statement"))).select("id", "statement_id").distinct()


def without_vectors(notes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Notes that no vector of the model stands for, or only one of another content; the latest first."""
    held = vectors.where(F.col("model") == model).select("id", "content_hash")
    return notes.join(held, ["id", "content_hash"], "left_anti").orderBy(F.desc("updated_at"), "id")
