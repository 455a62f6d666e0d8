"""Notes kept with an index: add, list, search, update, history, forget, status, preferences, vectors."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions.vectors import cosine
from ..operators import memory as M
from ..operators.checkpoints import cut
from ..operators.vector import hashing_embedding
from ..sources.snapshots import SnapshotStore

NOTES = "id string, scope string, project_key string, kind string, content string, content_hash string, tags array<string>, provenance string, valid_from long, updated_at long"
CLOSED = "id string, content string, kind string, tags array<string>, provenance string, valid_from long, valid_to long"
VECTORS = "id string, content_hash string, model string, vector array<double>"
MODEL = "hashing-64"


class MemoryStore:
    """Tables memories, revisions and memory_vectors of a snapshot store; every change is one commit.

    embed gives a note's or question's vector as a column; relevant, if given, is asked which found notes answer a
    question (a function of the DataFrame), and by default all do.
    """

    def __init__(self, spark: SparkSession, store: SnapshotStore, project: str, embed=hashing_embedding, model: str = MODEL, relevant=None):
        self.spark, self.store, self.project, self.embed, self.model, self.relevant = spark, store, project, embed, model, relevant

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if name in self.store.current()[1] else self.spark.createDataFrame([], schema)

    def notes(self, scope: str = "all") -> DataFrame:
        if scope not in (*V.NOTE_SCOPES, "all"):
            raise ValueError("a scope is project, user or all")
        return M.visible(self._table("memories", NOTES), scope, self.project)

    def add_all(self, incoming: DataFrame, now: int | None = None) -> None:
        """Add notes (scope, kind, content, tags, provenance); any that cannot be stored stops the whole batch."""
        rows = incoming.withColumn("project_key", F.lit(self.project)).withColumn("tags", F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")))
        bad = rows.select(M.problem(F.col("content"), F.col("scope"), F.col("kind"), F.col("tags")).alias("p")).where("p is not null").first()
        if bad:
            raise ValueError(f"a note cannot be stored: {bad['p']}")
        notes, closed = M.add_notes(self._table("memories", NOTES), rows, now or int(time.time()))
        self.store.commit({"memories": notes, "revisions": self._table("revisions", CLOSED).unionByName(closed)})

    def add(self, content: str, scope: str = "project", kind: str = "fact", tags=(), provenance: str = "", now: int | None = None) -> str:
        """The id of the note, new or known."""
        row = self.spark.createDataFrame([(scope, kind, content, list(tags), provenance)], "scope string, kind string, content string, tags array<string>, provenance string")
        self.add_all(row, now)
        return self.notes().where((F.col("scope") == scope) & (F.col("content_hash") == M.note_hash(F.lit(content)))).first()["id"]

    def list(self, scope: str = "all", limit: int = 50) -> DataFrame:
        if not 1 <= limit <= V.NOTE_RESULTS:
            raise ValueError(f"a limit is between 1 and {V.NOTE_RESULTS}")
        return M.recent(self.notes(scope), limit)

    def get(self, note_id: str):
        return self.notes().where(F.col("id") == note_id).first()

    def history(self, note_id: str) -> DataFrame:
        """Former versions of a visible note and the present one, oldest first."""
        now = self.notes().where(F.col("id") == note_id).select("id", "content", "kind", "tags", "provenance", "valid_from", F.lit(None).cast("long").alias("valid_to"))
        return self._table("revisions", CLOSED).join(now.select("id"), "id", "left_semi").unionByName(now).orderBy("valid_from")

    def update(self, note_id: str, content: str | None = None, kind: str | None = None, tags=None, provenance: str | None = None, now: int | None = None) -> None:
        old = self.get(note_id)
        if old is None or (content is None and kind is None and tags is None):
            raise ValueError("nothing to update")
        content, kind, tags, provenance = content if content is not None else old["content"], kind or old["kind"], list(tags) if tags is not None else old["tags"], provenance or old["provenance"]
        new = self.spark.createDataFrame([(content.strip(), kind, tags, provenance)], "content string, kind string, tags array<string>, provenance string")
        bad = new.select(M.problem(F.col("content"), F.lit(old["scope"]), F.col("kind"), F.col("tags")).alias("p")).first()["p"]
        if bad:
            raise ValueError(f"a note cannot be stored: {bad}")
        if (content.strip(), kind, tags, provenance) == (old["content"], old["kind"], old["tags"], old["provenance"]):
            return
        at = max(now or int(time.time()), old["valid_from"] + 1)
        rows = self._table("memories", NOTES)
        fresh = new.select(F.lit(note_id).alias("id"), F.lit(old["scope"]).alias("scope"), F.lit(old["project_key"]).alias("project_key"), "kind", "content", M.note_hash(F.col("content")).alias("content_hash"), "tags", "provenance", F.lit(at).cast("long").alias("valid_from"), F.lit(at).cast("long").alias("updated_at"))
        rest = rows.where(F.col("id") != note_id)
        if not rest.join(fresh, ["scope", "project_key", "content_hash"], "left_semi").isEmpty():
            raise ValueError("another note of the scope says the same")
        closed = rows.where(F.col("id") == note_id).select("id", "content", "kind", "tags", "provenance", "valid_from", F.lit(at).cast("long").alias("valid_to"))
        self.store.commit({"memories": rest.unionByName(fresh), "revisions": self._table("revisions", CLOSED).unionByName(closed)})

    def forget(self, note_id: str) -> None:
        if self.get(note_id) is None:
            raise ValueError("no such note")
        gone = self.spark.createDataFrame([(note_id,)], "id string")
        self.store.commit({n: M.forget(self._table(n, s), gone, "id") for n, s in (("memories", NOTES), ("revisions", CLOSED), ("memory_vectors", VECTORS))})

    def repair_vectors(self, most: int | None = None) -> int:
        """Embed notes that have no vector of this model and content, the latest first; how many."""
        held = self._table("memory_vectors", VECTORS)
        due = M.without_vectors(self.notes(), held, self.model)
        due = cut(due if most is None else due.limit(most), "due")
        n = due.count()
        if n:
            fresh = due.select("id", "content_hash", F.lit(self.model).alias("model"), self.embed(F.concat_ws(" ", "content", F.array_join("tags", " "), "kind")).alias("vector"))
            self.store.commit({"memory_vectors": held.where(F.col("model") != self.model).unionByName(held.where(F.col("model") == self.model).join(due.select("id"), "id", "left_anti")).unionByName(fresh)})
        return n

    def search(self, question: str, scope: str = "all", limit: int = 10) -> DataFrame:
        """Notes that answer a question, best first, with score, lexical and similarity; none where nothing is near enough."""
        notes = cut(self.notes(scope), "notes")
        words = cut(M.lexical_score(notes, question).withColumn("lexical", F.least(F.lit(1.0), "lexical")), "words")
        semantic = self.spark.createDataFrame([], "id string, similarity double")
        if words.where(F.col("lexical") >= V.STRONG_WORDS).isEmpty():  # else vectors are not asked
            self.repair_vectors(256)
            q = self.spark.createDataFrame([(question,)], "q string").select(self.embed(F.col("q")).alias("v")).first()["v"]
            v = self._table("memory_vectors", VECTORS).where(F.col("model") == self.model).join(notes.select("id", "content_hash"), ["id", "content_hash"], "left_semi")
            semantic = v.select("id", cosine(F.col("vector"), F.array(*map(F.lit, q))).alias("similarity")).where(F.col("similarity") >= V.LEAST_SIMILARITY)
        found = M.hybrid_score(words, semantic).join(notes, "id")
        found = self.relevant(question, found) if self.relevant else found
        return found.orderBy(*M.best_first()).limit(limit)

    def capture(self, message: str, trusted: bool = False, rejected=None) -> int:
        """Store the lasting preferences a trusted message states; each replaces what it contradicts. How many.

        rejected, if given, is asked which statements not to keep (a function of the list).
        """
        if not trusted:
            return 0
        said = M.captured_preferences(self.spark.createDataFrame([(message,)], "text string")).select("statement").distinct()
        said = [r["statement"] for r in said.collect()]  # statements of one message
        drop = rejected(said) if rejected else set()
        said = [s for i, s in enumerate(said) if i not in drop]
        for s in said:
            new = self.spark.createDataFrame([("s", "user", "", s)], "statement_id string, scope string, project_key string, statement string")
            for r in M.contradicted(self.notes("user").where("kind = 'preference'"), new).collect():
                self.forget(r["id"])
            self.add(s, "user", "preference")
        return len(said)

    def status(self) -> DataFrame:
        n = self.notes()
        v = self._table("memory_vectors", VECTORS).where(F.col("model") == self.model).join(n.select("id"), "id", "left_semi")
        closed = self._table("revisions", CLOSED).join(n.select("id"), "id", "left_semi")
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        return one(n.where("scope = 'user'"), "user").union(one(n.where("scope = 'project'"), "project")).union(one(closed, "revisions")).union(one(v, "vectors"))
