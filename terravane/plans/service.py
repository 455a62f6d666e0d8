"""The facade: questions about an indexed source tree or any tables of the same shape, answered as DataFrames."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions import identity as I
from ..functions import text as T
from ..functions.identity import content_hash
from ..functions.representation import search_text
from ..operators import aggregates, bindings, context, extraction, graph, incremental, lexical, lookups, quality, ranking, resolve, vector
from ..operators import communities as modular
from ..operators.checkpoints import cut
from ..operators.filters import search_filter, visible_edges
from ..operators.term_index import TermIndex
from ..operators.vector_index import VectorIndex
from ..sources.files import scan
from ..sources.snapshots import SnapshotStore
from .memory_store import MemoryStore

FTS_COLUMNS = V.FTS_WEIGHTS
SEGMENTS = 16  #: Segments of the lexical or the vector index from which an update writes it anew.
GROWTH = 4  #: Times the rows it was fitted on that the vector index may hold before it is fitted anew.
DETECT = {"labels": graph.label_communities, "louvain": modular.louvain, "leiden": modular.leiden}
CACHED = 64  #: Results of searches that are kept.
CONTEXT_EDGES = ("calls", "constructs", "imports", "inherits", "implements", "references")


COLUMNS = ["id", "root_id", "kind", "language", "name", "qualified_name", "path", "parent_id", "start_line", "end_line", "signature", "docstring"]
CONFIDENCE = V.DEFAULT_CONFIDENCE


def dotted(path):
    """The module a file declares."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.[^./]+$", ""), F.lit("/"), F.lit("."))


def parsed(files: DataFrame, root_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and references of scanned files, and paths of files that do not parse; each text is parsed once."""
    text = F.col("content").cast("string")
    front = extraction.frontmatter(text)
    shifted = F.concat(F.repeat(F.lit("\n"), front["line"] - 1), front["code"])  # a component's script, on its own lines
    files = files.withColumn("text", F.when((F.col("language") == "astro") & front.isNotNull(), shifted).otherwise(text))
    found, refs, failed = extraction.parse(files)
    sym = found.join(files.select("path", "language"), "path")
    eid = lambda kind, qn, start: I.stable_id(F.lit(root_id), kind, F.col("language"), F.col("path"), qn, start)
    none = F.lit(None).cast("string")
    file_id = eid(F.lit("file"), F.col("path"), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    kind = F.when(F.col("language").isin("markdown", "text", "pdf"), "document").otherwise("file")
    file_rows = files.select(file_id.alias("id"), F.lit(root_id).alias("root_id"), kind.alias("kind"), "language", stem.alias("name"), F.col("path").alias("qualified_name"), "path", none.alias("parent_id"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), none.alias("signature"), extraction.module_doc(text).alias("docstring"))
    own = sym.withColumn("id", eid(F.col("kind"), F.col("qualified_name"), F.col("start_line")))
    up = own.select(F.col("path"), F.col("qualified_name").alias("parent"), F.col("id").alias("up")).dropDuplicates(["path", "parent"])
    symbols = own.join(up, ["path", "parent"], "left").withColumn("parent_id", F.coalesce("up", file_id)).withColumn("root_id", F.lit(root_id)).select(*COLUMNS)
    sections = extraction.markdown_sections(files.where("language = 'markdown'"), "path", "text").withColumnRenamed("id", "path").withColumn("language", F.lit("markdown"))
    sections = sections.withColumn("kind", F.lit("section")).withColumn("id", eid(F.lit("section"), F.col("title"), F.col("start_line")))
    sections = sections.select("id", F.lit(root_id).alias("root_id"), "kind", "language", F.col("title").alias("name"), F.col("title").alias("qualified_name"), "path", eid(F.lit("file"), F.col("path"), F.lit("")).alias("parent_id"), "start_line", "end_line", none.alias("signature"), F.left("body", F.lit(600)).alias("docstring"))
    entities = cut(file_rows.unionByName(symbols).unionByName(sections), "entities")
    return entities, refs.join(files.select("path", "language"), "path"), failed


def linked(entities: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved references. A name that an import binds is looked for in the file its module names."""
    kind = F.when(F.col("kind") == "section", "contains").when(F.col("signature").isNotNull(), "defines").otherwise("contains")
    held = entities.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), kind.alias("type"), F.lit("extracted").alias("provenance"), F.lit(1.0).alias("confidence"))
    who = entities.select("path", F.col("qualified_name").alias("owner"), F.col("id").alias("source_id")).dropDuplicates(["path", "owner"])
    refs = refs.withColumn("owner", F.coalesce("owner", "path")).join(who, ["path", "owner"])
    refs = refs.withColumn("ref_id", F.sha2(F.concat_ws("|", "path", "line", "name", "type", "owner").cast("binary"), 256)).dropDuplicates(["ref_id"])
    refs = cut(refs, "references")
    files = entities.where(F.col("kind").isin("file", "document")).select("path")
    symbols = entities.where("kind not in ('file', 'document', 'section')").withColumn("module", dotted(F.col("path")))
    imported = refs.where("type = 'imports'").select("path", F.coalesce("alias", "name").alias("alias"), F.coalesce("qualifier", "name").alias("module"), F.when(F.col("qualifier").isNotNull(), F.col("name")).alias("name"))
    links = cut(bindings.targets(imported, files), "bindings")
    # The names a reference may be bound by: its own, or its qualifier and the first part of that.
    mine = F.when(F.col("type") == "imports", F.array(F.coalesce("alias", "name"))).otherwise(F.array_distinct(F.array(F.coalesce("qualifier", "name"), F.split(F.coalesce("qualifier", "name"), r"\.")[0])))
    hits = refs.select("ref_id", "path", "type", "name", "qualifier", F.explode(mine).alias("alias")).join(links, ["path", "alias"])
    inner = F.when(F.col("type") != "imports", F.col("name"))  # a name of the module that is bound
    ways = hits.select("ref_id", "place", F.col("target_path").alias("from"), F.coalesce("target_name", inner).alias("want"), (F.col("target_name").isNull() | F.col("qualifier").isNull() | (F.col("type") == "imports")).alias("whole"))
    starred = refs.where("type <> 'imports' and qualifier is null").join(links.where("alias = '*'").select("path").distinct(), "path", "left_semi").join(hits.select("ref_id"), "ref_id", "left_anti")
    ways = cut(ways.unionByName(starred.select("ref_id", F.lit(2).alias("place"), F.col("path").alias("from"), F.col("name").alias("want"), F.lit(True).alias("whole"))), "ways")
    reached = bindings.closure(ways.where("want is not null").select(F.col("from").alias("path"), F.col("want").alias("name")), links, symbols.select("path", F.col("qualified_name").alias("name")))
    to = ways.join(reached, (F.col("from") == F.col("path")) & (F.col("want") == reached["name"])).groupBy("ref_id").agg(F.min(F.struct("place", "def_path", "def_name", "whole")).alias("d"))
    at = ways.where("place < 2").groupBy("ref_id").agg(F.max(F.struct("place", "from")).alias("f")).join(to, "ref_id", "full").select("ref_id", F.coalesce("d.def_path", "f.from").alias("path"), F.when(F.col("d.whole"), F.col("d.def_name")).alias("def_name"))
    at = cut(at, "targets")
    named = refs.join(at.select("ref_id", dotted(F.col("path")).alias("module"), "def_name"), "ref_id", "left")
    full = F.coalesce("def_name", F.when(F.col("qualifier").isNotNull() & (F.col("type") != "imports") & F.col("module").isNull(), F.concat_ws(".", "qualifier", "name")).otherwise(F.col("name")))
    asked = named.where("type <> 'imports' or module is not null").select("ref_id", "source_id", full.alias("name"), "path", "language", "module", "type", "line", "qualifier")
    outcome = cut(resolve.resolve(asked, symbols), "outcome")
    sure = outcome.where("outcome = 'resolved'").join(refs.select("ref_id", "source_id", "type"), "ref_id").select("source_id", "target_id", "type", F.lit("resolved").alias("provenance"), F.lit(CONFIDENCE["resolved"]).alias("confidence"))
    # An import whose module is a file but whose name is no symbol of it points to the file.
    file_ids = entities.where(F.col("kind").isin("file", "document")).select(F.col("path").alias("at"), F.col("id").alias("target_id"))
    whole = at.select("ref_id", F.col("path").alias("at")).join(refs.where("type = 'imports'").select("ref_id", "source_id", "type"), "ref_id").join(outcome.where("outcome = 'resolved'").select("ref_id"), "ref_id", "left_anti")
    whole = whole.join(file_ids, "at").select("source_id", "target_id", "type", F.lit("resolved").alias("provenance"), F.lit(CONFIDENCE["resolved"]).alias("confidence"))
    lost = outcome.where("outcome <> 'resolved'").select("ref_id", "candidates").join(refs.select("ref_id", "source_id", "name", "path", "line", "type", "qualifier"), "ref_id")
    lost = resolve.unresolved_rows(lost).join(lost.select("source_id", "name", "path", "line", "type", "candidates"), ["source_id", "name", "path", "line", "type"])
    return held.unionByName(sure).unionByName(whole).distinct(), lost.dropDuplicates(["id"])


def searchable(entities: DataFrame) -> DataFrame:
    return entities.withColumn("semantic_text", search_text(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("docstring")))


class Repository:
    """One indexed tree: update, search, resolve, explain, neighbourhood, related, path, impact, find_tests, context, communities, graph_stage, events, status, freshness, doctor, and notes as memory.

    communities: how they are found, by `labels`, `louvain` or `leiden`. embed gives the vector of a text as a column; route, if given, may replace a question's channels (a function of
    the question and the default names).
    """

    def __init__(self, spark: SparkSession, store: str, root_id: str = "root:0", embed=vector.hashing_embedding, route=None, communities: str = "labels"):
        self.spark, self.store, self.root_id, self.embed, self.route = spark, SnapshotStore(spark, store), root_id, embed, route
        self.algorithm = communities
        self.memory = MemoryStore(spark, self.store, root_id, embed)
        self.found: OrderedDict = OrderedDict()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def update(self, root: str, **rules) -> int:
        """Scan, plan, and commit a new snapshot if anything changed; the generation that is current afterwards.

        Only added and changed files are parsed; references of all files are resolved again from their stored rows,
        and only entities without a vector of their text are embedded.
        """
        files = cut(scan(self.spark, root, **rules), "files")
        generation, names = self.store.current()
        listed = files.select("path", "size", "mtime", "language", "content_hash")
        known = self.table("files") if "files" in names else listed.limit(0)
        plan = cut(incremental.plan_update(known, listed), "plan")
        due = plan.where("change <> 'unchanged'")
        if names and due.isEmpty():
            return generation
        fresh, refs, failed = parsed(files.join(due, "path", "left_semi"), self.root_id)
        if "entities" in names:
            fresh = cut(self.table("entities").select(*COLUMNS).join(due, "path", "left_anti").unionByName(fresh), "entities")
            refs = self.table("references").join(due, "path", "left_anti").unionByName(refs)
            failed = self.table("failed").join(due, "path", "left_anti").unionByName(failed)
        edges, unresolved = linked(fresh, refs)
        edges = cut(edges, "edges")
        texts = searchable(fresh)
        hashed = texts.select("id", content_hash(F.col("semantic_text")).alias("input_hash"), "semantic_text")
        old = self.table("vectors") if "vectors" in names else None
        need = hashed if old is None else incremental.to_embed(hashed, old, ["id", "input_hash"])
        vectors = made = cut(need.select("id", "input_hash", self.embed(F.col("semantic_text")).alias("vector")), "vectors")
        gone = made.select("id").limit(0)
        if old is not None:
            keys = hashed.select("id", "input_hash")
            vectors, gone = old.join(keys, ["id", "input_hash"], "left_semi").unionByName(made), old.join(keys, ["id", "input_hash"], "left_anti").select("id")
        if "edges" in names:  # semantic edges stand, as long as both their ends do, until graph_stage() makes them anew
            held = self.table("edges").where(F.col("type") == V.SEMANTIC_EDGE_TYPE)
            for end in ("source_id", "target_id"):
                held = held.join(vectors.join(made.select("id"), "id", "left_anti").select(F.col("id").alias(end)), end, "left_semi")
            edges = cut(edges.unionByName(held.select(*edges.columns)), "edges")
        texts = cut(texts, "texts")
        members, communities = self._communities(vector.without_semantic(edges), fresh, "structural")
        events = due.select(F.lit(generation + 1).cast("long").alias("generation"), "path", "change")

        def sound(tables: dict[str, DataFrame]) -> None:
            lost = quality.orphan_edges(tables["edges"], tables["entities"]).count()
            if lost:
                raise ValueError(f"{lost} edges have an end that is no entity")

        return self.store.commit({
            "files": listed, "entities": fresh, "references": refs, "failed": failed, "edges": edges, "unresolved": unresolved, "vectors": vectors, **self._terms(names, due, texts), **self._near(names, made, gone, vectors),
            "members": members, "communities": communities, "importance": graph.importance(vector.without_semantic(edges), fresh), "events": self.table("events").unionByName(events) if "events" in names else events,
        }, [sound])

    def _communities(self, edges: DataFrame, entities: DataFrame, mode: str, semantic: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Members and labelled communities of a mode, of structural edges and of semantic ones from a similarity on."""
        found = graph.detected(DETECT[self.algorithm](graph.undirected(edges, semantic=semantic)), mode)
        how = lambda df: df.withColumn("mode", F.lit(mode)).withColumn("algorithm", F.lit(self.algorithm))
        labels = aggregates.community_terms(found.join(entities.select("id", "path", "name"), "id").select(F.col("community_id").alias("community"), "path", "name")).withColumnRenamed("community", "community_id")
        return how(found.select("community_id", "id")), how(found.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).join(labels, "community_id", "left"))

    def graph_stage(self, semantic_threshold: float = 0.75, neighbours: int = 16, exact: bool = False) -> int:
        """Semantic edges made anew from the vector index, communities with and without them; the new generation.

        exact looks for the neighbours in every list that may hold one. Semantic edges have their similarity as confidence.
        """
        entities = self.table("entities")
        asked = self.table("vectors").select(F.col("id").alias("query_id"), "vector")
        near = cut(self.nearest().search_all(asked, neighbours, exact=exact, same=True), "neighbours")
        made = vector.semantic_edges(near, asked.count(), vector.threshold(near).first()["threshold"])
        made = made.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit(V.SEMANTIC_EDGE_TYPE).alias("type"), F.lit("semantic").alias("provenance"), F.col("similarity").alias("confidence"))
        edges = vector.without_semantic(self.table("edges"))
        edges = cut(edges.unionByName(made.select(*edges.columns)), "edges")
        members, communities = self.table("members"), self.table("communities")
        for mode, least in (("structural", None), ("semantic", semantic_threshold)):
            m, c = self._communities(edges, entities, mode, least)
            members, communities = graph.replace_communities(members, mode, self.algorithm, m), graph.replace_communities(communities, mode, self.algorithm, c.select(*communities.columns))
        return self.store.commit({"edges": edges, "members": members, "communities": communities})

    def nearest(self) -> VectorIndex:
        """The vector index as of the current snapshot."""
        rows = self.table("near").orderBy("place").collect()  # SEGMENTS rows at most
        return VectorIndex(self.spark, f"{self.store.root}/near", rows[0]["model"], [r["segment"] for r in rows], self.table("near_removed"))

    def index(self) -> TermIndex:
        """The lexical index as of the current snapshot."""
        return TermIndex(self.spark, f"{self.store.root}/terms", FTS_COLUMNS, [r[0] for r in self.table("segments").collect()], self.table("removed"))

    def _terms(self, names: dict, due: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
        """The index's segments and removed documents after an update: a segment of what is due, or one of all after SEGMENTS updates."""
        index, new = TermIndex(self.spark, f"{self.store.root}/terms", FTS_COLUMNS), texts
        if "segments" in names and (old := self.index()).segments and len(old.segments) < SEGMENTS:
            index, new = old.remove(self.table("entities").join(due, "path", "left_semi").select("id")), texts.join(due, "path", "left_semi")
        index = index.add(new, "id")
        none = self.spark.createDataFrame([], "segment string, range long, id string, length int")
        return {"segments": self.spark.createDataFrame([(s,) for s in index.segments], "segment string"), "removed": none if index.removed is None else index.removed}

    def _near(self, names: dict, made: DataFrame, gone: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
        """The vector index's segments and removed rows after an update: a segment of what was embedded, or an index fitted anew."""
        index, fitted = None, 0
        if "near" in names and len((index := self.nearest()).segments) < SEGMENTS:
            fitted = self.table("near").first()["fitted"]
            index = index.remove(gone).add(made) if index.lists()["rows"].sum() <= GROWTH * fitted else None
        else:
            index = None
        if index is None:
            index = VectorIndex.fitted(vectors.select("id", "vector"), f"{self.store.root}/near")
            fitted = int(index.lists()["rows"].sum())
        none = self.spark.createDataFrame([], "segment string, id string")
        rows = [(i, index.model, s, fitted) for i, s in enumerate(index.segments)]
        return {"near": self.spark.createDataFrame(rows, "place int, model string, segment string, fitted long"), "near_removed": none if index.removed is None else index.removed}

    def search(self, question: str, limit: int = 10, expand: bool = True, **wanted) -> DataFrame:
        """Ranked entities: exact, lexical, semantic and structural evidence, fused; with what each channel gave.

        Filters hold before each channel takes its best. The last results of a generation are kept, CACHED at most.
        """
        key = (self.store.current()[0], question, limit, expand, repr(sorted(wanted.items())))
        if key in self.found:
            self.found.move_to_end(key)
            return self.found[key]
        entities, edges = self.table("entities"), self.table("edges")
        allowed = entities.where(search_filter(**wanted))
        q = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        names = ["exact", "lexical", "semantic"] + ["graph"] * expand
        names = self.route(question, names) if self.route else names
        zero = F.lit(0).alias("query_id")
        channels = {}
        if "lexical" in names:
            asked = q.select("query_id", F.explode(lexical.phrases_of(F.col("text"))).alias("terms"))
            channels["lexical"] = cut(ranking.normalised(self.index().search(asked, 40, allowed, "and_or")), "lexical")
        if "exact" in names:
            exact = cut(lexical.exact_matches(allowed, q.select(F.explode(F.split("text", r"\s+")).alias("ref")).where("ref <> ''").distinct()), "exact")
            channels |= {c: exact.where(F.col(c) > 0).select(zero, "id", F.col(c).alias("value")) for c in ("exact_name", "exact_path")}
        if "semantic" in names:
            v = q.select(self.embed(F.col("text")).alias("v")).first()["v"]
            near = self.nearest().search(v, 40, within=allowed)
            channels["semantic"] = cut(near.where("similarity > 0").select(zero, "id", F.col("similarity").alias("value")), "semantic")
        if "graph" in names and ("lexical" in channels or "exact_name" in channels):
            seeds = [df.select("id", "value") for c, df in channels.items() if c in ("lexical", "exact_name")]
            seeds = reduce(DataFrame.union, seeds).groupBy("id").agg(F.max("value").alias("v")).orderBy(F.desc("v"), "id").limit(10)
            grown = graph.expand(edges, seeds.select("id")).where("distance > 0").join(allowed.select(F.col("id").alias("node")), "node", "left_semi")
            channels["graph_expansion"] = cut(grown.select(zero, F.col("node").alias("id"), F.col("evidence").alias("value")), "expansion")
            closest = channels["exact_name"].orderBy(F.desc("value"), "id").first() if "exact_name" in channels else None
            if closest:
                channels["graph_proximity"] = cut(ranking.proximity(edges, closest["id"]).join(allowed.select("id"), "id", "left_semi").select(zero, "id", "value"), "proximity")
        found = cut(ranking.absorb(channels), "channels")
        near = edges.join(found.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
        members = self.table("members").where("mode = 'structural'").select("id", F.col("community_id").alias("community"))
        ranked = ranking.fuse(found, entities, self.table("importance"), members, ranking.provenance_bonus(near), list(channels))
        badge = lookups.badge({c: F.col(c) for c in channels})
        out = ranking.explained(ranked.where(F.col("rank") <= limit)).withColumn("evidence", badge).join(entities.drop("kind"), "id").orderBy("rank")
        self.found[key] = out = cut(out, "found").orderBy("rank")
        while len(self.found) > CACHED:
            self.found.popitem(last=False)
        return out

    def resolve(self, reference: str) -> str | None:
        """Id of an entity by id, path, qualified name or name."""
        e = self.table("entities")
        known = e.where(F.col("id") == reference).select("id", F.lit(0).alias("r"))
        ref = self.spark.createDataFrame([(reference,)], "ref string")
        row = known.union(lexical.exact_matches(e, ref, 5).select("id", "rank")).orderBy("r", "id").first()
        return row["id"] if row else None

    def _id(self, reference: str) -> DataFrame:
        return self.spark.createDataFrame([(self.resolve(reference),)], "id string")

    def explain(self, reference: str, most: int = 200) -> dict[str, DataFrame]:
        """An entity with its parent, inbound and outbound edges, nearest by vector, community, importance and unresolved references."""
        at, e, edges = cut(self._id(reference), "at"), self.table("entities"), self.table("edges")
        own = e.join(at, "id", "left_semi")
        ref = e.select(F.col("id").alias("other"), lookups.reference().alias("entity"))
        ends = lambda way: graph.edges_at(edges, at, way, limit=most).join(ref, "other").orderBy(F.desc("confidence"), "other")
        return {
            "entity": own.join(self.table("importance"), "id", "left").withColumnRenamed("value", "importance"), "parent": lookups.by_ids(e, own.select(F.col("parent_id").alias("id"))), "children": lookups.children(e, at),
            "inbound": ends("inbound"), "outbound": ends("outbound"), "related": self.related(reference), "communities": graph.membership(self.table("members").join(at, "id", "left_semi"), self.table("communities")),
            "unresolved": self.table("unresolved").join(at.select(F.col("id").alias("source_id")), "source_id", "left_semi"),
        }

    def neighbourhood(self, reference: str, depth: int = 2, fanout: int = 60) -> tuple[DataFrame, DataFrame]:
        """Nodes within depth hops of an entity, with their ways from it, and the edges among them."""
        edges = self.table("edges").where(F.col("type") != V.SEMANTIC_EDGE_TYPE)
        nodes = cut(graph.with_paths(graph.expand(edges, self._id(reference), depth, fanout, fanout * depth * 3), depth), "nodes")
        return nodes, visible_edges(edges, nodes.select(F.col("node").alias("id")))

    def communities(self) -> DataFrame:
        return self.table("communities").orderBy(F.desc("size"), "community_id")

    def events(self, after: int = 0, most: int = 50) -> DataFrame:
        """Changes of files by generation, oldest first."""
        return self.table("events").where(F.col("generation") > after).orderBy("generation", "path").limit(most)

    def status(self) -> DataFrame:
        """name, n: rows of the current tables, and the generation."""
        now = self.spark.createDataFrame([("generation", self.store.current()[0])], "name string, n long")
        return aggregates.table_counts({n: self.table(n) for n in ("files", "failed", "entities", "edges", "unresolved", "vectors", "communities")}).union(now)

    def freshness(self, root: str, verify: bool = False, **rules) -> DataFrame:
        """path, why of files that differ from the index."""
        listed = scan(self.spark, root, **rules)
        return incremental.stale_paths(listed, self.table("files"), verify=verify)

    def path(self, source: str, target: str, hops: int = 4) -> DataFrame:
        goal = self.resolve(target)
        return graph.shortest_paths(self.table("edges"), self.resolve(source) or "", hops).where(F.col("node") == goal)

    def impact(self, reference: str, depth: int = 3) -> DataFrame:
        return graph.impact(self.table("edges"), self.table("entities"), self._id(reference), depth)

    def find_tests(self, reference: str) -> DataFrame:
        e = self.table("entities")
        return graph.tests_of(self.table("edges"), e, e.join(self._id(reference), "id", "left_semi").select("id", "path"))

    def related(self, reference: str, limit: int = 10) -> DataFrame:
        """Nearest entities by vector, and whether an edge already links them."""
        at = self.resolve(reference)
        own = self.table("vectors").where(F.col("id") == at).first()
        none = self.table("vectors").select("id", F.lit(0.0).alias("similarity"), F.lit(False).alias("linked")).limit(0)
        if not own:
            return none
        near = self.nearest().search(own["vector"], limit + 1).where(F.col("id") != at).orderBy(F.desc("similarity"), "id").limit(limit)
        return vector.linked(near, at, self.table("edges")).orderBy(F.desc("similarity"), "id")

    def context(self, task: str, budget: int = 6000, delivered: str | None = None, changed: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """Evidence for a task under its plan's token budget (field, key, text, cost, in the order it was taken), and the cursor of what was delivered.

        Entities with their surest outbound edges, tests linked to the first ones, their communities and unresolved
        references, and notes. Evidence that the cursor `delivered` names is left out. Changed paths are searched on their own, too.
        """
        paths = F.array(*map(F.lit, changed)).cast("array<string>")
        plan = self.spark.createDataFrame([(task,)], "q string").select(T.plan_context(F.col("q"), budget, paths).alias("p")).first()["p"]
        had = F.coalesce(F.lit(delivered), F.lit(""))
        items = self.spark.createDataFrame([], "place int, rank int, field string, text string")
        if not plan["skipped"]:
            found = self.search(task, 30, expand="structural" in plan["lanes"]).select("id", "rank", "qualified_name", "path", "signature", "docstring", "start_line")
            if "changed_files" in plan["lanes"]:
                more = self.search(task, 24, expand=False, path_prefixes=list(changed)[:8]).select(*found.columns).join(found.select("id"), "id", "left_anti")
                found = found.unionByName(more.withColumn("rank", F.col("rank") + 30))
            found = cut(found, "evidence")
            first = lambda n: found.where(F.col("rank") <= n)
            item = lambda df, place, field, text: df.select(F.lit(place).alias("place"), F.col("rank").cast("int").alias("rank"), F.lit(field).alias("field"), text.alias("text"))
            out = graph.edges_at(self.table("edges"), found.select("id"), "outbound", CONTEXT_EDGES, limit=6).join(found.select(F.col("id").alias("node"), "rank", "qualified_name"), "node")
            out = out.join(self.table("entities").select(F.col("id").alias("other"), F.col("qualified_name").alias("to")), "other")
            items = item(found, 0, "entity", F.concat_ws("\n", "qualified_name", F.concat_ws(":", "path", "start_line"), "signature", "docstring")).unionByName(item(out, 1, "edge", F.concat_ws(" ", "qualified_name", "type", "to")))
            if "tests" in plan["lanes"]:
                e = self.table("entities")
                links = graph.tests_of(self.table("edges"), e, e.join(first(8).select("id"), "id", "left_semi").select("id", "path"))
                tests = context.linked_tests(first(8), links.select("id", "test_id"), e.select(F.col("id").alias("test_id"), F.concat_ws("\n", "qualified_name", "path", "signature", "docstring").alias("text")))
                items = items.unionByName(item(tests, 2, "test", F.col("text")))
            comm = graph.membership(self.table("members").join(first(12).select("id", "rank"), "id"), self.table("communities")).groupBy("community_id", "label").agg(F.min("rank").alias("rank"))
            lost = self.table("unresolved").join(first(20).select(F.col("id").alias("source_id"), "rank"), "source_id")
            lost = lost.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("line", "name", "id"))).where("n <= 2")
            notes = self.memory.search(task, limit=5).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # five rows
            items = items.unionByName(item(comm, 3, "community", F.concat_ws(" ", "community_id", "label"))).unionByName(item(lost, 4, "unresolved", F.concat_ws(" ", "name", "path", "line"))).unionByName(item(notes, 5, "note", F.col("content")))
        items = items.withColumn("key", context.evidence_key(F.col("field"), F.col("text"))).groupBy("key").agg(F.min(F.struct("place", "rank", "field", "text")).alias("i")).select("key", "i.*")
        items = cut(items.where(~F.array_contains(context.decode_cursor(had), F.col("key"))), "items")
        order = F.row_number().over(W.orderBy("rank", "place", "key"))  # some hundred rows
        items = items.withColumn("at", order)
        kept = context.pack(items.select(F.lit(0).alias("group"), F.col("at").alias("rank"), F.col("key").alias("id"), T.estimate_tokens(F.col("text")).alias("cost")), plan["budget"]).where("kept").select(F.col("id").alias("key"), "cost")
        out = cut(items.join(kept, "key").select("at", "field", "key", "text", "cost"), "context").orderBy("at")
        keys = F.concat(context.decode_cursor(had), F.coalesce(F.lit(None).cast("array<string>"), F.array(*[F.lit(r["key"]) for r in out.select("key").collect()]).cast("array<string>")))
        return out, self.spark.range(1).select(context.encode_cursor(keys).alias("c")).first()["c"]

    def doctor(self, root: str | None = None) -> DataFrame:
        """All checks; with the tree's root, freshness too."""
        vectors = self.table("vectors").select(F.col("id").alias("entity_id"), "vector")
        return quality.doctor(self.table("entities"), self.table("edges"), vectors, self.index().documents().select("id"), stale=self.freshness(root) if root else None, written_format=quality.FORMAT)
