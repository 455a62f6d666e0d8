"""Registered queries of the smaller operators: lookups, orders, notes, communities, phrases, representations; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import identity as I
from ..functions import representation as R
from ..functions import text as T
from ..functions import vectors as X
from ..operators import aggregates, bindings, communities, context, extraction, filters, incremental, lexical, lookups, memory, resolve, vector
from ..operators import graph as G
from ..streaming import changes
from . import property_graph as P
from .queries_graph import NEAR, query, with_
from .queries_text import BM25, FTS, POSTINGS, QUESTION, QUESTION_TERMS, folded_sql, vectors

# --- phrases, filters before the cut, all before any ---

COLUMNS = "d AS (SELECT doc_id AS id, {a} AS a, {b} AS b, {c} AS c FROM documents)".format(a=folded_sql("coalesce(source, '')"), b=folded_sql("coalesce(lang, '')"), c=folded_sql("coalesce(text, '')"))
TIMES = "len(list_filter(range(1, len({x})), lambda i: {x}[i] = p[1] AND {x}[i + 1] = p[2]))"


@query("lex_phrase", with_(f"q AS (SELECT item_id AS query_id, ({folded_sql('text')})[1:2] AS p FROM benchmark)", COLUMNS, "st AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM d)",
    f"post AS (SELECT * FROM (SELECT p, id, len(a) + len(b) + len(c) AS dl, (4.0 * {TIMES.format(x='a')} + 2.0 * {TIMES.format(x='b')} + {TIMES.format(x='c')})::DOUBLE AS tf FROM (SELECT DISTINCT p FROM q), d) WHERE tf > 0)",
    "df AS (SELECT p, count(*) AS df FROM post GROUP BY p)") + """SELECT query_id, id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score, 1::BIGINT AS matched, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) DESC, id)::INT AS rank FROM post JOIN df USING (p) JOIN q USING (p), st QUALIFY rank <= 5""")
def _(spark, d):
    q = P.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(lexical.tokens(F.col("text")), 1, 2).alias("terms"))
    return lexical.bm25(P.table(spark, d, "documents"), q, "doc_id", FTS, 5)


def question(spark):
    return spark.createDataFrame([(0, QUESTION)], "query_id int, text string")


@query("lex_prefilter", with_(QUESTION_TERMS, POSTINGS) + f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ({BM25}) WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr' AND starts_with(source, 'src1')) QUALIFY rank <= 20")
def _(spark, d):
    q = question(spark).select("query_id", F.explode(lexical.phrases_of(F.col("text"))).alias("terms"))
    return lexical.bm25(P.table(spark, d, "documents"), q, "doc_id", FTS, 20, keep=(F.col("lang") == "fr") & F.startswith("source", F.lit("src1")))


ASKED = "q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'is'), (2, 'und'), (2, 'que'), (2, 'zzzz'), (3, 'étre'), (3, 'SRC3')) v(query_id, t))"


@query("lex_and_before_or", with_("q AS (SELECT query_id, strip_accents(lower(t)) AS term FROM (VALUES (1, 'the'), (1, 'is'), (2, 'und'), (2, 'que'), (2, 'zzzz'), (3, 'étre'), (3, 'SRC3')) v(query_id, t))", POSTINGS) + f"""SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ({BM25}) s JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY ALL) USING (query_id) QUALIFY rank <= 30 AND TRUE""".replace(f"({BM25}) s JOIN", f"(SELECT * EXCLUDE (most, need) FROM (SELECT b.*, max(matched) OVER (PARTITION BY query_id) AS most, need FROM ({BM25}) b JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY ALL) USING (query_id)) WHERE most < need OR matched = need) s JOIN").replace("SELECT s.*", "SELECT s.query_id, s.id, s.score, s.matched"))
def _(spark, d):
    q = spark.createDataFrame([(1, "the"), (1, "is"), (2, "und"), (2, "que"), (2, "zzzz"), (3, "étre"), (3, "SRC3")], "query_id int, term string")
    return lexical.bm25(P.table(spark, d, "documents"), q, "doc_id", FTS, 30, match="and_or")


@query("lex_postings", "SELECT term, count(*) AS documents, sum(tf)::DOUBLE AS weight FROM (SELECT id, term, sum(w) AS tf FROM (" + " UNION ALL ".join(f"SELECT doc_id AS id, unnest({folded_sql(c)}) AS term, {w}::DOUBLE AS w FROM documents" for c, w in FTS.items()) + ") GROUP BY ALL) GROUP BY term")
def _(spark, d):
    return lexical.postings(P.table(spark, d, "documents"), "doc_id", FTS).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("weight"))


# --- lookups and orders ---


@query("lookup_names", with_(P.ENTITIES) + "SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY length(coalesce(path, '')), id)::INT AS rank FROM ent QUALIFY rank <= 3")
def _(spark, d):
    e = P.entities(spark, d)
    return lookups.by_name(e, e.select("name"), 3)


@query("lookup_qualified", with_(P.ENTITIES) + "SELECT id, qualified_name FROM ent WHERE qualified_name = 'NATION_7' OR ends_with(qualified_name, '.NATION_7') ORDER BY length(coalesce(qualified_name, '')), id LIMIT 50")
def _(spark, d):
    return lookups.by_qualified_name(P.entities(spark, d), "NATION_7").select("id", "qualified_name")


@query("lookup_children", with_(P.ENTITIES) + "SELECT id, parent_id FROM ent WHERE parent_id IN (SELECT id FROM ent WHERE kind = 'directory' OR (kind = 'class' AND size > 5000))")
def _(spark, d):
    e = P.entities(spark, d)
    return lookups.children(e, e.where("kind = 'directory' or (kind = 'class' and size > 5000)")).select("id", "parent_id")


@query("lookup_files", with_(P.ENTITIES) + "SELECT path, min(id) AS id FROM ent WHERE kind IN ('file', 'document', 'module') GROUP BY path")
def _(spark, d):
    return lookups.file_entities(P.entities(spark, d))


@query("lookup_ids", with_(P.ENTITIES) + "SELECT id, path FROM ent WHERE id IN (SELECT 'orders:' || l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    ids = P.table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("id"))
    return lookups.by_ids(P.entities(spark, d), ids).select("id", "path")


@query("ent_references", with_(P.ENTITIES) + "SELECT id, coalesce(nullif(qualified_name, ''), name) AS label, kind, path, qualified_name, language FROM ent")
def _(spark, d):
    return P.entities(spark, d).select(lookups.reference().alias("r")).select("r.*")


@query("roots_order", "SELECT row_number() OVER (ORDER BY is_primary DESC, name, id)::BIGINT AS place, id FROM (SELECT 'root:' || r_regionkey AS id, r_name AS name, r_regionkey = 2 AS is_primary FROM region)")
def _(spark, d):
    r = P.table(spark, d, "region").select(F.concat(F.lit("root:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 2).alias("is_primary"))
    return G.numbered(r, F.desc("is_primary"), F.col("name").asc(), F.col("id").asc()).select((F.col("number") + 1).alias("place"), "id")


@query("facet_order", "SELECT row_number() OVER (ORDER BY n IS NULL, n, value)::BIGINT AS place, value FROM (SELECT DISTINCT value, TRY_CAST(value AS BIGINT) AS n FROM (SELECT event_type AS value FROM events UNION ALL SELECT CAST(user_id AS VARCHAR) FROM events))")
def _(spark, d):
    e = P.table(spark, d, "events")
    v = e.select(F.col("event_type").alias("value")).union(e.select(F.col("user_id").cast("string"))).distinct()
    none, number, text = lookups.numeric_first(F.col("value"))
    return G.numbered(v.select("value", none.alias("_none"), number.alias("_n")), F.col("_none").asc(), F.col("_n").asc(), F.col("value").asc()).select((F.col("number") + 1).alias("place"), "value")


@query("rank_badge", """SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'exact' WHEN turn % 3 = 0 THEN 'lexical' WHEN conv_id % 4 = 0 THEN 'semantic' WHEN conv_id % 2 = 0 THEN 'graph-expanded' ELSE 'lexical' END AS badge FROM conversations""")
def _(spark, d):
    on = lambda c: F.when(c, 1.0)
    c, t = F.col("conv_id"), F.col("turn")
    return P.table(spark, d, "conversations").select("conv_id", "turn", lookups.badge({"exact_name": on(t % 5 == 0), "lexical": on(t % 3 == 0), "semantic": on(c % 4 == 0), "graph_expansion": on(c % 2 == 0)}).alias("badge"))


# --- graph ---


@query("graph_edges_at", with_(P.EDGES) + """SELECT node, other, direction, type, provenance, confidence FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, other, type, provenance, direction) AS r FROM (SELECT source_id AS node, target_id AS other, 'outbound' AS direction, type, provenance, confidence FROM edge UNION ALL SELECT target_id, source_id, 'inbound', type, provenance, confidence FROM edge WHERE source_id <> target_id) WHERE provenance IN ('extracted', 'resolved') AND (starts_with(node, 'nation:') OR starts_with(node, 'part:1'))) WHERE r <= 20""")
def _(spark, d):
    e = P.entities(spark, d)
    return G.edges_at(P.edges(spark, d), e.where("id like 'nation:%' or id like 'part:1%'"), "both", provenances=("extracted", "resolved"), limit=20).select("node", "other", "direction", "type", "provenance", "confidence")


@query("graph_pair_edges", with_(P.EDGES) + "SELECT edge.* FROM edge WHERE (source_id, target_id) IN (SELECT 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem WHERE l_quantity < 10)")
def _(spark, d):
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    return G.edges_between(P.edges(spark, d), P.table(spark, d, "lineitem").where("l_quantity < 10").select(key("orders:", "l_orderkey").alias("a"), key("part:", "l_partkey").alias("b")))


@query("graph_path_edges", with_(P.EDGES) + """, s AS (SELECT 'orders:' || o_orderkey AS a, 'customer:' || o_custkey AS b FROM orders WHERE o_totalprice > 150000 UNION SELECT 'customer:' || o_custkey, 'nation:' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000)
SELECT edge.* FROM edge WHERE (source_id, target_id) IN (SELECT a, b FROM s) OR (target_id, source_id) IN (SELECT a, b FROM s)""")
def _(spark, d):
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    o = P.table(spark, d, "orders").where("o_totalprice > 150000").join(P.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return G.along(P.edges(spark, d), o.select(F.array(key("orders:", "o_orderkey"), key("customer:", "o_custkey"), key("nation:", "c_nationkey")).alias("path")))


WORTH = "least(1.0, greatest(0.0, confidence * CASE provenance WHEN 'extracted' THEN 1.0 WHEN 'resolved' THEN 0.85 WHEN 'manual' THEN 0.8 WHEN 'inferred' THEN 0.55 WHEN 'ambiguous' THEN 0.3 WHEN 'semantic' THEN 0.0 ELSE 0.5 END))::DOUBLE"


@query("graph_expansion_evidence", with_(P.EDGES, NEAR) + f""", h0 AS (SELECT 'customer:' || c_custkey AS node FROM customer WHERE c_custkey <= 40),
s1 AS (SELECT n.*, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, other, type, provenance) AS r FROM near n SEMI JOIN h0 USING (node) QUALIFY r <= 50),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r) AS f FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, other ORDER BY r) AS one FROM s1 WHERE other NOT IN (SELECT node FROM h0)) WHERE one = 1)) WHERE f <= 25),
f1 AS (SELECT other AS node, 1 AS distance, list_extract(list_sort(list({{'c': -confidence, 'p': node, 't': {WORTH}}})), 1) AS m FROM c1 GROUP BY other)
SELECT node, 0 AS distance, NULL::VARCHAR AS parent, 1.0::DOUBLE AS trail, 1.0::DOUBLE AS evidence, [node] AS path FROM h0 UNION ALL SELECT node, distance, m.p, round(m.t, 6), round(m.t / distance, 6), [m.p, node] FROM f1""")
def _(spark, d):
    seeds = P.table(spark, d, "customer").where("c_custkey <= 40").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return G.with_paths(G.expand(P.edges(spark, d), seeds, hops=1, total=2000), 1)


@query("graph_undirected_semantic", with_(P.EDGES) + """, e AS (SELECT * FROM edge UNION ALL SELECT 'part:' || a.p_partkey, 'part:' || b.p_partkey, 'semantically_related', 'semantic', CASE WHEN a.p_size = b.p_size THEN 0.9 ELSE 0.6 END::DOUBLE FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(confidence) AS weight FROM e WHERE source_id <> target_id AND ((type <> 'semantically_related' AND provenance IN ('extracted', 'resolved', 'inferred')) OR (type = 'semantically_related' AND confidence >= 0.75)) GROUP BY ALL""")
def _(spark, d):
    p = P.table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_size").alias("y"))
    key = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    more = a.join(b, "k").select(key(F.col("k")), key(F.col("k") + 1), F.lit(V.SEMANTIC_EDGE_TYPE), F.lit("semantic"), F.when(F.col("x") == F.col("y"), 0.9).otherwise(0.6))
    return G.undirected(P.edges(spark, d).union(more), semantic=0.75)


@query("vec_clear_semantic", with_(P.EDGES) + "SELECT * FROM edge WHERE type <> 'references'")
def _(spark, d):
    e = P.edges(spark, d)
    return vector.without_semantic(e.withColumn("type", F.when(F.col("type") == "references", V.SEMANTIC_EDGE_TYPE).otherwise(F.col("type"))))


@query("community_ids", with_(P.ENTITIES) + """, s AS (SELECT root_id || '/' || kind AS community, count(*) AS size FROM ent GROUP BY ALL), n AS (SELECT *, 'structural-' || lpad(CAST(row_number() OVER (ORDER BY size DESC, community) - 1 AS VARCHAR), 5, '0') AS community_id FROM s)
SELECT community_id, id, n.size FROM ent JOIN n ON n.community = root_id || '/' || kind""")
def _(spark, d):
    return G.detected(P.entities(spark, d).select("id", F.concat_ws("/", "root_id", "kind").alias("community")), "structural")


def stored(spark, d):
    e = P.entities(spark, d)
    return e.select(F.col("root_id").alias("community_id"), F.when(F.col("kind") == "function", "hybrid").otherwise("structural").alias("mode"), F.lit("labels").alias("algorithm"), "id")


STORED = "m AS (SELECT root_id AS community_id, CASE WHEN kind = 'function' THEN 'hybrid' ELSE 'structural' END AS mode, 'labels' AS algorithm, id FROM ent)"


@query("community_membership", with_(P.ENTITIES, STORED, "c AS (SELECT community_id, mode, algorithm, count(*) AS size, min(id) AS label FROM m GROUP BY ALL)") + "SELECT community_id, mode, algorithm, id, size, label FROM m JOIN c USING (community_id, mode, algorithm)")
def _(spark, d):
    m = stored(spark, d)
    return G.membership(m, m.groupBy("community_id", "mode", "algorithm").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("label")))


@query("community_replace", with_(P.ENTITIES, STORED) + "SELECT * FROM m WHERE mode <> 'structural' UNION ALL SELECT kind, 'structural', 'labels', id FROM ent")
def _(spark, d):
    fresh = P.entities(spark, d).select(F.col("kind").alias("community_id"), F.lit("structural").alias("mode"), F.lit("labels").alias("algorithm"), "id")
    return G.replace_communities(stored(spark, d), "structural", "labels", fresh)


@query("community_meta_nodes", with_(P.ENTITIES) + "SELECT kind || '/' || root_id AS community, count(*) AS degree, round(sum(size), 6) AS importance FROM ent GROUP BY ALL")
def _(spark, d):
    return G.meta_nodes(P.entities(spark, d).select("id", F.concat_ws("/", "kind", "root_id").alias("community"), F.col("size").alias("importance")))


@query("community_terms", with_(P.ENTITIES) + """, x AS (SELECT kind AS community, split_part(name, '_', 1) AS name, CASE WHEN contains(path, '/') THEN list_extract(string_split(path, '/'), -2) END AS folder FROM ent)
SELECT community, trim(coalesce((SELECT folder FROM x y WHERE y.community = c.community AND folder IS NOT NULL GROUP BY folder ORDER BY count(*) DESC, folder LIMIT 1), '') || ' ' || coalesce((SELECT name FROM x y WHERE y.community = c.community AND name <> '' GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), '')) AS label FROM (SELECT DISTINCT community FROM x) c""")
def _(spark, d):
    e = P.entities(spark, d)
    return aggregates.community_terms(e.select(F.col("kind").alias("community"), "path", F.split("name", "_")[0].alias("name")))


@query("graph_betweenness")
def _(spark, d):
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    n, s = P.table(spark, d, "nation"), P.table(spark, d, "supplier")
    e = n.select(key("region:", "n_regionkey").alias("a"), key("nation:", "n_nationkey").alias("b"), F.lit(1.0).alias("weight")).union(s.select(key("nation:", "s_nationkey"), key("supplier:", "s_suppkey"), F.lit(0.5)))
    return G.betweenness(e)


@query("flt_all_facets", with_(P.ENTITIES) + """SELECT id FROM ent WHERE coalesce(NOT (CASE WHEN kind = 'interface' THEN NULL ELSE size > 9000 END), TRUE) AND coalesce(NOT contains(name, '#9'), TRUE) AND kind NOT IN ('document', 'section', 'image', 'audio', 'video') AND starts_with(path, 'A') AND root_id = 'root:1' AND contains(lower(concat_ws(' ', name, path, kind, language)), 'nation_1')""")
def _(spark, d):
    e = P.entities(spark, d).withColumn("is_generated", F.when(F.col("kind") != "interface", F.col("size") > 9000)).withColumn("is_external", F.contains("name", F.lit("#9"))).withColumn("community", F.col("root_id"))
    return e.where(filters.node_facets(text="nation_1", root_prefix="A", community="root:1", only="source", hide_generated=True, hide_external=True)).select("id")


# --- notes ---

NOTES = "n0 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'project' END AS scope, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS project_key, text AS content, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, lang AS kind FROM documents)"


def notes(spark, d):
    return P.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "user").otherwise("project").alias("scope"), F.col("source").alias("project_key"), F.col("lang").alias("kind"), F.col("text").alias("content"))


@query("mem_note_hash", with_(NOTES) + "SELECT doc_id, sha256(norm) AS content_hash FROM n0")
def _(spark, d):
    return notes(spark, d).select("doc_id", memory.note_hash(F.col("content")).alias("content_hash"))


def secrets_sql(c: str) -> str:
    return " OR ".join(f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in V.SECRET_PATTERNS)


@query("mem_validate", f"""SELECT doc_id, CASE WHEN scope NOT IN ('project', 'user') THEN 'scope' WHEN kind NOT IN ('fact', 'preference', 'decision', 'workflow', 'reference') THEN 'kind' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 32000 THEN 'long' WHEN {secrets_sql('text')} THEN 'secret' WHEN tags > 20 THEN 'tags' WHEN doc_id % 13 = 0 AND tags > 0 THEN 'tag' END AS problem FROM (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN 'all' ELSE 'user' END AS scope, CASE WHEN doc_id % 11 = 0 THEN 'poem' ELSE 'fact' END AS kind, doc_id % 23 AS tags FROM documents)""")
def _(spark, d):
    k = F.col("doc_id")
    tag = F.when(k % 13 == 0, F.repeat(F.lit("x"), F.lit(81))).otherwise("x")
    n = P.table(spark, d, "documents").select("doc_id", "text", F.when(k % 17 == 0, "all").otherwise("user").alias("scope"), F.when(k % 11 == 0, "poem").otherwise("fact").alias("kind"), F.array_repeat(tag, (k % 23).cast("int")).alias("tags"))
    return n.select("doc_id", memory.problem(F.col("text"), F.col("scope"), F.col("kind"), F.col("tags")).alias("problem"))


@query("mem_add_idempotent", with_(NOTES, "k AS (SELECT scope, project_key, sha256(norm) AS content_hash, min(kind) AS kind, bool_or(doc_id % 2 = 0) AS early, bool_or(doc_id % 2 = 1) AS late, min(CASE WHEN doc_id % 2 = 0 THEN kind END) AS first_kind, min(CASE WHEN doc_id % 2 = 1 THEN kind END) AS last_kind FROM n0 GROUP BY ALL)") + """SELECT 'mem_' || left(sha256(concat_ws(chr(31), scope, project_key, content_hash)), 20) AS id, scope, project_key, coalesce(last_kind, first_kind) AS kind, CASE WHEN early AND (NOT late OR first_kind IS NOT DISTINCT FROM last_kind) THEN 100 WHEN early THEN 200 ELSE 200 END::BIGINT AS valid_from FROM k""")
def _(spark, d):
    n = notes(spark, d).withColumn("tags", F.array().cast("array<string>")).withColumn("provenance", F.lit(""))
    none = spark.createDataFrame([], "id string, scope string, project_key string, kind string, content string, content_hash string, tags array<string>, provenance string, valid_from long, updated_at long")
    first, _ = memory.add_notes(none, n.where("doc_id % 2 = 0"), 100)
    again, closed = memory.add_notes(first, n.where("doc_id % 2 = 0"), 150)
    both, _ = memory.add_notes(again, n.where("doc_id % 2 = 1"), 200)
    return both.select("id", "scope", "project_key", "kind", "valid_from")


@query("mem_search_order", with_(NOTES, "f AS (SELECT *, round((doc_id % 7) / 7.0, 6) AS score, round((doc_id % 3) / 3.0, 6) AS lexical, CASE WHEN doc_id % 4 > 0 THEN round((doc_id % 4) / 4.0, 6) END AS similarity, doc_id % 50 AS updated_at FROM n0)") + """SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, lexical DESC, coalesce(similarity, -1.0) DESC, scope = 'project' DESC, updated_at DESC, lower(content) DESC, doc_id)::BIGINT - 1 AS place FROM f""")
def _(spark, d):
    k = F.col("doc_id")
    f = notes(spark, d).select(k.alias("id"), "scope", "content", F.round((k % 7) / 7.0, 6).alias("score"), F.round((k % 3) / 3.0, 6).alias("lexical"), F.when(k % 4 > 0, F.round((k % 4) / 4.0, 6)).alias("similarity"), (k % 50).alias("updated_at"))
    f = f.withColumn("_p", F.col("scope") == "project").withColumn("_s", F.coalesce("similarity", F.lit(-1.0))).withColumn("_c", F.lower("content"))
    order = [F.desc("score"), F.desc("lexical"), F.desc("_s"), F.desc("_p"), F.desc("updated_at"), F.desc("_c"), F.col("id").asc()]
    return G.numbered(f, *order).select("id", F.col("number").alias("place"))


@query("mem_recent", with_(NOTES) + "SELECT doc_id AS id, scope FROM n0 ORDER BY doc_id % 101 DESC, doc_id LIMIT 50")
def _(spark, d):
    return memory.recent(notes(spark, d).select(F.col("doc_id").alias("id"), "scope", (F.col("doc_id") % 101).alias("updated_at")), 50).select("id", "scope")


SAID = "(VALUES ('I like short answers'), ('I prefer long answers'), ('I always write concise text'), ('I want formal words'), ('I like casual words'), ('I like detailed text'), ('I like short and long')) v(s)"


@query("mem_replace_contradiction", f"""WITH s AS (SELECT s, row_number() OVER () - 1 AS i FROM {SAID}), n AS (SELECT c_custkey AS id, 'p' || (c_custkey % 5) AS project_key, s.s AS content FROM customer JOIN s ON i = c_custkey % 7), t AS (SELECT o_orderkey AS statement_id, 'p' || (o_orderkey % 5) AS project_key, s.s AS statement FROM orders JOIN s ON i = o_orderkey % 7 WHERE o_orderkey < 200),
o AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in V.OPPOSED_WORDS)}) v(x, y)), w AS (SELECT s, string_split(lower(s), ' ') AS ws FROM s)
SELECT DISTINCT n.id, t.statement_id FROM n JOIN t USING (project_key) JOIN w a ON a.s = n.content JOIN w b ON b.s = t.statement JOIN o ON list_contains(a.ws, x) AND NOT list_contains(a.ws, y) AND list_contains(b.ws, y) AND NOT list_contains(b.ws, x) WHERE len(list_intersect(a.ws, b.ws)) > 0""")
def _(spark, d):
    said = ("I like short answers", "I prefer long answers", "I always write concise text", "I want formal words", "I like casual words", "I like detailed text", "I like short and long")
    pick = lambda k: F.get(F.array(*map(F.lit, said)), (F.col(k) % 7).cast("int"))
    own = lambda k: F.concat(F.lit("p"), (F.col(k) % 5).cast("string")).alias("project_key")
    n = P.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("project").alias("scope"), own("c_custkey"), pick("c_custkey").alias("content"))
    t = P.table(spark, d, "orders").where("o_orderkey < 200").select(F.col("o_orderkey").alias("statement_id"), F.lit("project").alias("scope"), own("o_orderkey"), pick("o_orderkey").alias("statement"))
    return memory.contradicted(n, t)


@query("mem_vector_backfill", with_(NOTES) + "SELECT doc_id AS id FROM n0 WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 <> 0)")
def _(spark, d):
    n = notes(spark, d).select(F.col("doc_id").alias("id"), memory.note_hash(F.col("content")).alias("content_hash"), F.lit(1).alias("updated_at"))
    held = n.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("m").alias("model"))
    return memory.without_vectors(n, held, "m").select("id")


# --- texts, files and representations ---


@query("ext_module_doc", """WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '\"\"\"' || p_name || '.\"\"\"' WHEN 1 THEN '# ' || p_name || chr(10) || '#  more ' || p_brand || chr(10) || 'x = 1' WHEN 2 THEN '// ' || p_name || chr(10) || '* ' || p_type || chr(10) || 'code()' WHEN 3 THEN '/*' || chr(10) || ' * ' || p_name || chr(10) || ' */' ELSE 'import ' || p_name END AS t, p_name, p_brand, p_type FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN p_name || '.' WHEN 1 THEN p_name || ' more ' || p_brand WHEN 2 THEN p_name || ' ' || p_type WHEN 3 THEN p_name END AS doc FROM f""")
def _(spark, d):
    n, k = F.lit("\n"), F.col("p_partkey")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) and not v.startswith("p_") else F.col(v) if isinstance(v, str) else v for v in x])
    t = F.when(k % 5 == 0, c('"""', "p_name", '."""')).when(k % 5 == 1, c("# ", "p_name", n, "#  more ", "p_brand", n, "x = 1")).when(k % 5 == 2, c("// ", "p_name", n, "* ", "p_type", n, "code()")).when(k % 5 == 3, c("/*", n, " * ", "p_name", n, " */")).otherwise(c("import ", "p_name"))
    return P.table(spark, d, "part").select(k.alias("k"), extraction.module_doc(t).alias("doc"))


@query("media_image_size", """SELECT p_partkey AS k, p_size AS width, p_partkey AS height FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 4 = 3""")
def _(spark, d):
    k, w = F.col("p_partkey"), F.col("p_size")
    big = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    little = lambda c, n: F.concat(*[F.lpad(F.hex(F.pmod(F.shiftright(c.cast("long"), 8 * i), F.lit(256))), 2, "0") for i in range(n)])
    gif = (k % 4 == 1) & (k < 1 << 16) & (w < 1 << 16)  # a GIF's sizes have two bytes; a larger one is written as a BMP
    head = F.when(k % 4 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(k))).when(gif, F.concat(F.lit("474946383961"), little(w, 2), little(k, 2))).when(k % 4 < 3, F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(k, 4))).otherwise(F.lit("FFD8FFE0"))
    return P.table(spark, d, "part").select(k.alias("k"), extraction.image_size(F.unhex(head)).alias("s")).select("k", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@query("ext_frontmatter", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN left(replace(text, chr(10), ' '), 30) || chr(10) || 'const x = 1' END AS code, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 3 END::INT AS line FROM documents")
def _(spark, d):
    k, t = F.col("doc_id"), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30))
    made = F.when(k % 3 == 2, t).otherwise(F.concat(F.when(k % 3 == 1, "\n").otherwise(""), F.lit("---\n"), t, F.lit("\nconst x = 1\n---\n<p/>")))
    return P.table(spark, d, "documents").select("doc_id", extraction.frontmatter(made).alias("f")).select("doc_id", "f.code", "f.line")


@query("ext_generic_symbols", """WITH p AS (SELECT 'x/' || p_partkey || '.zig' AS path, p_partkey AS k FROM part) SELECT path, 'class' AS kind, 'S' || k AS name, 1 AS line FROM p UNION ALL SELECT path, 'function', 'run' || k, 3 FROM p UNION ALL SELECT path, 'interface', 'I' || k, 4 FROM p""")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("pub struct S"), k, F.lit(" {\n  x: int\n  pub fn run"), k, F.lit("() {}\nexport interface I"), k, F.lit(" {\n"))
    return extraction.generic_symbols(P.table(spark, d, "part").select(F.concat(F.lit("x/"), k, F.lit(".zig")).alias("path"), text.alias("text")))


@query("res_module_files", """WITH m AS (SELECT p_partkey AS ref_id, CASE p_partkey % 4 WHEN 0 THEN 'pkg.m' || (p_partkey % 50) WHEN 1 THEN '.m' || (p_partkey % 50) WHEN 2 THEN '..m' || (p_partkey % 50) ELSE 'none.x' END AS module FROM part)
SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN 'pkg/m' WHEN 1 THEN 'pkg/sub/m' ELSE 'pkg/m' END || (ref_id % 50) || CASE WHEN ref_id % 50 % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM m WHERE ref_id % 4 < 3""")
def _(spark, d):
    k = F.col("p_partkey")
    n = F.concat(F.lit("m"), (k % 50).cast("string"))
    module = F.when(k % 4 == 0, F.concat(F.lit("pkg."), n)).when(k % 4 == 1, F.concat(F.lit("."), n)).when(k % 4 == 2, F.concat(F.lit(".."), n)).otherwise("none.x")
    files = spark.range(50).select(F.explode(F.transform(F.array(F.lit("pkg/"), F.lit("pkg/sub/")), lambda p: F.concat(p, F.lit("m"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".py").otherwise("/__init__.py")))).alias("path"))
    return resolve.module_files(P.table(spark, d, "part").select(k.alias("ref_id"), F.lit("pkg/sub/me.py").alias("importer"), module.alias("module")), files)


@query("res_unresolved_ids", """SELECT 'unres:' || left(sha256('src/p' || l_partkey || '.py:' || l_linenumber || ':' || n || ':calls'), 24) AS id, 's' AS source_id, n AS name, 'src/p' || l_partkey || '.py' AS path, l_linenumber AS line, 'calls' AS type FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'len' WHEN 1 THEN 'run_' || l_suppkey ELSE 'go_' || l_suppkey END AS n FROM lineitem) WHERE l_linenumber % 3 <> 0 AND NOT (l_linenumber % 3 = 2 AND l_suppkey % 2 = 0)""")
def _(spark, d):
    k, s = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    name = F.when(k % 3 == 0, "len").when(k % 3 == 1, F.concat(F.lit("run_"), s)).otherwise(F.concat(F.lit("go_"), s))
    refs = P.table(spark, d, "lineitem").select(F.lit("s").alias("source_id"), name.alias("name"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), k.alias("line"), F.lit("calls").alias("type"), F.when((k % 3 == 2) & (F.col("l_suppkey") % 2 == 0), "self").alias("qualifier"))
    return resolve.unresolved_rows(refs)


@query("fn_representations", """SELECT p_partkey AS k, 'kind: interface' || chr(10) || 'name: ' || p_name || chr(10) || 'path: parts/' || p_brand || chr(10) || 'signature: ' || p_type AS code, 'file: ' || p_name || chr(10) || 'language: c' || chr(10) || 'exports: ' || p_brand || ', ' || p_type AS file, 'section: ' || p_brand || ' > ' || p_name || chr(10) || 'path: ' || p_type AS section, p_name || ' ' || p_brand || ' ' || p_type AS search FROM part""")
def _(spark, d):
    n, b, t, none = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string")
    return P.table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), R.code(F.lit("interface"), n, none, F.concat(F.lit("parts/"), b), t, none, none).alias("code"), R.file(n, F.lit("c"), F.array(b, t), none, none).alias("file"),
        R.section(n, F.array(b), t, none).alias("section"), R.search_text(n, b, t, none).alias("search"),
    )


@query("fn_small", """SELECT event_id, round(1 - value * value / 20000, 10) AS similarity, CASE WHEN value < 60 THEN CAST(floor(value) AS BIGINT) || 's' ELSE CAST(floor(value / 60) AS BIGINT) || 'm' END AS age, CASE WHEN user_id % 2 = 0 THEN 'same_file' ELSE 'cross_file' END AS scope, round(value / 8, 6) AS sample_end FROM events WHERE value > 0""")
def _(spark, d):
    e = P.table(spark, d, "events").where("value > 0")
    sample = F.get(X.video_samples(F.col("value").cast("double")), F.lit(0))["end"]
    return e.select("event_id", F.round(X.similarity_from_distance(F.col("value") / 100), 10).alias("similarity"), T.humanize_age(F.col("value")).alias("age"), R.scope_label(F.lit("a"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")).alias("scope"), F.round(sample, 6).alias("sample_end"))


@query("fn_semantic_hash", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), E' \\t\\n\\r\\f\\v')) AS h FROM documents")
def _(spark, d):
    return P.table(spark, d, "documents").select("doc_id", I.content_hash(I.normalize_representation(F.col("text"))).alias("h"))


@query("ctx_evidence_keys", """SELECT conv_id, turn, sha256('entities' || chr(0) || '{"role":"' || role || '","turn":' || turn || '}') AS key FROM conversations""")
def _(spark, d):
    item = F.to_json(F.struct("role", "turn"))
    return P.table(spark, d, "conversations").select("conv_id", "turn", context.evidence_key(F.lit("entities"), item).alias("key"))


@query("ctx_plan_changed_paths", """SELECT conv_id, turn, conv_id % 2 = 0 AS changed FROM conversations""")
def _(spark, d):
    paths = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a.py"))).otherwise(F.array().cast("array<string>"))
    c = P.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_contains(T.plan_context(F.lit("explain the session flow"), 3500, paths)["lanes"], "changed_files").alias("changed"))


@query("ctx_linked_tests", """WITH t AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), l AS (SELECT o_custkey AS id, o_orderkey AS test_id FROM orders), f AS (SELECT test_id, min(rank) AS rank FROM t JOIN l USING (id) WHERE rank <= 8 GROUP BY test_id ORDER BY 2, 1 LIMIT 8)
SELECT test_id, rank, left(repeat('order ' || test_id || ' ', 200), 800) AS text, 200::INT AS cost FROM f""")
def _(spark, d):
    c = G.numbered(P.table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), F.col("c_custkey").asc()).select(F.col("c_custkey").alias("id"), (F.col("number") + 1).alias("rank"))
    o = P.table(spark, d, "orders")
    tests = o.select(F.col("o_orderkey").alias("test_id"), F.repeat(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" ")), F.lit(200)).alias("text"))
    return context.linked_tests(c, o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("test_id")), tests)


@query("inc_stale_paths", """WITH k AS (SELECT 'p' || p_partkey AS path, p_size AS size FROM part WHERE p_partkey % 7 > 0), l AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 5 > 0)
SELECT path, CASE WHEN l.size IS NULL THEN 'missing' WHEN k.size IS NULL THEN 'new' ELSE 'changed' END AS why FROM k FULL JOIN l USING (path) WHERE k.size IS DISTINCT FROM l.size ORDER BY path LIMIT 100""")
def _(spark, d):
    p = P.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("n"), F.col("p_size").alias("size"), F.lit(1).alias("mtime"))
    return incremental.stale_paths(p.where("n % 5 > 0").withColumn("size", F.when(F.col("n") % 11 == 0, F.col("size") + 1).otherwise(F.col("size"))), p.where("n % 7 > 0"))


@query("inc_delete_unresolved", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    u = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linenumber")
    return incremental.delete_unresolved(u, P.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).select(F.col("source_id").alias("l_orderkey"), "l_linenumber")


@query("inc_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return incremental.upsert(c.where("k % 2 = 0").withColumn("v", F.lit("old")), c.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("str_keep_last", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def _(spark, d):
    return changes.keep_last(P.table(spark, d, "events").select("event_id", "user_id"), "user_id", 3)


@query("str_poll_intervals", "SELECT user_id, event_id, list_reduce(list_prepend(1.0::DOUBLE, xs), lambda a, x: CASE WHEN x > 50 THEN 1.0 ELSE least(10.0, a * 1.5) END) AS interval FROM (SELECT user_id, event_id, list(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM events WHERE event_id < 600)")
def _(spark, d):
    return changes.poll_intervals(P.table(spark, d, "events").where("event_id < 600").select("user_id", "event_id", (F.col("value") > 50).alias("changed")), "user_id", "event_id").withColumn("interval", F.round("interval", 9))


@query("vec_space_fingerprint", """SELECT sha256('{"dimensions":' || d || ',"model":"hash","normalize":true}') AS fingerprint FROM (SELECT max(len(embedding)) AS d FROM embeddings)""")
def _(spark, d):
    n = vectors(spark, d).select(F.max(F.size("vector"))).first()[0]
    return spark.createDataFrame([(vector.space_fingerprint({"model": "hash", "dimensions": n, "normalize": True}),)], "fingerprint string")


@query("vec_approximate_knn")
def _(spark, d):
    v = vectors(spark, d)
    return vector.approximate_knn(v.withColumnRenamed("id", "query_id"), v, 5)


# --- scans, counts, linkage, cursors ---


@query("src_ignored", """SELECT path, regexp_matches(path, '^(?:.*/)?[^/]*\\.tmp(?:/.*)?$') OR regexp_matches(path, '^build/.*$') OR (regexp_matches(path, '^src/(?:.*/)?gen(?:/.*)?$') AND NOT regexp_matches(path, '^src/(?:.*/)?gen/keep[^/]*(?:/.*)?$')) OR list_has_any(string_split(path, '/')[:-2], ['node_modules', 'dist']) AS ignored FROM (SELECT ['src/', 'build/', 'src/gen/', 'lib/node_modules/', 'src/gen/keep', ''][page_id % 6 + 1] || 'f' || page_id || ['.py', '.tmp', '.js'][page_id % 3 + 1] AS path FROM pages)""")
def _(spark, d):
    from ..sources import files

    k = F.col("page_id")
    pick = lambda n, *x: F.get(F.array(*map(F.lit, x)), (k % n).cast("int"))
    p = P.table(spark, d, "pages").select(F.concat(pick(6, "src/", "build/", "src/gen/", "lib/node_modules/", "src/gen/keep", ""), F.lit("f"), k.cast("string"), pick(3, ".py", ".tmp", ".js")).alias("path"))
    rules = [("", "*.tmp"), ("", "/build/"), ("src", "gen"), ("src", "!**/gen/keep*")]
    return p.select("path", (files.ignored(F.col("path"), rules) | files.in_excluded_dir(F.col("path"))).alias("ignored"))


@query("agg_root_counts", with_(P.ENTITIES, P.EDGES) + """SELECT root_id, 'entity' AS what, kind AS name, count(*) AS n FROM ent GROUP BY ALL UNION ALL SELECT root_id, 'edge', type, count(*) FROM edge JOIN ent ON source_id = id GROUP BY ALL""")
def _(spark, d):
    e = P.entities(spark, d)
    return aggregates.root_counts(e, P.edges(spark, d))


@query("lex_hydrated", with_(QUESTION_TERMS, POSTINGS) + f"SELECT id, lang, source, score FROM ({BM25}) JOIN documents ON doc_id = id WHERE source IN ('src3', 'src4')")
def _(spark, d):
    docs = P.table(spark, d, "documents")
    q = question(spark).select("query_id", F.explode(lexical.phrases_of(F.col("text"))).alias("terms"))
    hits = lexical.bm25(docs, q, "doc_id", FTS, 2**31 - 1)
    return hits.join(docs.where("source in ('src3', 'src4')").select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("id", "lang", "source", "score")


@query("vec_related", """SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 6) AS similarity, vec_id % 5 = 0 AS linked FROM embeddings WHERE vec_id <> 3 ORDER BY similarity DESC, id LIMIT 12""")
def _(spark, d):
    v = vectors(spark, d)
    own = v.where("id = 3").first()["vector"]
    edges = v.where("id % 5 = 0").select(F.lit(3).cast("long").alias("source_id"), F.col("id").alias("target_id"))
    return vector.related(v, 3, own, edges, 12)


@query("rank_because", """SELECT event_id, array_to_string(list_transform(list_sort([{'o': -abs(a), 'k': 'lexical', 'v': a}, {'o': -abs(b), 'k': 'semantic', 'v': b}, {'o': -abs(c), 'k': 'centrality', 'v': c}]), lambda x: x.k), ' ') AS because FROM (SELECT event_id, (user_id % 7)::DOUBLE AS a, -(event_id % 5)::DOUBLE AS b, (event_id % 3)::DOUBLE AS c FROM events)""")
def _(spark, d):
    from ..operators import ranking

    e, u = F.col("event_id"), F.col("user_id")
    rows = P.table(spark, d, "events").select("event_id", F.create_map(F.lit("lexical"), (u % 7).cast("double"), F.lit("semantic"), -(e % 5).cast("double"), F.lit("centrality"), (e % 3).cast("double")).alias("contributions"))
    return ranking.explained(rows).select("event_id", F.array_join(F.transform("because", lambda x: x["key"]), " ").alias("because"))


@query("ctx_cursor_codec", """SELECT conv_id, rtrim(translate(to_base64(encode('["' || array_to_string(list(sha256(role || turn) ORDER BY turn), '","') || '"]')), '+/', '-_'), '=') AS cursor, count(*) AS keys FROM conversations GROUP BY conv_id""")
def _(spark, d):
    c = P.table(spark, d, "conversations").withColumn("k", F.sha2(F.concat("role", F.col("turn").cast("string")).cast("binary"), 256))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("turn", "k"))), lambda x: x["k"])
    c = c.groupBy("conv_id").agg(context.encode_cursor(keys).alias("cursor"))
    return c.select("conv_id", "cursor", F.size(context.decode_cursor(F.col("cursor"))).cast("long").alias("keys"))


@query("lookup_references", with_(P.ENTITIES, "r AS (SELECT 'customer:' || c_custkey AS ref FROM customer UNION ALL SELECT c_name FROM customer)") + "SELECT ref, min(e.id) AS id FROM r JOIN ent e ON ref = e.id OR ref = e.name GROUP BY ref")
def _(spark, d):
    e = P.entities(spark, d)
    c = P.table(spark, d, "customer")
    refs = c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("ref")).union(c.select("c_name"))
    return lookups.resolved(e, refs)


# --- names through re-exports ---

BOUND = """b AS (SELECT 'm' || c_custkey AS path, 'n' || (c_nationkey % 4) AS alias, 'm' || (c_custkey * 7 + 3) % 1500 AS target_path, 'n' || (c_custkey % 4) AS target_name FROM customer
UNION SELECT 'm' || s_suppkey * 15, '*', 'm' || (s_suppkey * 31) % 1500, NULL FROM supplier UNION SELECT 'm' || o_orderkey % 1500, 'n' || (o_custkey % 4), 'm' || o_custkey % 1500, 'n' || (o_orderkey % 4) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0),
def AS (SELECT DISTINCT 'm' || c_custkey AS path, 'n' || (c_custkey % 3) AS name FROM customer WHERE c_acctbal > 5000)"""


@query("res_export_closure", "WITH RECURSIVE " + BOUND + """, names AS (SELECT DISTINCT alias AS name FROM b WHERE alias <> '*'),
nodes AS (SELECT path, name FROM (SELECT path FROM b UNION SELECT target_path FROM b), names), own AS (SELECT DISTINCT path, alias AS name FROM b WHERE alias <> '*'),
s AS (SELECT path, alias AS name, target_path, target_name FROM b WHERE alias <> '*' UNION SELECT n.path, n.name, x.target_path, n.name FROM nodes n JOIN b x ON x.path = n.path AND x.alias = '*' WHERE (n.path, n.name) NOT IN (SELECT path, name FROM own)),
o AS (SELECT * FROM s WHERE (path, name) NOT IN (SELECT path, name FROM def)),
r AS (SELECT path, name, path AS at_path, name AS at_name FROM own UNION SELECT r.path, r.name, o.target_path, o.target_name FROM r JOIN o ON o.path = r.at_path AND o.name = r.at_name)
SELECT r.path, r.name, at_path AS def_path, at_name AS def_name FROM r JOIN def ON def.path = at_path AND def.name = at_name""")
def _(spark, d):
    m = lambda c: F.concat(F.lit("m"), c.cast("string"))
    n = lambda c, k=4: F.concat(F.lit("n"), (c % k).cast("string"))
    c, s, o = (P.table(spark, d, t) for t in ("customer", "supplier", "orders"))
    o = o.where("o_orderpriority = '1-URGENT' and o_orderkey % 3 = 0")
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    b = c.select(m(key).alias("path"), n(F.col("c_nationkey")).alias("alias"), m((key * 7 + 3) % 1500).alias("target_path"), n(key).alias("target_name"))
    b = b.union(s.select(m(F.col("s_suppkey") * 15), F.lit("*"), m(F.col("s_suppkey") * 31 % 1500), F.lit(None).cast("string")))
    b = b.union(o.select(m(order % 1500), n(F.col("o_custkey")), m(F.col("o_custkey") % 1500), n(order)))
    defined = c.where("c_acctbal > 5000").select(m(key).alias("path"), n(key, 3).alias("name"))
    return bindings.closure(b.where("alias <> '*'").select("path", F.col("alias").alias("name")), b, defined)


@query("graph_community_weights", with_(P.EDGES, "u AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(confidence) AS weight FROM edge WHERE provenance IN ('extracted', 'resolved', 'inferred') GROUP BY ALL)",
    "w AS (SELECT a, b, weight AS w FROM u UNION ALL SELECT b, a, weight FROM u)", "l AS (SELECT a AS id, split_part(a, ':', 1) || (split_part(a, ':', 2)::BIGINT % 5) AS community FROM (SELECT DISTINCT a FROM w))") + """SELECT x.community, round(sum(w), 6) AS total, round(sum(CASE WHEN x.community = y.community THEN w ELSE 0 END), 6) AS inner_weight FROM w JOIN l x ON x.id = w.a JOIN l y ON y.id = w.b GROUP BY x.community""")
def _(spark, d):
    both = communities.both_ways(G.undirected(P.edges(spark, d)))
    part = F.split("id", ":")
    labels = communities.alone(both).select("id", F.concat(part[0], (part[1].cast("long") % 5).cast("string")).alias("community"))
    return communities.community_weights(both, labels).select("community", F.round("total", 6).alias("total"), F.round("inner", 6).alias("inner_weight"))
