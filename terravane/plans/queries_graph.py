"""Registered queries over the property graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import graph as G
from ..operators import incremental, quality, ranking, resolve
from ..operators.checkpoints import cut
from . import property_graph as P

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


NEAR = "near AS (SELECT source_id AS node, target_id AS other, * EXCLUDE (source_id, target_id) FROM edge UNION ALL SELECT target_id, source_id, * EXCLUDE (source_id, target_id) FROM edge WHERE source_id <> target_id)"


@query("ent_stable_id", with_(P.ENTITIES) + """SELECT id, kind || ':' || left(sha256(coalesce(root_id, '') || chr(31) || kind || chr(31) || coalesce(language, '') || chr(31) || trim(regexp_replace(trim(replace('./' || path || '/', '\\', '/')), '^(\\./)+', ''), '/') || chr(31) || qualified_name || chr(31) || ''), 32) AS stable_id FROM ent""")
def _(spark, d):
    e = P.entities(spark, d)
    path = F.concat(F.lit("./"), "path", F.lit("/"))
    return e.select("id", I.stable_id(F.col("root_id"), F.col("kind"), F.col("language"), path, F.col("qualified_name"), F.lit(None)).alias("stable_id"))


@query("edge_ids", with_(P.EDGES) + """SELECT source_id, target_id, type, provenance, 'edge:' || left(sha256(source_id || chr(31) || type || chr(31) || target_id || chr(31) || provenance || chr(31) || ''), 32) AS edge_id FROM edge""")
def _(spark, d):
    return P.edges(spark, d).select("source_id", "target_id", "type", "provenance", I.edge_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("provenance"), F.lit(None)).alias("edge_id"))


@query("flt_search_filters", with_(P.ENTITIES, P.EDGES) + """SELECT id, kind, language FROM ent WHERE kind IN ('class', 'module') AND language IN ('python', 'c') AND root_id IN ('root:0', 'root:1', 'root:2') AND (starts_with(path, 'AFRICA/') OR starts_with(path, 'ASIA/')) AND id IN (SELECT target_id FROM edge WHERE provenance IN ('extracted', 'resolved'))""")
def _(spark, d):
    from ..operators.filters import search_filter

    e = P.entities(spark, d).where(search_filter(kinds=["class", "module"], languages=["python", "c"], roots=["root:0", "root:1", "root:2"], path_prefixes=["AFRICA/", "ASIA/"]))
    proven = G.select_edges(P.edges(spark, d), provenances=("extracted", "resolved")).select(F.col("target_id").alias("id"))
    return e.join(proven, "id", "left_semi").select("id", "kind", "language")


@query("flt_node_edge_facets", with_(P.ENTITIES, P.EDGES) + """, v AS (SELECT id FROM ent WHERE kind IN ('class', 'function') AND contains(lower(concat_ws(' ', name, path, kind, language)), 'customer#') OR kind = 'function')
SELECT type, provenance, count(*) AS edges FROM edge WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v) AND provenance <> 'ambiguous' GROUP BY ALL""")
def _(spark, d):
    from ..operators.filters import edge_facets, node_facets, visible_edges

    e = P.entities(spark, d)
    v = e.where(node_facets(kinds=["class", "function"], text="customer#")).union(e.where("kind = 'function'"))
    edges = P.edges(spark, d).where(edge_facets(provenances=["extracted", "resolved", "inferred"]))
    return visible_edges(edges, v).groupBy("type", "provenance").agg(F.count(F.lit(1)).alias("edges"))


@query("flt_nullsafe_actionable", with_(P.ENTITIES) + """, u AS (SELECT 'ref:' || o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'missing_' || o_orderkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'root:' || (o_orderkey % 5) END AS root_id FROM orders)
SELECT ref_id, name FROM u WHERE EXISTS (SELECT 1 FROM ent WHERE ent.name = u.name AND (CASE WHEN ent.language IS NULL THEN NULL ELSE ent.root_id END) IS NOT DISTINCT FROM u.root_id)""")
def _(spark, d):
    o = P.table(spark, d, "orders")
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("missing_"), key.cast("string")))
    u = o.select(F.concat(F.lit("ref:"), key.cast("string")).alias("ref_id"), name.alias("name"), F.when(key % 2 == 0, F.concat(F.lit("root:"), (key % 5).cast("string"))).alias("root_id"))
    e = P.entities(spark, d).withColumn("root_id", F.when(F.col("language").isNotNull(), F.col("root_id")))
    return quality.actionable(u, e).select("ref_id", "name")


@query("dq_orphan_edges", with_(P.ENTITIES, P.EDGES) + """, known AS (SELECT id FROM ent WHERE NOT (kind = 'interface' AND size < 950))
SELECT source_id, target_id, type, provenance, 'target_id' AS missing FROM edge WHERE target_id NOT IN (SELECT id FROM known)
UNION ALL SELECT source_id, target_id, type, provenance, 'source_id' FROM edge WHERE source_id NOT IN (SELECT id FROM known)""")
def _(spark, d):
    known = P.entities(spark, d).where(~((F.col("kind") == "interface") & (F.col("size") < 950)))
    return quality.orphan_edges(P.edges(spark, d), known).select("source_id", "target_id", "type", "provenance", "missing")


@query("dq_path_safety", """SELECT page_id, path, NOT (starts_with(path, '/') OR list_contains(regexp_split_to_array(path, '[/\\\\]'), '..') OR contains(path, chr(0)) OR regexp_matches(path, '^[A-Za-z]:')) AS safe FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '../' || url WHEN page_id % 11 = 0 THEN regexp_replace(url, '^[a-z]+:/', '') ELSE regexp_replace(url, '^[a-z]+://', '') END AS path FROM pages)""")
def _(spark, d):
    k = F.col("page_id")
    path = F.when(k % 7 == 0, F.concat(F.lit("../"), "url")).when(k % 11 == 0, F.regexp_replace("url", "^[a-z]+:/", "")).otherwise(F.regexp_replace("url", "^[a-z]+://", ""))
    return P.table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("safe", quality.safe_path(F.col("path")))


@query("dq_doctor", with_(P.ENTITIES, P.EDGES) + """, emb AS (SELECT 'customer:' || vec_id AS entity_id, embedding AS vector FROM embeddings), fts AS (SELECT 'orders:' || doc_id AS id FROM documents),
c AS (SELECT 'orphan_edges' AS "check", 'error' AS severity, (SELECT count(*) FROM edge WHERE source_id NOT IN (SELECT id FROM ent)) + (SELECT count(*) FROM edge WHERE target_id NOT IN (SELECT id FROM ent)) AS failures
UNION ALL SELECT 'orphan_embeddings', 'warning', count(*) FROM emb WHERE entity_id NOT IN (SELECT id FROM ent)
UNION ALL SELECT 'parent_cycles', 'error', 0
UNION ALL SELECT 'fts_orphans', 'warning', count(*) FROM fts WHERE id NOT IN (SELECT id FROM ent)
UNION ALL SELECT 'fts_missing', 'warning', count(*) FROM ent WHERE id NOT IN (SELECT id FROM fts)
UNION ALL SELECT 'vector_dimensions', 'error', count(*) FROM emb WHERE len(vector) <> (SELECT len(vector) FROM emb GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'vector_norms', 'warning', count(*) FROM emb WHERE abs(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) - 1) > 0.02
UNION ALL SELECT 'path_safety', 'error', 0 UNION ALL SELECT 'span_bounds', 'error', 0)
SELECT "check", failures = 0 AS ok, failures, severity FROM c""")
def _(spark, d):
    emb = P.table(spark, d, "embeddings").select(F.concat(F.lit("customer:"), F.col("vec_id").cast("string")).alias("entity_id"), F.col("embedding").alias("vector"))
    fts = P.table(spark, d, "documents").select(F.concat(F.lit("orders:"), F.col("doc_id").cast("string")).alias("id"))
    return quality.doctor(P.entities(spark, d), P.edges(spark, d), emb, fts)


@query("graph_degree", with_(P.EDGES) + """SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target_id, 0, 1 FROM edge) GROUP BY id""")
def _(spark, d):
    return G.degrees(P.edges(spark, d))


@query("graph_undirected_max", with_(P.EDGES) + """SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(confidence) AS weight FROM edge WHERE provenance IN ('extracted', 'resolved', 'inferred') GROUP BY ALL""")
def _(spark, d):
    return G.undirected(P.edges(spark, d))


@query("graph_top_edges_per_node", with_(P.EDGES) + """SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id, type, provenance)::INT AS rank FROM edge QUALIFY rank <= 6""")
def _(spark, d):
    return G.top_edges(P.edges(spark, d), 6)


@query("graph_incident_edges", with_(P.ENTITIES, P.EDGES) + """, n AS (SELECT id FROM ent WHERE kind = 'module' AND size > 5000)
SELECT DISTINCT * FROM edge WHERE source_id IN (SELECT id FROM n) OR target_id IN (SELECT id FROM n)""")
def _(spark, d):
    return G.incident(P.edges(spark, d), P.entities(spark, d).where("kind = 'module' AND size > 5000"))


@query("graph_edges_by_root", with_(P.ENTITIES, P.EDGES) + """SELECT s.root_id AS source_root, t.root_id AS target_root, type, count(*) AS edges FROM edge LEFT JOIN ent s ON source_id = s.id LEFT JOIN ent t ON target_id = t.id GROUP BY ALL""")
def _(spark, d):
    e = P.entities(spark, d).select("id", "root_id")
    s, t = e.toDF("source_id", "source_root"), e.toDF("target_id", "target_root")
    return P.edges(spark, d).join(s, "source_id", "left").join(t, "target_id", "left").groupBy("source_root", "target_root", "type").agg(F.count(F.lit(1)).alias("edges"))


EXPAND_HOP = """, s{h} AS (SELECT node, other, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, other, type, provenance) AS r FROM near WHERE node IN (SELECT node FROM f{p}) QUALIFY r <= 50),
n{h} AS (SELECT node, other, confidence, r FROM s{h} WHERE other NOT IN (SELECT node FROM r{p}) QUALIFY row_number() OVER (PARTITION BY node, other ORDER BY r) = 1),
k{h} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r) AS f FROM n{h} QUALIFY f <= 25),
f{h} AS (SELECT other AS node, {h} AS distance, min({{'c': -confidence, 'n': node}}).n AS parent FROM k{h} GROUP BY other),
r{h} AS (SELECT * FROM r{p} UNION ALL SELECT * FROM f{h})"""


@query("graph_expand_2hop", with_(P.EDGES, NEAR, "f0 AS (SELECT 'customer:' || c_custkey AS node, 0 AS distance, NULL::VARCHAR AS parent FROM customer WHERE c_custkey IN (1, 2, 5))", "r0 AS (SELECT * FROM f0)") + EXPAND_HOP.format(h=1, p=0) + EXPAND_HOP.format(h=2, p=1) + """
SELECT * FROM r2 WHERE distance = 0 UNION ALL SELECT * FROM (SELECT * FROM r2 WHERE distance > 0 ORDER BY distance, node LIMIT 150)""")
def _(spark, d):
    seeds = spark.createDataFrame([(f"customer:{k}",) for k in (1, 2, 5)], "id string").join(P.entities(spark, d).select("id"), "id", "left_semi")
    return G.expand(P.edges(spark, d), seeds).select("node", "distance", "parent")


@query("graph_bfs_depth", with_(P.EDGES, "r AS (SELECT 'region:' || r_regionkey AS seed, 'region:' || r_regionkey AS node, 0 AS distance FROM region UNION SELECT seed, target_id, distance + 1 FROM r JOIN edge ON node = source_id WHERE distance < 3)", recursive=True) + "SELECT seed, node, min(distance) AS distance FROM r GROUP BY ALL")
def _(spark, d):
    return G.reach(P.edges(spark, d), P.table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id")), 3)


PATH_COSTS = "costs AS (SELECT node, other, min(CASE provenance WHEN 'extracted' THEN 1.0 WHEN 'resolved' THEN 1.2 WHEN 'inferred' THEN 1.8 WHEN 'ambiguous' THEN 2.5 ELSE 1.5 END::DOUBLE) AS c FROM near GROUP BY ALL)"


PATH_ROUND = """q{h} AS MATERIALIZED (SELECT node, b.c AS cost, b.p AS path FROM (SELECT node, min({{'c': cost, 'p': path}}) AS b FROM (SELECT * FROM q{p} UNION ALL SELECT other, round(cost + c, 6), list_append(path, other) FROM q{p} JOIN costs USING (node) WHERE NOT list_contains(path, other)) GROUP BY node))"""


@query("graph_shortest_path", with_(P.EDGES, NEAR, PATH_COSTS, "q0 AS (SELECT 'supplier:1' AS node, 0.0::DOUBLE AS cost, ['supplier:1'] AS path)", *[PATH_ROUND.format(h=i + 1, p=i) for i in range(4)]) + "SELECT node, cost, array_to_string(path, ' > ') AS path FROM q4")
def _(spark, d):
    return G.shortest_paths(P.edges(spark, d), "supplier:1").withColumn("path", F.array_join("path", " > "))


@query("graph_impact", with_(P.ENTITIES, P.EDGES, "back AS (SELECT target_id AS id, source_id AS by_ FROM edge WHERE type IN ('calls', 'constructs', 'imports', 'references', 'inherits', 'implements', 'overrides', 'routes_to', 'accepts_type', 'returns_type'))", "r AS (SELECT id, 0 AS distance FROM ent WHERE kind = 'interface' AND size < 905 UNION SELECT by_, distance + 1 FROM r JOIN back USING (id) WHERE distance < 3)", recursive=True) + """SELECT id, min(distance) AS distance, CASE WHEN min(distance) = 1 THEN 'direct' ELSE 'transitive' END AS impact FROM r GROUP BY id HAVING min(distance) > 0""")
def _(spark, d):
    e = P.entities(spark, d)
    return G.impact(P.edges(spark, d), e, e.where("kind = 'interface' AND size < 905").select("id"))


@query("graph_tests_fallback", """WITH t AS (SELECT 'test:' || p_partkey AS test_id, lower('tests/' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 2 = 0 THEN 'ing_test.py' ELSE 's/re' || split_part(p_name, ' ', 1) || 'd.py' END) AS test_path FROM part), e AS (SELECT DISTINCT 'name:' || w AS id, w AS stem FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT left(p_name, 2) FROM part))
SELECT id, test_id, 'path' AS how FROM e JOIN t ON contains(test_path, stem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY test_id) <= 20""")
def _(spark, d):
    p = P.table(spark, d, "part")
    tests = p.select(F.concat(F.lit("test:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("test").alias("kind"), F.concat(F.lit("tests/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_partkey") % 2 == 0, "ing_test.py").otherwise(F.concat(F.lit("s/re"), F.split("p_name", " ")[0], F.lit("d.py")))).alias("path"))
    words = p.select(F.explode(F.array(F.split("p_name", " ")[1], F.split("p_name", " ")[0], F.left("p_name", F.lit(2)))).alias("word"))
    word = F.col("word")
    targets = words.select(F.concat(F.lit("name:"), word).alias("id"), F.concat(F.lit("src/"), word, F.lit(".py")).alias("path")).distinct()
    return G.tests_of(P.edges(spark, d), tests, targets)


COMPONENTS = "r AS (SELECT a AS node, a AS reach FROM pairs UNION SELECT r.node, p.b FROM r JOIN pairs p ON r.reach = p.a)"


@query("graph_components", with_("pairs AS (SELECT 'user:' || user_id AS a, 'hour:' || date_trunc('hour', ts) AS b FROM events UNION SELECT 'hour:' || date_trunc('hour', ts), 'user:' || user_id FROM events)", COMPONENTS, recursive=True) + "SELECT node AS id, min(reach) AS component FROM r GROUP BY node")
def _(spark, d):
    e = P.table(spark, d, "events")
    hour = F.concat(F.lit("hour:"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    return G.components(e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_id"), hour.alias("target_id"), F.lit("x").alias("type")))


RANK_ROUND = """, r{h} AS MATERIALIZED (SELECT id, dangling, 0.15 / n + 0.85 * (coalesce(got, 0.0) + (SELECT coalesce(sum(rank), 0.0) FROM r{p} WHERE dangling) / n) AS rank FROM nodes LEFT JOIN (SELECT target_id AS id, sum(share * rank) AS got FROM shares JOIN r{p} ON source_id = r{p}.id GROUP BY target_id) USING (id), total)"""


@query("graph_pagerank_k", with_(P.EDGES, "e AS (SELECT source_id, target_id, greatest(0.001, max(confidence)) AS w FROM edge GROUP BY ALL)", "shares AS (SELECT source_id, target_id, w / sum(w) OVER (PARTITION BY source_id) AS share FROM e)", "ids AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)", "nodes AS (SELECT id, id NOT IN (SELECT source_id FROM e) AS dangling FROM ids)", "total AS (SELECT count(*)::DOUBLE AS n FROM ids)", "r0 AS (SELECT id, dangling, 1.0 / n AS rank FROM nodes, total)") + "".join(RANK_ROUND.format(h=i + 1, p=i) for i in range(10)) + "SELECT id, round(rank, 8) AS rank FROM r10")
def _(spark, d):
    edges, name = P.coded_edges(spark, d)
    return G.pagerank(edges).select(name(F.col("id")).alias("id"), F.round("rank", 8).alias("rank"))


LABEL_ROUND = """, l{h} AS MATERIALIZED (SELECT l{p}.node, CASE WHEN vote < label OR {even} THEN vote ELSE label END AS label FROM l{p} JOIN (SELECT node, min({{'w': -w, 'v': vote}}).v AS vote FROM (SELECT b2.node, label AS vote, round(sum(weight), 6) AS w FROM b2 JOIN l{p} ON other = l{p}.node GROUP BY b2.node, label) GROUP BY node) m ON l{p}.node = m.node)"""


@query("graph_label_communities", with_(P.EDGES, "u AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(confidence) AS weight FROM edge WHERE provenance IN ('extracted', 'resolved', 'inferred') GROUP BY ALL)", "b2 AS (SELECT a AS node, b AS other, weight FROM u UNION ALL SELECT b, a, weight FROM u)", "l0 AS (SELECT DISTINCT node, node AS label FROM b2)") + "".join(LABEL_ROUND.format(h=i + 1, p=i, even=str(i % 2 == 0).upper()) for i in range(5)) + "SELECT node AS id, label AS community FROM l5")
def _(spark, d):
    edges, name = P.coded_edges(spark, d)
    return G.label_communities(G.undirected(edges)).select(*[name(F.col(c)).alias(c) for c in ("id", "community")])


@query("graph_parent_cycles", """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), s AS (SELECT 0 AS i, c_custkey AS id FROM customer UNION SELECT i + 1, (id * 10 + 3) % n FROM s, n WHERE i < 16)
SELECT DISTINCT 'customer:' || id AS id FROM s WHERE i = 16""")
def _(spark, d):
    c = P.table(spark, d, "customer")
    key = lambda x: F.concat(F.lit("customer:"), x.cast("string"))
    return G.parent_cycles(c.select(key(F.col("c_custkey")).alias("id"), key((F.col("c_custkey") * 10 + 3) % c.count()).alias("parent_id")), 6)


@query("graph_collapse", with_(P.ENTITIES, P.EDGES) + """, m AS (SELECT id, kind || '/' || root_id AS community FROM ent)
SELECT s.community AS a, t.community AS b, count(*) AS bundled, max(confidence) AS confidence, min(type) AS type FROM edge JOIN m s ON source_id = s.id JOIN m t ON target_id = t.id WHERE s.community <> t.community GROUP BY ALL""")
def _(spark, d):
    m = cut(P.entities(spark, d).select("id", F.concat_ws("/", "kind", "root_id").alias("community")), "members")
    return G.collapse(P.edges(spark, d), m)


@query("graph_aggregate_dir", with_(P.ENTITIES) + """SELECT split_part(path, '/', 1) AS directory, count(*) AS entities, array_to_string(list_sort(list(id))[1:200], ' ') AS members FROM ent GROUP BY ALL""")
def _(spark, d):
    return G.directories(P.entities(spark, d)).withColumn("members", F.array_join("members", " "))


@query("graph_global_topn", with_(P.EDGES) + """, i AS (SELECT id, count(*) AS value FROM (SELECT source_id AS id FROM edge UNION ALL SELECT target_id FROM edge) GROUP BY id), top AS (SELECT id FROM i ORDER BY value DESC, id LIMIT 300)
SELECT * FROM edge WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top) ORDER BY confidence DESC, source_id, target_id, type, provenance LIMIT 1200""")
def _(spark, d):
    e = P.edges(spark, d)
    return G.global_graph(P.entities(spark, d), e, G.degrees(e).select("id", F.col("degree").alias("value")), 300, 1200)


@query("community_label_mode", with_(P.ENTITIES) + """, t AS (SELECT root_id AS community, list_extract(string_split(path, '/'), -2) AS term, count(*) AS n FROM ent WHERE contains(path, '/') GROUP BY ALL), s AS (SELECT root_id AS community, count(*) AS size FROM ent GROUP BY ALL)
SELECT community, size, (SELECT term FROM t WHERE t.community = s.community ORDER BY n DESC, term LIMIT 1) AS label, size = (SELECT max(size) FROM s) AS dominant FROM s""")
def _(spark, d):
    from ..operators.aggregates import community_labels

    return community_labels(P.entities(spark, d).withColumn("community", F.col("root_id")))


@query("facet_counts", with_(P.ENTITIES, P.EDGES) + """SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM ent GROUP BY ALL UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*) FROM ent GROUP BY ALL UNION ALL SELECT 'root', root_id, count(*) FROM ent GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM edge GROUP BY ALL UNION ALL SELECT 'provenance', provenance, count(*) FROM edge GROUP BY ALL""")
def _(spark, d):
    from ..operators.aggregates import facets

    return facets(P.entities(spark, d), {"kind": "kind", "language": "language", "root": "root_id"}).unionByName(facets(P.edges(spark, d), {"type": "type", "provenance": "provenance"}))


@query("agg_fingerprint", with_(P.ENTITIES, P.EDGES) + """SELECT (SELECT count(*) || ':' || CAST(max(size) AS BIGINT) FROM ent) AS nodes, (SELECT count(*) || ':' || CAST(max(confidence) AS BIGINT) FROM edge) AS edges""")
def _(spark, d):
    from ..operators.aggregates import fingerprint

    a = fingerprint(P.entities(spark, d), "size").withColumnRenamed("fingerprint", "nodes")
    return a.crossJoin(F.broadcast(fingerprint(P.edges(spark, d), "confidence").withColumnRenamed("fingerprint", "edges")))  # a row each


@query("rank_fuse", with_(P.ENTITIES, P.EDGES) + """, lex AS (SELECT 'q' || (o_custkey % 4) AS query_id, 'orders:' || o_orderkey AS id, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey % 4), 6) AS v FROM orders),
ex AS (SELECT 'q' || (c_custkey % 4) AS query_id, 'customer:' || c_custkey AS id, 1.0::DOUBLE AS v FROM customer WHERE c_acctbal > 5000),
sem AS (SELECT 'q' || (o_custkey % 4) AS query_id, 'orders:' || o_orderkey AS id, round((o_orderkey % 97) / 97.0, 6)::DOUBLE AS v FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT query_id, id, max(l) AS lexical, max(e) AS exact_name, max(s) AS semantic FROM (SELECT query_id, id, v AS l, NULL::DOUBLE AS e, NULL::DOUBLE AS s FROM lex UNION ALL SELECT query_id, id, NULL, v, NULL FROM ex UNION ALL SELECT query_id, id, NULL, NULL, v FROM sem) GROUP BY ALL),
imp AS (SELECT id, count(*) AS value FROM (SELECT source_id AS id FROM edge UNION ALL SELECT target_id FROM edge) GROUP BY id),
b AS (SELECT id, max(CASE provenance WHEN 'extracted' THEN 0.05 WHEN 'resolved' THEN 0.03 ELSE 0.0 END::DOUBLE) AS bonus FROM (SELECT source_id AS id, provenance, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id, type, provenance) AS r FROM edge) WHERE r <= 20 GROUP BY id),
j AS (SELECT c.*, e.kind, imp.value, e.root_id || '/' || e.kind AS community, b.bonus, count(e.root_id) OVER (PARTITION BY query_id, e.root_id || '/' || e.kind) AS size FROM c JOIN ent e USING (id) LEFT JOIN imp USING (id) LEFT JOIN b USING (id)),
s AS (SELECT query_id, id, round(coalesce(semantic, 0.0) * 1.0 + coalesce(lexical, 0.0) * 0.8 + coalesce(exact_name, 0.0) * 1.6 + coalesce(value / max(value) OVER (PARTITION BY query_id), 0.0) * 0.2 + CASE kind WHEN 'function' THEN 1.0 WHEN 'class' THEN 0.95 ELSE 0.4 END * 0.15 + CASE WHEN community = first_value(community) OVER (PARTITION BY query_id ORDER BY size DESC, community) THEN 0.1 ELSE 0.0 END + coalesce(bonus, 0.0), 6) AS score FROM j)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 50""")
def _(spark, d):
    o, c = P.table(spark, d, "orders"), P.table(spark, d, "customer")
    q = lambda k: F.concat(F.lit("q"), (F.col(k) % 4).cast("string")).alias("query_id")
    oid = F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("id")
    lex = ranking.normalised(o.select(q("o_custkey"), oid, F.col("o_totalprice").alias("score"))).withColumn("value", F.round("value", 6))
    exact = c.where("c_acctbal > 5000").select(q("c_custkey"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1.0).alias("value"))
    sem = o.where("o_orderstatus = 'F'").select(q("o_custkey"), oid, F.round((F.col("o_orderkey") % 97) / 97.0, 6).alias("value"))
    cand = ranking.absorb({"lexical": lex, "exact_name": exact, "semantic": sem})
    e, edges = cut(P.entities(spark, d), "entities"), cut(P.edges(spark, d), "edges")
    cand = cut(cand, "candidates")
    comm = e.select("id", F.concat_ws("/", "root_id", "kind").alias("community"))
    got = ranking.fuse(cand, e, G.degrees(edges).select("id", F.col("degree").alias("value")), comm, ranking.provenance_bonus(edges), ["lexical", "exact_name", "semantic"])
    return got.where("rank <= 50").select("query_id", "id", "score", "rank")


@query("rank_dedupe_first", """WITH a AS (SELECT 'customer:' || o_custkey AS key, 0 AS l, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL), b AS (SELECT 'customer:' || c_custkey AS key, 1 AS l, c_custkey AS p FROM customer)
SELECT key, l AS list, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l, p) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE r = 1 ORDER BY l, p, key LIMIT 54""")
def _(spark, d):
    cid = lambda k: F.concat(F.lit("customer:"), F.col(k).cast("string")).alias("key")
    a = P.table(spark, d, "orders").where("o_orderstatus = 'P'").select(cid("o_custkey"), F.col("o_orderkey").alias("position"))
    b = P.table(spark, d, "customer").select(cid("c_custkey"), F.col("c_custkey").alias("position"))
    return ranking.first_wins([a, b], "key", 54)


@query("inc_plan_diff", """WITH k AS (SELECT 'o' || o_orderkey AS path, sha256(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 10 <> 0), f AS (SELECT 'o' || o_orderkey AS path, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT path, CASE WHEN k.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'removed' WHEN k.h = f.h THEN 'unchanged' ELSE 'changed' END AS change FROM k FULL JOIN f USING (path)""")
def _(spark, d):
    o = P.table(spark, d, "orders")
    key, path, body = F.col("o_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.concat("o_orderstatus", "o_orderpriority")
    known = o.where(key % 10 != 0).select(path, I.content_hash(body).alias("content_hash"))
    found = o.where(key % 11 != 0).select(path, I.content_hash(F.concat(F.when(key % 7 == 0, "x").otherwise(""), body)).alias("content_hash"))
    return incremental.plan_update(known, found)


@query("inc_edge_upsert", with_(P.EDGES) + """, old AS (SELECT *, 'r' AS resolver FROM edge WHERE type <> 'defines'), new AS (SELECT source_id, target_id, type, provenance, 0.5::DOUBLE AS confidence, 'r' AS resolver FROM edge WHERE type IN ('defines', 'calls'))
SELECT o.source_id, o.target_id, o.type, o.provenance, coalesce(n.confidence, o.confidence) AS confidence, o.resolver FROM old o LEFT JOIN new n ON o.source_id = n.source_id AND o.target_id = n.target_id AND o.type = n.type AND o.provenance = n.provenance
UNION ALL SELECT source_id, target_id, type, provenance, confidence, resolver FROM new WHERE type = 'defines'""")
def _(spark, d):
    e = P.edges(spark, d).withColumn("resolver", F.lit("r"))
    return incremental.upsert_edges(e.where("type <> 'defines'"), e.where("type in ('defines', 'calls')").withColumn("confidence", F.lit(0.5)))


@query("res_resolve_tiers", with_(P.ENTITIES) + """, s AS (SELECT id, name, split_part(name, ' ', 2) AS leaf, path, language, NULL::VARCHAR AS module FROM ent WHERE kind = 'interface'),
sym AS (SELECT id, CASE WHEN kind = 'interface' THEN split_part(name, ' ', 2) ELSE name END AS s_name, qualified_name, CASE WHEN kind = 'interface' THEN split_part(path, '/', 2) ELSE path END AS s_path, CASE WHEN kind = 'interface' THEN ['c', 'cpp', 'csharp'][length(name) % 3 + 1] ELSE language END AS s_lang, root_id AS s_module FROM ent WHERE kind IN ('interface', 'class')),
ref AS (SELECT 'ref:' || p_partkey AS ref_id, 'part:' || p_partkey AS source_id, CASE WHEN p_partkey % 5 = 0 THEN 'Customer#' || lpad((p_partkey % 200)::VARCHAR, 9, '0') WHEN p_partkey % 17 = 0 THEN 'nowhere' WHEN p_partkey % 13 = 0 THEN 'len' ELSE split_part(p_name, ' ', 2) END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'other' END AS path, ['c', 'cpp', 'python', 'typescript'][p_partkey % 4 + 1] AS language, CASE WHEN p_partkey % 3 = 0 THEN 'root:1' END AS module FROM part),
dia AS (SELECT * FROM (VALUES ('typescript', 'javascript'), ('javascript', 'typescript'), ('tsx', 'javascript'), ('javascript', 'tsx'), ('c', 'cpp'), ('cpp', 'c'), ('c', 'csharp'), ('csharp', 'c'), ('cpp', 'csharp'), ('csharp', 'cpp')) v(x, y)),
hit AS (SELECT ref_id, id, CASE WHEN r.name = qualified_name AND r.path = s_path THEN 1 WHEN r.name = s_name AND r.path = s_path THEN 2 WHEN r.name = s_name AND module = s_module AND (language = s_lang OR (language, s_lang) IN (SELECT (x, y) FROM dia)) THEN 3 WHEN r.name = s_name AND language IS NOT DISTINCT FROM s_lang THEN 4 WHEN r.name = s_name AND (language, s_lang) IN (SELECT (x, y) FROM dia) THEN 5 END AS tier FROM ref r JOIN sym ON r.name = s_name OR r.name = qualified_name WHERE r.name <> 'len' AND id <> source_id),
best AS (SELECT *, min(tier) OVER (PARTITION BY ref_id) AS b FROM hit WHERE tier IS NOT NULL),
g AS (SELECT ref_id, tier, count(*) AS n, list_sort(list(id))[1:8] AS c FROM best WHERE tier = b GROUP BY ALL)
SELECT ref_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, tier, CASE WHEN n = 1 THEN c[1] END AS target_id, coalesce(array_to_string(c, ' '), '') AS candidates FROM ref LEFT JOIN g USING (ref_id) WHERE name <> 'len'""")
def _(spark, d):
    e = P.entities(spark, d).where("kind in ('interface', 'class')")
    part = F.col("kind") == "interface"
    lang = F.when(part, F.get(F.array(*map(F.lit, ("c", "cpp", "csharp"))), F.char_length("name") % 3)).otherwise(F.col("language"))
    sym = e.select("id", F.when(part, F.split("name", " ")[1]).otherwise(F.col("name")).alias("name"), "qualified_name", F.when(part, F.split("path", "/")[1]).otherwise(F.col("path")).alias("path"), lang.alias("language"), F.col("root_id").alias("module"))
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("Customer#"), F.lpad((k % 200).cast("string"), 9, "0"))).when(k % 17 == 0, "nowhere").when(k % 13 == 0, "len").otherwise(F.split("p_name", " ")[1])
    ref = P.table(spark, d, "part").select(
        F.concat(F.lit("ref:"), k.cast("string")).alias("ref_id"), F.concat(F.lit("part:"), k.cast("string")).alias("source_id"), name.alias("name"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("other").alias("path"),
        F.get(F.array(*map(F.lit, ("c", "cpp", "python", "typescript"))), (k % 4).cast("int")).alias("language"), F.when(k % 3 == 0, "root:1").alias("module"),
    )
    return resolve.resolve(ref, sym).withColumn("candidates", F.array_join("candidates", " "))
