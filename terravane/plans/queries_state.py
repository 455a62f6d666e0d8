"""Registered queries over kept state: revisions, notes, freshness, excerpts, path rules, counts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import identity as I
from ..functions import text as T
from ..operators import aggregates, context, filters, incremental, memory, quality, ranking
from ..sources import files
from . import property_graph as P
from .queries_graph import query, with_

REVISIONS = "rev AS (SELECT user_id, event_id, epoch_us(ts) AS valid_from, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"
MOMENT = "(SELECT (min(valid_from) + max(valid_from)) // 2 FROM rev)"


def revisions(spark, d):
    e = P.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"))
    r = memory.history(e, "user_id", "valid_from", "event_id")
    return r, r.agg(F.expr("(min(valid_from) + max(valid_from)) div 2")).first()[0]


@query("mem_as_of", with_(REVISIONS) + f"SELECT user_id, event_id FROM rev WHERE valid_from <= {MOMENT} AND (valid_to IS NULL OR valid_to > {MOMENT})")
def _(spark, d):
    r, moment = revisions(spark, d)
    return memory.as_of(r, "valid_from", moment).select("user_id", "event_id")


@query("mem_status_counts", with_(REVISIONS, f"s AS (SELECT valid_to IS NULL OR valid_to > {MOMENT} AS c, CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'project' END AS scope FROM rev)") + "SELECT count(*) AS revisions, count(*) FILTER (c) AS current, count(*) FILTER (NOT c) AS superseded, count(*) FILTER (c AND scope = 'user') AS user_notes, count(*) FILTER (c AND scope = 'project') AS project_notes FROM s")
def _(spark, d):
    r, moment = revisions(spark, d)
    return aggregates.note_status(r.withColumn("scope", F.when(F.col("user_id") % 3 == 0, "user").otherwise("project")), moment)


@query("mem_merge", """WITH cur AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS content, max(o_orderkey) AS valid_from FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
new AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS content, max(o_orderkey) AS valid_from FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT * FROM cur UNION ALL SELECT new.id, new.content, CASE WHEN cur.id IS NULL THEN new.valid_from ELSE greatest(new.valid_from, cur.valid_from + 1) END FROM new LEFT JOIN cur USING (id) WHERE cur.id IS NULL OR new.content IS DISTINCT FROM cur.content""")
def _(spark, d):
    o = P.table(spark, d, "orders")
    last = lambda half: o.where(F.col("o_orderkey") % 2 == half).groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("content"), F.max("o_orderkey").alias("valid_from"))
    return memory.merge(last(0), last(1), "id", ["content"], "valid_from")


@query("mem_forget", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    gone = P.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return memory.forget(P.table(spark, d, "events"), gone, "user_id").select("event_id", "user_id")


@query("mem_hybrid_score", """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN round((o_orderkey % 79) / 100.0::DOUBLE, 6) END AS lexical, CASE WHEN o_orderkey % 5 > 0 THEN round((o_custkey % 101) / 100.0::DOUBLE, 6) END AS similarity FROM orders),
s AS (SELECT id, coalesce(lexical, 0.0) AS lexical, CASE WHEN similarity >= 0.28 THEN similarity END AS similarity FROM b WHERE lexical IS NOT NULL OR similarity IS NOT NULL)
SELECT id, round(CASE WHEN similarity IS NULL THEN lexical ELSE 0.45 * lexical + 0.55 * greatest(0.0, least(1.0, (similarity - 0.35) / 0.5)) END, 6) AS score, lexical, similarity FROM s WHERE lexical >= 0.4 OR coalesce(similarity, 0.0) >= 0.65""")
def _(spark, d):
    o = P.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    lex = o.where("id % 3 > 0").select("id", F.round((F.col("id") % 79).cast("double") / 100, 6).alias("lexical"))
    sem = o.where("id % 5 > 0").select("id", F.round((F.col("o_custkey") % 101).cast("double") / 100, 6).alias("similarity"))
    return memory.hybrid_score(lex, sem)


@query("inc_freshness", """WITH k AS (SELECT p_name || p_partkey AS path, p_size AS size, p_retailprice AS mtime FROM part WHERE p_partkey % 10 > 0),
l AS (SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice END AS mtime FROM part WHERE p_partkey % 13 > 0)
SELECT count(*) FILTER (l.path IS NULL) AS missing, count(*) FILTER (k.path IS NULL) AS new, count(*) FILTER (l.path IS NOT NULL AND k.path IS NOT NULL AND (k.size <> l.size OR k.mtime <> l.mtime)) AS changed FROM k FULL JOIN l ON k.path = l.path""")
def _(spark, d):
    p = P.table(spark, d, "part")
    path, key = F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey")
    known = p.where(key % 10 > 0).select(path, F.col("p_size").alias("size"), F.col("p_retailprice").alias("mtime"))
    listed = p.where(key % 13 > 0).select(path, F.when(key % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.when(key % 11 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("mtime"))
    return incremental.freshness(listed, known)


@query("inc_delete_nodes", with_(P.ENTITIES, P.EDGES) + ", gone AS (SELECT id FROM ent WHERE kind = 'interface' AND size < 950) SELECT type, count(*) AS edges FROM edge WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) GROUP BY ALL")
def _(spark, d):
    e = P.entities(spark, d)
    _, edges = incremental.delete_nodes(e, P.edges(spark, d), e.where("kind = 'interface' and size < 950").select("id"))
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


@query("src_excerpt", "SELECT conv_id, turn, left(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), 200) AS excerpt FROM conversations")
def _(spark, d):
    c = P.table(spark, d, "conversations")
    return c.select("conv_id", "turn", context.excerpt(F.col("text"), F.lit(2), 3, 200).alias("excerpt"))


def cases(table: dict[str, str]) -> str:
    return " ".join(f"WHEN x = '{e}' THEN '{name}'" for e, name in table.items())


FILES = "f AS (SELECT page_id, 'site/' || page_id || ['/a.py', '/b.ts', '/c.png', '/d.mp4', '/e.md', '/node_modules/f.js', '/.git/config', '/g.unknown', '/H.RS'][page_id % 9 + 1] AS path FROM pages), x AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM f)"


@query("src_classify", with_(FILES) + f"SELECT path, CASE {cases(V.LANGUAGE_EXTENSIONS)} END AS language, CASE {cases(V.MEDIA_EXTENSIONS)} END AS media, NOT (path LIKE '%/node_modules/%' OR path LIKE '%/.git/%') AS watched FROM x")
def _(spark, d):
    tails = F.array(*map(F.lit, ("/a.py", "/b.ts", "/c.png", "/d.mp4", "/e.md", "/node_modules/f.js", "/.git/config", "/g.unknown", "/H.RS")))
    p = P.table(spark, d, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.get(tails, (F.col("page_id") % 9).cast("int"))).alias("path"))
    c = F.col("path")
    return p.select("path", files.language(c).alias("language"), files.media_kind(c).alias("media"), filters.watched(c).alias("watched"))


@query("flt_needs_embedding", with_(P.ENTITIES) + "SELECT kind, count(*) FILTER (kind NOT IN ('repository', 'directory') AND (kind <> 'module' OR length(path) > 20)) AS embedded, count(*) AS n FROM ent GROUP BY ALL")
def _(spark, d):
    e = P.entities(spark, d)
    return e.groupBy("kind").agg(F.count_if(filters.needs_embedding(F.col("kind"), F.col("path"))).alias("embedded"), F.count(F.lit(1)).alias("n"))


@query("fn_representation", r"SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || chr(10) || 'end  ', '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS representation_sha256 FROM conversations")
def _(spark, d):
    c = P.table(spark, d, "conversations")
    return c.select("conv_id", "turn", I.content_hash(I.normalize_representation(F.concat("text", F.lit("\n\n\n\nend  ")))).alias("representation_sha256"))


@query("fn_token_estimate", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::BIGINT AS tokens FROM documents")
def _(spark, d):
    return P.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("agg_unresolved_breakdown", with_(P.ENTITIES) + ", u AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'missing_' || o_orderkey END AS name FROM orders), k AS (SELECT name IN (SELECT name FROM ent WHERE root_id = 'root:2') AS known FROM u) SELECT count(*) AS total, count(*) FILTER (known) AS actionable, count(*) FILTER (NOT known) AS external FROM k")
def _(spark, d):
    o, key = P.table(spark, d, "orders"), F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("missing_"), key.cast("string")))
    u = o.select(key.alias("ref_id"), name.alias("name"), F.lit("root:2").alias("root_id"))
    return aggregates.unresolved_breakdown(u, quality.actionable(u, P.entities(spark, d)), "ref_id")


@query("agg_dominant_language", with_(P.ENTITIES) + "SELECT language, count(*) AS n FROM ent WHERE language IS NOT NULL GROUP BY ALL ORDER BY n DESC, language LIMIT 1")
def _(spark, d):
    return aggregates.dominant(P.entities(spark, d).where("language is not null"), "language")


@query("rank_proximity", with_(P.EDGES, "b AS (SELECT source_id AS s, target_id AS t FROM edge UNION SELECT target_id, source_id FROM edge)", "d AS (SELECT 'part:7' AS id, 0 AS h UNION ALL SELECT t, 1 FROM b WHERE s = 'part:7' UNION ALL SELECT y.t, 2 FROM b x JOIN b y ON x.t = y.s WHERE x.s = 'part:7')") + "SELECT id, round(1 - min(h) / 3.0::DOUBLE, 6) AS value FROM d GROUP BY ALL")
def _(spark, d):
    return ranking.proximity(P.edges(spark, d), "part:7")


@query("ctx_snippet_containment", """WITH RECURSIVE x AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) AS r, CASE WHEN turn % 3 = 1 THEN text[1 + turn:] ELSE text END AS t FROM conversations),
f AS (SELECT g, 0::BIGINT AS r, []::VARCHAR[] AS kept FROM (SELECT DISTINCT g FROM x) UNION ALL SELECT f.g, x.r, CASE WHEN len([k for k in f.kept if contains(k, x.t)]) > 0 THEN f.kept ELSE list_append(f.kept, x.t) END FROM f JOIN x ON x.g = f.g AND x.r = f.r + 1)
SELECT g AS conv_id, len(arg_max(kept, r))::BIGINT AS kept FROM f GROUP BY ALL""")
def _(spark, d):
    c = P.table(spark, d, "conversations").select(F.col("conv_id").alias("group"), (F.col("turn") % 2).alias("start"), (-F.col("turn")).alias("end"), F.when(F.col("turn") % 3 == 1, F.substr("text", F.col("turn") + 1)).otherwise(F.col("text")).alias("text"))
    return context.without_contained(c).groupBy(F.col("group").alias("conv_id")).agg(F.count(F.lit(1)).alias("kept"))


@query("ctx_attach_notes", """WITH n AS (SELECT conv_id AS g, turn, text, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::BIGINT + 28 AS cost FROM conversations),
r AS (SELECT *, 420 - coalesce(sum(cost) OVER (PARTITION BY g ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM n),
k AS (SELECT g, turn, CASE WHEN cost <= room THEN text ELSE rtrim(regexp_replace(left(text, ((room - 28) * 4)::BIGINT), '\\S*$', ''), ' ') END AS text FROM r WHERE room > 28)
SELECT g AS "group", turn AS rank, turn AS id, text, (greatest(1, ceil(length(text) / 4.0)) + 28)::BIGINT AS cost FROM k WHERE text <> ''""".replace("\\\\", "\\"))
def _(spark, d):
    c = P.table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("rank"), F.col("turn").alias("id"), "text")
    return context.attach_notes(c, 500)
