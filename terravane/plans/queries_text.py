"""Registered queries over texts, vectors, notes and the change log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions import vectors as X
from ..operators import aggregates, context, extraction, incremental, lexical, memory, ranking, vector
from ..operators.checkpoints import cut
from ..operators.vector_index import VectorIndex
from ..streaming import changes
from . import property_graph as P
from .queries_graph import ORACLES, QUERIES, query, with_

FTS = {"source": V.FTS_WEIGHTS["name"], "lang": V.FTS_WEIGHTS["qualified_name"], "text": V.FTS_WEIGHTS["semantic_text"]}
TERMS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
FOLDED = "regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


FEW = 10_000  #: Questions up to which they are broadcast.


def terms_sql(c: str) -> str:
    return TERMS.format(c=c)


def folded_sql(c: str) -> str:
    return FOLDED.format(c=c)


POSTINGS = f"""tok AS (SELECT doc_id AS id, unnest({folded_sql("source")}) AS term, 4.0 AS w FROM documents UNION ALL SELECT doc_id, unnest({folded_sql("lang")}), 2.0 FROM documents UNION ALL SELECT doc_id, unnest({folded_sql("text")}), 1.0 FROM documents),
len AS (SELECT id, count(*) AS dl FROM tok GROUP BY id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
post AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
BM25 = """SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score, count(*) AS matched FROM post JOIN df USING (term) JOIN len USING (id) JOIN q USING (term), st GROUP BY ALL"""


def bm25_sql(q: str, k: int) -> str:
    return with_(q, POSTINGS) + f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ({BM25}) QUALIFY rank <= {k}"


QUESTION = "where is the nicht thble cióndo and étre in src3 de"
QUESTION_TERMS = "q AS (SELECT DISTINCT 0 AS query_id, unnest(['nicht', 'thble', 'ciondo', 'etre', 'src3', 'de']) AS term)"


@query("lex_bm25_topk", bm25_sql(QUESTION_TERMS, 20))
def _(spark, d):
    stop = F.array(*map(F.lit, V.STOPWORDS))
    q = spark.createDataFrame([(0, QUESTION)], "query_id int, text string")
    q = q.select("query_id", F.explode(F.filter(T.terms(F.col("text")), lambda w: ~F.array_contains(stop, w))).alias("term"))
    return lexical.bm25(P.table(spark, d, "documents"), q, "doc_id", FTS, 20)


@query("lex_bm25_batch", bm25_sql(f"q AS (SELECT DISTINCT item_id AS query_id, unnest({folded_sql('text')}) AS term FROM benchmark)", 5))
def _(spark, d):
    q = P.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.terms(F.col("text"))).alias("term"))
    return lexical.bm25(P.table(spark, d, "documents"), q, "doc_id", FTS, 5)


@query("lex_and_or_fallback", with_("q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'is'), (2, 'und'), (2, 'que'), (2, 'zzzz')) v(query_id, term))", f"d AS (SELECT doc_id AS id, unnest(list_distinct({terms_sql('text')})) AS term FROM documents)", "h AS (SELECT query_id, id, count(*) AS matched FROM d JOIN q USING (term) GROUP BY ALL)", "f AS (SELECT h.*, need, max(matched = need) OVER (PARTITION BY query_id) AS every FROM h JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY ALL) USING (query_id))") + "SELECT query_id, id, matched, CASE WHEN every THEN 'and' ELSE 'or' END AS mode FROM f WHERE NOT every OR matched = need")
def _(spark, d):
    q = spark.createDataFrame([(1, "the"), (1, "is"), (2, "und"), (2, "que"), (2, "zzzz")], "query_id int, term string")
    return lexical.and_or(P.table(spark, d, "documents"), q, "doc_id", "text")


@query("lex_term_stats", f"SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _(spark, d):
    return lexical.term_stats(P.table(spark, d, "documents"), F.col("text"))


@query("lex_exact_match", with_(P.ENTITIES) + """, ref AS (SELECT n_name AS ref FROM nation UNION SELECT DISTINCT p_name FROM part UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT p_brand || '/' || p_name FROM part UNION SELECT r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT ref, id, 0.0 AS n, 1.0 AS p FROM ref JOIN ent ON ref = path WHERE contains(ref, '/') UNION ALL SELECT ref, id, 0.0, 0.8 FROM ref JOIN ent ON ends_with(path, '/' || ref) WHERE contains(ref, '/')
UNION ALL SELECT ref, id, 1.0, 0.0 FROM ref JOIN ent ON ref = qualified_name WHERE NOT contains(ref, '/') UNION ALL SELECT ref, id, 0.9, 0.0 FROM ref JOIN ent ON list_extract(string_split(ref, '.'), -1) = name WHERE NOT contains(ref, '/')),
g AS (SELECT ref, id, max(n)::DOUBLE AS exact_name, max(p)::DOUBLE AS exact_path FROM h GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY ref ORDER BY greatest(exact_name, exact_path) DESC, id)::INT AS rank FROM g QUALIFY rank <= 50""")
def _(spark, d):
    n = P.table(spark, d, "nation").join(F.broadcast(P.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    p = P.table(spark, d, "part")
    refs = n.select(F.col("n_name").alias("ref"))
    for more in (p.select("p_name"), n.select(F.concat_ws("/", "r_name", "n_name")), p.select(F.concat_ws("/", "p_brand", "p_name")), n.select(F.concat_ws(".", "r_name", "n_name"))):
        refs = refs.union(more)
    return lexical.exact_matches(P.entities(spark, d), refs.distinct())


def vectors(spark, d):
    return P.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


@query("vec_knn_query", f"SELECT vec_id AS id, {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')} AS similarity FROM embeddings ORDER BY similarity DESC, id LIMIT 10")
def _(spark, d):
    q = vectors(spark, d).where("id = 7").first()["vector"]
    return vector.knn(vectors(spark, d), q, 10)


@query("vec_knn_batch", f"""WITH q AS (SELECT label AS query_id, list(s ORDER BY i) AS vector FROM (SELECT label, i, avg(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT query_id::BIGINT AS query_id, vec_id AS id, {COS.format(a='vector', b='embedding')} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format(a='vector', b='embedding')} DESC, vec_id)::INT AS rank FROM q, embeddings QUALIFY rank <= 10""")
def _(spark, d):
    e = P.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    q = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return vector.all_knn(q, vectors(spark, d), 10)


@query("vec_index_search", f"SELECT a.vec_id AS query_id, b.vec_id AS id, {COS.format(a='a.embedding', b='b.embedding')} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10")
def _(spark, d):
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return VectorIndex.fitted(v, lists=32).search_all(asked, 10, exact=True, same=True)


NEIGHBOURS = f"nb AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS.format(a='a.embedding', b='b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM nb QUALIFY rank <= 5)"


def stored(spark, d):
    return P.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def neighbours(spark, d, k=5):
    return vector.own_knn(stored(spark, d), k)


@query("vec_neighbors_topk", with_(NEIGHBOURS) + "SELECT * FROM top")
def _(spark, d):
    return neighbours(spark, d)


@query("vec_mutual_knn", with_(NEIGHBOURS) + "SELECT x.query_id AS a, x.id AS b, x.similarity FROM top x JOIN top y ON x.query_id = y.id AND x.id = y.query_id WHERE x.query_id < x.id")
def _(spark, d):
    return vector.mutual(neighbours(spark, d))


@query("vec_threshold_median", with_(NEIGHBOURS) + "SELECT round(median(similarity), 6) AS median_best, round(greatest(0.55, 0.85 * round(median(similarity), 6)), 6) AS threshold FROM top WHERE rank = 1")
def _(spark, d):
    return vector.threshold(neighbours(spark, d, 1))  # of which only the best is asked for


@query("vec_semantic_edges")
def _(spark, d):
    v = stored(spark, d)
    near = cut(vector.own_knn(v, 16), "neighbours")  # twelve partners and four more, as the stage asks for
    return vector.semantic_edges(near, v.count(), vector.threshold(near).first()["threshold"])


@query("vec_norm_check", "SELECT len(embedding)::INT AS dimensions, count(*) AS vectors, count(*) FILTER (abs(n - 1) > 0.02) AS off_norm, round(min(n), 4) AS least, round(max(n), 4) AS greatest FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) GROUP BY ALL")
def _(spark, d):
    return vector.norm_check(vectors(spark, d))


@query("vec_matryoshka", "SELECT vec_id AS id, i::INT AS i, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS i, sqrt(list_dot_product(h, h)) AS n FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS h FROM embeddings))")
def _(spark, d):
    return vectors(spark, d).select("id", F.posexplode(X.truncate(F.col("vector"), 16)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("agg_embedding_counts", "SELECT label, len(embedding)::INT AS dimensions, count(*) AS n FROM embeddings GROUP BY ALL")
def _(spark, d):
    return P.table(spark, d, "embeddings").groupBy("label", F.size("embedding").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "documents", "events")))
def _(spark, d):
    return aggregates.table_counts({t: P.table(spark, d, t) for t in ("customer", "orders", "lineitem", "documents", "events")})


@query("agg_percentile", "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r = round_even((n - 1) * 0.95, 0)")
def _(spark, d):
    return aggregates.percentile_nearest(P.table(spark, d, "events"), "value", 0.95)


def intent_sql(column: str) -> str:
    q = lambda p: p.replace("(?i)", "").replace("'", "''")
    whens = " ".join(f"WHEN regexp_matches(trim({column}), '{q(p)}', '{'i' if p.startswith('(?i)') else 'c'}') THEN '{n}'" for n, p in V.INTENT_PATTERNS)
    return f"CASE {whens} ELSE 'semantic' END"


ASK = "ask AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'where is ' WHEN 1 THEN 'how does it reach ' WHEN 2 THEN 'fix the error in ' WHEN 3 THEN 'tests for ' WHEN 4 THEN 'architecture of ' ELSE '' END || text AS q FROM conversations WHERE role = 'user')"


def asked(spark, d):
    c = P.table(spark, d, "conversations").where("role = 'user'")
    lead = F.get(F.array(*map(F.lit, ("where is ", "how does it reach ", "fix the error in ", "tests for ", "architecture of ", ""))), (F.col("conv_id") % 6).cast("int"))
    return c.select("conv_id", "turn", F.concat(lead, F.col("text")).alias("q"))


@query("rank_intent", with_(ASK) + f"SELECT conv_id, turn, {intent_sql('q')} AS intent FROM ask")
def _(spark, d):
    return asked(spark, d).select("conv_id", "turn", T.detect_intent(F.col("q")).alias("intent"))


def plan_sql(budget: int) -> str:
    q = lambda p: p.replace("(?i)", "").replace("'", "''")
    hit = lambda p: f"regexp_matches(q, '{q(p)}', 'i')"
    whens = " ".join(f"WHEN {hit(p)} THEN '{n}'" for n, p in V.PLAN_PATTERNS)
    most = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.PLAN_BUDGETS.items())
    return f""", a AS (SELECT conv_id, turn, trim(q) AS q, len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) AS words FROM ask),
b AS (SELECT *, q = '' OR {hit(V.SOCIAL)} AS skipped, {hit(V.NARROW)} AND words <= 12 AND NOT {hit(V.BROAD)} AS locate, CASE {whens} ELSE 'explain' END AS i FROM a)
SELECT conv_id, turn, CASE WHEN skipped THEN 'none' WHEN locate THEN 'locate' ELSE i END AS intent, (CASE WHEN skipped THEN 0 WHEN locate THEN least({budget}, 1000) ELSE least({budget}, 6000, CASE i {most} END + CASE WHEN words > 30 THEN 600 ELSE 0 END) END)::INT AS budget, skipped,
CASE WHEN skipped THEN '' WHEN locate THEN 'exact lexical' WHEN i = 'explain' THEN 'exact lexical semantic' ELSE 'exact lexical semantic structural tests' END AS lanes FROM b"""


@query("ctx_plan", with_(ASK) + plan_sql(3500))
def _(spark, d):
    return asked(spark, d).select("conv_id", "turn", T.plan_context(F.col("q"), 3500).alias("p")).select("conv_id", "turn", "p.intent", "p.budget", "p.skipped", F.array_join("p.lanes", " ").alias("lanes"))


@query("ctx_pack_budget", with_("x AS (SELECT conv_id AS g, turn AS r, ceil(length(text) / 4)::BIGINT AS c FROM conversations)", "f AS (SELECT g, -1::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS c, FALSE AS kept FROM (SELECT DISTINCT g FROM x) UNION ALL SELECT x.g, x.r, f.used + CASE WHEN f.used + x.c <= 480 THEN x.c ELSE 0 END, x.c, f.used + x.c <= 480 FROM f JOIN x ON x.g = f.g AND x.r = f.r + 1)", recursive=True) + """SELECT g AS "group", r AS rank, r AS id, c AS cost, kept FROM f WHERE r >= 0""")
def _(spark, d):
    c = P.table(spark, d, "conversations")
    return context.pack(c.select(F.col("conv_id").alias("group"), F.col("turn").alias("rank"), F.col("turn").alias("id"), T.estimate_tokens(F.col("text")).cast("long").alias("cost")), 600)


@query("ctx_cursor_dedupe", """SELECT user_id AS session, sha256(event_type || '|' || props) AS key, min(event_id) AS event_id FROM events e WHERE value >= 10 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.value < 10 AND o.user_id = e.user_id AND o.event_type = e.event_type AND o.props = e.props) GROUP BY ALL""")
def _(spark, d):
    e = P.table(spark, d, "events").select(F.col("user_id").alias("session"), F.sha2(F.concat_ws("|", "event_type", "props").cast("binary"), 256).alias("key"), "event_id", "value")
    return context.undelivered(e.where("value >= 10").drop("value"), e.where("value < 10").select("session", "key"), "session", "key")


@query("inc_embed_reuse", "SELECT doc_id, sha256(text) AS input_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1', 'src2'))")
def _(spark, d):
    docs = P.table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("input_hash"))
    return incremental.to_embed(docs.select("doc_id", "input_hash"), docs.where("source in ('src0', 'src1', 'src2')"), ["input_hash"])


@query("mem_scd2_history", """SELECT user_id, event_id, epoch_us(ts) AS valid_from, lead(epoch_us(ts)) OVER w AS valid_to, lead(event_id) OVER w AS superseded_by, lead(event_id) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(spark, d):
    e = P.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"))
    return memory.history(e, "user_id", "valid_from", "event_id")


@query("mem_scope_visible", """SELECT doc_id, scope FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'project' END AS scope, source AS project_key FROM documents) WHERE scope = 'user' OR project_key = 'src4'""")
def _(spark, d):
    n = P.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "user").otherwise("project").alias("scope"), F.col("source").alias("project_key"))
    return memory.visible(n, "all", "src4").select("doc_id", "scope")


# The words of the question and their variants, as the term rules give them.
LEXICAL = f"""WITH n AS (SELECT doc_id AS id, list_distinct({terms_sql('text')}) AS body, ' ' || array_to_string({terms_sql('text')}, ' ') || ' ' AS line, [lower(lang), lower(source)] AS label FROM documents),
t AS (SELECT * FROM (VALUES ('checks', ['checks', 'check', 'test', 'tests', 'validation']), ('onand', ['onand']), ('tioning', ['tioning', 'tion'])) v(term, forms)),
p AS (SELECT id, term, line, CASE WHEN len(list_filter(forms, lambda v: len(list_filter(label, lambda k: v = k OR (length(v) >= 5 AND starts_with(k, v)) OR (length(k) >= 5 AND starts_with(v, k)))) > 0)) > 0 THEN 1.25 WHEN len(list_filter(forms, lambda v: len(list_filter(body, lambda k: v = k OR (length(v) >= 5 AND starts_with(k, v)) OR (length(k) >= 5 AND starts_with(v, k)))) > 0)) > 0 THEN 1.0 ELSE 0.0 END AS points FROM n, t)
SELECT id, round(sum(points)::DOUBLE / 3 + max(CASE WHEN contains(line, ' checks onand tioning ') THEN 0.2 ELSE 0.0 END), 6) AS lexical FROM p GROUP BY id HAVING sum(points) > 0"""


@query("mem_lexical_score", LEXICAL)
def _(spark, d):
    n = P.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.lower("lang")).alias("tags"), F.col("source").alias("kind"))
    return memory.lexical_score(n, "checks the onand tioning")


PREFERENCE_TEXT = "CASE WHEN conv_id % 5 = 0 THEN 'I prefer ' || replace(text, chr(10), ' ') || '. ' || chr(10) || 'I always test for this task.' WHEN conv_id % 7 = 0 THEN '```I like fences.```' || chr(10) || 'remember that I like short   answers!' ELSE text END"


@query("mem_capture_prefs", f"""SELECT conv_id, turn, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS statement FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(regexp_replace({PREFERENCE_TEXT}, '```.*?```|~~~.*?~~~', '', 'gs'), '(?im)^[ \\t]*(?:remember that\\s+)?(I\\s+(?:always|usually|generally|typically|prefer|like|dislike|don''t like|do not like)\\b[^\\n.!?]{{1,400}}[.!?]?)', 1))) AS s FROM conversations WHERE role = 'user') WHERE NOT regexp_matches(lower(s), 'for this task|this time|for now|in this change') AND NOT regexp_matches(s, '(?i)\\b(?:password|passwd|api[_ -]?key|access[_ -]?token|secret)\\s*[:=]\\s*\\S+')""")
def _(spark, d):
    c = P.table(spark, d, "conversations").where("role = 'user'")
    k = F.col("conv_id")
    made = F.when(k % 5 == 0, F.concat(F.lit("I prefer "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". \nI always test for this task."))).when(k % 7 == 0, F.lit("```I like fences.```\nremember that I like short   answers!")).otherwise(F.col("text"))
    return memory.captured_preferences(c.select("conv_id", "turn", made.alias("text"))).select("conv_id", "turn", "statement")


def redact_sql(c: str) -> str:
    for p in V.SECRET_PATTERNS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"
    return c


@query("secrets_redact", f"SELECT doc_id, sha256(r) AS redacted_sha256, r <> text AS had_secret FROM (SELECT doc_id, text, {redact_sql('text')} AS r FROM documents)")
def _(spark, d):
    return P.table(spark, d, "documents").withColumn("r", T.redact(F.col("text"))).select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"), (F.col("r") != F.col("text")).alias("had_secret"))


@query("str_tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return changes.windowed(P.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 hour").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_debounce_sessions", """WITH s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS changes FROM s GROUP BY user_id, g""")
def _(spark, d):
    e = P.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.debounce(e, ["user_id"], "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("str_changelog_tail", "SELECT event_id, event_type, user_id FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 50")
def _(spark, d):
    return changes.tail(P.table(spark, d, "events").select("event_id", "event_type", "user_id"), 300)


@query("str_changelog_prune", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 500")
def _(spark, d):
    return changes.prune(P.table(spark, d, "events").select("event_id", "event_type", "user_id"))


MARKDOWN = "replace(replace(replace(text, '. ', '.' || chr(10) || '## '), ', ', chr(10) || '# '), 'the ', '```' || chr(10))"


@query("ext_markdown_sections", f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS n FROM (SELECT doc_id, {MARKDOWN} AS md FROM documents)),
f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS fences FROM l),
h AS (SELECT *, fences % 2 = 0 AND NOT fence AND regexp_matches(line, '^#{{1,6}}[ \\t]+\\S') AS head FROM f), o AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n)::BIGINT AS ordinal FROM h)
SELECT id, ordinal, length(regexp_extract(max(line) FILTER (head), '^(#+)', 1))::INT AS level, trim(regexp_replace(regexp_replace(max(line) FILTER (head), '^#+[ \\t]+', ''), '[ \\t]+#+[ \\t]*$', '')) AS title, (min(n) + 1)::INT AS start_line, (max(n) + 1)::INT AS end_line, coalesce(trim(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head)), '') AS body FROM o WHERE ordinal > 0 GROUP BY id, ordinal""")
def _(spark, d):
    made = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit(".\n## ")), F.lit(", "), F.lit("\n# ")), F.lit("the "), F.lit("```\n"))
    return extraction.markdown_sections(P.table(spark, d, "documents").select("doc_id", made.alias("md")), "doc_id", "md")


@query("eval_recall_mrr", bm25_sql(f"q AS (SELECT DISTINCT item_id AS query_id, unnest({folded_sql('text')}) AS term FROM benchmark)", 5).replace("SELECT *, row_number()", "SELECT query_id, round(count(CASE WHEN hit THEN 1 END) / max(wanted), 6) AS recall, round(coalesce(1 / min(CASE WHEN hit THEN rank END), 0.0), 6) AS reciprocal_rank, round(count(CASE WHEN hit THEN 1 END) / count(*), 6) AS precision FROM (SELECT r.*, w.doc_id IS NOT NULL AS hit, n.wanted FROM (SELECT *, row_number()", 1) + ") r JOIN (SELECT item_id, count(*) AS wanted FROM rel GROUP BY ALL) n ON n.item_id = r.query_id LEFT JOIN rel w ON w.item_id = r.query_id AND w.doc_id = r.id) GROUP BY query_id")
def _(spark, d):
    docs, b = P.table(spark, d, "documents"), P.table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.explode(T.terms(F.col("text"))).alias("term"))
    rel = relevant(docs, b)
    got = ranking.evaluate(lexical.bm25(docs, q, "doc_id", FTS, 5), rel)
    return got


def relevant(docs, b):
    """Documents that hold all of a benchmark item's terms in a row: an equi-join on the hash of its first terms, eight at most, then the check of all.

    What is exploded is an id and a hash a term; the texts of the few documents that meet are joined to them afterwards.
    """
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    q = b.where("text is not null").select(F.col("item_id").alias("query_id"), T.terms(F.col("text")).alias("terms"))
    q = q.select("query_id", line("terms").alias("item"), F.slice("terms", 1, 8).alias("first"))
    q = q.select("query_id", "item", F.xxhash64("first").alias("run"), F.size("first").alias("n"))
    d = docs.where("text is not null").select(F.col("doc_id").alias("id"), T.terms(F.col("text")).alias("terms"))
    runs = lambda n: F.when(F.size("terms") < n, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.size("terms") - (n - 1)), lambda i: F.xxhash64(F.slice("terms", i, n))))
    none = F.when(F.size("terms") == 0, F.array(F.xxhash64("terms"))).otherwise(F.array())
    at = None
    for (n,) in q.select("n").distinct().collect():  # 0 to 8
        some = d.select("id", F.explode(F.array_distinct(runs(n) if n else none)).alias("run")).join(F.broadcast(q.where(F.col("n") == n)) if q.count() <= FEW else q.where(F.col("n") == n), "run").select("query_id", "id", "item")
        at = some if at is None else at.union(some)
    if at is None:
        return b.select(F.col("item_id").alias("query_id")).crossJoin(docs.select(F.col("doc_id").alias("id")).limit(0))
    return at.distinct().join(d, "id").where(F.contains(line("terms"), F.col("item"))).select("query_id", "id").distinct()


ORACLES["eval_recall_mrr"] = ORACLES["eval_recall_mrr"].replace("WITH q AS", f"WITH dl AS (SELECT doc_id, ' ' || array_to_string({terms_sql('text')}, ' ') || ' ' AS line FROM documents), it AS (SELECT item_id, ' ' || array_to_string({terms_sql('text')}, ' ') || ' ' AS run FROM benchmark), rel AS (SELECT item_id, doc_id FROM it JOIN dl ON contains(line, run)),\nq AS", 1)


@query("media_windows", """SELECT event_id, i::INT AS ordinal, i * 25.0::DOUBLE AS start, round(least(value * 4, i * 25 + 30), 6) AS "end" FROM (SELECT event_id, value, unnest(range(CASE WHEN value > 0 THEN least(400, greatest(1, ceil((value * 4 - 30) / 25)::INT + 1)) ELSE 0 END)) AS i FROM events)""")
def _(spark, d):
    e = P.table(spark, d, "events").select("event_id", F.posexplode(X.media_windows(F.col("value") * 4)).alias("ordinal", "w"))
    return e.select("event_id", "ordinal", F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


def code_files(spark, d):
    """A small Python file for every part."""
    k = F.col("p_partkey").cast("string")
    lines = F.concat(F.lit("class "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(":\n    def make_"), k, F.lit("(self):\n        return Build"), k, F.lit("()\n\ndef test_"), k, F.lit("():\n    run_"), k, F.lit("(1)\n"))
    return P.table(spark, d, "part").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), lines.alias("text"))


@query("ext_symbols", """WITH p AS (SELECT 'src/p' || p_partkey || '.py' AS path, replace(p_brand, '#', '_') AS c, p_partkey AS k FROM part)
SELECT path, 'class' AS kind, c AS name, c AS qualified_name, NULL::VARCHAR AS parent, 1::INT AS start_line, 3::INT AS end_line, 'class ' || c || '()' AS signature FROM p
UNION ALL SELECT path, 'method', 'make_' || k, c || '.make_' || k, c, 2, 3, 'def make_' || k || '(self)' FROM p
UNION ALL SELECT path, 'test', 'test_' || k, 'test_' || k, NULL, 5, 6, 'def test_' || k || '()' FROM p""")
def _(spark, d):
    return extraction.symbols(code_files(spark, d)).drop("docstring")


@query("ext_references", """WITH p AS (SELECT 'src/p' || p_partkey || '.py' AS path, replace(p_brand, '#', '_') AS c, p_partkey AS k FROM part)
SELECT path, c || '.make_' || k AS owner, 'constructs' AS type, 'Build' || k AS name, 3::INT AS line FROM p UNION ALL SELECT path, 'test_' || k, 'calls', 'run_' || k, 6 FROM p""")
def _(spark, d):
    return extraction.references(code_files(spark, d)).drop("qualifier", "alias")


@query("fn_modules", """SELECT url_path AS path, array_to_string(list_sort(CASE WHEN ends_with(url_path, '/__init__.py') THEN [replace(left(url_path, length(url_path) - 12), '/', '.')] ELSE list_distinct([replace(regexp_replace(url_path, '\\.[^./]+$', ''), '/', '.'), list_extract(string_split(replace(regexp_replace(url_path, '\\.[^./]+$', ''), '/', '.'), '.'), -1)]) END), ' ') AS modules FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pkg/' || p_type || '/__init__.py' WHEN p_partkey % 4 = 1 THEN 'single' || p_partkey || '.py' ELSE 'pkg/' || lower(p_type) || '/m' || p_partkey || '.py' END AS url_path FROM part)""")
def _(spark, d):
    from ..functions.representation import declared_modules

    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("pkg/"), "p_type", F.lit("/__init__.py"))).when(k % 4 == 1, F.concat(F.lit("single"), k.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("pkg/"), F.lower("p_type"), F.lit("/m"), k.cast("string"), F.lit(".py")))
    return P.table(spark, d, "part").select(path.alias("path")).withColumn("modules", F.array_join(F.array_sort(declared_modules(F.col("path"))), " "))
