"""Queries of end-to-end search, graph contexts, extraction and structured content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.models import collection_statistics, dense_embedder, embed_texts, reranker
from tessera.operators import chunking, extraction, fusion, graph, retrieval, search, structured
from tessera.plans.registry import _APPEARS, _COS, _DENSE, _FP, _STRIP, _TF, _WINDOWS, _appears, _first_vector, _query_terms, query
from tessera.sources import stores
from tessera.sources.readers import table

_ENTITIES = """entities AS (SELECT c_custkey, c_name AS name, c_mktsegment AS kind, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' in ' || c_nationkey END AS description FROM customer)"""
_NAMES = """edges AS (SELECT o_orderkey AS edge_id, printf('Customer#%09d', o_custkey) AS src, printf('Customer#%09d', o_orderkey // 10) AS dst, o_orderpriority AS kind, o_orderstatus AS description FROM orders),
ways AS (SELECT edge_id, src, dst, kind, description FROM edges UNION ALL SELECT edge_id, dst, src, kind, description FROM edges)"""
_CUT = """CASE WHEN length(c) <= 2000 THEN c WHEN 2000 - position(chr(10) IN reverse(left(c, 2000))) > 1600 AND contains(left(c, 2000), chr(10)) THEN left(c, (2000 - position(chr(10) IN reverse(left(c, 2000))))::INT)
  WHEN 2000 - length(regexp_extract(left(c, 2000), '(?s)([^。！？.!?]*)$', 1)) - 1 > 1600 THEN left(c, (2000 - length(regexp_extract(left(c, 2000), '(?s)([^。！？.!?]*)$', 1)))::INT) ELSE left(c, 2000) || '...' END"""
_TERMS = [("Customer#00000001", 0), ("Customer#000000003", 1)]
_TERM_SQL = "terms AS (SELECT * FROM (VALUES ('Customer#00000001', 0), ('Customer#000000003', 1)) v(term, pos))"
_LOCAL = """hits AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY name) AS rn FROM entities JOIN terms ON contains(name, term)),
lnodes AS (SELECT name, kind, description, pos * 5 + rn AS seq FROM hits WHERE rn <= 5),
lrels AS (SELECT DISTINCT src AS source, kind, dst AS target, description, edge_id AS seq FROM ways WHERE src IN (SELECT term FROM hits))"""
_GLOBAL = """t1 AS (SELECT src AS seed, dst AS target, [edge_id] AS path, [{'kind': kind, 'description': description}] AS rels, 1 AS hops FROM ways WHERE src IN (SELECT term FROM terms)),
t2 AS (SELECT seed, dst AS target, list_append(path, edge_id) AS path, list_append(rels, {'kind': kind, 'description': description}) AS rels, 2 AS hops FROM t1 JOIN ways ON target = src WHERE NOT list_contains(path, edge_id)),
t3 AS (SELECT seed, dst AS target, list_append(path, edge_id) AS path, list_append(rels, {'kind': kind, 'description': description}) AS rels, 3 AS hops FROM t2 JOIN ways ON target = src WHERE NOT list_contains(path, edge_id)),
d AS (SELECT DISTINCT seed, target, hops, rels FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)),
top AS (SELECT *, row_number() OVER (ORDER BY hops, seed, target, rels) AS n FROM d ORDER BY hops, seed, target, rels LIMIT 50),
gnodes AS (SELECT name, kind, description, seq FROM (SELECT target AS name, min(n) AS seq FROM top GROUP BY 1) JOIN entities USING (name)),
grels AS (SELECT seed AS source, r.kind AS kind, target, r.description AS description, n * 3 + k - 1 AS seq FROM (SELECT seed, target, n, unnest(rels) AS r, generate_subscripts(rels, 1) AS k FROM top))"""


def _known(spark: SparkSession, d: str) -> search.Graph:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    said = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" in "), F.col("c_nationkey").cast("string")))
    entities = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), said.alias("description"))
    name = lambda x: F.format_string("Customer#%09d", x)
    edges = o.select(F.col("o_orderkey").alias("edge_id"), name(F.col("o_custkey")).alias("src"), name(F.floor(F.col("o_orderkey") / 10).cast("long")).alias("dst"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("description"))
    return search.Graph(entities, edges)


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TERMS, "term string, pos int")


def _union(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    n = nodes.select(F.lit("entity").alias("what"), F.col("name").alias("source"), "kind", F.lit("").alias("target"), "description", "seq")
    return n.unionByName(rels.select(F.lit("relation").alias("what"), "source", "kind", "target", "description", "seq"))


_UNION = "SELECT 'entity' AS what, name AS source, kind, '' AS target, description, seq FROM {0}nodes UNION ALL SELECT 'relation', source, kind, target, description, seq FROM {0}rels"


@query(f"WITH {_ENTITIES}, {_NAMES}, {_TERM_SQL}, {_LOCAL} " + _UNION.format("l"))
def graph_local_query(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    return _union(*graph.local_query(known.edges, known.entities, _terms(spark)))


@query(f"WITH {_ENTITIES}, {_NAMES}, {_TERM_SQL}, {_GLOBAL} " + _UNION.format("g"))
def graph_global_query(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    return _union(*graph.global_context(known.edges, known.entities, _terms(spark).select(F.col("term").alias("seed"))))


_FOUND = f"""found AS (SELECT a.vec_id, {_COS} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE a.vec_id % 3 = 1),
near AS (SELECT * FROM found WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 30),
live AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND (lang = 'en' OR source = 'src1')),
results AS (SELECT vec_id AS doc_id, s AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM near WHERE vec_id IN (SELECT doc_id FROM live))"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("user_id"), "embedding")
    bad = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("bad"))
    docs = table(spark, d, "documents").join(bad, F.col("doc_id") == F.col("bad"), "left")
    docs = docs.select("doc_id", F.when(F.col("bad").isNotNull(), "deleted").otherwise("completed").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), F.array("lang", "source").alias("tags"))
    return search.search_documents(vectors, _first_vector(spark, d), docs, F.lit(1), 30, 0.05, ["en", "src1"])


@query(f"WITH {_FOUND} SELECT doc_id, round(score, 4) AS score, rank FROM results")
def search_tenant_live_tags(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).withColumn("score", F.round("score", 4))


def _vector(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return docs.join(F.broadcast(_results(spark, d)), "doc_id").select(F.col("doc_id").alias("chunk_id"), "content", "score", F.col("rank").cast("long").alias("seq"))


_TEXTS = """'[实体] ' || name || ' (' || kind || ')' || CASE WHEN description = '' THEN '' ELSE ': ' || description END"""
_RTEXT = """'[关系] ' || source || ' ←' || kind || '→ ' || target || CASE WHEN description = '' THEN '' ELSE ': ' || description END"""


@query(
    f"""WITH {_ENTITIES}, {_NAMES}, {_TERM_SQL}, {_LOCAL}, {_GLOBAL}, {_FOUND}
SELECT 'vector_rerank_top' AS source_type, doc_id::VARCHAR AS chunk_id, text AS content, round(2.0 * (0.5 + 0.5 * score), 4)::DOUBLE AS weight FROM results JOIN documents USING (doc_id)
UNION ALL SELECT 'direct_entity_match', NULL, {_TEXTS}, 3.0 FROM (SELECT * FROM lnodes UNION ALL SELECT * FROM gnodes)
UNION ALL SELECT 'relation_description', NULL, {_RTEXT}, 1.5 FROM (SELECT * FROM lrels UNION ALL SELECT * FROM grels)"""
)
def search_candidates_mix(spark: SparkSession, d: str) -> DataFrame:
    c = search.candidates("mix", _vector(spark, d), _known(spark, d), _terms(spark))
    return c.select("source_type", "chunk_id", "content", F.round("weight", 4).alias("weight"))


@query(
    f"""WITH {_ENTITIES}, {_NAMES}, {_TERM_SQL}, {_LOCAL}
SELECT content, weight FROM (SELECT {_TEXTS} AS content, 3.0::DOUBLE AS weight FROM lnodes UNION SELECT {_RTEXT}, 1.5 FROM lrels)"""
)
def search_candidates_local(spark: SparkSession, d: str) -> DataFrame:
    return fusion.keep_best(search.candidates("local", _vector(spark, d), _known(spark, d), _terms(spark))).select("content", "weight")


_KEY = _FP.replace("coalesce(text, '')", "content")


@query(
    rf"""WITH {_ENTITIES}, {_NAMES}, {_TERM_SQL}, {_LOCAL}, {_GLOBAL}, {_FOUND},
told AS (SELECT 'local' AS part, 3.0 AS weight, seq, NULL AS chunk_id, '图谱-实体' AS label, {_TEXTS} AS content FROM lnodes
  UNION ALL SELECT 'local', 1.5, seq, NULL, '图谱-关系', {_RTEXT} FROM lrels
  UNION ALL SELECT 'global', 3.0, seq, NULL, '图谱-实体', {_TEXTS} FROM gnodes UNION ALL SELECT 'global', 1.5, seq, NULL, '图谱-关系', {_RTEXT} FROM grels
  UNION ALL SELECT 'vector', 2.0 * (0.5 + 0.5 * score), rank, doc_id::VARCHAR, '向量', text FROM results JOIN documents USING (doc_id)),
modes AS (SELECT * FROM (VALUES ('vector', 'vector'), ('other', 'vector'), ('local', 'local'), ('global', 'global'), ('hybrid', 'local'), ('hybrid', 'global'), ('hybrid', 'vector'), ('mix', 'local'), ('mix', 'global'), ('mix', 'vector')) v(mode, part)),
asked AS (SELECT mode, weight::DOUBLE AS weight, seq + CASE WHEN part = 'global' AND mode <> 'global' THEN 4294967296 ELSE 0 END AS seq, coalesce(chunk_id, {_KEY}) AS key, content, ' [来源:' || label || ']' || chr(10) AS tail FROM modes JOIN told USING (part)),
best AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY mode, key ORDER BY weight DESC, seq) = 1),
sized AS (SELECT *, row_number() OVER o AS p, length(content) + length(tail) AS size, coalesce(sum(length(content) + length(tail)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM best WINDOW o AS (PARTITION BY mode ORDER BY weight DESC, seq)),
fit AS (SELECT *, before + size <= 10000 AS fits, min(CASE WHEN before + size > 10000 THEN p END) OVER (PARTITION BY mode) AS stop FROM sized),
cut AS (SELECT mode, p, fits, tail, CASE WHEN fits OR length(content) <= 10000 - before THEN content ELSE regexp_replace(left(content, 10000 - before), '(?s)[。！？.!?\n][^。！？.!?\n]*$', '') END AS short FROM fit WHERE (stop IS NULL OR p <= stop) AND before <= 10000)
SELECT mode, string_agg(short || tail, '' ORDER BY p) AS context FROM cut WHERE fits OR short <> '' GROUP BY 1"""
)
def search_context_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """The packed context of each mode, and of one that is not known."""
    return search.contexts((*search.MODES, "other"), _vector(spark, d), _known(spark, d), _terms(spark))


_MENTIONS = "mentions AS (SELECT o_custkey, o_orderkey // 10 AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS chunk_id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS snippet FROM orders)"


@query(f"WITH {_MENTIONS} SELECT * FROM (SELECT DISTINCT chunk_id, snippet AS content, doc_id FROM mentions WHERE o_custkey IN (1, 2, 3) AND chunk_id IS NOT NULL ORDER BY doc_id, chunk_id, content LIMIT 20) WHERE content <> ''")
def graph_related_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity_name"), F.floor(F.col("o_orderkey") / 10).cast("long").alias("doc_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("chunk_id"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("snippet"),
    )
    return graph.related_chunks(m, spark.range(1, 4).select(F.col("id").alias("name")))


@query(f"WITH {_ENTITIES}, {_NAMES}, n AS (SELECT name FROM entities ORDER BY c_custkey DESC, name LIMIT 60) SELECT edge_id, src, dst, kind, (SELECT count(*) FROM n) AS n_nodes FROM edges WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def graph_full(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    nodes, edges = graph.full_graph(known.entities, known.edges, 60, "c_custkey")
    return edges.select("edge_id", "src", "dst", "kind").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))


@query(f"WITH {_APPEARS}, mine AS (SELECT entity_name FROM appears WHERE doc_id = 1) SELECT doc_id, string_agg(entity_name, ',' ORDER BY entity_name) AS shared FROM appears JOIN mine USING (entity_name) WHERE doc_id <> 1 GROUP BY 1")
def graph_cross_documents(spark: SparkSession, d: str) -> DataFrame:
    found = graph.cross_document_relations(_appears(spark, d), table(spark, d, "documents").where("doc_id = 1").select("doc_id"))
    return found.select("doc_id", F.array_join("shared", ",").alias("shared"))


@query(f"WITH {_APPEARS}, gone AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0) SELECT (SELECT count(*) FROM gone) AS doc_count, (SELECT count(*) FROM appears WHERE doc_id IN (SELECT doc_id FROM gone)) AS rel_count")
def graph_delete_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return graph.delete_statistics(docs, _appears(spark, d), docs.where("doc_id % 10 = 0"))


@query(f"WITH {_APPEARS} SELECT entity_name FROM appears GROUP BY 1 HAVING count_if(doc_id % 10 <> 0) > 0")
def graph_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    docs, a = table(spark, d, "documents").select("doc_id"), _appears(spark, d)
    return graph.delete_documents(docs, a, a.select("entity_name").distinct(), docs.where("doc_id % 10 = 0"))[2]


@query("SELECT doc_id, max(title) AS title FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' again' ELSE source END AS title FROM documents) GROUP BY 1")
def graph_document_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"))
    return graph.merge_document_nodes(docs, docs.where("doc_id % 3 = 0").withColumn("title", F.concat("title", F.lit(" again"))))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id END, md5(user_id || ',' || event_type)) AS entity_id FROM events")
def graph_id_backfill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("entity_id"))
    return graph.with_ids(e.withColumn("user_id", F.col("user_id").cast("string"))).select("event_id", "entity_id")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS with_id, count(*) FILTER (event_id % 3 <> 0) AS without_id FROM events")
def graph_id_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.id_counts(table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("entity_id")))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def graph_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicates(table(spark, d, "events"), "user_id", "event_type")


@query("WITH r AS (SELECT o_custkey AS source, o_orderkey // 10 AS target FROM orders) SELECT DISTINCT name FROM (SELECT source AS name FROM r UNION SELECT target FROM r) WHERE name % 2 <> 0")
def graph_missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.floor(F.col("o_orderkey") / 10).cast("long").alias("target"))
    return graph.missing_endpoints(o, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name")))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '组织' ELSE '概念' END AS type, 'of ' || c_nationkey AS description FROM customer WHERE c_custkey % 5 <> 4")
def extraction_entities(spark: SparkSession, d: str) -> DataFrame:
    """Answers of five kinds: plain, fenced, fenced without an end, cut inside a string, and unreadable."""
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "公司").otherwise("whatever")
    one = F.format_string('{"name": " %s ", "type": "%s", "description": "of %d"}', "c_name", kind, "c_nationkey")
    whole = F.concat(F.lit('{"entities": [{"name": " ", "type": "x"}, '), one, F.lit('], "relations": []}'))
    cut = F.concat(F.lit('so: {"entities": ['), one, F.lit('], "relations": [{"source": "a", "target": "b, c'))
    shape = F.col("c_custkey") % 5
    text = F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("```json\n"), whole)).when(shape == 3, cut).otherwise("no answer {")
    entities, _ = extraction.parse_answers(c.select("c_custkey", text.alias("answer")), "c_custkey")
    return entities.select("c_custkey", "name", "type", "description")


@query("SELECT c_custkey, 'a' || c_custkey AS source, 'b' AS target, CASE WHEN c_custkey % 2 = 0 THEN '依赖' ELSE '相关' END AS type FROM customer WHERE c_custkey % 3 <> 0")
def extraction_relations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "依赖").otherwise("")
    source = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("a"), F.col("c_custkey").cast("string")))
    text = F.format_string('{"relations": [{"source": "%s", "target": "b", "type": "%s"}]}', source, kind)
    _, relations = extraction.parse_answers(c.select("c_custkey", text.alias("answer")), "c_custkey")
    return relations.select("c_custkey", "source", "target", "type")


@query(rf"WITH {_WINDOWS} SELECT doc_id, count(*) FILTER (length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 20) AS asked, count(*) AS n FROM windows GROUP BY 1")
def extraction_guard(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.fixed_windows(table(spark, d, "documents"))
    return w.groupBy("doc_id").agg(F.count_if(extraction.worth_asking(F.col("content"))).alias("asked"), F.count("*").alias("n"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FIRST = rf"""CASE WHEN contains(t, chr(10)) AND {_TRIM.format("string_split(t, chr(10))[1]")} <> '' THEN {_TRIM.format("string_split(t, chr(10))[1]")}
WHEN NOT contains(t, chr(10)) AND contains(t, '.') THEN {_TRIM.format("left(t, position('.' IN t)::INT)")} WHEN NOT contains(t, chr(10)) AND contains(t, '!') THEN {_TRIM.format("left(t, position('!' IN t)::INT)")}
WHEN NOT contains(t, chr(10)) AND contains(t, '?') THEN {_TRIM.format("left(t, position('?' IN t)::INT)")} WHEN length(t) > 120 THEN left(t, 120) || '...' ELSE t END"""


@query(f"WITH {_FOUND}, r AS (SELECT rank, {_TRIM.format('text')} AS t FROM results JOIN documents USING (doc_id) WHERE rank <= 3) SELECT string_agg('- ' || {_FIRST}, chr(10) ORDER BY rank) AS summary FROM r")
def results_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return extraction.summarise_results(_results(spark, d).join(docs, "doc_id"))


@query(f"WITH {_FOUND} SELECT doc_id, rank, left(text, 500) AS content FROM results JOIN documents USING (doc_id) ORDER BY rank LIMIT 10")
def sse_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return fusion.source_list(_results(spark, d).join(docs, "doc_id").select("doc_id", "rank", "content"))


_ITEMS = r"""li AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
items AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM li),
typed AS (SELECT doc_id, pos, pos // 6 AS page_idx, CASE WHEN pos % 5 = 3 THEN 'image' WHEN pos % 11 = 9 THEN 'table' ELSE 'text' END AS type, CASE WHEN pos % 7 = 0 THEN 1 WHEN pos % 7 = 4 THEN 2 END AS text_level, line FROM items)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    kind = F.when(F.col("pos") % 5 == 3, "image").when(F.col("pos") % 11 == 9, "table").otherwise("text")
    level = F.when(F.col("pos") % 7 == 0, 1).when(F.col("pos") % 7 == 4, 2)
    t = lines.select("doc_id", "pos", "line", kind.alias("type"), level.alias("text_level"), F.floor(F.col("pos") / 6).cast("int").alias("page_idx"))
    media, none = F.col("type") != "text", F.lit(None).cast("string")
    return t.select(
        "doc_id", "pos", "type", F.when(~media, F.col("line")).alias("text"), "text_level", "page_idx", F.when(media, F.array(F.left("line", F.lit(20)), F.lit("fig"))).alias("captions"),
        F.lit(None).cast("array<string>").alias("footnotes"), none.alias("caption"), F.lit("note").alias("footnote"), F.concat(F.lit("/data/uploads/7/images/"), F.col("pos").cast("string"), F.lit(".png")).alias("img_path"),
        F.when(F.col("type") == "table", F.col("line")).alias("table_body"), none.alias("latex"),
    )


_HEADS = rf"""h AS (SELECT *, {_TRIM.format('line')} AS body,
 last_value(CASE WHEN type = 'text' AND text_level = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN type = 'text' AND text_level = 1 THEN {_TRIM.format('line')} END IGNORE NULLS) OVER w AS t1,
 last_value(CASE WHEN type = 'text' AND text_level = 2 THEN pos END IGNORE NULLS) OVER w AS p2, last_value(CASE WHEN type = 'text' AND text_level = 2 THEN {_TRIM.format('line')} END IGNORE NULLS) OVER w AS t2,
 last_value(CASE WHEN type = 'text' AND {_TRIM.format('line')} <> '' THEN {_TRIM.format('line')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    f"""WITH {_ITEMS}, {_HEADS}
SELECT doc_id, pos, type, CASE WHEN type = 'text' THEN md5(body) END AS body, CASE WHEN p1 IS NULL AND p2 IS NULL THEN NULL ELSE md5(concat_ws(' > ', t1, CASE WHEN p1 IS NULL OR p2 > p1 THEN t2 END)) END AS path,
CASE WHEN type = 'image' THEN md5(before) END AS neighbour, CASE WHEN type <> 'text' THEN left(line, 20) || ', fig' END AS caption, CASE WHEN type <> 'text' THEN 'note' END AS footnote FROM h WHERE type <> 'text' OR body <> ''"""
)
def structured_items(spark: SparkSession, d: str) -> DataFrame:
    t = structured.typed_items(_items(spark, d))
    return t.select("doc_id", "pos", "type", F.md5("text").alias("body"), F.md5("section_path").alias("path"), F.md5("neighbour_text").alias("neighbour"), "caption", "footnote")


@query(
    f"""WITH {_ITEMS}, said AS (SELECT doc_id, pos, page_idx, CASE WHEN text_level > 0 THEN repeat('#', text_level) || ' ' || line ELSE line END AS s FROM typed WHERE type = 'text'),
ok AS (SELECT * FROM said WHERE {_TRIM.format('s')} <> ''), pages AS (SELECT DISTINCT doc_id, page_idx AS page FROM typed),
ctx AS (SELECT p.doc_id, p.page, string_agg(CASE WHEN o.page_idx = p.page THEN s ELSE '[Page ' || o.page_idx || '] ' || s END, chr(10) ORDER BY o.pos) AS c FROM pages p LEFT JOIN ok o ON o.doc_id = p.doc_id AND o.page_idx BETWEEN p.page - 1 AND p.page + 1 GROUP BY 1, 2)
SELECT doc_id, page, {_CUT} AS context FROM (SELECT doc_id, page, coalesce(c, '') AS c FROM ctx)"""
)
def structured_page_contexts(spark: SparkSession, d: str) -> DataFrame:
    return structured.page_contexts(_items(spark, d)).select("doc_id", "page", "context")


_MIXED = f"""{_WINDOWS}, n AS (SELECT doc_id, count(*)::INT AS n FROM windows GROUP BY 1),
src AS (SELECT w.doc_id, max(doc_id % n)::INT AS index, max((doc_id % n) // 3)::INT AS page_idx, CASE w.doc_id % 5
  WHEN 0 THEN to_json(list({{'type': CASE WHEN idx % 4 = 3 THEN 'image' ELSE 'text' END, 'text': content, 'text_level': CASE WHEN idx % 5 = 0 THEN 2 END, 'page_idx': idx // 3}} ORDER BY idx))::VARCHAR
  WHEN 1 THEN to_json(list(content ORDER BY idx))::VARCHAR WHEN 2 THEN to_json(first(content ORDER BY idx))::VARCHAR
  WHEN 3 THEN '[' || string_agg(content, '' ORDER BY idx) ELSE to_json({{'text': first(content ORDER BY idx)}})::VARCHAR END AS source
FROM windows w JOIN n USING (doc_id) GROUP BY w.doc_id)"""


@query(
    rf"""WITH {_MIXED}, j AS (SELECT *, CASE WHEN json_valid(source) THEN source::JSON END AS v FROM src),
e AS (SELECT doc_id, index, page_idx, json_type(v, '$[0]') = 'OBJECT' AS layout, unnest(json_extract(v, '$[*]')) AS x, generate_subscripts(json_extract(v, '$[*]'), 1) - 1 AS i FROM j WHERE json_type(v) = 'ARRAY'),
p AS (SELECT doc_id, i, layout, CASE WHEN NOT layout THEN CASE WHEN i <> index AND abs(i - index) <= 1 THEN {_STRIP.format("x->>'$'")} END
  WHEN x->>'type' = 'text' AND abs((x->>'page_idx')::INT - page_idx) <= 1 THEN CASE WHEN (x->>'page_idx')::INT <> page_idx THEN '[Page ' || (x->>'page_idx') || '] ' ELSE '' END || CASE WHEN x->>'text_level' IS NOT NULL THEN '## ' ELSE '' END || (x->>'text') END AS s FROM e),
c AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) FILTER ({_STRIP.format('s')} <> '') AS c FROM p GROUP BY 1),
a AS (SELECT j.doc_id, coalesce(CASE WHEN v IS NULL THEN source WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE c.c END, '') AS c FROM j LEFT JOIN c ON c.doc_id = j.doc_id)
SELECT doc_id, {_CUT} AS context FROM a"""
)
def any_source_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of items of sources of five forms: layouts, lists of texts, JSON strings, broken JSON and objects."""
    w = chunking.fixed_windows(table(spark, d, "documents"))
    item = F.struct(F.when(F.col("idx") % 4 == 3, "image").otherwise("text").alias("type"), F.col("content").alias("text"), F.when(F.col("idx") % 5 == 0, 2).alias("text_level"), F.floor(F.col("idx") / 3).cast("int").alias("page_idx"))
    per = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content", item.alias("item")))).alias("x"))
    texts, k = F.transform("x", lambda x: x["content"]), F.col("doc_id") % 5
    source = (
        F.when(k == 0, F.to_json(F.transform("x", lambda x: x["item"]))).when(k == 1, F.to_json(texts)).when(k == 2, F.to_json(F.slice(texts, 1, 1)).substr(F.lit(2), F.length(F.to_json(F.slice(texts, 1, 1))) - 2))
        .when(k == 3, F.concat(F.lit("["), F.array_join(texts, ""))).otherwise(F.to_json(F.struct(texts[0].alias("text"))))
    )
    at = (F.col("doc_id") % F.size("x")).cast("int")
    return structured.any_contexts(per.select("doc_id", source.alias("source"), at.alias("index"), F.floor(at / 3).cast("int").alias("page_idx"))).select("doc_id", "context")


_TYPED = """rel AS (SELECT 'r' || o_orderkey AS edge_id, 'e' || o_custkey AS src, 'e' || (o_orderkey // 10) AS dst, o_orderpriority AS kind, o_custkey::VARCHAR AS a, (o_orderkey // 10)::VARCHAR AS b, o_orderstatus AS description FROM orders),
app AS (SELECT DISTINCT 'a ' || (o_orderkey // 40) || ' ' || o_custkey AS edge_id, 'e' || o_custkey AS src, 'd' || (o_orderkey // 40) AS dst, '' AS kind, o_custkey::VARCHAR AS a, '' AS b, '' AS description FROM orders),
one AS (SELECT * FROM rel UNION ALL SELECT * FROM app), ways AS (SELECT * FROM one UNION ALL SELECT edge_id, dst, src, kind, a, b, description FROM one),
w1 AS (SELECT src AS seed, dst AS target, [edge_id] AS path FROM ways WHERE src IN ('e1', 'e2', 'e3')),
w2 AS (SELECT seed, dst AS target, list_append(path, edge_id) AS path FROM w1 JOIN ways ON target = src WHERE NOT list_contains(path, edge_id)),
w3 AS (SELECT * FROM (SELECT *, 1 AS hops FROM w1 UNION ALL SELECT *, 2 FROM w2) WHERE target[1] = 'e')"""


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders link customers, and each puts its customer into a document of about ten orders."""
    o = table(spark, d, "orders")
    ten = F.floor(F.col("o_orderkey") / 10).cast("long")
    rel = o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source"), ten.alias("target"), F.col("o_orderpriority").alias("relation_type"), F.col("o_orderstatus").alias("description"))
    app = o.select(F.col("o_custkey").alias("entity_name"), F.floor(F.col("o_orderkey") / 40).cast("long").alias("doc_id"))
    return rel, app, spark.range(1, 4).select(F.col("id").alias("seed"))


@query(f"WITH {_TYPED} SELECT substr(seed, 2) AS seed, substr(target, 2) AS target, hops, array_to_string(path, ',') AS path FROM w3")
def graph_typed_trails(spark: SparkSession, d: str) -> DataFrame:
    return graph.typed_trails(*_typed(spark, d)).select("seed", "target", "hops", F.array_join("path", ",").alias("path"))


@query(f"WITH {_TYPED} SELECT DISTINCT substr(seed, 2) AS seed, kind AS relation_type, a AS source, b AS target FROM (SELECT seed, unnest(path) AS edge_id FROM w3) JOIN one USING (edge_id)")
def graph_neighbourhood_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_neighbourhood(*_typed(spark, d))[1]


def _letter_embedder():
    """Letter counts as vectors; tables are more than it can read."""

    def embed(sentences: list[str]) -> list[list[int]]:
        if any("|" in s for s in sentences):
            raise ValueError("no table")
        return [[s.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for s in sentences]

    return embed


@query()
def chunk_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Two documents of three by meaning, where the embedder can read them; all others by characters."""
    asked = F.when(F.col("doc_id") % 3 == 0, "recursive").otherwise("semantic")
    return chunking.chunk_by_strategy(table(spark, d, "documents"), _letter_embedder, asked, similarity=0.8)


@query(
    f"""WITH {_ITEMS}, {_HEADS}, said AS (SELECT doc_id, pos, page_idx, CASE WHEN text_level > 0 THEN repeat('#', text_level) || ' ' || line ELSE line END AS s FROM typed WHERE type = 'text'),
ok AS (SELECT * FROM said WHERE {_TRIM.format('s')} <> ''), pages AS (SELECT DISTINCT doc_id, page_idx AS page FROM typed),
joined AS (SELECT p.doc_id, p.page, string_agg(CASE WHEN o.page_idx = p.page THEN s ELSE '[Page ' || o.page_idx || '] ' || s END, chr(10) ORDER BY o.pos) AS c FROM pages p JOIN ok o ON o.doc_id = p.doc_id AND o.page_idx BETWEEN p.page - 1 AND p.page + 1 GROUP BY 1, 2),
ctx AS (SELECT doc_id, page, {_CUT} AS context FROM joined)
SELECT h.doc_id, h.pos, CASE WHEN coalesce(context, '') <> '' THEN context WHEN h.type = 'image' THEN coalesce(left(h.before, 2000), '') ELSE '' END AS context FROM h LEFT JOIN ctx ON ctx.doc_id = h.doc_id AND ctx.page = h.page_idx WHERE h.type <> 'text'"""
)
def structured_media_contexts(spark: SparkSession, d: str) -> DataFrame:
    return structured.media_contexts(_items(spark, d))


_PATH = "CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN concat_ws(' > ', t1, CASE WHEN p1 IS NULL OR p2 > p1 THEN t2 END) END"
_FIELDS = {
    "type": "type", "text": "CASE WHEN type = 'text' THEN body END", "page_idx": "page_idx", "section_path": _PATH, "neighbour_text": "CASE WHEN type = 'image' THEN before END",
    "caption": "CASE WHEN type <> 'text' THEN left(line, 20) || ', fig' END", "footnote": "CASE WHEN type <> 'text' THEN 'note' END",
    "image_path": "CASE WHEN type <> 'text' THEN '/data/uploads/7/images/' || pos || '.png' END", "table_body": "CASE WHEN type = 'table' THEN line END",
}
_PAIRS = ", ".join(f"""CASE WHEN ({x}) IS NOT NULL THEN '"{name}":' || to_json({x}) END""" for name, x in _FIELDS.items())


@query(f"WITH {_ITEMS}, {_HEADS} SELECT doc_id, pos, '{{' || concat_ws(',', {_PAIRS}) || '}}' AS record FROM h WHERE type <> 'text' OR body <> ''")
def structured_records(spark: SparkSession, d: str) -> DataFrame:
    return structured.to_records(structured.typed_items(_items(spark, d)), "doc_id", "pos")


@query("SELECT p_partkey, '/api/v1/images/' || p_size || '/' || p_name || '.png' AS image_url, '/api/v1/images/' || p_size || '/' || p_name || '.png?size=thumbnail' AS thumbnail_url, CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'markdown' END AS content_format FROM part")
def media_projection(spark: SparkSession, d: str) -> DataFrame:
    path, kind = F.concat(F.lit("/srv/uploads/"), F.col("p_size").cast("string"), F.lit("/images/"), "p_name", F.lit(".png")), F.when(F.col("p_partkey") % 2 == 0, "image").otherwise("table")
    p = table(spark, d, "part").select("p_partkey", path.alias("path"), kind.alias("kind"))
    return p.select("p_partkey", *[c.alias(n) for n, c in structured.media_columns(F.col("path"), F.col("kind")).items()])


@query("SELECT count(*) AS points, count(embedding) AS vectors, max(len(embedding)) AS dim, max(len(embedding)) <> min(len(embedding)) AS mixed FROM embeddings")
def vector_statistics(spark: SparkSession, d: str) -> DataFrame:
    return collection_statistics(table(spark, d, "embeddings"))


def _load_lengths():
    return lambda texts: texts.map(lambda t: [float(len(t)), float(t.count(" "))])


def _load_overlap():
    return lambda queries, contents: contents.combine(queries, lambda c, q: len(set(c.split()) & set(q.split())) / 100)


@query(rf"SELECT doc_id, length({_TRIM.format('text')})::DOUBLE AS chars, (length({_TRIM.format('text')}) - length(replace({_TRIM.format('text')}, ' ', '')))::DOUBLE AS blanks FROM documents WHERE {_TRIM.format('text')} <> ''")
def plugged_embedder(spark: SparkSession, d: str) -> DataFrame:
    """An embedder of one's own: here the numbers of characters and blanks."""
    found = embed_texts(table(spark, d, "documents"), dense_embedder(_load_lengths), "text")
    return found.select("doc_id", F.col("vector")[0].cast("double").alias("chars"), F.col("vector")[1].cast("double").alias("blanks"))


@query(
    rf"""WITH d AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_DENSE}) WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 20),
o AS (SELECT d.*, len(list_filter(['the', 'and', 'of', 'is'], lambda w: list_contains(regexp_split_to_array(coalesce(text, ''), '\s+'), w)))::DOUBLE / 100 AS again FROM d JOIN documents ON doc_id = vec_id),
r AS (SELECT vec_id, s, again, max(s) OVER () >= 0.75 AS sure, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS plain, row_number() OVER (ORDER BY again DESC, s DESC, vec_id)::INT AS anew FROM o)
SELECT vec_id, CASE WHEN sure THEN plain ELSE anew END AS rank, CASE WHEN sure THEN s ELSE again END AS score, NOT sure AS reranked FROM r WHERE CASE WHEN sure THEN plain <= 10 ELSE anew <= 5 END"""
)
def plugged_reranker(spark: SparkSession, d: str) -> DataFrame:
    """A reranker of one's own behind the guard: words shared with a query."""
    near = retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20, where=F.col("vec_id") != 0)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    model = reranker(_load_overlap, F.lit("the and of is"))
    scored = near.join(docs, "vec_id").withColumn("again", model(F.coalesce("content", F.lit(""))))
    return retrieval.rerank_guard(scored, 10, rerank=F.col("again"))


@query(f"WITH {_TF} SELECT doc_id, sum(weight * q) AS score FROM post JOIN qt USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def sparse_block_max_topk(spark: SparkSession, d: str) -> DataFrame:
    """``sparse_tf_topk`` over postings that are stored, by block maxima."""
    path = stores.scratch_folder(spark, "postings")
    docs = table(spark, d, "documents").withColumn("block", stores.block_of(F.col("doc_id"), 6))
    stores.write_postings(retrieval.term_postings(docs, by=("block",)), path, block_bits=6)
    return stores.search_postings(spark, path, _query_terms(spark, d), 20, first=4)
