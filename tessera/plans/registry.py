"""Registered queries of the engine over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine, hash_buckets, hash_embedding
from tessera.operators import chunking, content, conversations, fusion, graph, lifecycle, retrieval, stats
from tessera.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-02-15 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def _first_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


# SQL shared by several queries
_COS = """list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"""
_DENSE = f"SELECT a.vec_id, a.label, {_COS} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_APPEARS = r"""appears AS (
  SELECT DISTINCT doc_id, w AS entity_name FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+')) AS w FROM documents) WHERE length(w) >= 5
)"""
_WINDOWS = """windows AS (
  SELECT doc_id, (s // 450)::INT AS idx, substr(text, (s + 1)::INT, 500) AS content
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM documents WHERE length(text) > 0)
)"""


@query(f"SELECT vec_id, round(s, 4) AS score FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 10")
def knn_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 10).withColumn("score", F.round("score", 4))


@query(f"SELECT vec_id, round(s, 4) AS score FROM ({_DENSE}) WHERE s >= 0.3 AND label <> 3 ORDER BY s DESC, vec_id LIMIT 20")
def knn_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20, retrieval.DENSE_THRESHOLD, F.col("label") != 3)
    return found.withColumn("score", F.round("score", 4))


@query(
    f"""SELECT query_id, vec_id, round(s, 4) AS score, r AS rank FROM (
SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id)::INT AS r
FROM embeddings a, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q) WHERE r <= 5"""
)
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.knn_batch(e, asked, 5).withColumn("score", F.round("score", 4))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '\s+') AS ws FROM documents),
f AS (SELECT doc_id, unnest(list_slice(list_filter(ws, lambda x: x <> ''), 1, 1000)) AS f FROM w WHERE len(list_filter(ws, lambda x: x <> '')) > 1)
SELECT doc_id, (('0x' || right(md5(f), 8))::BIGINT % 64)::INT AS idx, round(sum(1.0 + 0.1 * (length(f) % 3)), 4)::DOUBLE AS weight FROM f GROUP BY 1, 2"""
)
def hash_embed_buckets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(T.word_count(F.coalesce("text", F.lit(""))) > 1)
    return hash_buckets(docs).withColumn("weight", F.round("weight", 4))


@query(
    r"""WITH docs AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id = 0),
b AS (SELECT kind, id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM docs),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS ws, regexp_replace(body, '\s+', '', 'g') AS solid FROM b),
f AS (SELECT kind, id, unnest(list_slice(CASE WHEN len(ws) > 1 THEN ws WHEN length(solid) < 3 THEN list_filter([solid], lambda x: x <> '') ELSE list_transform(range(1, length(solid) - 1), lambda i: substr(solid, i, 3)) END, 1, 1000)) AS f FROM w),
h AS (SELECT kind, id, ('0x' || right(md5(f), 8))::BIGINT % 64 AS idx, sum(10 + length(f) % 3) AS n FROM f GROUP BY ALL),
m AS (SELECT kind, id, sqrt(sum(n * n)::DOUBLE) AS norm FROM h GROUP BY ALL),
s AS (SELECT d.id AS doc_id, sum(d.n * q.n)::DOUBLE AS dot FROM h d JOIN h q ON q.kind = 1 AND q.idx = d.idx WHERE d.kind = 0 GROUP BY 1)
SELECT doc_id, round(coalesce(dot / (a.norm * (SELECT norm FROM m WHERE kind = 1)), 0), 4) AS score FROM (SELECT doc_id FROM documents) LEFT JOIN s USING (doc_id) LEFT JOIN m a ON a.kind = 0 AND a.id = doc_id ORDER BY coalesce(dot / (a.norm * (SELECT norm FROM m WHERE kind = 1)), 0) DESC, doc_id LIMIT 20"""
)
def hash_embed_similarity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    q = hash_embedding(table(spark, d, "benchmark").where("item_id = 0"), "item_id", "text").select(F.col("vector").alias("q"))
    return retrieval.knn(hash_embedding(docs), q, 20, id_col="doc_id", vec="vector").withColumn("score", F.round("score", 4))


_TF = r"""post AS (SELECT doc_id, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
qt AS (SELECT term, count(*)::DOUBLE AS q FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id = 0) WHERE term <> '' GROUP BY 1)"""


def _query_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_postings(table(spark, d, "benchmark").where("item_id = 0"), "item_id").select("term", F.col("weight").alias("q"))


@query(f"WITH {_TF} SELECT doc_id, sum(weight * q) AS score FROM post JOIN qt USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def sparse_tf_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_terms(table(spark, d, "documents"), _query_terms(spark, d), 20)


@query(
    f"""WITH {_TF},
dense AS (SELECT vec_id AS id, s AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT * FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 20)),
sparse AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, sum(weight * q) AS score FROM post JOIN qt USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)),
f AS (SELECT coalesce(d.id, s.id) AS id, coalesce(1.0 / (60 + d.r), 0)::DOUBLE + coalesce(1.0 / (60 + s.r), 0)::DOUBLE AS rrf, coalesce(d.score, s.score) AS score, d.r AS dr, s.r AS sr FROM dense d FULL JOIN sparse s ON d.id = s.id)
SELECT id, round(rrf, 8) AS rrf, round(score, 4) AS score, row_number() OVER (ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST, id)::INT AS rank FROM f"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    dense = retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20).withColumnRenamed("vec_id", "id")
    sparse = sparse_tf_topk(spark, d).withColumnRenamed("doc_id", "id")
    out = retrieval.reciprocal_rank_fusion(retrieval.ranked(dense, "id"), retrieval.ranked(sparse, "id"))
    return out.select("id", F.round("rrf", 8).alias("rrf"), F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH d AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 20), b AS (SELECT max(s) AS best FROM d)
SELECT vec_id, rank, CASE WHEN best >= 0.75 THEN round(s, 4) ELSE 1.0 END AS score, best < 0.75 AS reranked FROM d, b WHERE rank <= CASE WHEN best >= 0.75 THEN 10 ELSE 5 END"""
)
def rerank_guard(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 20)
    return retrieval.rerank_guard(found, 10).withColumn("score", F.round("score", 4))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def live_docs_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_docs_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


_FP = r"substr(md5(replace(replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10), ' '), '  ', ' ')), 1, 16)"


@query(f"SELECT {_FP} AS fp, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.fingerprint(F.coalesce("text", F.lit(""))).alias("fp")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    f"""WITH d AS (SELECT doc_id, {_FP} AS fp, (doc_id % 7)::DOUBLE / 7 AS weight FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY weight DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY fp) AS place FROM d)
SELECT doc_id, place, round(weight, 4) AS weight FROM r WHERE rn = 1"""
)
def keep_best_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), ((F.col("doc_id") % 7).cast("double") / 7).alias("weight"), F.col("doc_id").alias("seq"))
    return fusion.keep_best(rows).select("doc_id", "place", F.round("weight", 4).alias("weight"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    vectors = retrieval.ranked(retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 12), "vec_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    found = vectors.join(docs, "vec_id").select(F.col("vec_id").alias("chunk_id"), "content", "score", F.col("rank").alias("seq"))
    return fusion.pack(fusion.candidates(found, None, None, None), 2000)


_PACK = rf"""WITH v AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 12),
c AS (SELECT rank AS pos, text AS content, ' [来源:向量]' || chr(10) AS tail FROM v JOIN documents ON doc_id = vec_id),
n AS (SELECT *, row_number() OVER (ORDER BY pos) AS p, coalesce(sum(length(content) + length(tail)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT *, before + length(content) + length(tail) <= 5000 AS fits FROM n),
g AS (SELECT *, min(CASE WHEN NOT fits THEN p END) OVER () AS stop FROM f),
h AS (SELECT p, fits, tail, CASE WHEN fits THEN content WHEN length(content) <= 5000 - before THEN content ELSE regexp_replace(left(content, (5000 - before)::INT), '(?s)[。！？.!?\n][^。！？.!?\n]*$', '') END AS short FROM g WHERE (stop IS NULL OR p <= stop) AND before <= 5000)
SELECT p::INT AS pos, short || tail AS part FROM h WHERE fits OR short <> ''"""


@query(_PACK)
def context_pack_budget(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query(f"SELECT string_agg(part, '' ORDER BY pos) AS context FROM ({_PACK})")
def packed_context(spark: SparkSession, d: str) -> DataFrame:
    return fusion.packed_text(_packed(spark, d))


@query(
    f"""WITH {_APPEARS}, v AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 10),
e AS (SELECT entity_name, count(*) AS n FROM appears GROUP BY 1)
SELECT 'vector_rerank_top' AS source_type, vec_id::VARCHAR AS chunk_id, text AS content, round(2.0 * (0.5 + 0.5 * s), 4)::DOUBLE AS weight FROM v JOIN documents ON doc_id = vec_id
UNION ALL SELECT 'direct_entity_match', NULL, '[实体] ' || entity_name || ' (概念): ' || n, 3.0 FROM e"""
)
def fusion_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = retrieval.ranked(retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 10), "vec_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    vec = v.join(docs, "vec_id").select(F.col("vec_id").alias("chunk_id"), "content", "score", F.col("rank").cast("long").alias("seq"))
    e = _appears(spark, d).groupBy("entity_name").agg(F.count("*").alias("n"))
    ent = e.select(F.col("entity_name").alias("name"), F.lit("概念").alias("kind"), F.col("n").cast("string").alias("description"), F.lit(0).cast("long").alias("seq"))
    return fusion.candidates(vec, ent, None, None).select("source_type", "chunk_id", "content", F.round("weight", 4).alias("weight"))


@query(f"WITH {_WINDOWS} SELECT doc_id, idx, content FROM windows")
def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents"))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents"))


@query(
    f"""WITH {_WINDOWS} SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
md5(right(lag(content) OVER w, 200)) AS before, md5(left(lead(content) OVER w, 200)) AS after FROM windows WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"""
)
def chunk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = chunking.with_neighbours(chunking.fixed_windows(table(spark, d, "documents")), 200)
    return n.select("doc_id", "idx", "total_chunks", F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query(
    f"""WITH {_WINDOWS}, w AS (SELECT doc_id, idx, lag(content) OVER o AS p, lead(content) OVER o AS n FROM windows WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, md5(concat_ws(chr(10), p, n)) AS context FROM w"""
)
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.around(chunking.fixed_windows(table(spark, d, "documents"))).select("doc_id", "idx", F.md5("context").alias("context"))


@query(
    f"""WITH {_WINDOWS}, i AS (SELECT *, idx // 4 AS page FROM windows)
SELECT a.doc_id, a.idx, md5(string_agg(CASE WHEN a.page = b.page THEN b.content ELSE '[Page ' || b.page || '] ' || b.content END, chr(10) ORDER BY b.page, b.idx)) AS context
FROM i a JOIN i b ON a.doc_id = b.doc_id AND abs(a.page - b.page) <= 1 GROUP BY 1, 2"""
)
def page_window_context(spark: SparkSession, d: str) -> DataFrame:
    items = chunking.fixed_windows(table(spark, d, "documents")).withColumn("page", F.floor(F.col("idx") / 4).cast("int"))
    return chunking.page_context(items).select("doc_id", "idx", F.md5("context").alias("context"))


@query(
    r"""WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([。！？.!?])', '\1' || chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split_regex(t, chr(1) || '|\n\s*\n')) AS x FROM m)
SELECT doc_id, count(*) AS n, sum(length(regexp_replace(x, '^\s+|\s+$', '', 'g')))::BIGINT AS chars FROM s WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1"""
)
def sentence_split_count(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_rows(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(
    r"""WITH RECURSIVE m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([。！？.!?])', '\1' || chr(1), 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, chr(1) || '|\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM m),
s AS (SELECT doc_id, generate_subscripts(ss, 1) AS idx, unnest(ss) AS s FROM p),
w AS (SELECT doc_id, idx, regexp_split_to_array(s, '\s+') AS ws, regexp_replace(s, '\s+', '', 'g') AS solid FROM s),
f AS (SELECT doc_id, idx, unnest(list_slice(CASE WHEN len(ws) > 1 THEN ws WHEN length(solid) < 3 THEN [solid] ELSE list_transform(range(1, length(solid) - 1), lambda i: substr(solid, i, 3)) END, 1, 1000)) AS f FROM w),
h AS (SELECT doc_id, idx, ('0x' || right(md5(f), 8))::BIGINT % 64 AS b, sum(10 + length(f) % 3)::DOUBLE AS n FROM f GROUP BY ALL),
l AS (SELECT doc_id, idx, sqrt(sum(n * n)) AS norm FROM h GROUP BY ALL),
d AS (SELECT a.doc_id, a.idx, sum(a.n * o.n) AS dot FROM h a JOIN h o ON o.doc_id = a.doc_id AND o.idx = a.idx - 1 AND o.b = a.b GROUP BY ALL),
r AS (SELECT s.doc_id, s.idx, s.s, length(s.s) AS n, coalesce(d.dot, 0) / (x.norm * y.norm) AS sim FROM s JOIN l x USING (doc_id, idx) LEFT JOIN l y ON y.doc_id = s.doc_id AND y.idx = s.idx - 1 LEFT JOIN d ON d.doc_id = s.doc_id AND d.idx = s.idx),
walk AS (SELECT doc_id, idx, 0 AS run, n AS size FROM r WHERE idx = 1
  UNION ALL SELECT r.doc_id, r.idx, w.run + (w.size >= 100 AND (r.sim < 0.5 OR w.size + r.n > 750))::INT, CASE WHEN w.size >= 100 AND (r.sim < 0.5 OR w.size + r.n > 750) THEN r.n ELSE w.size + r.n END FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.idx = w.idx + 1),
runs AS (SELECT doc_id, run, string_agg(s, ' ' ORDER BY idx) AS t FROM walk JOIN r USING (doc_id, idx) GROUP BY 1, 2),
joined AS (SELECT doc_id, run, 0 AS idx, length(t) AS held FROM runs WHERE run = 0
  UNION ALL SELECT u.doc_id, u.run, j.idx + (j.held >= 100 OR j.held + length(u.t) > 750)::INT, CASE WHEN j.held >= 100 OR j.held + length(u.t) > 750 THEN length(u.t) ELSE j.held + 1 + length(u.t) END FROM joined j JOIN runs u ON u.doc_id = j.doc_id AND u.run = j.run + 1)
SELECT doc_id, idx, string_agg(t, ' ' ORDER BY run) AS content FROM joined JOIN runs USING (doc_id, run) GROUP BY 1, 2"""
)
def semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_chunks(table(spark, d, "documents"))


@query()
def section_asof(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.section_of(chunking.recursive_chunks(docs), chunking.sections(docs)).select("doc_id", "idx", "start", "section_path")


@query()
def extraction_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.extraction_units(chunking.section_of(chunking.recursive_chunks(docs), chunking.sections(docs)))


_HEADINGS = rf"""lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
spots AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM lines),
heads AS (SELECT doc_id, position, level, title, row_number() OVER (PARTITION BY doc_id ORDER BY turn, position) AS k FROM (
  SELECT doc_id, position, 0 AS turn, length(regexp_extract(line, '^(#{{1,6}})\s+\S', 1)) AS level, regexp_replace(regexp_extract(line, '^#{{1,6}}\s+(\S.*)$', 1), '^\s+|\s+$', '', 'g') AS title FROM spots WHERE regexp_matches(line, '^#{{1,6}}\s+\S.*$')
  UNION ALL SELECT doc_id, position, 1, len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)\s+\S', 1), '.')),
    regexp_extract(line, '^(\d+(?:\.\d+)*)\s+\S', 1) || ' ' || regexp_replace(regexp_extract(line, '^\d+(?:\.\d+)*\s+(\S.*)$', 1), '^\s+|\s+$', '', 'g') FROM spots WHERE regexp_matches(line, '^\d+(?:\.\d+)*\s+\S.*$'))),
above AS (SELECT h.doc_id, h.k, max(u.k) AS up FROM heads h LEFT JOIN heads u ON u.doc_id = h.doc_id AND u.k < h.k AND u.level < h.level GROUP BY 1, 2),
paths AS (SELECT h.doc_id, h.k, h.position, h.title AS path FROM heads h JOIN above USING (doc_id, k) WHERE up IS NULL
  UNION ALL SELECT h.doc_id, h.k, h.position, p.path || ' > ' || h.title FROM paths p JOIN above a ON a.doc_id = p.doc_id AND a.up = p.k JOIN heads h ON h.doc_id = a.doc_id AND h.k = a.k),
{_WINDOWS},
placed AS (SELECT w.doc_id, w.idx, w.content, (SELECT p.path FROM paths p WHERE p.doc_id = w.doc_id AND p.position <= w.idx * 450 ORDER BY p.position DESC LIMIT 1) AS section_path FROM windows w)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.section_of(chunking.fixed_windows(docs).withColumn("start", F.col("idx") * 450), chunking.sections(docs))


@query(f"WITH RECURSIVE {_HEADINGS} SELECT doc_id, idx, section_path FROM placed")
def section_windows(spark: SparkSession, d: str) -> DataFrame:
    """``section_asof`` of fixed windows."""
    return _placed(spark, d).select("doc_id", "idx", "section_path")


@query(
    f"""WITH RECURSIVE {_HEADINGS}, r AS (SELECT doc_id, idx, content, coalesce(section_path, '') AS sec FROM placed),
walk AS (SELECT doc_id, idx, 0 AS unit, sec, length(content) AS size FROM r WHERE idx = 0
  UNION ALL SELECT r.doc_id, r.idx, CASE WHEN r.sec <> w.sec OR w.size + length(r.content) + 1 > 2500 THEN w.unit + 1 ELSE w.unit END, r.sec,
    CASE WHEN r.sec <> w.sec OR w.size + length(r.content) + 1 > 2500 THEN length(r.content) ELSE w.size + length(r.content) + 1 END FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.idx = w.idx + 1)
SELECT w.doc_id, w.unit, min(w.idx) AS first_idx, md5(string_agg(r.content, chr(10) ORDER BY r.idx)) AS content FROM walk w JOIN r USING (doc_id, idx) GROUP BY 1, 2"""
)
def window_units(spark: SparkSession, d: str) -> DataFrame:
    """``extraction_units`` of fixed windows."""
    return chunking.extraction_units(_placed(spark, d)).withColumn("content", F.md5("content"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = {"queries": "click", "added": "purchase", "deleted": "error"}
    return stats.daily({k: e.where(F.col("event_type") == v) for k, v in kinds.items()}, "2024-01")


_DAILY = """daily AS (SELECT ts::DATE AS date, count(*) FILTER (event_type = 'click') AS queries, count(*) FILTER (event_type = 'purchase') AS added, count(*) FILTER (event_type = 'error') AS deleted
FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' AND event_type IN ('click', 'purchase', 'error') GROUP BY 1)"""
_CAL = """cal AS (SELECT x::DATE AS date, coalesce(queries, 0) AS queries, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted,
CASE WHEN coalesce(queries, 0) <= 0 THEN 0 WHEN queries <= 2 THEN 1 WHEN queries <= 5 THEN 2 WHEN queries <= 9 THEN 3 ELSE 4 END AS level
FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(x) LEFT JOIN daily ON daily.date = x::DATE)"""


@query(f"WITH {_DAILY} SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM daily")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {_DAILY}, {_CAL} SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM cal")
def usage_calendar_levels(spark: SparkSession, d: str) -> DataFrame:
    return stats.calendar(_usage(spark, d), "2024-01").withColumn("date", F.col("date").cast("string"))


@query(f"WITH {_DAILY}, {_CAL} SELECT sum(queries)::BIGINT AS queries, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, count(*) FILTER (level > 0) AS active_days FROM cal")
def usage_month_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.month_totals(stats.calendar(_usage(spark, d), "2024-01"))


@query(
    """SELECT strftime(DATE '2024-01-01' + (conv_id % 31)::INT, '%Y-%m-%d') AS date, count(*) AS queries FROM conversations JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') USING (conv_id) WHERE role = 'user' GROUP BY 1"""
)
def usage_messages_join(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    sessions = m.where("role = 'assistant'").select("conv_id").distinct().withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 31).cast("int")).cast("string"))
    return m.where("role = 'user'").join(sessions, "conv_id").groupBy("date").agg(F.count("*").alias("queries"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def status_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_by(table(spark, d, "documents"), "lang", "source")


@query("SELECT conv_id, left(arg_min(text, turn) FILTER (role = 'user'), 20) AS preview, count(*) AS n_messages FROM conversations GROUP BY 1")
def session_preview(spark: SparkSession, d: str) -> DataFrame:
    return conversations.previews(table(spark, d, "conversations"))


_PAIRS = """pairs AS (SELECT conv_id, turn, text AS question, a AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


@query(f"WITH {_PAIRS} SELECT conv_id, turn, question, answer FROM pairs WHERE r <= 5")
def turn_pairs_last5(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turn_pairs(table(spark, d, "conversations"))


@query(f"WITH {_PAIRS} SELECT conv_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) ORDER BY turn) AS history FROM pairs WHERE r <= 5 GROUP BY 1")
def history_prompt(spark: SparkSession, d: str) -> DataFrame:
    return conversations.history_prompt(conversations.turn_pairs(table(spark, d, "conversations")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' - INTERVAL 7 DAY AND o_orderdate < TIMESTAMP '1998-07-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5")
def recent_docs_page(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-07-01").cast("timestamp_ntz")
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= now - F.expr("interval 7 days")) & (F.col("o_orderdate") < now))
    return lifecycle.page(o.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 5, 20)


@query(f"SELECT event_id, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400)::BIGINT AS days FROM events WHERE event_type = 'error' AND floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) > 30")
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    gone = lifecycle.expired(table(spark, d, "events").where("event_type = 'error'").withColumn("deleted_at", F.col("ts")), now)
    return gone.select("event_id", lifecycle.days_since(F.col("deleted_at"), now).alias("days"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("v"))
    return lifecycle.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "v").drop("v")


def _entity_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("E"), F.col("value").cast("long").cast("string")).alias("name"), F.lit("1").alias("user_id"), F.col("event_type").alias("type"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("props")).alias("description"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("chunk_id"), F.col("event_id").alias("seq"),
    )


_EE = "ev AS (SELECT 'E' || trunc(value)::BIGINT AS name, '1' AS user_id, event_type AS type, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS description, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS chunk_id, event_id AS seq FROM events)"


@query(f"WITH {_EE} SELECT name, user_id, arg_min(type, seq) AS type, arg_max(description, seq) FILTER (description <> '') AS description, arg_min(chunk_id, seq) FILTER (chunk_id IS NOT NULL) AS chunk_id, count(*) AS n_mentions FROM ev GROUP BY 1, 2")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_entities(_entity_events(spark, d))


@query(
    f"""WITH {_EE}, d AS (SELECT name, type, description, min(seq) AS seq FROM ev WHERE description <> '' GROUP BY 1, 2, 3), p AS (SELECT name, type, string_agg(description, '; ' ORDER BY seq) AS description FROM d GROUP BY 1, 2),
c AS (SELECT name, type, first(chunk_id ORDER BY seq) AS chunk_id FROM ev GROUP BY 1, 2) SELECT name, type, chunk_id, coalesce(description, '') AS description FROM c LEFT JOIN p USING (name, type)"""
)
def entity_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return graph.append_descriptions(_entity_events(spark, d))


@query("SELECT source, target, relation_type, description, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation_type ORDER BY seq) AS rn FROM (SELECT user_id % 20 AS source, (event_id * 7) % 20 AS target, event_type AS relation_type, props AS description, event_id AS seq FROM events)) WHERE rn = 1")
def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("source"), ((F.col("event_id") * 7) % 20).alias("target"), F.col("event_type").alias("relation_type"), F.col("props").alias("description"), F.col("event_id").alias("seq"))
    return graph.merge_relations(e, ("source", "target", "relation_type"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') ORDER BY p_name, p_partkey LIMIT 50")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_entities(table(spark, d, "part").select("p_partkey", "p_name"), "a", 50, "p_name", "p_partkey")


def _appears(spark: SparkSession, d: str) -> DataFrame:
    return graph.token_entities(table(spark, d, "documents"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order is an edge from its customer to a customer of its number without the last digit, so that degrees stay the same at every size."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src"), F.floor(F.col("o_orderkey") / 10).cast("long").alias("dst"))


_E = "e AS (SELECT o_orderkey AS edge_id, o_custkey AS src, o_orderkey // 10 AS dst FROM orders), b AS (SELECT edge_id, src, dst FROM e UNION ALL SELECT edge_id, dst, src FROM e)"
_T1 = "t1 AS (SELECT src AS seed, dst AS target, [edge_id] AS path FROM b WHERE src IN (1, 2, 3))"
_T2 = "t2 AS (SELECT seed, dst AS target, list_append(path, edge_id) AS path FROM t1 JOIN b ON target = src WHERE NOT list_contains(path, edge_id))"
_T3 = "t3 AS (SELECT seed, dst AS target, list_append(path, edge_id) AS path FROM t2 JOIN b ON target = src WHERE NOT list_contains(path, edge_id))"


def _trail_counts(spark: SparkSession, d: str, hops: int) -> DataFrame:
    seeds = spark.range(1, 4).select(F.col("id").alias("seed"))
    return graph.trails(_edges(spark, d), seeds, hops).groupBy("seed", "target", "hops").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT DISTINCT src AS seed, dst AS neighbour, edge_id FROM b WHERE src IN (1, 2, 3)")
def graph_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_context(_edges(spark, d), spark.range(1, 4).select(F.col("id").alias("seed")))


@query(f"WITH {_E}, {_T1}, {_T2} SELECT seed, target, hops, count(*) AS n FROM (SELECT *, 1 AS hops FROM t1 UNION ALL SELECT *, 2 FROM t2) GROUP BY 1, 2, 3")
def graph_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _trail_counts(spark, d, 2)


@query(f"WITH {_E}, {_T1}, {_T2}, {_T3} SELECT seed, target, hops, count(*) AS n FROM (SELECT *, 1 AS hops FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3) GROUP BY 1, 2, 3")
def graph_3hop(spark: SparkSession, d: str) -> DataFrame:
    return _trail_counts(spark, d, 3)


@query(
    f"""WITH {_APPEARS}, mine AS (SELECT DISTINCT entity_name FROM appears WHERE doc_id = 1)
SELECT doc_id, count(DISTINCT entity_name) AS shared_count, string_agg(DISTINCT entity_name, ',' ORDER BY entity_name) AS shared FROM appears JOIN mine USING (entity_name) WHERE doc_id <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def shared_entity_docs(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_entity_documents(_appears(spark, d), table(spark, d, "documents").where("doc_id = 1").select("doc_id"), 20)


@query(
    f"""WITH {_APPEARS}, newest AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 100), a AS (SELECT * FROM appears WHERE doc_id IN (SELECT doc_id FROM newest))
SELECT x.doc_id AS id1, y.doc_id AS id2, count(*) AS weight FROM a x JOIN a y ON x.entity_name = y.entity_name AND x.doc_id < y.doc_id GROUP BY 1, 2"""
)
def doc_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "documents").select("doc_id").orderBy(F.desc("doc_id")).limit(100)
    return graph.document_graph(_appears(spark, d), newest)


@query(
    f"""WITH {_APPEARS}, h AS (SELECT entity_name, count(*) - 1 AS others FROM appears GROUP BY 1)
SELECT doc_id, count(*) AS n_entities, sum(others)::BIGINT AS n_links FROM appears JOIN h USING (entity_name) GROUP BY 1"""
)
def doc_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_links(_appears(spark, d))


@query("SELECT l_orderkey AS id1, l_partkey AS entity_name FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_appearances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id1"), F.col("l_partkey").alias("entity_name")).agg(F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"WITH {_E} SELECT edge_id, src, dst FROM e WHERE src <> dst AND src < 30 AND dst < 30")
def entity_graph_induced(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced_edges(_edges(spark, d), spark.range(30).select(F.col("id").alias("node")))


@query(f"WITH {_APPEARS}, {_E} SELECT (SELECT count(DISTINCT entity_name) FROM appears) AS entities, (SELECT count(*) FROM e) AS relations, (SELECT count(*) FROM documents) AS documents")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(_appears(spark, d).select("entity_name").distinct(), _edges(spark, d), table(spark, d, "documents"))


@query(f"WITH {_APPEARS} SELECT DISTINCT entity_name FROM appears WHERE entity_name NOT IN (SELECT entity_name FROM appears JOIN labels USING (doc_id))")
def graph_sync_orphans(spark: SparkSession, d: str) -> DataFrame:
    a, docs = _appears(spark, d), table(spark, d, "documents").select("doc_id")
    return graph.reconcile(docs, table(spark, d, "labels").select("doc_id"), a.select("entity_name").distinct(), a)[2]


@query(
    f"""WITH {_APPEARS}, v AS (SELECT vec_id AS doc_id, s FROM ({_DENSE}) WHERE vec_id <> 0 AND s >= 0.2 ORDER BY s DESC, vec_id LIMIT 15),
t AS (SELECT doc_id FROM documents WHERE lang = (SELECT lang FROM documents WHERE doc_id = 0) AND source = (SELECT source FROM documents WHERE doc_id = 0) AND doc_id <> 0),
mine AS (SELECT entity_name FROM appears WHERE doc_id = 0),
g AS (SELECT doc_id, count(*) AS n FROM appears JOIN mine USING (entity_name) WHERE doc_id <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
x AS (SELECT doc_id, round(s, 4)::DOUBLE AS similarity, 'similar content' AS reason, 0 AS prio FROM v UNION ALL SELECT doc_id, 0.6, 'same tags', 1 FROM t UNION ALL SELECT doc_id, 0.7, 'shared entities', 2 FROM g)
SELECT doc_id, arg_min(similarity, prio) AS similarity, string_agg(reason, ' + ' ORDER BY prio) AS reason FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def related_docs_blend(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 15, 0.2, F.col("vec_id") != 0).withColumnRenamed("vec_id", "doc_id")
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    both = lifecycle.same_tags(docs, F.lit(0)).where(F.size("common") == 2)
    shared = graph.shared_entity_documents(_appears(spark, d), docs.where("doc_id = 0").select("doc_id"), 10)
    return retrieval.related_documents([(near, None, "similar content"), (both, 0.6, "same tags"), (shared, 0.7, "shared entities")], 20)


_TYPES = [" Dataset ", "公司", "xyz", "", "Tool", "城市", "PERSON", "理论", "时间段"]
_RELS = ["依赖", "depends on", "foo", "", " 影响", "Causes", "located IN", "产生"]
_AGENTS = ["Mozilla/5.0 (iPhone) Safari", "Mozilla/5.0 (iPad)", "Android 14 Chrome Mobile", "Mozilla Chrome/120", "Safari mobile", "curl/8", ""]


def _said(spark: SparkSession, d: str, values: list[str]) -> DataFrame:
    """Every event with one of the values, as sources outside would spell it."""
    at = (F.col("event_id") % len(values) + 1).cast("int")
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, values)), at).alias("x"))


def _said_sql(values: list[str], y: str) -> str:
    return f"SELECT event_id, x, {y} AS y FROM (SELECT event_id, {values}[(event_id % {len(values)})::INT + 1] AS x FROM events)"


def _case(groups: dict[str, list[str]], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(repr(w) for w in ws)}) THEN '{g}'" for g, ws in groups.items())


@query(_said_sql(_TYPES, _case(T.ENTITY_TYPES, "lower(trim(x))") + " ELSE '概念' END"))
def entity_type_norm(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d, _TYPES).withColumn("y", T.entity_type(F.col("x")))


@query(_said_sql(_RELS, _case({k: [*v, k] for k, v in T.RELATION_LABELS.items()}, "upper(replace(trim(x), ' ', '_'))") + " ELSE 'RELATED_TO' END"))
def relation_type_norm(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d, _RELS).withColumn("y", T.relation_label(F.col("x")))


@query(_said_sql(_AGENTS, "CASE WHEN lower(x) LIKE '%iphone%' THEN 'iphone' WHEN lower(x) LIKE '%ipad%' THEN 'ipad' WHEN lower(x) LIKE '%android%' THEN 'android' WHEN regexp_matches(lower(x), 'chrome|firefox|safari|edge|opera') AND lower(x) NOT LIKE '%mobile%' THEN 'web' ELSE 'unknown' END"))
def device_type(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d, _AGENTS).withColumn("y", T.device_type(F.col("x")))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>\s*(.*?)\s*</title>', 1) AS title, (length(html) - length(replace(html, '<a ', '')))//3 AS links FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    links = F.floor((F.length("html") - F.length(F.replace("html", F.lit("<a "), F.lit("")))) / 3)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>\s*(.*?)\s*</title>", 1).alias("title"), links.cast("long").alias("links"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|noscript)\b.*?</(script|style|noscript)>', '', 'g'), '<[^>]*>', '', 'g') AS body FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?s)<(script|style|noscript)\b.*?</(script|style|noscript)>", "")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(bare, "<[^>]*>", "").alias("body"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return content.pages_to_markdown(table(spark, d, "pages"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _markdown_sql() -> str:
    """The Markdown rules as nested replacements, then paragraphs."""
    html = "coalesce(text, '')"
    for pattern, to in T.MARKDOWN:
        to = to.replace("$", "\\")
        html = f"regexp_replace({html}, '{pattern}', '{to}', 'g')"
    block = " OR ".join(f"starts_with(p, '{x}')" for x in T.BLOCK_STARTS)
    parts = f"list_filter(list_transform(string_split({html}, chr(10) || chr(10)), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
    return f"SELECT doc_id, array_to_string(list_transform({parts}, lambda p: CASE WHEN {block} THEN p ELSE '<p>' || replace(p, chr(10), '<br>') || '</p>' END), chr(10)) AS html FROM documents"


@query(_markdown_sql())
def md_to_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.md_to_html(F.coalesce("text", F.lit(""))).alias("html"))


@query("""SELECT doc_id, '---' || chr(10) || 'title: "Document ' || doc_id || '"' || chr(10) || 'file_type: text' || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '') AS body FROM documents""")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    title, tags = F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.array("lang", "source")
    body = content.export_markdown(title, F.lit("text"), tags, F.lit(None).cast("timestamp_ntz"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", body.alias("body"))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text})::VARCHAR AS body FROM documents")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", content.export_json("doc_id", "lang", "source", "text").alias("body"))


_ENDS = "[。！？.!?]"
_SENTENCE = "CASE " + " ".join(f"WHEN contains(p, '{e}') THEN {_STRIP.format(f"left(p, position('{e}' IN p)::INT)")}" for e in T.SENTENCE_END) + " END"
_HEAD = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(raw, '^[^\r\n]*'), 'PREFIXES', ''), '[\\/:*?"<>|]', '', 'g'), '\s+', ' ', 'g')"""
_PREFIXES = "^" + "".join(rf"(?:{p}\s*)?" for p in T.TITLE_PREFIXES)
_HEAD = _HEAD.replace("PREFIXES", _PREFIXES)


@query(
    rf"""WITH t AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS raw FROM documents),
h AS (SELECT doc_id, raw, left({_STRIP.format(_HEAD)}, 60) AS head FROM t),
p AS (SELECT doc_id, list_slice(list_filter(list_transform(string_split(regexp_replace(raw, '\r\n?', chr(10), 'g'), chr(10) || chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), 1, 4) AS ps FROM t),
b AS (SELECT doc_id, list_transform(ps, lambda p: CASE WHEN coalesce({_SENTENCE}, '') <> '' THEN {_SENTENCE} WHEN length(p) > 120 THEN left(p, 120) || '...' ELSE p END) AS firsts FROM p)
SELECT h.doc_id, CASE WHEN head = '' THEN '{T.NO_TITLE}' ELSE head END AS title, CASE WHEN raw = '' THEN '{T.NO_TEXT}' ELSE array_to_string(list_transform(firsts, lambda x: '- ' || x), chr(10)) END AS bullets,
CASE WHEN length(raw) > 200 THEN left(raw, 200) || '...' ELSE raw END AS summary,
array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array(raw, '{_ENDS}'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 10), 1, 3), '|') AS key_points FROM h JOIN b USING (doc_id)"""
)
def local_digest_parts(spark: SparkSession, d: str) -> DataFrame:
    got = content.local_digest(table(spark, d, "documents"))
    return got.select("doc_id", "title", "bullets", "summary", F.array_join("key_points", "|").alias("key_points"))


@query(
    f"""SELECT doc_id, 'Document_ ' || doc_id || '.html' AS filename, 'text/html' AS mime,
'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Document: ' || doc_id || '</title></head><body><h1>Document: ' || doc_id || '</h1>' || html || '</body></html>' AS body FROM ({_markdown_sql()})"""
)
def export_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Document: "), F.col("doc_id").cast("string")).alias("title"), F.lit("text").alias("file_type"), F.array("lang").alias("tags"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.coalesce("text", F.lit("")).alias("content"))
    return content.export_files(docs, "html", "doc_id")


@query()
def local_digest(spark: SparkSession, d: str) -> DataFrame:
    return content.local_digest(table(spark, d, "documents"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS summary FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def doc_summary_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.summary_parts(F.lit(""), F.col("text"))["summary"].alias("summary"))


@query(
    f"""SELECT string_agg('[来源' || r || '] 标题: ' || vec_id || chr(10) || '内容: ' || text || chr(10) || '得分: ' || printf('%.4f', s), chr(10) || chr(10) ORDER BY r) AS context
FROM (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({_DENSE}) ORDER BY s DESC, vec_id LIMIT 5) JOIN documents ON doc_id = vec_id"""
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    v = retrieval.ranked(retrieval.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 5), "vec_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return fusion.prompt_context(v.join(docs, "vec_id").select("rank", F.col("vec_id").cast("string").alias("title"), "content", "score"))


@query("SELECT b.doc_id, list_aggregate(list_sort(list_filter([b.lang, b.source], lambda x: x IN (a.lang, a.source))), 'string_agg', ',') AS common FROM documents a, documents b WHERE a.doc_id = 0 AND b.doc_id <> 0 AND (b.lang = a.lang OR b.source = a.source)")
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return lifecycle.same_tags(docs, F.lit(0)).select("doc_id", F.array_join("common", ",").alias("common"))


@query(f"SELECT item_id, list_aggregate(list_slice(list_filter(regexp_split_to_array(text, '{T.TOKEN_SEPARATORS}'), lambda t: length(t) >= 2), 1, 5), 'string_agg', ' ') AS tokens FROM benchmark")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT source, max(doc_id) AS doc_id FROM (SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 5) GROUP BY 1")
def recent_paths(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest rows, of which repeated paths go afterwards."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("doc_id").alias("created_at"))
    return lifecycle.recent_paths(rows, 5).select(F.col("file_path").alias("source"), "doc_id")


@query(
    f"""WITH {_APPEARS} SELECT coalesce(lang, 'all') AS user_id, coalesce(doc_id, -1) AS doc_id, count(DISTINCT entity_name) AS n_entities, count(*) AS n_appearances FROM appears JOIN documents USING (doc_id)
GROUP BY GROUPING SETS ((lang, doc_id), (lang), ())"""
)
def appearance_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("user_id", F.col("lang"))
    return graph.listed_counts(graph.token_lists(docs)).fillna({"user_id": "all", "doc_id": -1})


@query("SELECT source, max(doc_id) AS doc_id FROM (SELECT doc_id, source FROM documents) GROUP BY 1")
def path_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("doc_id").alias("created_at"))
    return lifecycle.dedup_paths(rows).select(F.col("file_path").alias("source"), "doc_id")


from tessera.plans import lifecycle_queries, search_queries  # noqa: E402, F401  (they register more)
