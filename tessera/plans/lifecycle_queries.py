"""Queries of ingest, files, sessions and tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, conversations, lifecycle, stats, tokens
from tessera.plans.registry import _WINDOWS, query
from tessera.sources import stores
from tessera.sources.readers import table
from tessera.streaming import gates

_NOW = "2024-02-15 00:00:00"


def _at():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(
    f"""WITH {_WINDOWS}, c AS (SELECT doc_id, count(*) AS chunks, count_if(doc_id % 7 <> 0 OR idx = 0) AS vectors FROM windows GROUP BY 1)
SELECT d.doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'failed' WHEN chunks IS NULL THEN 'failed' WHEN coalesce(vectors, 0) < chunks THEN 'embedding' ELSE 'completed' END AS status,
CASE WHEN trim(coalesce(text, '')) = '' THEN 10 WHEN chunks IS NULL THEN 30 WHEN coalesce(vectors, 0) < chunks THEN 60 ELSE 100 END AS progress,
CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text could be read' WHEN chunks IS NULL THEN 'no chunks' END AS error
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""
)
def ingest_progress(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = chunking.fixed_windows(docs)
    return lifecycle.ingest(docs, chunks, chunks.where("doc_id % 7 <> 0 OR idx = 0"))


_STATES = "CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'parsing' WHEN 2 THEN 'completed' ELSE 'indexed' END"


@query(f"SELECT doc_id, CASE WHEN hit THEN 'pending' ELSE state END AS status, CASE WHEN hit THEN 0 ELSE 50 END AS progress, CASE WHEN NOT hit THEN 'e' END AS error FROM (SELECT o_orderkey AS doc_id, {_STATES} AS state, o_orderkey % 3 = 0 AND {_STATES} IN ('failed', 'completed', 'indexed') AS hit FROM orders)")
def reprocess_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "failed").when(k == 1, "parsing").when(k == 2, "completed").otherwise("indexed").alias("status"), F.lit(50).alias("progress"), F.lit("e").alias("error"))
    return lifecycle.reprocess(docs, docs.where("doc_id % 3 = 0"))


_FILES = "files AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' ELSE '.exe' END AS name, length(html) AS size FROM pages)"
_VALID = "regexp_matches(lower(name), '\\.(txt|md|pdf|docx|doc)$') AND size <= 1500"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    return table(spark, d, "pages").select(F.concat("url", F.when(k == 0, ".md").when(k == 1, ".PDF").otherwise(".exe")).alias("name"), F.length("html").alias("size"))


@query(f"WITH {_FILES} SELECT name, CASE WHEN {_VALID} THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT ({_VALID}) THEN 'unsupported type or too large: ' || name END AS error FROM files")
def batch_import_rows(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.batch_outcomes(_files(spark, d), T.valid_file(F.col("name"), F.col("size"), 1500))[0]


@query(f"WITH {_FILES} SELECT count(*) FILTER ({_VALID}) AS success, count(*) FILTER (NOT ({_VALID})) AS failed FROM files")
def batch_import_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.batch_outcomes(_files(spark, d), T.valid_file(F.col("name"), F.col("size"), 1500))[1]


@query("SELECT source AS user_id, count(*) AS n_all, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS n_live FROM documents GROUP BY 1")
def user_document_counts(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("bad")).distinct()
    docs = table(spark, d, "documents").join(bad, F.col("doc_id") == F.col("bad"), "left")
    return lifecycle.count_documents(docs.select(F.col("source").alias("user_id"), F.when(F.col("bad").isNotNull(), "deleted").alias("status")))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (3, 7, 11) AND source = (SELECT source FROM documents WHERE doc_id = 7)")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    owner = docs.where("doc_id = 7").select("source").distinct()
    return lifecycle.light(docs.where(F.col("doc_id").isin(3, 7, 11)).join(owner, "source", "left_semi"), "text").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {_WINDOWS} SELECT idx, content FROM windows WHERE doc_id = 3 ORDER BY idx LIMIT 1000")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id = 3")
    return chunking.fixed_windows(docs).orderBy("idx").limit(1000).select("idx", "content")


@query("SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE text END) = '' THEN source ELSE text END AS content FROM documents WHERE text IS NOT NULL")
def lazy_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    some = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text")).alias("content"))
    return lifecycle.with_text(some, docs.select("doc_id", F.col("source").alias("content")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'kept' ELSE lang END AS summary, CASE WHEN doc_id % 5 = 0 THEN 'kept' ELSE lang END AS cached, source AS other FROM documents")
def summary_cache(spark: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("other"), F.col("source"))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, F.map_concat(meta, F.create_map(F.lit("summary"), F.lit("kept")))).otherwise(meta).alias("metadata"))
    return lifecycle.cached_summaries(docs, F.col("lang")).select("doc_id", "summary", F.col("metadata")["summary"].alias("cached"), F.col("metadata")["other"].alias("other"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def status_patch(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    changes = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(None).cast("long").alias("o_custkey"))
    return lifecycle.patch(o, changes, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return lifecycle.delete_keys(o, o.where("o_orderkey % 10 = 0"), ["o_orderkey"])


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 604800 THEN (s // 86400) || ' d ago' ELSE strftime(ts, '%Y-%m-%d') END AS said FROM (SELECT event_id, ts, floor(epoch(TIMESTAMP '2024-01-31 00:00:00'))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.relative_time(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("said"))


@query("SELECT conv_id, count(DISTINCT role) > 2 OR count_if(role = 'system') > 0 AS has_multimodal, count(DISTINCT role)::INT AS n_types FROM conversations GROUP BY 1")
def content_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "system", "image").otherwise(F.lit("text")).alias("type"), "role")
    n = items.groupBy("conv_id").agg(F.count_distinct("role").cast("int").alias("n_types"))
    return stats.content_types(items, "conv_id").join(n, "conv_id").select("conv_id", "has_multimodal", "n_types")


_SESSIONS = "sessions AS (SELECT conv_id AS session_id, conv_id % 20 AS user_id, CASE WHEN conv_id % 3 = 0 THEN 'kb' ELSE 'chat' END AS mode, conv_id % 4 < 2 AS is_active, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("updated_at"))
    return c.select("session_id", (F.col("session_id") % 20).alias("user_id"), F.when(F.col("session_id") % 3 == 0, "kb").otherwise("chat").alias("mode"), (F.col("session_id") % 4 < 2).alias("is_active"), "updated_at")


@query(f"WITH {_SESSIONS} SELECT user_id, mode, arg_max(session_id, (updated_at, session_id)) AS session_id FROM sessions WHERE is_active GROUP BY 1, 2")
def sessions_active(spark: SparkSession, d: str) -> DataFrame:
    return conversations.active_sessions(_sessions(spark, d))


@query(f"WITH {_SESSIONS} SELECT session_id, updated_at FROM sessions WHERE user_id = 3 ORDER BY updated_at DESC, session_id LIMIT 50")
def sessions_recent(spark: SparkSession, d: str) -> DataFrame:
    return conversations.recent_sessions(_sessions(spark, d), F.lit(3)).select("session_id", "updated_at")


@query("SELECT turn, role FROM conversations WHERE conv_id = 2 ORDER BY turn LIMIT 100")
def session_messages(spark: SparkSession, d: str) -> DataFrame:
    return conversations.first_messages(table(spark, d, "conversations"), F.lit(2), order="turn").select("turn", "role")


@query(f"WITH {_SESSIONS}, stay AS (SELECT session_id FROM sessions WHERE updated_at >= 2) SELECT count(*) AS messages FROM conversations WHERE conv_id IN (SELECT session_id FROM stay)")
def sessions_unexpired(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d).withColumn("expires_at", F.col("updated_at"))
    m = table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    return conversations.drop_expired(s, m, F.lit(2))[1].agg(F.count("*").alias("messages"))


@query(f"WITH {_SESSIONS} SELECT count(*) AS messages FROM (SELECT conv_id FROM conversations UNION ALL SELECT conv_id + 1 FROM conversations WHERE conv_id + 1 IN (SELECT session_id FROM sessions))")
def session_messages_saved(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"))
    new = m.select((F.col("session_id") + 1).alias("session_id"))
    return conversations.save_messages(m, new, _sessions(spark, d)).agg(F.count("*").alias("messages"))


_AGENT = "CASE event_type WHEN 'click' THEN 'iPhone Safari' WHEN 'view' THEN 'Chrome' WHEN 'signup' THEN 'iPad' ELSE 'curl' END"
_TOKENS = f"tokens AS (SELECT event_id AS token_id, user_id, {_AGENT} AS device_info, ts + INTERVAL 30 DAY AS expires_at, event_id % 5 = 0 AS is_revoked, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 DAY END AS revoked_at, ts AS created_at FROM events)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    kind, gone = F.col("event_type"), F.col("event_id") % 5 == 0
    agent = F.when(kind == "click", "iPhone Safari").when(kind == "view", "Chrome").when(kind == "signup", "iPad").otherwise("curl")
    days = lambda n: F.col("ts") + F.make_interval(days=F.lit(n))
    return table(spark, d, "events").select(F.col("event_id").alias("token_id"), "user_id", agent.alias("device_info"), days(30).alias("expires_at"), gone.alias("is_revoked"), F.when(gone, days(10)).alias("revoked_at"), F.col("ts").alias("created_at"))


@query(f"WITH {_TOKENS} SELECT token_id, user_id FROM tokens WHERE NOT is_revoked AND expires_at > TIMESTAMP '{_NOW}'")
def tokens_active(spark: SparkSession, d: str) -> DataFrame:
    return tokens.active(_tokens(spark, d), _at()).select("token_id", "user_id")


@query(f"WITH {_TOKENS} SELECT token_id FROM tokens WHERE NOT (expires_at < TIMESTAMP '{_NOW}' OR coalesce(is_revoked AND revoked_at < TIMESTAMP '{_NOW}' - INTERVAL 7 DAY, FALSE))")
def tokens_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return tokens.clean_up(_tokens(spark, d), _at()).select("token_id")


@query(
    f"""WITH {_TOKENS}, k AS (SELECT *, CASE device_info WHEN 'iPhone Safari' THEN 'iphone' WHEN 'Chrome' THEN 'web' WHEN 'iPad' THEN 'ipad' ELSE 'unknown' END AS device FROM tokens),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY created_at DESC, token_id DESC) AS rn FROM k WHERE token_id % 10 = 1) WHERE rn = 1 OR device = 'unknown'),
old AS (SELECT * FROM k WHERE token_id % 10 <> 1 AND NOT (NOT is_revoked AND device <> 'unknown' AND (user_id, device) IN (SELECT (user_id, device) FROM fresh)))
SELECT token_id, is_revoked FROM old UNION ALL SELECT token_id, is_revoked FROM fresh"""
)
def tokens_created(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return tokens.create(t.where("token_id % 10 <> 1"), t.where("token_id % 10 = 1")).select("token_id", "is_revoked")


@query(f"WITH {_TOKENS} SELECT token_id, is_revoked OR user_id = 5 AS is_revoked, CASE WHEN user_id = 5 AND NOT is_revoked THEN TIMESTAMP '{_NOW}' ELSE revoked_at END AS revoked_at FROM tokens")
def tokens_revoked(spark: SparkSession, d: str) -> DataFrame:
    return tokens.revoke(_tokens(spark, d), F.col("user_id") == 5, _at()).select("token_id", "is_revoked", "revoked_at")


@query("SELECT event_type, count(DISTINCT user_id) AS n_exact, true AS close FROM events GROUP BY 1")
def distinct_users_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of each type from sketches of its days, and whether they are within five percent of the exact number."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    near = stats.distinct_users(stats.user_sketches(e, "event_type", "day"), "event_type")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_exact"))
    return exact.join(near, "event_type").select("event_type", "n_exact", (F.abs(F.col("n_users") - F.col("n_exact")) <= 0.05 * F.col("n_exact")).alias("close"))


@query("WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS turn FROM orders UNION ALL SELECT o_orderkey, 'X', o_totalprice, 2 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) SELECT o_orderkey, arg_max(o_orderstatus, turn) AS o_orderstatus FROM t GROUP BY 1")
def upserted_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a table at rest, of which a second batch brings new ones and changes some."""
    o, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), stores.scratch_folder(spark, "upsert")
    stores.upsert_table(o.where("o_orderkey % 5 <> 0"), path, "o_orderkey", buckets=16)
    changed = o.where("o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.lit("X"))
    stores.upsert_table(changed.unionByName(o.where("o_orderkey % 5 = 0")), path, "o_orderkey", buckets=16)
    return spark.read.parquet(path).drop("bucket")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (5, 55, 555) AND lang = 'en'")
def stored_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Three documents by id, those of one owner, from a table stored for look-ups."""
    path = stores.scratch_folder(spark, "lookup")
    stores.write_lookup(lifecycle.light(table(spark, d, "documents"), "text"), path, "doc_id")
    return stores.lookup(spark, path, "doc_id", [5, 55, 555], lang="en").select("doc_id", "lang", "source", "n_chars")


@query(
    """WITH RECURSIVE c AS (SELECT (user_id % 20)::VARCHAR AS service, event_id AS call_id, epoch_us(ts) AS us, epoch_us(ts)::DOUBLE / 1e6 AS sec, event_type IN ('error', 'view') AS failed FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY us, call_id) AS k FROM c),
g AS (SELECT service, 0::BIGINT AS k, NULL::BIGINT AS call_id, NULL::DOUBLE AS sec, NULL::BOOLEAN AS admitted, 'closed' AS state, 0 AS failures, NULL::DOUBLE AS last FROM n WHERE k = 1
UNION ALL SELECT service, k, call_id, sec, ok, CASE WHEN ok AND (NOT failed OR f < 3) THEN 'closed' ELSE 'open' END, CASE WHEN NOT ok THEN failures WHEN NOT failed THEN 0 ELSE f END, CASE WHEN ok AND failed THEN sec ELSE last END
FROM (SELECT n.service, n.k, n.call_id, n.sec, n.failed, g.failures, g.last, g.state <> 'open' OR n.sec - g.last >= 7200 AS ok, CASE WHEN g.state = 'open' THEN 3 WHEN g.last IS NULL OR n.sec - g.last >= 7200 THEN 1 ELSE g.failures + 1 END AS f FROM g JOIN n ON n.service = g.service AND n.k = g.k + 1))
SELECT service, call_id, sec AS "at", admitted, state FROM g WHERE k > 0"""
)
def failure_gates(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of twenty services: which a gate lets through, and its state after each."""
    e = table(spark, d, "events")
    calls = e.select((F.col("user_id") % 20).cast("string").alias("service"), F.col("event_id").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6, F.col("event_type").isin("error", "view").alias("failed"))
    return gates.gate_table(calls.toDF("service", "call_id", "at", "failed"), 3, 7200.0)
