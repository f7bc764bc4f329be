"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tessera.llm import additive_quantizer, chat, content_chunks, decontaminate, hard_negatives, hmm, hyperminhash, licenses, line_dedup, merkle, secrets, toxicity, trie_bpe

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those dropped as ten documents or more hold them, and the digest of the rest."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, count_by="doc_id")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, in segments, with masks."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans and their digest, and all spans with those of high entropy."""
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return additive_quantizer.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses and notices that each document holds."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its score, and whether its label was left out of learning."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shingles and the component of its near copies at 85 %."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold, also with other numbers and names."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that other documents hold too."""
    return content_chunks.repeated_passages(table(spark, sf_dir, "documents"))


def vocabulary(path: str | None = None) -> str:
    """A vocabulary file's content; the public word vocabulary by default."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its tokens, the digest of their ids, and that of what they decode to."""
    return trie_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, proof and root, and whether the leaf, tampered with in one row of seven, still leads to the root."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector's five positives."""
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base score and the hidden Markov model's log10 probability of its text."""
    return hmm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_additive_quantization": op7_additive_quantization,
    "op8_licenses": op8_licenses,
    "op9_content_chunks": op9_content_chunks,
    "op10_trie_bpe": op10_trie_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_hidden_markov": op13_hidden_markov,
}

def _license_sql() -> str:
    """Containment of every template in every document, by shingles of all words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.TEMPLATES.items()))
    word = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
    grams = f"unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - {licenses.SHINGLE} + 1, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + {licenses.SHINGLE} - 1), ' ')) END)"
    return f"""WITH t(license, body) AS (VALUES {rows}),
tg AS (SELECT DISTINCT license, {grams} AS g FROM (SELECT license, regexp_extract_all(lower(body), '{word}') AS ws FROM t)),
n AS (SELECT license, count(*) AS n_shingles FROM tg GROUP BY 1),
dg AS (SELECT DISTINCT doc_id, {grams} AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS ws FROM documents)),
c AS (SELECT doc_id, license, count(*) AS n_shared FROM dg JOIN tg USING (g) GROUP BY 1, 2)
SELECT doc_id, license, n_shared, n_shingles, n_shared / n_shingles AS containment FROM c JOIN n USING (license)
WHERE n_shared / n_shingles >= CASE WHEN n_shingles < {licenses.SHORT} THEN 1.0 ELSE {licenses.CONTAINED} END"""


#: crc32 of a short ASCII text, as SQL: bit by bit over its characters.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: Node lists of a tree level by level, from nodes(g, level, nodes), and what a slot meets on its way up.
_LEVELS = "SELECT g, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {0} WHERE len(nodes) > 1"
_SIBLING = "CASE WHEN (slot >> level) % 2 = 1 THEN '<' || nodes[slot >> level] ELSE coalesce('>' || nodes[(slot >> level) + 2], '') END"

_MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, {_CRC.format("doc_id::VARCHAR")} % 7 = 0 AS hit FROM documents
), h AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS bad FROM d
), l AS (
  SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM h
), t(g, level, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY slot) FROM l GROUP BY g UNION ALL {_LEVELS.format("t")}
), s AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS slot FROM t WHERE len(nodes) = 1
), r(g, level, nodes) AS (
  SELECT '', 0, list(subroot ORDER BY slot) FROM s UNION ALL {_LEVELS.format("r")}
), up AS (
  SELECT s.g, coalesce(list({_SIBLING} ORDER BY level) FILTER (WHERE len(nodes) > 1), []) AS path FROM s, r GROUP BY s.g
), own AS (
  SELECT l.g, slot, coalesce(list({_SIBLING} ORDER BY level) FILTER (WHERE len(nodes) > 1), []) AS path FROM l JOIN t ON l.g = t.g GROUP BY l.g, slot
), f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM r WHERE len(nodes) = 1) AS root, list_concat(own.path, up.path) AS path, coalesce(bad, leaf) AS node
  FROM l JOIN s ON l.g = s.g JOIN up ON up.g = l.g JOIN own ON own.g = l.g AND own.slot = l.slot
), o AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(list_concat([node], path), lambda a, x: CASE WHEN x = '' THEN sha256(a) WHEN x[1] = '<' THEN sha256(substr(x, 2) || a) ELSE sha256(a || substr(x, 2)) END) AS folded_root FROM f
)
SELECT *, folded_root = root AS verified FROM o"""

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _MERKLE_SQL,
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
    "op8_licenses": _license_sql(),
    "op6_hyperminhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
    lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x AS doc, y AS other FROM e UNION SELECT r.doc, e.y FROM r JOIN e ON r.other = e.x
), m AS (
  SELECT doc, min(other) AS low FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc = d.doc_id""",
    "op2_line_dedup": """
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id""",
    "op3_chat_rotation": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), m AS (
  SELECT conv_id, perspective, turn // 64 AS segment, turn, role, text, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name="' || replace(role, chr(34), chr(39)) || '"|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM t JOIN p USING (conv_id)
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment
    ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start FROM m
)
SELECT conv_id, perspective, segment, 0::BIGINT AS bucket, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_masked,
  string_agg(head || body, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, segment""".replace("\\'", "'"),
}
