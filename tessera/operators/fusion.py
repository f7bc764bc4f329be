"""Context fusion: candidates of several sources, keep-best dedup, packing into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import cut_at_sentence, fingerprint

# Weights of the source types, their labels in a packed context, characters a token.
WEIGHTS = {"direct_entity_match": 3.0, "vector_rerank_top": 2.0, "relation_description": 1.5, "graph_expansion": 1.0}
LABELS = {"direct_entity_match": "图谱-实体", "vector_rerank_top": "向量", "relation_description": "图谱-关系", "graph_expansion": "图谱-扩展"}
CHARS_PER_TOKEN = 2.5


def vector_weight(score: Column) -> Column:
    return F.lit(2.0) * (F.lit(0.5) + F.lit(0.5) * score)


def entity_text(name: Column, kind: Column, description: Column) -> Column:
    head = F.concat(F.lit("[实体] "), name, F.lit(" ("), kind, F.lit(")"))
    return F.when(F.coalesce(description, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(": "), description))


def relation_text(source: Column, kind: Column, target: Column, description: Column) -> Column:
    head = F.concat(F.lit("[关系] "), source, F.lit(" ←"), kind, F.lit("→ "), target)
    return F.when(F.coalesce(description, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(": "), description))


def candidates(vector: DataFrame | None, entities: DataFrame | None, relations: DataFrame | None, expansion: DataFrame | None) -> DataFrame:
    """``(source_type, seq, chunk_id, content, weight)`` from results of each kind; what is None is left out.

    vector(chunk_id, content, score, seq), entities(name, kind, description, seq),
    relations(source, kind, target, description, seq), expansion(chunk_id, content, seq).
    """
    parts, none = [], F.lit(None).cast("string")
    make = lambda df, kind, chunk, content, weight: df.select(F.lit(kind).alias("source_type"), "seq", chunk.cast("string").alias("chunk_id"), content.alias("content"), weight.alias("weight"))
    if entities is not None:
        parts.append(make(entities, "direct_entity_match", none, entity_text(F.col("name"), F.col("kind"), F.col("description")), F.lit(3.0)))
    if vector is not None:
        parts.append(make(vector, "vector_rerank_top", F.col("chunk_id"), F.col("content"), vector_weight(F.col("score"))))
    if relations is not None:
        parts.append(make(relations, "relation_description", none, relation_text(F.col("source"), F.col("kind"), F.col("target"), F.col("description")), F.lit(1.5)))
    if expansion is not None:
        parts.append(make(expansion, "graph_expansion", F.col("chunk_id"), F.col("content"), F.lit(1.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_best(rows: DataFrame, chunk_id: str = "chunk_id", content: str = "content", weight: str = "weight", seq: str = "seq") -> DataFrame:
    """One row a chunk (a fingerprint where no chunk id is known): the heaviest, the first of equals, at the first's place."""
    key = F.coalesce(F.col(chunk_id).cast("string"), fingerprint(F.col(content)))
    k = rows.withColumn("_key", key)
    w = W.partitionBy("_key").orderBy(F.desc(weight), seq)
    best = k.withColumns({"_rn": F.row_number().over(w), "place": F.min(seq).over(W.partitionBy("_key"))})
    return best.where("_rn = 1").drop("_rn", "_key")


def pack(rows: DataFrame, tokens: int, weight: str = "weight", seq: str = "seq") -> DataFrame:
    """``(pos, part)``: parts by weight while they fit the budget; the first that doesn't is cut at a sentence end.

    ``rows`` are the candidates of one query, a bounded list.
    """
    budget = int(tokens * CHARS_PER_TOKEN)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("source_type")), F.col("source_type"))
    tail = F.concat(F.lit(" [来源:"), label, F.lit("]\n"))
    order = W.orderBy(F.desc(weight), seq)
    p = rows.withColumns({"tail": tail, "pos": F.row_number().over(order)})
    p = p.withColumn("size", F.length("content") + F.length("tail"))
    p = p.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("fits", F.col("before") + F.col("size") <= budget)
    p = p.where(F.col("before") <= budget).withColumn("short", F.when(F.col("fits"), F.col("content")).otherwise(cut_at_sentence(F.col("content"), (F.lit(budget) - F.col("before")).cast("int"))))
    first_over = F.min(F.when(~F.col("fits"), F.col("pos"))).over(W.partitionBy())
    p = p.withColumn("stop", first_over).where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop")))
    return p.where(F.col("fits") | (F.col("short") != "")).select(F.col("pos").cast("int").alias("pos"), F.concat("short", "tail").alias("part"))


def packed_text(parts: DataFrame) -> DataFrame:
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("context"))


def prompt_context(results: DataFrame) -> DataFrame:
    """``(context)``: numbered blocks of a short result list ``(rank, title, content, score)``."""
    block = F.format_string("[来源%d] 标题: %s\n内容: %s\n得分: %.4f", F.col("rank"), F.col("title"), F.col("content"), F.col("score"))
    return results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def source_list(results: DataFrame, limit: int = 10, chars: int = 500) -> DataFrame:
    """What a stream names as its sources: the first results, their contents cut."""
    return results.orderBy("rank").limit(limit).withColumn("content", F.left("content", F.lit(chars)))
