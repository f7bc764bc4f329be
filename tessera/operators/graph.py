"""The entity graph: building, merging, bounded hops, document links, statistics, reconciling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.sizes import broadcast_small


def token_entities(docs: DataFrame, least_chars: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, entity_name)``: each document's distinct lower-cased words of ``least_chars`` letters or more.

    A substitute for extraction by a model. One scan, no shuffle.
    """
    return docs.select(doc_id, F.explode(_names(text, least_chars)).alias("entity_name"))


def token_lists(docs: DataFrame, least_chars: int = 5, doc_id: str = "doc_id", text: str = "text", user: str = "user_id") -> DataFrame:
    """``(user, doc_id, names)``: the same as an array a document, with its user."""
    return docs.select(user, doc_id, _names(text, least_chars).alias("names"))


def _names(text: str, least_chars: int) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= least_chars)
    return F.array_distinct(words)


def merge_entities(events: DataFrame, key: tuple[str, ...] = ("name", "user_id")) -> DataFrame:
    """One row a key from ``(name, user_id, type, description, chunk_id, seq)`` in order of seq.

    The first creator gives the type, the last non-empty description stays, provenance is the first non-null.
    """
    said = F.coalesce(F.col("description"), F.lit("")) != ""
    return events.groupBy(*key).agg(
        F.min_by("type", "seq").alias("type"),
        F.max_by("description", F.when(said, F.col("seq"))).alias("description"),
        F.min_by("chunk_id", F.when(F.col("chunk_id").isNotNull(), F.col("seq"))).alias("chunk_id"),
        F.count("*").alias("n_mentions"),
    )


def append_descriptions(events: DataFrame, key: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """One row a key: first provenance, and descriptions appended in order unless already contained.

    A description counts where it first comes, so that only a key's distinct ones are gathered, however often
    the key is mentioned.
    """
    said = events.groupBy(*key, F.coalesce("description", F.lit("")).alias("d")).agg(F.min("seq").alias("seq"), F.min_by("chunk_id", "seq").alias("chunk_id"))
    per = said.groupBy(*key).agg(F.min_by("chunk_id", "seq").alias("chunk_id"), F.array_sort(F.collect_list(F.struct("seq", "d"))).alias("x"))
    fold = F.aggregate("x", F.lit(""), lambda a, s: F.when(F.contains(a, s["d"]), a).otherwise(F.when(a == "", s["d"]).otherwise(F.concat_ws("; ", a, s["d"]))))
    return per.select(*key, "chunk_id", fold.alias("description"))


def merge_relations(events: DataFrame, key: tuple[str, ...] = ("source", "target", "label", "relation_type", "doc_id")) -> DataFrame:
    """One edge a key, with what its first event says."""
    w = W.partitionBy(*key).orderBy("seq")
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def missing_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(name)`` of edge ends that are no entities yet; they are created with an unknown type."""
    ends = relations.select(F.col("source").alias("name")).union(relations.select(F.col("target").alias("name"))).distinct()
    return ends.join(entities.select("name"), "name", "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(edge_id, src, dst)`` in both directions."""
    return edges.select("edge_id", "src", "dst").unionByName(edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def trails(edges: DataFrame, seeds: DataFrame, hops: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(seed, target, hops, path)``: undirected trails of 1 to ``hops`` edges from ``seeds(seed)``; no edge twice in one.

    An unrolled join a hop. Nodes may repeat, as in graph patterns. With ``carry`` also ``rels``: those columns
    of the path's edges, in order.
    """
    rel = F.struct(*carry) if carry else F.lit(None)
    both = edges.select("edge_id", "src", "dst", rel.alias("rel")).unionByName(edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), rel.alias("rel")))
    reach, out = seeds.select("seed", F.col("seed").alias("target")), None
    for k in range(1, hops + 1):
        step = reach.join(both, F.col("target") == F.col("src"))
        path, rels = F.array("edge_id"), F.array("rel")
        if k > 1:
            step = step.where(~F.array_contains("path", F.col("edge_id")))
            path, rels = F.array_append("path", F.col("edge_id")), F.array_append("rels", F.col("rel"))
        reach = step.select("seed", F.col("dst").alias("target"), path.alias("path"), rels.alias("rels"))
        part = reach.withColumn("hops", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("seed", "target", "hops", "path", *(["rels"] if carry else []))


def nearest_trails(edges: DataFrame, seeds: DataFrame, hops: int, limit: int, carry: tuple[str, ...]) -> DataFrame:
    """``(seed, target, hops, rels)``: the first ``limit`` distinct trails by hops, seed, target and rels, as ``trails`` has them.

    Hop by hop, and no further than the limit needs. A trail is told by its ends and what its edges say, so of edges
    that are alike no more than ``hops`` can matter, and of a node's other ends no more than the limit and the edges
    that a trail already has: tasks drop the rest before anything is shuffled, so that a hub costs a read of its edges.
    As long as there are fewer trails than the limit, their paths are few and start the next hop.
    """
    spark, rel = edges.sparkSession, F.struct(*carry)
    both = edges.select("edge_id", "src", "dst", rel.alias("rel")).unionByName(edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), rel.alias("rel")))
    kind = both.schema["rel"].dataType.simpleString()
    node, edge = both.schema["src"].dataType.simpleString(), both.schema["edge_id"].dataType.simpleString()
    schema = f"seed {node}, target {node}, path array<{edge}>, rels array<{kind}>"
    reach = seeds.select("seed", F.col("seed").alias("target"), F.expr(f"cast(array() as array<{edge}>)").alias("path"), F.expr(f"cast(array() as array<{kind}>)").alias("rels")).distinct()
    alike, near = W.partitionBy("src", "dst", "rel").orderBy("edge_id"), W.partitionBy("src").orderBy("dst", "rel")
    found: list[tuple] = []
    for k in range(1, hops + 1):
        step = both.join(reach.select(F.col("target").alias("src")).distinct(), "src", "left_semi")
        step = step.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= hops)
        step = step.withColumn("r", F.dense_rank().over(near)).where(F.col("r") <= limit + hops).drop("r")
        step = reach.join(step, F.col("target") == F.col("src")).where(~F.array_contains("path", F.col("edge_id")))
        grown = step.select("seed", F.col("dst").alias("target"), F.array_append("path", F.col("edge_id")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels"))
        left = limit - len(found)
        order = ["seed", "target", "rels"]
        first = grown.select(*order).distinct().orderBy(*order).limit(left).collect()  # the limit's rows at most
        found += [(r["seed"], r["target"], k, r["rels"]) for r in first]
        if len(first) == left or not first:
            break
        if k < hops:  # fewer trails than the limit, with ``hops`` edges at most where several are alike
            reach = spark.createDataFrame(grown.collect(), schema)
    return spark.createDataFrame(found, f"seed {node}, target {node}, hops int, rels array<{kind}>")


def typed_trails(relations: DataFrame, appears: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``(seed, target, hops, path, rels)``: trails of 1 to ``hops`` edges of either kind between entities, documents between them allowed.

    ``relations(edge_id, source, target, relation_type, description)`` link entities, ``appears(entity_name, doc_id)`` entities
    and documents. A trail begins at an entity of ``seeds(seed)`` and ends at an entity, whatever it passes through, and
    has no edge twice. path names its edges, rels has each edge's ``(relation_type, source, target, description)`` in the edge's
    own direction; an appearance has no type and an empty target.
    """
    name = lambda c: F.struct(F.lit("entity").alias("kind"), F.col(c).cast("string").alias("id"))
    document = F.struct(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    say = lambda kind, a, b, text: F.struct(kind.alias("relation_type"), a.cast("string").alias("source"), b.alias("target"), text.alias("description"))
    own = relations.select(
        F.concat(F.lit("r"), F.col("edge_id").cast("string")).alias("edge_id"), name("source").alias("src"), name("target").alias("dst"),
        say(F.coalesce("relation_type", F.lit("")), F.col("source"), F.col("target").cast("string"), F.coalesce("description", F.lit(""))).alias("say"),
    )
    held = appears.select("entity_name", "doc_id").distinct().select(
        F.concat_ws(" ", F.lit("a"), F.col("doc_id").cast("string"), F.col("entity_name").cast("string")).alias("edge_id"), name("entity_name").alias("src"), document.alias("dst"),
        say(F.lit(""), F.col("entity_name"), F.lit(""), F.lit("")).alias("say"),
    )
    start = seeds.select(name("seed").alias("seed"))
    all_trails = trails(own.unionByName(held), start, hops, ("say",))
    ends = all_trails.where("target.kind = 'entity'")
    return ends.select(F.col("seed.id").alias("seed"), F.col("target.id").alias("target"), "hops", "path", F.transform("rels", lambda x: x["say"]).alias("rels"))


def entity_neighbourhood(relations: DataFrame, appears: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Entities ``(seed, entity_name)`` that ``typed_trails`` reach, the seed among them where any is reached, and the distinct
    relations ``(seed, relation_type, source, target)`` on the way."""
    t = typed_trails(relations, appears, seeds, hops)
    names = t.select("seed", F.col("target").alias("entity_name")).unionByName(t.select("seed", F.col("seed").alias("entity_name"))).distinct()
    said = t.select("seed", F.explode("rels").alias("x")).select("seed", "x.relation_type", "x.source", "x.target").distinct()
    return names, said


def global_context(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 3, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities ``(name, kind, description, seq)`` and relations ``(source, kind, target, description, seq)`` around seeds.

    Distinct trails (by ends and what their edges say), the shortest first, ``limit`` of them; each gives its
    far end once, and each edge on it a relation from the seed to the far end.
    ``edges(edge_id, src, dst, kind, description)``, ``entities(name, kind, description)``, ``seeds(seed)``.
    """
    order = ["hops", "seed", "target", "rels"]
    top = nearest_trails(edges, seeds, hops, limit, ("kind", "description")).withColumn("n", F.row_number().over(W.orderBy(*order)).cast("long"))
    ends = top.groupBy(F.col("target").alias("name")).agg(F.min("n").alias("seq"))
    nodes = ends.join(entities, "name").select("name", "kind", F.coalesce("description", F.lit("")).alias("description"), "seq")
    said = top.select("seed", "target", "n", F.posexplode("rels").alias("k", "rel"))
    return nodes, said.select(F.col("seed").alias("source"), F.col("rel.kind").alias("kind"), "target", F.col("rel.description").alias("description"), (F.col("n") * hops + F.col("k")).alias("seq"))


def local_query(edges: DataFrame, entities: DataFrame, terms: DataFrame, per_term: int = 5) -> tuple[DataFrame, DataFrame]:
    """As ``global_context``, for one hop: entities whose name contains a term, and the relations of the terms themselves.

    ``terms(term, pos)`` is a query's short list and goes to every task. Relations come once, though several
    entities match.
    """
    t = F.broadcast(terms)
    hit = entities.join(t, F.contains(F.col("name"), F.col("term")))
    hit = hit.withColumn("rn", F.row_number().over(W.partitionBy("term").orderBy("name"))).where(F.col("rn") <= per_term)
    nodes = hit.select("name", "kind", F.coalesce("description", F.lit("")).alias("description"), (F.col("pos") * per_term + F.col("rn")).cast("long").alias("seq"))
    asked = hit.select("term", "pos").distinct()
    both = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "description", "edge_id").unionByName(edges.select(F.col("dst").alias("source"), F.col("src").alias("target"), "kind", "description", "edge_id"))
    rels = both.join(F.broadcast(asked), F.col("source") == F.col("term")).select("source", "kind", "target", "description", F.col("edge_id").alias("seq")).distinct()
    return nodes, rels


def related_chunks(appears: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """``(chunk_id, content, doc_id)``: distinct chunks in which entities ``names(name)`` appear, less those without text.

    The limit comes before empty ones go, as a result list is cut by the search itself.
    ``appears(entity_name, doc_id, chunk_id, snippet)``.
    """
    hit = appears.where(F.col("chunk_id").isNotNull()).join(broadcast_small(names), F.col("entity_name") == F.col("name"), "left_semi")
    top = hit.select("chunk_id", F.col("snippet").alias("content"), "doc_id").distinct().orderBy("doc_id", "chunk_id", "content").limit(limit)
    return top.where(F.coalesce("content", F.lit("")) != "")


def cross_document_relations(appears: DataFrame, anchor: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, shared)``: all documents that share entities with those of ``anchor(doc_id)``, and which."""
    mine = appears.join(anchor, doc_id, "left_semi").select("entity_name").distinct()
    other = appears.join(mine, "entity_name", "left_semi").join(anchor, doc_id, "left_anti")
    return other.groupBy(doc_id).agg(F.array_sort(F.collect_set("entity_name")).alias("shared"))


def full_graph(entities: DataFrame, edges: DataFrame, limit: int, created: str = "created_at", key: str = "name") -> tuple[DataFrame, DataFrame]:
    """The newest ``limit`` entities and the edges among them; the limit comes before the edges."""
    nodes = entities.orderBy(F.desc(created), key).limit(limit)
    ends = F.broadcast(nodes.select(F.col(key).alias("_end")))
    inside = edges.join(ends, F.col("src") == F.col("_end"), "left_semi").join(ends, F.col("dst") == F.col("_end"), "left_semi")
    return nodes, inside


def local_context(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, neighbour, edge_id)``: one hop, the seed first whatever the edge's direction."""
    return both_ways(edges).join(seeds, F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("neighbour"), "edge_id").distinct()


def search_entities(entities: DataFrame, keyword: str, limit: int, name: str = "name", *then: str) -> DataFrame:
    """Entities whose name contains the keyword, case-sensitively, by name, ties by the columns ``then``."""
    return entities.where(F.contains(F.col(name), F.lit(keyword))).orderBy(name, *then).limit(limit)


def shared_entity_documents(appears: DataFrame, anchor: DataFrame, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, shared_count, shared)``: documents that share entities with those of ``anchor(doc_id)``, most first."""
    each = cross_document_relations(appears, anchor, doc_id)
    return each.select(doc_id, F.size("shared").cast("long").alias("shared_count"), F.array_join("shared", ",").alias("shared")).orderBy(F.desc("shared_count"), doc_id).limit(limit)


def document_graph(appears: DataFrame, newest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(id1, id2, weight)``: pairs of the documents ``newest(doc_id)``, id1 < id2, and how many entities they share.

    The documents to draw are chosen before any pair is made, so that an entity has no more than those.
    """
    a = appears.join(F.broadcast(newest), doc_id, "left_semi").select("entity_name", F.col(doc_id).alias("id1")).distinct()
    return a.join(a.withColumnRenamed("id1", "id2"), "entity_name").where("id1 < id2").groupBy("id1", "id2").agg(F.count("*").alias("weight"))


def document_links(appears: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_entities, n_links)`` for every document: how many entities it has, and how many appearances of
    those in other documents. Sums of entities' numbers, so no pair is made."""
    a = appears.select("entity_name", doc_id).distinct()
    held = a.groupBy("entity_name").agg((F.count("*") - 1).alias("others"))
    return a.join(held, "entity_name").groupBy(doc_id).agg(F.count("*").alias("n_entities"), F.sum("others").alias("n_links"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(node)``, without loops."""
    semi = edges.where("src <> dst").join(nodes, F.col("src") == F.col("node"), "left_semi")
    return semi.join(nodes, F.col("dst") == F.col("node"), "left_semi")


def statistics(entities: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """``(entities, relations, documents)``: one row of counts."""
    tag = lambda df, k: df.select(F.lit(k).alias("k"))
    both = tag(entities, "e").unionByName(tag(relations, "r")).unionByName(tag(documents, "d"))
    return both.agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("e", "entities"), ("r", "relations"), ("d", "documents"))])


def orphans(entities: DataFrame, appears: DataFrame, on: str = "entity_name") -> DataFrame:
    """Entities that appear in no document."""
    return entities.join(appears.select(on).distinct(), on, "left_anti")


def reconcile(graph_docs: DataFrame, live_docs: DataFrame, entities: DataFrame, appears: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph documents not live, the appearances that stay, and the entities left without any."""
    gone = graph_docs.join(live_docs, doc_id, "left_anti")
    stay = appears.join(gone, doc_id, "left_anti")
    return gone, stay, orphans(entities, stay)


def delete_statistics(docs: DataFrame, appears: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_count, rel_count)``: documents to be deleted and the appearances that go with them."""
    gone = docs.join(ids, doc_id, "left_semi").select(doc_id).distinct()
    both = gone.join(appears.select(doc_id, F.lit(1).alias("r")), doc_id, "left")
    return both.agg(F.count_distinct(doc_id).alias("doc_count"), F.count("r").alias("rel_count"))


def delete_documents(docs: DataFrame, appears: DataFrame, entities: DataFrame, ids: DataFrame, doc_id: str = "doc_id", on: str = "entity_name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, appearances and entities that stay when ``ids(doc_id)`` go with what belonged to them alone.

    Entities without any appearance left go, all of them.
    """
    stay = appears.join(ids, doc_id, "left_anti")
    return docs.join(ids, doc_id, "left_anti"), stay, entities.join(stay.select(on).distinct(), on, "left_semi")


def merge_document_nodes(nodes: DataFrame, new: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Document nodes ``(doc_id, title)`` with new ones; a title given again overwrites."""
    both = nodes.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(doc_id).agg(F.max_by("title", "_new").alias("title"))


def with_ids(entities: DataFrame, entity_id: str = "entity_id", key: tuple[str, ...] = ("user_id", "name")) -> DataFrame:
    """Entities with ids where there were none: digests of their keys, the same whenever they are made."""
    return entities.withColumn(entity_id, F.coalesce(F.col(entity_id), F.md5(F.concat_ws(",", *key))))


def id_counts(entities: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """``(with_id, without_id)``."""
    return entities.agg(F.count(entity_id).alias("with_id"), F.count_if(F.col(entity_id).isNull()).alias("without_id"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that should be unique and are not, with their numbers."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def appearance_counts(appears: DataFrame, user: str = "user_id", doc_id: str = "doc_id") -> DataFrame:
    """``(user_id, doc_id, n_entities, n_appearances)`` by document, by user (doc_id null) and in all (both null).

    One pass: grouping sets share what tasks have summed up.
    """
    n = appears.groupBy(user, doc_id, "entity_name").agg(F.count("*").alias("n"))
    sets = n.groupingSets([[user, doc_id], [user], []], user, doc_id)
    return sets.agg(F.count_distinct("entity_name").alias("n_entities"), F.sum("n").alias("n_appearances"))


def listed_counts(lists: DataFrame, user: str = "user_id", doc_id: str = "doc_id", names: str = "names") -> DataFrame:
    """``appearance_counts`` of rows ``(user, doc_id, names)``, an array of names each, none of them null.

    A document in one row is counted where it is; only those of several rows are put together. What users have in common is summed
    up by name, so that what is held and sent grows with the vocabulary and not with the appearances.
    """
    rows = lists.select(F.col(user).alias("u"), F.col(doc_id).alias("d"), F.array_distinct(names).alias("names"), F.size(names).alias("n")).where("n > 0")
    several = broadcast_small(rows.groupBy("u", "d").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("u").alias("_u"), F.col("d").alias("_d")))
    same = F.col("u").eqNullSafe(F.col("_u")) & F.col("d").eqNullSafe(F.col("_d"))
    none = lambda c: F.lit(None).cast(lists.schema[c].dataType)
    out = lambda u, d, names, n: [u.alias(user), d.alias(doc_id), names.cast("long").alias("n_entities"), n.cast("long").alias("n_appearances")]
    alone = rows.join(several, same, "left_anti").select(*out(F.col("u"), F.col("d"), F.size("names"), F.col("n")))
    sets = rows.join(several, same, "left_semi").groupBy("u", "d").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.sum("n").alias("n"))
    sets = sets.select(*out(F.col("u"), F.col("d"), F.size("names"), F.col("n")))
    by_name = lists.select(F.col(user).alias("u"), F.explode(names).alias("name")).groupBy("u", "name").agg(F.count("*").alias("n"))
    by_user = by_name.groupBy("u").agg(F.count("*").alias("k"), F.sum("n").alias("n")).select(*out(F.col("u"), none(doc_id), F.col("k"), F.col("n")))
    total = by_name.groupBy("name").agg(F.sum("n").alias("n")).agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return alone.unionByName(sets).unionByName(by_user).unionByName(total.select(*out(none(user), none(doc_id), F.col("k"), F.col("n"))))
