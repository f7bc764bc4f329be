"""End-to-end search: tenant and threshold, live documents, tags, graph context by mode, fusion into one context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import fusion, graph, retrieval
from tessera.sources.stores import scratch_folder

MODES = ("vector", "local", "global", "hybrid", "mix")


@dataclass
class Graph:
    """``entities(name, kind, description)`` and ``edges(edge_id, src, dst, kind, description)`` of one tenant."""

    entities: DataFrame
    edges: DataFrame

    def near(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        return graph.local_query(self.edges, self.entities, terms)

    def far(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        return graph.global_context(self.edges, self.entities, terms.select(F.col("term").alias("seed")))


class KeptGraph(Graph):
    """A graph that looks around one list of terms once in either way, and keeps what it found in a scratch folder."""

    def __init__(self, known: Graph, terms: DataFrame):
        super().__init__(known.entities, known.edges)
        self._near, self._far = ((kept(nodes), kept(rels)) for nodes, rels in (known.near(terms), known.far(terms)))

    def near(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self._near

    def far(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self._far


def kept(rows: DataFrame) -> DataFrame:
    """Rows written to a scratch folder, for what reads them several times."""
    path = scratch_folder(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def search_documents(vectors: DataFrame, query: DataFrame, docs: DataFrame, user: Column, limit: int, threshold: float | None = retrieval.DENSE_THRESHOLD, tags: list[str] | None = None, most: int = 50, id_col: str = "doc_id") -> DataFrame:
    """``(id, score, rank)``: a tenant's live documents nearest to a query.

    ``vectors(id, user_id, embedding)``, ``docs(id, status, deleted_at, tags)``. The tenant is chosen before
    the similarities; what is deleted, and tags, of which any will do, are left out after the limit, as the
    search itself doesn't know them, so that fewer than ``limit`` may come back.
    """
    found = retrieval.knn(vectors, query, min(limit, most), threshold, F.col("user_id") == user, id_col)
    live = docs.where((F.col("status") != "deleted") & F.col("deleted_at").isNull())
    if tags:
        live = live.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    # a few results go to every task, documents are not shuffled for them
    found = F.broadcast(retrieval.ranked(found, id_col))
    return retrieval.ranked(live.select(id_col).join(found, id_col).dropDuplicates(["rank"]).drop("rank"), id_col)


def graph_context(mode: str, known: Graph, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations for ``terms(term, pos)``: around the terms (local), along trails (global), or both."""
    near = known.near(terms) if mode != "global" else None
    far = known.far(terms) if mode != "local" else None
    if near is None or far is None:
        return near or far
    after = lambda df: df.withColumn("seq", F.col("seq") + F.lit(1 << 32))  # noqa: E731  (local ones come first)
    return near[0].unionByName(after(far[0])), near[1].unionByName(after(far[1]))


def candidates(mode: str, vector: DataFrame, known: Graph | None, terms: DataFrame) -> DataFrame:
    """Context candidates by mode. Without a graph, without terms, or in a mode not known, the vector results alone.

    ``vector(chunk_id, content, score, seq)``. The two graph modes leave the vector results out.
    """
    if mode not in MODES or mode == "vector" or known is None or terms.isEmpty():
        return fusion.candidates(vector, None, None, None)
    entities, relations = graph_context(mode, known, terms)
    return fusion.candidates(vector if mode in ("hybrid", "mix") else None, entities, relations, None)


def context(mode: str, vector: DataFrame, known: Graph | None, terms: DataFrame, tokens: int = 4000) -> DataFrame:
    """``(context)``: candidates once each, heaviest first, packed into the budget."""
    best = fusion.keep_best(candidates(mode, vector, known, terms))
    return fusion.packed_text(fusion.pack(best, tokens))


def contexts(modes: tuple[str, ...], vector: DataFrame, known: Graph, terms: DataFrame, tokens: int = 4000) -> DataFrame:
    """``(mode, context)`` of each mode; vector results and what the graph gives are found once for all of them."""
    vector, known, out = kept(vector), KeptGraph(known, terms), None
    for mode in modes:
        one = context(mode, vector, known, terms, tokens).select(F.lit(mode).alias("mode"), "context")
        out = one if out is None else out.unionByName(one)
    return out
