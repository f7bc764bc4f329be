"""Plug-in models as pandas UDFs: embedders, sparse embedders and rerankers, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import strip

Load = Callable[[], Callable[[pd.Series], pd.Series]]


def _model(load: Load, returns: str) -> Callable[[Column], Column]:
    @pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return run


def dense_embedder(load: Load) -> Callable[[Column], Column]:
    """Texts to arrays of floats. ``load`` is called in the worker and gives a function from texts to vectors."""
    return _model(load, "array<float>")


def sparse_embedder(load: Load) -> Callable[[Column], Column]:
    """Texts to maps from term number to weight."""
    return _model(load, "map<int,float>")


def reranker(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]], query: Column) -> Callable[[Column], Column]:
    """Contents to scores for a query."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, contents in batches:
            yield model(queries, contents)

    return lambda content: run(query, content)


def embed_texts(rows: DataFrame, model: Callable[[Column], Column], text: str, out: str = "vector") -> DataFrame:
    """Rows with their vectors, less those whose text is blank; vectors stay with their rows, whatever is dropped."""
    return rows.where(strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn(out, model(strip(F.col(text))))


def collection_statistics(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(points, vectors, dim, mixed)``: rows, rows with a vector, its largest length, and whether lengths differ."""
    n = F.size(F.col(vector))
    has = F.col(vector).isNotNull()
    return rows.agg(F.count("*").alias("points"), F.count_if(has).alias("vectors"), F.max(F.when(has, n)).alias("dim"), (F.max(F.when(has, n)) != F.min(F.when(has, n))).alias("mixed"))
