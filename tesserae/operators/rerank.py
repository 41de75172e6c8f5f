"""Rerankers over each query's ranked chunks: a scorer of pairs, and the graph of chunks that share words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: Makes a model on a worker, once; the model gives a score for each (question, text) of a batch.
ScorerMaker = Callable[[], Callable[[list[tuple[str, str]]], list[float]]]


def _ranked(rows: DataFrame, score: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("rank"), F.asc("chunk_id"))
    return rows.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def overlap_score(question: Column, text: Column) -> Column:
    """Share of a question's words that a text has: a deterministic stand-in for a model."""
    asked = F.array_distinct(tx.rank_tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tx.rank_tokens(text))) / F.size(asked)).otherwise(0.0)


def pair_scorer(make: ScorerMaker, batch: int = 32) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in parts:
            pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], index=a.index)

    return lambda question, text: score(question, text)


def pairs(ranked: DataFrame, top_n: int | None = 10, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """ranked: (query_id, question, chunk_id, text, rank, similarity). The scorer's score replaces similarity and rank;
    the best top_n stay, all if it isn't positive. Without a scorer nothing changes."""
    if scorer is None:
        return ranked
    rows = _ranked(ranked.withColumn("similarity", scorer(F.col("question"), F.col("text"))), "similarity")
    return rows.where(F.col("rank") <= top_n) if top_n and top_n > 0 else rows


def graph(ranked: DataFrame, threshold: float = 0.1, boost: float = 0.05) -> DataFrame:
    """ranked: (query_id, chunk_id, text, rank, similarity). Chunks of a query whose word sets reach a Jaccard of
    `threshold` are neighbours; similarity grows by boost for each, and ranks follow it. Adds degree.

    A query's candidates, which stage limits bound, stand in one row while their word sets are compared.
    """
    own = ranked.select("query_id", F.struct("chunk_id", "rank", F.array_distinct(tx.words(F.lower("text"))).alias("w")).alias("x"))
    held = own.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("all"))

    def near(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a["w"], b["w"]))
        either = F.size(a["w"]) + F.size(b["w"]) - both
        return (a["rank"] != b["rank"]) & (either > 0) & (both / F.greatest(either, F.lit(1)) >= threshold)

    degrees = F.transform(
        "all",
        lambda a: F.struct(a["chunk_id"].alias("chunk_id"), F.size(F.filter("all", lambda b: near(a, b))).alias("degree")),
    )
    each = held.select("query_id", F.explode(degrees).alias("d")).select("query_id", "d.chunk_id", "d.degree").groupBy("query_id", "chunk_id").agg(
        F.sum("degree").cast("int").alias("degree")
    )
    rows = ranked.join(each, ["query_id", "chunk_id"]).withColumn("similarity", F.col("similarity") + boost * F.col("degree"))
    return _ranked(rows, "similarity")
