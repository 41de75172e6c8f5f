"""Scores of stages, metadata, structure and words as one weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Retrieval
from ..functions import text as tx
from . import filters

PRIORS = ("reliability", "recency_score", "domain_score")


def stage_sums(hits: DataFrame, retrieval: Retrieval) -> DataFrame:
    """(query_id, chunk_id, similarity): weighted sum over stages, a stage that lacks a chunk adds nothing."""
    weight = F.lit(0.0)
    for stage in retrieval.stages:
        weight = F.when(F.col("stage") == stage.name, stage.weight).otherwise(weight)
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(weight * F.col("score")).alias("similarity"))


def priors(metadata: Column) -> dict[str, Column]:
    """Numbers in metadata; 0 where there is none."""
    return {name: tx.number(F.try_element_at(metadata, F.lit(name))) for name in PRIORS}


def fused(retrieval: Retrieval) -> Column:
    """The weighted mean of similarity, reliability, recency_score, domain_score, structural and bm25."""
    r = retrieval
    parts = (
        ("similarity", r.lambda_similarity),
        ("reliability", r.alpha_reliability),
        ("recency_score", r.beta_temporal),
        ("domain_score", r.gamma_domain),
        ("structural", r.zeta_structural_similarity),
        ("bm25", r.epsilon_bm25),
    )
    total = sum((F.col(name) * weight for name, weight in parts if weight), F.lit(0.0))
    return total / r.total_weight


def fuse(
    hits: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    retrieval: Retrieval,
    *,
    bm25: DataFrame | None = None,
    structural: DataFrame | None = None,
) -> DataFrame:
    """Ranked chunks of each query with all their scores.

    bm25 and structural: (query_id, chunk_id, value); an absent one counts 0, or 0.5 for words, which is no match. Order:
    sum of stages, fused score, rank, soft metadata filter, limit of the last stage.
    """
    rows = stage_sums(hits, retrieval).join(chunks.select("chunk_id", "text", "metadata"), "chunk_id")
    rows = rows.withColumns(priors(F.col("metadata")))
    for name, given, absent in (("bm25", bm25, 0.5), ("structural", structural, 0.0)):
        rows = rows.withColumn(name, F.lit(absent)) if given is None else rows.join(
            given.select("query_id", "chunk_id", F.col("value").alias(name)),
            ["query_id", "chunk_id"],
            "left",
        ).fillna({name: absent})
    rows = rows.withColumn("combined", F.col("similarity")).withColumn("weighted", fused(retrieval))
    order = Window.partitionBy("query_id").orderBy(F.desc("weighted"), F.asc("chunk_id"))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("similarity", F.col("weighted"))
    asked = queries.select(
        "query_id",
        filters.query_filters(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("_filters"),
    )
    rows = rows.join(asked, "query_id").withColumn(
        "matched",
        filters.matches(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("_filters")),
    )
    kept = filters.soft(rows).drop("matched", "_filters")
    return filters.limited(kept, retrieval.stages[-1].top_k if retrieval.stages else None)


def score_map() -> Column:
    """All scores of a row as map<string,double>, for the edge of the API."""
    names = {
        "combined": "combined",
        "bm25": "bm25",
        "structural_similarity": "structural",
        "weighted": "weighted",
        **{p: p for p in PRIORS}
    }
    return F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))])
