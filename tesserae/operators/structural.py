"""Similarity of what a question expects of a table and what the table is like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structure as sx
from ..functions import vectors as vx
from ..sources import store
from .embedding import Encoder, hash_encoder
from .index import BLOCK


def structure_vectors(structures: DataFrame, dimension: int, encoder: Encoder = hash_encoder) -> DataFrame:
    """(table_id, content_key, vector) from (table_id, structure)."""
    rows = structures.select("table_id", sx.structure_text(F.col("structure")).alias("text"))
    return rows.select("table_id", sx.cache_key(F.col("text")).alias("content_key"), encoder(F.col("text"), dimension).alias("vector"))


def cached_vectors(structures: DataFrame, root: str, dimension: int, encoder: Encoder = hash_encoder) -> DataFrame:
    """(table_id, content_key, vector), from the vectors kept under a folder by what they are of; what it lacks is made
    and added, so that a text is encoded once, however many tables say it and whenever they come."""
    spark, path = structures.sparkSession, f"{root}/structures-{dimension}"
    texts = structures.select("table_id", sx.structure_text(F.col("structure")).alias("text"))
    held = store.load(spark, root, f"structures-{dimension}", ["vectors"])
    known = held["vectors"] if held else spark.createDataFrame([], "content_key string, vector array<double>")
    lacking = store.missing_vectors(texts, known).dropDuplicates(["content_key"])
    made = lacking.select("content_key", encoder(F.col("text"), dimension).cast("array<double>").alias("vector"))
    store.kept(made).write.mode("append").parquet(f"{path}/vectors")
    known = spark.read.parquet(f"{path}/vectors")
    return texts.select(
        "table_id",
        F.md5(F.col("text").cast("binary")).alias("content_key"),
    ).join(known, "content_key").select("table_id", "content_key", "vector")


def table_of(chunk_id: str = "chunk_id") -> F.Column:
    """A chunk's table: named in its metadata, else what stands before the first `_` of its id."""
    return F.coalesce(F.try_element_at("metadata", F.lit("table_id")), F.substring_index(chunk_id, "_", 1))


def scores(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    dimension: int,
    encoder: Encoder = hash_encoder,
) -> DataFrame:
    """(query_id, chunk_id, value) in 0..1 for candidate pairs; 0 for a chunk whose table has no structure."""
    asked = queries.select("query_id", encoder(sx.query_structure(F.col("text")), dimension).alias("_q"))
    rows = candidates.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", table_of().alias("table_id")), "chunk_id")
    rows = rows.join(vectors.select("table_id", "vector"), "table_id", "left").join(asked, "query_id")
    return rows.select(
        "query_id",
        "chunk_id",
        F.coalesce(vx.unit_interval(vx.cosine(F.col("_q"), F.col("vector"))), F.lit(0.0)).alias("value"),
    )


def compare(query: DataFrame, candidates: DataFrame, dimension: int, encoder: Encoder = hash_encoder) -> DataFrame:
    """(query_id, candidate_id, value) of texts against few candidate texts: cosine in 0..1. A broadcast holds about
    BLOCK queries; more go block by block."""
    asked = query.select("query_id", encoder(F.col("text"), dimension).alias("_q"))
    held = candidates.select("candidate_id", encoder(F.col("text"), dimension).alias("_c"))
    blocks = max(1, -(-query.count() // BLOCK))
    marked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = held.crossJoin(F.broadcast(marked.where(F.col("_block") == b))).select(
            "query_id",
            "candidate_id",
            vx.unit_interval(vx.cosine(F.col("_q"), F.col("_c"))).alias("value"),
        )
        out = part if out is None else out.union(part)
    return out
