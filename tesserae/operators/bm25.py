"""BM25 over postings: terms of queries meet terms of documents by an equi-join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.store import kept
from .index import ranked

#: Terms that may be broadcast, after counting them.
BROADCAST_ROWS = 100_000
K1, B, EPSILON = 1.2, 0.75, 0.25


@dataclass(frozen=True)
class Statistics:
    """What a corpus fixes: postings (item_id, term, tf, length), document frequencies and two numbers."""

    postings: DataFrame
    frequencies: DataFrame
    n: int
    mean_length: float


def tokens(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(item_id, term): one row for each ranking token of rows that aren't blank; made by one expression, filtered as rows."""
    parts = rows.select(F.col(id_col).alias("item_id"), F.explode(tx.rank_parts(F.col(text_col))).alias("term"))
    return parts.where(tx.is_rank_token(F.col("term")))


def document_frequencies(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(term, df) alone: nothing is kept."""
    return tokens(rows, id_col, text_col).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def documents(rows: DataFrame, text_col: str = "text") -> int:
    """Documents that count: those that aren't blank."""
    return rows.where(~tx.blank(F.col(text_col))).count()


def fit(rows: DataFrame, id_col: str, text_col: str = "text", terms: DataFrame | None = None) -> Statistics:
    """Statistics of a corpus whose ids are unique, from one pass that counts its tokens and keeps the counts.

    terms: (term) to keep postings of, where it is known what will be asked; all other tokens of a document are counted
    together, for its length.
    """
    found = tokens(rows, id_col, text_col)
    if terms is not None:
        wanted = terms.select("term").distinct().withColumn("_wanted", F.lit(True))
        found = beside(found, wanted, "term").select("item_id", F.when(F.col("_wanted"), F.col("term")).alias("term"))
    counted = found.groupBy("item_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    whole = F.sum("tf").over(Window.partitionBy("item_id")).cast("int")
    postings = kept(counted.withColumn("length", whole))
    n, total = documents(rows, text_col), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    postings = postings.where(F.col("term").isNotNull())
    return Statistics(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, total / n if n else 0.0)


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with what right says of its key, if anything: by broadcast if right has few rows, as counted, else by a shuffle."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, key, "left")


def idf(n: int):
    """max(0.1, ln((n - df + 0.5) / (df + 0.5))), from below by 1.1 in the logarithm."""
    return F.greatest(F.lit(0.1), F.log(F.greatest(F.lit(1.1), (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))))


def scores(
    queries: DataFrame,
    known: Statistics,
    *,
    query_col: str = "query_id",
    text_col: str = "text",
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """(query_id, item_id, score) of documents that share a term with a query.

    candidates: (query_id, item_id) pairs to score; without it every document is. A term that the fitted corpus lacks
    adds epsilon * ln(n + 1) for each time it is asked. Query terms narrow the postings before anything is summed.
    """
    asked = tokens(queries, query_col, text_col).groupBy(F.col("item_id").alias("query_id"), "term").agg(F.count(F.lit(1)).alias("qtf"))
    hits = known.postings.join(asked, "term")
    if candidates is not None:
        hits = hits.join(candidates.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi")
    weights = known.frequencies.join(asked.select("term").distinct(), "term", "left_semi").withColumn("idf", idf(known.n))
    hits = hits.join(weights, "term", "left")
    tf, qtf = F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("length") / max(known.mean_length, 1e-9))
    ), F.col("qtf") * (k1 + 1) / (F.col("qtf") + k1)
    gain = F.when(F.col("df").isNull(), epsilon * math.log(known.n + 1) * F.col("qtf")).otherwise(F.col("idf") * tf * qtf)
    return hits.groupBy("query_id", "item_id").agg(F.sum(gain).alias("score"))


def normalized(score, mean_length: float):
    """Into 0..1 by a sigmoid whose slope follows the documents' length; 0.5 for no match."""
    return 1.0 / (1.0 + F.exp(-F.coalesce(score, F.lit(0.0)) / (5.0 + math.log(mean_length + 1))))


def top_k(queries: DataFrame, known: Statistics, k: int, *, precision: int = 9, **options) -> DataFrame:
    found = scores(queries, known, **options).withColumn("score", F.round("score", precision))
    return ranked(found, ["query_id"], "item_id", k)
