"""Ranking metrics for all queries, stages and cut-offs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_documents(ranked: DataFrame, keys: list[str], doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Each document once, at the place of its first chunk; places count documents."""
    first = ranked.groupBy(*keys, doc).agg(F.min(rank).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first", doc)
    return first.withColumn("rank", F.row_number().over(order)).drop("_first")


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("relevance > 0")


def metrics(ranked: DataFrame, qrels: DataFrame, ks: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, query_id, k, precision, recall, ndcg, mrr) for queries with something relevant.

    ranked: (keys, query_id, doc_id, rank), documents once each. Precision divides by k even if fewer are there. The
    ideal order of ndcg is that of what was retrieved; ndcg_full takes it from all judgements.
    """
    by = [*keys, "query_id"]
    good = relevant(qrels)
    wanted = good.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("wanted"),
        F.sort_array(F.collect_list("relevance"), asc=False).alias("all"),
    )
    rows = ranked.join(good, ["query_id", "doc_id"], "left").withColumn("gain", F.coalesce("relevance", F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gain"), F.asc("rank")))
    rows = rows.withColumn("ideal", best)
    at = lambda name, k: F.sum(F.when(F.col(name) <= k, F.col("gain") / F.log2(F.col(name) + 1.0)).otherwise(0.0))
    found = [F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first")]
    for k in ks:
        found += [
            F.count_if((F.col("rank") <= k) & (F.col("gain") > 0)).alias(f"hits{k}"),
            at("rank", k).alias(f"dcg{k}"),
            at("ideal", k).alias(f"idcg{k}")
        ]
    per = rows.groupBy(*by).agg(*found).join(wanted, "query_id")
    full = lambda k: F.aggregate(F.transform(F.slice("all", 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col(f"hits{k}") / max(k, 1)).alias("precision"),
                (F.col(f"hits{k}") / F.greatest("wanted", F.lit(1))).alias("recall"),
                ratio(F.col(f"dcg{k}"), F.col(f"idcg{k}")).alias("ndcg"),
                ratio(F.col(f"dcg{k}"), full(k)).alias("ndcg_full"),
            ) for k in ks
        ]
    )
    return per.select(*by, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.explode(each).alias("m")).select(*by, "m.*", "mrr")


def averages(per_query: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over evaluated queries, for each cut-off."""
    names = [c for c in ("precision", "recall", "ndcg", "ndcg_full", "mrr") if c in per_query.columns]
    return per_query.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def first_queries(queries: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n queries by a column, before anything is known about their judgements."""
    return queries if n is None else queries.sort(order).limit(n)
