"""Retrieval test collections: corpus, queries and relevance judgements as files and as frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import store
from .ingest import JSON_MAP, numbered


@dataclass(frozen=True)
class Split:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def _lines(spark: SparkSession, path: str, kind: str, every: bool) -> DataFrame:
    """(f, _place): lines as JSON, with their places where these are asked for."""
    rows = spark.read.text(path)
    return (rows if every else numbered(rows, "_place")).select(F.from_json("value", kind).alias("f"), *[] if every else ["_place"])


def _last_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows that share a key the last in file order."""
    latest = Window.partitionBy(key).orderBy(F.desc("_place"))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_place")


def corpus(spark: SparkSession, path: str, *, every: bool = False) -> DataFrame:
    """Title and text are joined; other keys are metadata. Of lines that share an _id the last counts, or every one."""
    text = tx.stripped(F.concat(F.coalesce(F.col("f")["title"], F.lit("")), F.lit("\n"), F.coalesce(F.col("f")["text"], F.lit(""))))
    rest = F.map_filter("f", lambda k, v: ~k.isin("_id", "title", "text"))
    rows = _lines(spark, path, JSON_MAP, every).withColumns({"doc_id": F.col("f")["_id"], "text": text, "metadata": rest}).drop("f")
    rows = rows if every else _last_of_each(rows, "doc_id")
    return rows.select("doc_id", "text", "metadata")


def queries(spark: SparkSession, path: str, *, every: bool = False) -> DataFrame:
    """The same for queries."""
    rows = _lines(spark, path, "_id string, text string", every).withColumns({"query_id": F.col("f._id"), "text": F.col("f.text")}).drop("f")
    rows = rows if every else _last_of_each(rows, "query_id")
    return rows.select("query_id", "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Four fields a line: query, anything, document, relevance; another number of fields raises."""
    parts = F.split(tx.stripped(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.col("value") != "").select(
        F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("value")))).alias("p")
    )
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("double").alias("relevance"))


def split(spark: SparkSession, root: str, name: str = "test", *, every: bool = False) -> Split:
    """every: lines that share an _id are all kept, as `write` wrote them; else the last stands for them."""
    return Split(
        corpus(spark, f"{root}/corpus.jsonl", every=every),
        queries(spark, f"{root}/queries.jsonl", every=every),
        qrels(spark, f"{root}/qrels/{name}.tsv"),
    )


def corpus_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as corpus rows: the chunk type is the title."""
    return chunks.select(F.col("id").alias("_id"), F.col("chunk_type").alias("title"), F.col("content").alias("text"), "table_id")


def query_rows(tables: DataFrame) -> DataFrame:
    return tables.select(F.col("table_id").alias("_id"), F.col("question").alias("text"))


def qrel_rows(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk of a table answers the table's question."""
    joined = tables.select("table_id").distinct().join(chunks.select("table_id", "id"), "table_id")
    return joined.select(F.col("table_id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("relevance"))


def _keys(data: Split, types: list[str] | None) -> list[tuple[str, DataFrame, DataFrame]]:
    """(part, all, kept) with keys alone, as `restricted` keeps them; a query's id counts once. Each frame is made once and
    read as files."""
    chunks = store.kept(data.corpus.select("_id", "title", "table_id"))
    queries = store.kept(data.queries.select("_id").distinct())
    qrels = store.kept(data.qrels.select("query_id", "doc_id"))
    kept = chunks.where(F.col("title").isin(*types)) if types else chunks
    asked = store.kept(queries.join(kept.select(F.col("table_id").alias("_id")), "_id", "left_semi"))
    found = store.kept(kept.join(asked.select(F.col("_id").alias("table_id")), "table_id", "left_semi").select("_id"))
    judged = qrels.join(asked.select(F.col("_id").alias("query_id")), "query_id", "left_semi")
    judged = judged.join(found.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi")
    return [("corpus", chunks, found), ("queries", queries, asked), ("qrels", qrels, judged)]


def restricted(data: Split, types: list[str] | None = None) -> tuple[Split, DataFrame]:
    """What belongs together after chunks of some types were chosen, and how much of it was kept.

    data.corpus has table_id, and title with the chunk type. Queries need a chunk of their table, judgements a query
    and a chunk, chunks a query.
    """
    kept = data.corpus.where(F.col("title").isin(*types)) if types else data.corpus
    asked = data.queries.join(kept.select(F.col("table_id").alias("_id")), "_id", "left_semi")
    found = kept.join(asked.select(F.col("_id").alias("table_id")), "table_id", "left_semi").select(*kept.columns)
    judged = data.qrels.join(
        asked.select(F.col("_id").alias("query_id")),
        "query_id",
        "left_semi",
    ).join(found.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi").select(*data.qrels.columns)
    rows = None
    for name, old, new in _keys(data, types):
        both = old.agg(F.count(F.lit(1)).alias("original")).join(new.agg(F.count(F.lit(1)).alias("kept")))
        row = both.select(
            F.lit(name).alias("part"),
            "original",
            "kept",
            (F.col("original") - F.col("kept")).alias("removed"),
            F.when(F.col("original") > 0, F.col("kept") / F.col("original")).otherwise(0.0).alias("rate"),
        )
        rows = row if rows is None else rows.union(row)
    return Split(found, asked, judged), rows


def write(data: Split, root: str, name: str = "test") -> None:
    """Corpus and queries as JSON lines, judgements as four tab-separated fields; folders of part files."""
    data.corpus.write.mode("overwrite").json(f"{root}/corpus.jsonl")
    data.queries.write.mode("overwrite").json(f"{root}/queries.jsonl")
    line = F.concat_ws("\t", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("int").cast("string"))
    data.qrels.select(line.alias("value")).write.mode("overwrite").text(f"{root}/qrels/{name}.tsv")
