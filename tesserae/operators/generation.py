"""Prompts, answers without a model, and answers from a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Makes a generator on a worker, once; it gives an answer for each prompt of a batch, empty for a failure.
GeneratorMaker = Callable[[], Callable[[list[str]], list[str]]]
NO_CONTEXT = "No relevant context retrieved."
NO_MODEL = "No generation model available. Here is the retrieved context summary:"


def contexts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, question, items): each query with its chunks in order; a query without any has none."""
    items = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("items"))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,text:string>>")
    rows = queries.select("query_id", F.col("text").alias("question")).join(items, "query_id", "left")
    return rows.select("query_id", "question", F.coalesce("items", none).alias("items"))


def prompt(system: Column | str) -> Column:
    head = F.lit(system) if isinstance(system, str) else system
    blocks = F.array_join(
        F.transform("items", lambda x: F.concat(F.lit("["), x["chunk_id"].cast("string"), F.lit("] "), tx.stripped(x["text"]))),
        "\n\n",
    )
    return F.concat(
        head,
        F.lit("\n\nContext:\n"),
        F.when(blocks == "", NO_CONTEXT).otherwise(blocks),
        F.lit("\n\nQuestion: "),
        F.col("question"),
        F.lit("\nAnswer:"),
    )


def fallback() -> Column:
    lines = F.transform(
        "items",
        lambda x: F.concat(F.lit("- ["), x["chunk_id"].cast("string"), F.lit("] "), F.substring(x["text"], 1, 150), F.lit("...")),
    )
    return F.array_join(F.concat(F.array(F.lit(NO_MODEL)), lines), "\n")


def generator(make: GeneratorMaker, batch: int = 8) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.tolist()
            yield pd.Series([a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])], index=part.index)

    return lambda text: run(text)


def answers(held: DataFrame, system: Column | str, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, question, prompt, answer, references, metadata) from contexts; no or an empty answer falls back."""
    rows = held.withColumn("prompt", prompt(system))
    said = F.coalesce(F.nullif(model(F.col("prompt")), F.lit("")), fallback()) if model else fallback()
    return rows.withColumn("answer", said).select(
        "query_id", "question", "prompt", "answer", F.transform("items", lambda x: x["chunk_id"]).alias("references"), F.create_map(
            F.lit("retrieved_chunks"),
            F.size("items").cast("double"),
        ).alias("metadata")
    )
