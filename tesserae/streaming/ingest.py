"""Documents that arrive as files become chunks with vectors, exactly once, by the operators of the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import chunking, embedding
from ..sources.ingest import JSON_MAP


def json_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(doc_id, text, metadata) of JSON lines files as they appear in a folder; lines without text are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    f = F.from_json("value", JSON_MAP)
    rows = lines.select(f.alias("f")).where("f['text'] is not null")
    ident = F.coalesce(F.nullif(F.col("f")["id"], F.lit("")), F.col("f")["doc_id"], F.sha2(F.col("f")["text"], 256))
    return rows.select(
        ident.alias("doc_id"),
        F.col("f")["text"].alias("text"),
        F.map_filter("f", lambda k, v: ~k.isin("text", "id")).alias("metadata"),
    )


def index_stream(docs: DataFrame, settings: Settings, root: str, checkpoint: str, encoders: dict | None = None) -> StreamingQuery:
    """Writes chunks and vectors under root, a folder for each batch: a batch that is run again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.token_chunks(batch, settings.chunking).drop("chunk_index")
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        held = batch.sparkSession.read.parquet(f"{root}/chunks/batch={number}")
        vectors = embedding.by_stage(held, settings.retrieval, id_col="chunk_id", settings=settings.embedding, encoders=encoders)
        vectors.write.mode("overwrite").parquet(f"{root}/vectors/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(events: DataFrame, time_col: str, text_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of ranking tokens in windows of time, with a bound for late rows."""
    from ..functions.text import rank_tokens

    terms = events.withWatermark(time_col, late).select(F.col(time_col), F.explode(rank_tokens(F.col(text_col))).alias("term"))
    return terms.groupBy(F.window(time_col, window), "term").agg(F.count(F.lit(1)).alias("n"))
