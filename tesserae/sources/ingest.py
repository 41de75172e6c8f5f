"""Documents from text folders, JSON lines and PDF folders, and their normal form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PdfIngestion
from ..functions import text as tx
from ..operators.chunking import character_chunks

JSON_MAP = "map<string,string>"


def metadata_map(values: dict[str, Any] | None) -> Column:
    pairs = [F.lit(str(x)) for kv in (values or {}).items() for x in kv]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def text_files(spark: SparkSession, folder: str, metadata: dict[str, Any] | None = None) -> DataFrame:
    """One document for each .txt file below a folder: its id is the file's stem, its path is in the metadata."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    stem = F.regexp_extract("_path", r"([^/]*)\.txt$", 1)
    rows = files.select(F.col("value").alias("text"), path.alias("_path"))
    return rows.select(
        stem.alias("doc_id"),
        "text",
        F.map_concat(metadata_map(metadata), F.create_map(F.lit("source_path"), F.col("_path"))).alias("metadata"),
    )


def json_documents(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id") -> DataFrame:
    """JSON lines: id from the id field, else doc_id, else a hash of the text; other keys are string metadata.

    0 and the empty string are no ids. A line without text or that isn't an object raises when it is read.
    """
    fields = F.from_json("value", JSON_MAP)
    rows = spark.read.text(path).select(fields.alias("f"), "value")
    text = F.when(
        F.col("f").isNull() | F.col("f")[text_field].isNull(),
        F.raise_error(F.concat(F.lit("no text in: "), F.substring("value", 1, 200))),
    ).otherwise(F.col("f")[text_field])
    known = lambda c: F.when(~c.isin("", "0", "false", "null"), c)
    ident = F.coalesce(known(F.col("f")[id_field]), known(F.col("f")["doc_id"]), F.sha2(F.col("f")[text_field], 256))
    rest = F.map_filter("f", lambda k, v: ~k.isin(text_field, id_field))
    return rows.select(ident.alias("doc_id"), text.cast("string").alias("text"), rest.alias("metadata"))


def documents(spark: SparkSession, source: str, *, metadata: dict[str, Any] | None = None, **options) -> DataFrame:
    """A JSON lines file by its ending, else a folder of texts; global metadata goes to the latter only."""
    if source.endswith((".jsonl", ".jsonl.gz")):
        return json_documents(spark, source, **options)
    if source.rstrip("/").rsplit("/", 1)[-1].count(".") and not source.endswith("/"):
        raise ValueError(f"neither a folder nor JSON lines: {source}")
    return text_files(spark, source, metadata)


def numbered(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Adds 0, 1, ... over all rows, in the order of columns or else of the input.

    Partitions are counted first, and each row adds its place in its own: no task sees all rows.
    """
    if order:
        df = df.sort(*order)
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sizes = marked.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # One row for each partition, which the session bounds.
    joined = marked.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, place).drop("_part", "_at", "_p", "_start")


def normalized(docs: DataFrame) -> DataFrame:
    """doc_id, or `doc-` and eight digits of the row's place; metadata as strings, never null."""
    rows = numbered(docs, "_place")
    ident = F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.format_string("doc-%08d", "_place"))
    meta = F.coalesce(F.col("metadata").cast(JSON_MAP), metadata_map(None)) if "metadata" in docs.columns else metadata_map(None)
    return rows.select(ident.alias("doc_id"), "text", meta.alias("metadata"))


PageReader = Callable[[bytes], list[str]]


def plain_pages(content: bytes) -> list[str]:
    """Text shown by a PDF's uncompressed or deflated streams, one text for each stream: a small stand-in for a reader."""
    import re
    import zlib

    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        shown = [re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in re.findall(rb"\(((?:\\.|[^()\\])*)\)\s*Tj", body)]
        if shown:
            pages.append("\n".join(shown))
    return pages


def pdf_documents(
    spark: SparkSession,
    folder: str,
    settings: PdfIngestion | None = None,
    read: PageReader = plain_pages,
    locations: Callable[[str], list[str]] | None = None,
) -> DataFrame:
    """Pages of the PDF files below a folder, split by characters, with the metadata of a segment.

    read gives a file's pages, locations the places a text names: both are plug-ins. Document type, department,
    confidentiality and author are drawn, the same each time, from fixed options: they are synthetic.
    """
    settings = settings or PdfIngestion()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, c in zip(batch["path"], batch["content"], strict=True) for i, t in enumerate(read(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    paged = files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        "content",
    ).mapInPandas(pages, "path string, page int, text string")
    split = character_chunks(paged, settings.chunk_size, settings.chunk_overlap, keep=["path", "page"])
    rows = numbered(split, "_place", ["path", "page", "chunk_index"]).withColumn("text", tx.stripped(F.col("text"))).where("text != ''")
    named = locations or (lambda _: [])

    @F.pandas_udf("string")
    def places(texts: pd.Series) -> pd.Series:
        import json

        return texts.map(lambda t: json.dumps(named(t)))

    seed = F.concat_ws("-", "path", "_place")
    pick = lambda options, tail: tx.stable_choice(options, F.concat(seed, F.lit(tail)))
    values = {
        "title": F.element_at(F.split("path", "/"), -1),
        "source_path": F.col("path"),
        "parent_id": F.col("path"),
        "chunk_hint": F.concat(F.col("path"), F.lit("_chunk_"), F.col("_place").cast("string")),
        "locations": places("text") if locations else F.lit("[]"),
        "document_type": pick(settings.document_types, "-type"),
        "department": pick(settings.departments, "-dept"),
        "confidentiality_level": pick(settings.confidentiality_levels, "-conf"),
        "author": pick(settings.authors, "-author"),
    }
    meta = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return rows.select(F.format_string("%s__split_%05d", "path", "_place").alias("doc_id"), "text", meta.alias("metadata"))
