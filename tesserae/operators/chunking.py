"""Chunks of plain texts: token windows, and recursive splits by characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as tx


def token_chunks(docs: DataFrame, settings: Chunking | None = None) -> DataFrame:
    """Overlapping windows of white-space tokens, without a shuffle.

    Windows start every max - overlap tokens while there are tokens, so the last may lie inside the one before. Chunk
    ids are the document's and the window's place; texts without tokens have no chunk.
    """
    settings = settings or Chunking()
    stride = settings.stride
    meta = F.coalesce(
        F.col("metadata"),
        F.create_map().cast("map<string,string>"),
    ) if "metadata" in docs.columns else F.create_map().cast("map<string,string>")

    def windows(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(stride))
        said = lambda i: F.array_join(F.slice(tokens, i + 1, settings.max_tokens), " ")
        size = lambda i: F.least(F.size(tokens) - i, F.lit(settings.max_tokens))
        return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.struct(said(i).alias("text"), size(i).alias("size"))))

    # Tokens stay within one expression: as a column they would be written out for each text, and split again by filters.
    each = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        meta.alias("_meta"),
        F.posexplode(tx.held(tx.words(F.col("text")), windows)).alias("chunk_index", "_window"),
    )
    return each.select(
        F.format_string("%s__%05d", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id",
        F.col("_window.text").alias("text"),
        F.lit(0).alias("start_char"),
        F.lit(0).alias("end_char"),
        F.col("_window.size").alias("token_count"),
        F.map_concat("_meta", F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))).alias("metadata"),
        "chunk_index",
    )


SEPARATORS = ("\n\n", "\n", " ", "")


def _merge(parts: list[str], separator: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(separator) + len(part) > size:
            out.append(separator.join(held))
            while held and (total > overlap or total + len(separator) + len(part) > size):
                total -= len(held.pop(0)) + (len(separator) if held else 0)
        total += len(part) + (len(separator) if held else 0)
        held.append(part)
    if held:
        out.append(separator.join(held))
    return out


def split_characters(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters: by paragraphs, where one is too long by lines, then words, then characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    separator, *rest = separators
    if not separator:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    out: list[str] = []
    fitting: list[str] = []
    for part in [p for p in text.split(separator) if p]:
        if len(part) <= size:
            fitting.append(part)
            continue
        out += _merge(fitting, separator, size, overlap)
        fitting = []
        out += split_characters(part, size, overlap, tuple(rest))
    return [p.strip() for p in out + _merge(fitting, separator, size, overlap) if p.strip()]


def character_chunks(docs: DataFrame, size: int = 2000, overlap: int = 500, keep: list[str] | None = None) -> DataFrame:
    """Recursive character splits of the text column; `keep` columns go along, chunk_index counts from 0 for each row."""
    keep = keep or ["doc_id"]
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(i, k, piece) for i, t in enumerate(batch["text"]) for k, piece in enumerate(split_characters(t or "", size, overlap))]
            held = {c: batch[c].tolist() for c in keep}
            rows = {c: [held[c][p[0]] for p in parts] for c in keep} | {"chunk_index": [p[1] for p in parts], "text": [p[2] for p in parts]}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in rows.items()})

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", chunk_index int, text string"
    return docs.select(*keep, "text").mapInPandas(split, schema)


def chunk_lengths(chunks: DataFrame, group: str, content: str = "content") -> DataFrame:
    """Counts, sums and a histogram of lengths by a column; the row with a null group is for all."""
    n = F.length(content)
    rows = chunks.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(n).cast("long").alias("total_length"),
        F.avg(n).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.count_if(n < 200).alias("short"),
        F.count_if((n >= 200) & (n < 800)).alias("medium"),
        F.count_if((n >= 800) & (n < 1500)).alias("long"),
        F.count_if(n >= 1500).alias("very_long"),
    )
    return rows
