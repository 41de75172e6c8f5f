"""Vectors for each stage, from a plug-in encoder or from hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Embedding, Retrieval
from ..functions import vectors as vx

#: Makes a model on a worker, once; the model gives a list of numbers for each text of a batch.
ModelMaker = Callable[[], Callable[[list[str]], list[list[float]]]]
#: From a text column and a dimension to a vector column.
Encoder = Callable[[Column, int], Column]


def model_encoder(make: ModelMaker, batch: int = 64) -> Encoder:
    """An encoder around a model, which each worker makes once and which sees bounded batches."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [[float(x) for x in v] for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series(rows, index=part.index)

    # Called once a text: the optimizer doesn't copy what may differ from call to call.
    once = encode.asNondeterministic()
    return lambda text, dimension: vx.fitted(once(text), dimension)


def hash_encoder(text: Column, dimension: int) -> Column:
    return vx.hash_vector(text, dimension)


def by_stage(
    rows: DataFrame,
    retrieval: Retrieval,
    *,
    id_col: str,
    text_col: str = "text",
    settings: Embedding | None = None,
    encoders: dict[str, Encoder] | None = None,
    query: bool = False,
) -> DataFrame:
    """(id, stage, vector): each stage's encoder, cut or filled to its dimension, normalised if asked for.

    encoders: by model name or stage name; a stage without one uses hashes. query: normalise as queries are.
    """
    settings = settings or Embedding()
    encoders = encoders or {}
    normal = vx.query_normalized if query else vx.l2_normalized
    parts, raw = [], {}
    for i, stage in enumerate(retrieval.stages):
        encode = encoders.get(stage.name) or encoders.get(stage.model_name or "") or hash_encoder
        # A column of its own: a model can't be called within the expressions that normalise.
        raw[f"_raw{i}"] = vx.fitted(encode(F.col(text_col), stage.dimension), stage.dimension)
        vector = F.col(f"_raw{i}")
        parts.append(F.struct(F.lit(stage.name).alias("stage"), (normal(vector) if settings.normalize else vector).alias("vector")))
    rows = rows.select(id_col, *[c.alias(name) for name, c in raw.items()])
    return rows.select(F.col(id_col), F.explode(F.array(*parts)).alias("s")).select(id_col, "s.stage", "s.vector")


def multi_resolution(
    rows: DataFrame,
    dimensions: list[int],
    *,
    id_col: str,
    vector_col: str = "vector",
    normalize: bool = True,
) -> DataFrame:
    """(id, dimension, vector): the full vector, cut or filled to the largest dimension, and its first numbers for each
    smaller one, normalised again after the cut."""
    most = max(dimensions, default=2048)
    full = vx.fitted(F.col(vector_col), most)
    base = rows.select(id_col, (vx.l2_normalized(full) if normalize else full).alias("_full"))
    parts = [
        F.struct(
            F.lit(d).alias("dimension"),
            vx.l2_normalized(F.slice("_full", 1, d)).alias("vector"),
        ) for d in sorted(set(dimensions) or {most})
    ]
    return base.select(id_col, F.explode(F.array(*parts)).alias("s")).select(id_col, "s.dimension", "s.vector")


def one_vector_each(texts: DataFrame, dimensions: list[int], encoder: Encoder = hash_encoder) -> DataFrame:
    """(id, dimension, vector) of texts that have no id: ids are `row-` and the place."""
    from ..sources.ingest import numbered

    rows = numbered(texts, "_place").select(
        F.concat(F.lit("row-"), F.col("_place").cast("string")).alias("id"),
        encoder(F.col("text"), max(dimensions)).alias("vector"),
    )
    return multi_resolution(rows, dimensions, id_col="id")
