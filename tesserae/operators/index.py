"""Vector search over stages: every stage searches the whole corpus, for all queries at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Retrieval
from ..functions import vectors as vx

#: Query vectors that one broadcast holds; more queries are searched in blocks of so many.
BLOCK = 4096
#: Queries up to which expressions compare vectors; more are compared as a matrix.
FEW = 16
#: Items that are compared at once, at most, and scores that a worker holds of them (16 MB).
PART, SCORES = 1024, 1 << 21


def ranked(scores: DataFrame, keys: list[str], item: str, k: int, score: str = "score") -> DataFrame:
    """The best k items of each key, ties by item; Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("stage_rank", F.row_number().over(order)).where(F.col("stage_rank") <= k)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """dot, or inverse_l2: 1 / (1 + squared distance)."""
    if metric not in ("dot", "inverse_l2"):
        raise ValueError(f"unknown metric: {metric}")
    return vx.dot(a, b) if metric == "dot" else vx.inverse_distance(a, b)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "dot", precision: int | None = None) -> DataFrame:
    """(query_id, item_id, score, stage_rank) from queries (query_id, vector) and corpus (item_id, vector), exactly.

    The corpus streams past the queries; each partition keeps k candidates of a query. A few queries are broadcast to
    expressions, more are blocks of a matrix. precision: digits by which scores are compared, where two engines must
    agree on ties. Vectors of one search have one length; a null vector is nobody's neighbour.
    """
    if metric not in ("dot", "inverse_l2"):
        raise ValueError(f"unknown metric: {metric}")
    if queries.limit(FEW + 1).count() > FEW:
        return top_k_blocks(queries, corpus, k, metric=metric, precision=precision)
    # A stated query set of bounded size against the corpus, which is never broadcast.
    asked = F.broadcast(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"))
    pairs = corpus.where(F.col("vector").isNotNull()).select("item_id", F.col("vector").alias("_item")).crossJoin(asked)
    score = similarity(metric, F.col("vector"), F.col("_item"))
    scores = pairs.select("query_id", "item_id", (F.round(score, precision) if precision else score).alias("score"))
    return ranked(scores, ["query_id"], "item_id", k).select("query_id", "item_id", "score", "stage_rank")


def top_k_blocks(queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "dot", precision: int | None = None) -> DataFrame:
    """The same by products of matrices over Arrow batches. A query matrix holds about BLOCK queries; more go block by
    block."""
    blocks = max(1, -(-queries.count() // BLOCK))
    marked = queries.where(F.col("vector").isNotNull()).select(
        "query_id",
        F.col("vector").cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"),
    )
    parts = [_block_scores(marked.where(F.col("_block") == b), corpus, k, metric, precision) for b in range(blocks)]
    out = functools.reduce(DataFrame.union, parts)
    return ranked(out, ["query_id"], "item_id", k).select("query_id", "item_id", "score", "stage_rank")


def matrix(lists: pa.Array) -> np.ndarray:
    """The values of a list column without nulls, a row for each."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _block_scores(queries: DataFrame, corpus: DataFrame, k: int, metric: str, precision: int | None) -> DataFrame:
    rows = queries.select("query_id", "vector").toArrow().combine_chunks()
    sent = corpus.sparkSession.sparkContext.broadcast(rows)

    digits = precision or 12

    def compared(own: np.ndarray, asked: np.ndarray) -> np.ndarray:
        scores = own @ asked.T
        if metric == "inverse_l2":
            scores *= -2
            scores += (own**2).sum(1)[:, None]
            scores += (asked**2).sum(1)
            np.maximum(scores, 0, out=scores)
            scores += 1
            np.divide(1, scores, out=scores)
        return scores

    def best(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """The best k (query, score, item) of each query, ties by item."""
        query, score, item = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((np.unique(item, return_inverse=True)[1], -score, query))
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < k]
        return query[order], score[order], item[order]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value.column("query_id")
        if not len(ids):
            return
        asked = matrix(sent.value.column("vector").combine_chunks())
        rows = max(1, min(PART, SCORES // len(asked)))
        # What is found so far, and the score below which an item is no longer among the best k of a query.
        found, pending, floor, kind = [], 0, np.full(len(asked), -np.inf), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                scores = compared(matrix(part.column(1)), asked)
                if len(scores) >= k and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                # Products of equal vectors may differ in their last bits, which must not order them.
                item, query = np.nonzero(scores >= floor - 10.0**-digits)
                found.append((query, np.round(scores[item, query], digits), part.column(0).to_numpy(zero_copy_only=False)[item]))
                pending += len(query)
                if pending > max(1 << 16, 2 * k * len(asked)):
                    found, pending = [best(found)], 0
                    query, score, _ = found[0]
                    size = np.bincount(query, minlength=len(asked))
                    full = size >= k
                    floor[full] = np.maximum(floor[full], score[np.cumsum(size)[full] - 1])
        if found:
            query, score, item = best(found)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids.chunks).take(pa.array(query)), pa.array(item, kind), pa.array(score)],
                ["query_id", "item_id", "score"],
            )

    kinds = dict(corpus.dtypes) | dict(queries.dtypes)
    items = corpus.where(F.col("vector").isNotNull()).select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    return items.mapInArrow(search, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def search(queries: DataFrame, corpus: DataFrame, retrieval: Retrieval) -> DataFrame:
    """(query_id, stage, chunk_id, score, stage_rank) from (query_id, stage, vector) and (chunk_id, stage, vector)."""
    parts = []
    for stage in retrieval.stages:
        own = corpus.where(F.col("stage") == stage.name).select(F.col("chunk_id").alias("item_id"), "vector")
        asked = queries.where(F.col("stage") == stage.name).select("query_id", "vector")
        found = near_candidates(
            asked,
            own,
            stage.top_k,
            probes=stage.probes,
            metric=stage.metric,
        ) if stage.search == "cells" else top_k(asked, own, stage.top_k, metric=stage.metric)
        parts.append(found.withColumn("stage", F.lit(stage.name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "stage", F.col("item_id").alias("chunk_id"), "score", "stage_rank")


def checked_stages(chunks: DataFrame, vectors: DataFrame, retrieval: Retrieval) -> None:
    """Raises if a stage lacks vectors of some chunk: none is made up."""
    want = chunks.select("chunk_id").distinct()
    for stage in retrieval.stages:
        lacking = want.join(vectors.where(F.col("stage") == stage.name), "chunk_id", "left_anti").limit(1).collect()
        if lacking:
            raise ValueError(f"stage {stage.name} has no vector for chunk {lacking[0][0]}")


#: Vectors that cell centres are fitted on, at most (about: they are drawn by hash), the centres at most, and tasks that share a cell.
SAMPLE, CELLS, SALTS = 20_000, 256, 8


def cell_centres(corpus: DataFrame, *, sample: int = SAMPLE, cells: int = CELLS, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of the cells of an index, by k-means on a bounded sample; about the square root of its size, `cells` at most."""
    corpus = corpus.where(F.col("vector").isNotNull()).select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = corpus.count()
    drawn = F.xxhash64(F.lit(seed), "item_id")
    if rows > sample:
        corpus = corpus.where(drawn.bitwiseAND(F.lit((1 << 63) - 1)) <= ((1 << 63) - 1) * sample // rows)
    held = corpus.orderBy(drawn).limit(2 * sample).toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    points = matrix(held.column("vector").combine_chunks())
    centres = points[: max(1, min(cells, int(len(points) ** 0.5)))].copy()
    for _ in range(rounds):
        near = nearest(points, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each point."""
    far = (centres**2).sum(1) - 2 * points @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def in_cells(rows: DataFrame, name: str, centres: np.ndarray, k: int) -> DataFrame:
    """(name, vector, cell) of each row for its k nearest cells; every row has one."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, PART) for i in range(0, batch.num_rows, PART)):
                cells = nearest(matrix(part.column(1)), sent.value, k)
                at = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(cells.ravel().astype(np.int32))],
                    [name, "vector", "cell"],
                )

    kind = dict(rows.dtypes)[name]
    rows = rows.where(F.col("vector").isNotNull()).select(name, F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(assign, f"{name} {kind}, vector array<double>, cell int")


def near_candidates(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    probes: int = 12,
    metric: str = "dot",
    centres: np.ndarray | None = None,
) -> DataFrame:
    """Approximate search: all items lie in cells, a query looks at its `probes` nearest ones, scores are exact there.

    Cells are fitted on a bounded sample, every item is in one. A cell with many items is dealt over SALTS tasks. Recall
    grows with probes and is 1 where they cover all cells.
    """
    centres = cell_centres(corpus) if centres is None else centres
    if not len(centres):
        return top_k(queries, corpus, k, metric=metric)
    items = in_cells(corpus, "item_id", centres, 1).withColumnRenamed("vector", "_item").withColumn(
        "_salt",
        F.pmod(F.xxhash64("item_id"), F.lit(SALTS)),
    )
    asked = in_cells(queries, "query_id", centres, probes).withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))),
    )
    met = items.join(asked, ["cell", "_salt"])
    scores = met.select("query_id", "item_id", similarity(metric, F.col("vector"), F.col("_item")).alias("score"))
    return ranked(scores, ["query_id"], "item_id", k).select("query_id", "item_id", "score", "stage_rank")
