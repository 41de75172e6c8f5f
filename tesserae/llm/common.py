"""What the operators of this subpackage share: reading, stages in Python, materialising, grouping."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MOST = (1 << 63) - 1
#: Rows of a side that may be broadcast after counting it; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder that the cluster names, and name it; make one only where none is set, on one machine."""
    context = spark.sparkContext
    if (held := context.getCheckpointDir()) is not None:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master.startswith("local[") or context.master == "local":
            named = tempfile.mkdtemp(prefix="checkpoint-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it lies. PySpark has no call for it, so this goes through the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing.

    Spark removes the files when nothing refers to them, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch on its way to or from a Python worker.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def streamed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, whose memory a worker gives back.

    The bound is a setting of the session, which is lowered if it is higher: a batch of rows with long texts would
    otherwise be held several times over by the executor and by its worker.
    """
    spark = df.sparkSession
    held = spark.conf.get(_BATCH).lower()
    if int(held.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(held.rstrip("b")[-1:], 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def in_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a function over each Arrow batch; it yields batches of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from per_batch(batch)

    return streamed(df, run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def sorted_runs(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Cut batches sorted by an integer key into tables that hold whole runs of the key.

    A run of more than `most` rows comes in several tables, each with True beside it (False for the last).
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def last_start(batch: pa.RecordBatch) -> int:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        return int(np.searchsorted(keys, keys[-1], "left"))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1].as_py() != keys[0].as_py():
            yield pa.Table.from_batches(held), False
            held, rows = [], 0
        cut = last_start(batch)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]), False
            held, rows = [], 0
        held.append(batch.slice(cut))
        rows += batch.num_rows - cut
        if rows > most:
            yield pa.Table.from_batches(held), True
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held), False


def hash_share(hashed: Column, sample: int, count: int | Column) -> Column:
    """Whether a 64-bit hash falls into the share sample / count of all its values: exact for any count, all if count is
    sample at most."""
    count = F.greatest(F.lit(1), F.lit(count) if isinstance(count, int) else count).cast("long")
    bound = F.when(count <= sample, F.lit(_MOST)).otherwise(
        F.floor(F.lit(_MOST).cast("decimal(38,0)") * F.lit(sample).cast("decimal(18,0)") / count.cast("decimal(19,0)")).cast("long")
    )
    return hashed.bitwiseAND(F.lit(_MOST)) <= bound


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among ids: by broadcast if few (counted), else by a shuffle."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")
