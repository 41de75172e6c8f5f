"""Persistence: indexes and vectors as Parquet under a content key, chunk files, statistics, results, environment files."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_loaded: set[str] = set()
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where results are kept between jobs: the checkpoint folder that the session names; a folder of this machine only
    where there is one machine, else the warehouse."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tesserae-"))
            atexit.register(shutil.rmtree, _local[0], True)
        return _local[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.kept"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written as Parquet to the shared folder: later reads take the columns they need,
    and a lost executor loses nothing. The files stay until the folder goes."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(frames: dict[str, DataFrame], settings: object) -> str:
    """16 hex digits of what frames hold, in any order of rows, and of the settings."""
    parts = []
    for name, df in sorted(frames.items()):
        row = F.xxhash64(*[F.to_json(F.col(c)) if "<" in t else F.col(c) for c, t in sorted(df.dtypes)])
        n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
        parts.append(f"{name}:{n}:{total}")
    return hashlib.sha256(f"{'|'.join(parts)}:{json.dumps(settings, sort_keys=True, default=str)}".encode()).hexdigest()[:16]


def save(frames: dict[str, DataFrame], root: str, key: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{key}/{name}")


def load(spark: SparkSession, root: str, key: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The frames that were saved under a key, or None if one is missing or can't be read."""
    from pyspark.errors import AnalysisException

    try:
        return {n: spark.read.parquet(f"{root}/{key}/{n}") for n in names}
    except AnalysisException:
        return None


def load_or_build(spark: SparkSession, root: str, key: str, names: list[str], build, rebuild: bool = False) -> dict[str, DataFrame]:
    found = None if rebuild else load(spark, root, key, names)
    if found is None:
        save(build(), root, key)
        found = load(spark, root, key, names)
    return found


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts whose content has no vector in the cache: (id, text, content_key), by the text and not by its id."""
    keyed = texts.withColumn("content_key", F.md5(F.col("text").cast("binary")))
    return keyed.join(cache.select("content_key"), "content_key", "left_anti")


def write_chunks(chunks: DataFrame, root: str) -> None:
    """All chunks as JSON lines, in a folder for each type."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").json(root)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Number of chunks and share by type, with a row for all."""
    counts = chunks.groupBy("chunk_type").count().withColumnRenamed("count", "n")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(total).select("chunk_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def write_results(metrics: DataFrame, details: DataFrame, root: str) -> None:
    metrics.write.mode("overwrite").json(f"{root}/metrics")
    details.write.mode("overwrite").json(f"{root}/queries")


def load_environment(start: str | None = None) -> dict[str, str]:
    """Sets `name=value` lines of the nearest .env file upwards, once, where the name isn't set yet."""
    at = Path(start or os.getcwd()).resolve()
    for folder in (at, *at.parents):
        file = folder / ".env"
        if file.is_file():
            if str(file) in _loaded:
                return {}
            _loaded.add(str(file))
            new = {}
            for line in file.read_text(encoding="utf-8").splitlines():
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#") and name.strip() not in os.environ:
                    new[name.strip()] = value.strip().strip("\"'")
            os.environ.update(new)
            return new
    return {}
