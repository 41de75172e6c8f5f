"""Language identification by the nearest of several centroids per language, over TF-IDF byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, hash_share, in_arrow, stored, streamed, table
from .kernels import ALNUM, LOWER, slices

#: Hashed n-gram features (bytes, two and three long), as a power of two.
BITS = 12
#: Documents of each language that the centroids are fitted on, at most (about: they are drawn by hash).
SAMPLE = 600
CENTROIDS = 4
#: Share of a language's own training texts that may lie outside the rejection distance.
OUTSIDE = 0.01
UNKNOWN = "und"

#: ASCII letters lower-cased and all bytes of other characters; digits and the rest become a blank.
_TEXT = np.where(ALNUM & ~((np.arange(256) >= 0x30) & (np.arange(256) < 0x3A)), LOWER, 32).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of each hashed n-gram for each text; whole texts, n-grams never cross them."""
    plain = _TEXT[data].astype(np.uint32)
    two = plain[:-1] * np.uint32(257) + plain[1:] if len(plain) > 1 else np.zeros(0, np.uint32)
    three = two[:-1] * np.uint32(257) + plain[2:] + np.uint32(1) if len(plain) > 2 else np.zeros(0, np.uint32)
    places = [((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.intp) for x in (two, three)]
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for n, x in zip((2, 3), places, strict=True):
            if b - a >= n:
                out[t] += np.bincount(x[a : b - n + 1], minlength=1 << BITS)
    return np.log1p(out)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for t in np.flatnonzero(~out):
        out[t] = any(c.isalpha() for c in data[offsets[t] : offsets[t + 1]].tobytes().decode())
    return out


@dataclass
class Centroids:
    languages: list[str]
    #: One row for each centroid, idf and length one; the language of each; the least similarity that is not rejected.
    rows: np.ndarray
    of: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def classify(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1 and rejection for each text."""
        known = has_letter(data, offsets)
        if not len(self.rows):
            n = len(offsets) - 1
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        x = frequencies(data, offsets) * self.idf
        norm = np.linalg.norm(x, axis=1)
        cosine = (x @ self.rows.T) / np.maximum(norm, 1e-9)[:, None]
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1) * known
        names = [self.languages[self.of[c]] if k else UNKNOWN for c, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, score, (score < self.least[best]) | ~known


def weighted(vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = vectors * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def fit(own: np.ndarray, *, centroids: int = CENTROIDS, rounds: int = 15) -> tuple[list[np.ndarray], list[float]]:
    """Spherical k-means within a language; farthest-first seeds, so that rare kinds of text get a centroid."""
    rows, least = [], []
    picked = own.mean(0, keepdims=True)
    picked /= max(np.linalg.norm(picked), 1e-9)
    while len(picked) < min(centroids, len(own)):
        far = (own @ picked.T).max(1).argmin()
        picked = np.vstack([picked, own[far]])
    for _ in range(rounds):
        nearest = (own @ picked.T).argmax(1)
        for c in range(len(picked)):
            if (nearest == c).any():
                mean = own[nearest == c].mean(0)
                picked[c] = mean / max(np.linalg.norm(mean), 1e-9)
    close = own @ picked.T
    nearest = close.argmax(1)
    for c in range(len(picked)):
        mine = close[nearest == c, c]
        if len(mine):
            rows.append(picked[c])
            least.append(float(np.quantile(mine, OUTSIDE)))
    return rows, least


def train(docs: DataFrame, *, sample: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 3) -> Centroids:
    """Centroids from docs (doc_id, text, lang), from a bounded sample of each language drawn by hash.

    Every lang value is learned; each is fitted on an executor, and the driver holds its centroids only. Rows without
    text, without letters or with a null lang teach nothing.
    """
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    drawn = docs.join(F.broadcast(counts), "lang").where(hash_share(F.xxhash64(F.lit(seed), "doc_id"), sample, F.col("_rows")))
    # Rows that share an id are drawn together or not at all, so their number needs a bound of its own.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), F.xxhash64("text")))
    picked = drawn.withColumn("_place", place).where(F.col("_place") <= 2 * sample)

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(0)):
            keep = has_letter(data, offsets)
            x = frequencies(data, offsets)[keep]
            yield batch_of(
                lang=batch.column(1).slice(a, b - a).filter(pa.array(keep)),
                vector=pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
            )

    vectors = stored(in_arrow(picked.select("text", "lang"), per_batch, "lang string, vector binary"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for v in batch.column(0):
                rows += 1
                texts += np.frombuffer(v.as_buffer(), np.float16) > 0
        if rows:
            yield batch_of(rows=[rows], texts=[texts.tolist()])

    rows, texts = 0, np.zeros(1 << BITS, np.int64)
    for r in streamed(vectors.select("vector"), seen, "rows long, texts array<long>").toLocalIterator():
        rows, texts = rows + r["rows"], texts + np.array(r["texts"])
    none = np.zeros((0, 1 << BITS), np.float32)
    if not rows:
        return Centroids([], none, np.zeros(0, int), np.zeros(0), np.ones(1 << BITS, np.float32))
    idf = np.log((1 + rows) / (1 + texts)).astype(np.float32) + 1

    def per_language(group: pa.Table) -> pa.Table:
        own = np.stack([np.frombuffer(v, np.float16) for v in sorted(group["vector"].to_pylist())]).astype(np.float32)
        found, least = fit(weighted(own, idf), centroids=centroids)
        return pa.table(
            {
                "lang": pa.array([group["lang"][0].as_py()] * len(found), pa.string()),
                "c": pa.array(range(len(found)), pa.int32()),
                "vector": pa.array([x.astype(np.float32).tobytes() for x in found], pa.binary()),
                "least": least
            }
        )

    got = vectors.groupBy("lang").applyInArrow(
        per_language,
        "lang string, c int, vector binary, least double",
    ).toArrow().sort_by([("lang", "ascending"), ("c", "ascending")])
    names = got["lang"].unique().to_pylist()
    at = {name: k for k, name in enumerate(names)}
    centres = np.empty((got.num_rows, 1 << BITS), np.float32)
    for i, v in enumerate(got["vector"]):
        centres[i] = np.frombuffer(v.as_buffer(), np.float32)
    return Centroids(names, centres, np.array([at[v] for v in got["lang"].to_pylist()]), got["least"].to_numpy(), idf)


def identified(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs.

    A null text and one without a letter are `und` with score 0. rejected: farther from the nearest centroid than
    nearly all of the texts it was made of; lang_pred still names that language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(1), 1 << 19):
            for i in range(a, b, 256):
                j = min(b, i + 256)
                o = offsets[i - a : j - a + 1]
                names, score, rejected = sent.value.classify(data[o[0] : o[-1]], o - o[0])
                yield batch_of(doc_id=batch.column(0).slice(i, j - i), lang_pred=names, score=score, rejected=rejected)

    return in_arrow(docs.select(id_col, text_col), per_batch, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
