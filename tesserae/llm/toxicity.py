"""Toxicity: a logistic classifier over word features, regularised by counterfactual swaps of identity terms.

Each labelled sentence that names a group is scored again with each other name of its kind in its place; the mean
squared change of the probability is part of the loss, so that naming a group is no evidence by itself. Where no
labelled sentence names a group the term is empty: Model.swaps, which queries return, says over how many it went.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, hash_share, in_arrow, table
from .kernels import ALNUM, LOWER, grams, slices, word_hashes, words

BITS = 20
#: Labelled documents of each class that the classifier is fitted on, at most (about: they are drawn by hash).
SAMPLE = 4000
#: Features that the classifier keeps: those whose presence differs most between the classes.
FEATURES = 1500
LEAST_DOCS = 2
PENALTY, RIDGE, STEPS = 4.0, 1e-4, 800
THRESHOLD = 0.7
#: What a clean document that is rejected costs, against a toxic one that is kept, where the intercept is set.
CLEAN_COST = 10.0
#: Names of groups in the corpus languages; each is swapped for the others of its line.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "transgender", "bisexual"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("french", "german", "spanish", "english", "italian", "polish"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs"),
    ("frauen", "männer", "christen", "muslime", "juden"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos"),
)


def feature_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _one(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(feature_ids(grams(word_hashes(data, np.array([0]), np.array([len(data)])), 1))[0])


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word of a slice, and where each text's words begin."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ALNUM)
    return feature_ids(grams(word_hashes(low, starts, ends), 1)), first


_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: A swap in a labelled sentence: the sentence's features, the one that goes and the one that comes.
Swap = tuple[np.ndarray, int, int]
_OTHERS = {w: tuple(x for x in group if x != w) for group in IDENTITIES for w in group}
_NAMES = re.compile("|".join(sorted(_OTHERS, key=len, reverse=True)))


def swaps(text: str) -> list[Swap]:
    """Every swap of an identity term for each other of its kind that its sentence doesn't name already."""
    named = []
    for sentence in _SENTENCE.split(text.lower()):
        if _NAMES.search(sentence):
            found = set(_WORD.findall(sentence))
            changes = [(w, o) for w in sorted(found & _OTHERS.keys()) for o in _OTHERS[w] if o not in found]
            if changes:
                named.append((sentence, changes))
    out: list[Swap] = []
    if named:
        for a, _, data, offsets in slices(pa.array([s for s, _ in named])):
            ids, first = text_features(data, offsets)
            for t, (s, e) in enumerate(itertools.pairwise(first.tolist())):
                feats = np.unique(ids[s:e]).astype(np.int32)
                out += [(feats, _one(w), _one(o)) for w, o in named[a + t][1]]
    return out


@dataclass
class Model:
    """Sorted feature ids, their weights, the intercept, and how many swaps the fit saw."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    #: Swaps in labelled sentences that the fit looked at.
    swaps: int = 0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probability for each text; a feature counts once in a text, however long."""
        ids, first = text_features(data, offsets)
        at = np.flatnonzero(dense[ids])
        text = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(text * (1 << BITS) + ids[at])
        total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -40, 40)))


Row = tuple[int, np.ndarray, list[Swap]]


def labelled(docs: DataFrame, labels: DataFrame, *, sample: int, seed: int) -> list[Row]:
    """(label, features, swaps) of a bounded sample of labelled documents, both classes drawn by hash.

    Features are taken on the executors, where the texts lie: the driver gets feature ids, never texts. A document with
    several labels counts as toxic if any says so; one whose id repeats is several documents, and where such rows make
    the sample too large, equal ones count once and a second draw goes by their text.
    """
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("_toxic")
    )
    marks = marks.select("_id", (F.col("_toxic") > 0).cast("int").alias("_toxic"))

    def drawn(rows: DataFrame, counts: dict[int, int], *key: str) -> DataFrame:
        keep = F.lit(False)
        for label, n in counts.items():
            keep = F.when(F.col("_toxic") == label, hash_share(F.xxhash64(F.lit(seed), *key), sample, n)).otherwise(keep)
        return rows.where(keep)

    def by_class(rows: DataFrame) -> dict[int, int]:
        return {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    # About `sample` ids of each class, so they may be broadcast: texts aren't shuffled for them.
    marks = F.broadcast(drawn(marks, by_class(marks), "_id"))
    picked = docs.join(marks, docs["doc_id"] == marks["_id"]).select("doc_id", "text", "_toxic")
    counts = by_class(picked.select("_toxic"))
    if max(counts.values(), default=0) > 2 * sample:
        picked = picked.dropDuplicates(["doc_id", "text"])
        picked = drawn(picked, by_class(picked), "doc_id", "text")
    swap = pa.list_(pa.struct([("features", pa.list_(pa.int32())), ("goes", pa.int32()), ("comes", pa.int32())]))

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(0)):
            ids, first = text_features(data, offsets)
            feats = [np.unique(ids[s:e]).astype(np.int32) for s, e in itertools.pairwise(first.tolist())]
            found = [
                [{"features": f, "goes": x, "comes": y} for f, x, y in swaps(data[s:e].tobytes().decode())] for s,
                e in itertools.pairwise(offsets.tolist())
            ]
            yield batch_of(
                toxic=batch.column(1).slice(a, b - a),
                features=pa.array(feats, pa.list_(pa.int32())),
                swaps=pa.array(found, swap),
            )

    schema = "toxic int, features array<int>, swaps array<struct<features:array<int>,goes:int,comes:int>>"
    rows = in_arrow(picked.select("text", "_toxic"), per_batch, schema).toArrow()
    out: list[Row] = []
    for toxic, feats, found in zip(rows["toxic"].to_pylist(), rows["features"], rows["swaps"].to_pylist(), strict=True):
        out.append((toxic, feats.values.to_numpy(), [(np.array(x["features"], np.int32), x["goes"], x["comes"]) for x in found]))
    return sorted(out, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))


def boundary(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes at the least cost; the middle of those that do."""
    order = np.argsort(logits, kind="stable")
    held, toxic = logits[order], y[order] > 0
    # Cost of a boundary before each place: toxic ones below, clean ones at or above.
    cost = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum() + CLEAN_COST * np.concatenate(
        [np.cumsum(~toxic[::-1])[::-1], [0]]
    ) / (~toxic).sum()
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    low, high = held[max(best[0] - 1, 0)], held[min(best[-1], len(held) - 1)]
    return float((low + high) / 2)


def calibrated(rows: list[Row], prior: float | None = None, *, penalty: float = PENALTY) -> Model:
    """The model of all rows, its intercept such that THRESHOLD is where models of three parts best judge the fourth."""
    model = fit(rows, prior, penalty=penalty)
    y = np.array([r[0] for r in rows])
    if len(y) < 40 or not 8 <= y.sum() <= len(y) - 8:
        return model
    logits = np.zeros(len(y))
    for k in range(4):
        own = np.arange(len(y)) % 4 == k
        part = fit([r for r, o in zip(rows, own, strict=True) if not o], prior, penalty=penalty)
        dense = part.dense()
        logits[own] = [dense[r[1]].sum() + part.intercept for r, o in zip(rows, own, strict=True) if o]
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - boundary(logits, y)
    return Model(model.features, model.weights, model.intercept + float(shift), model.swaps)


class Sparse:
    """Rows of 0 and 1 by the columns that are 1."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray, b: float) -> np.ndarray:
        """Probability of each row."""
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.row, w[self.column], self.n) + b, -40, 40)))

    def summed(self, weight: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, weight[self.row], columns)


class Loss:
    """Mean logistic loss, ridge, and penalty times the mean squared change of the probability under swaps."""

    def __init__(
        self,
        rows: list[np.ndarray],
        y: np.ndarray,
        changes: dict[tuple[tuple[int, ...], tuple[int, ...]], int],
        penalty: float,
    ) -> None:
        self.x, self.y = Sparse(rows), y
        self.before = Sparse([np.array(a, np.int64) for a, _ in changes])
        self.after = Sparse([np.array(b, np.int64) for _, b in changes])
        times = np.array(list(changes.values()), float)
        self.share = penalty * times / max(times.sum(), 1)

    def value(self, w: np.ndarray, b: float) -> float:
        p = self.x.times(w, b)
        own = -np.mean(np.log(np.where(self.y > 0, p, 1 - p))) + RIDGE / 2 * (w @ w)
        return float(own + (self.share * (self.after.times(w, b) - self.before.times(w, b)) ** 2).sum())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        error = (self.x.times(w, b) - self.y) / len(self.y)
        grad, at = self.x.summed(error, len(w)) + RIDGE * w, float(error.sum())
        if self.before.n:
            p, q = self.before.times(w, b), self.after.times(w, b)
            up, down = 2 * self.share * (q - p) * q * (1 - q), 2 * self.share * (q - p) * p * (1 - p)
            grad = grad + self.after.summed(up, len(w)) - self.before.summed(down, len(w))
            at += float((up - down).sum())
        return grad, at


def fit(rows: list[Row], prior: float | None = None, *, penalty: float = PENALTY) -> Model:
    """The least loss by Adam on all rows. Features: those that tell the classes apart, and all that a swap takes away.

    prior: the share of toxic documents outside the sample, to which the intercept is set. Without rows of both
    classes the model has no weights and gives the prior, or 0.5 without one or where that is less: it rejects nothing.
    """
    y = np.array([r[0] for r in rows], np.float64)
    base = min(max(0.5 if prior is None else prior, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), min(0.0, float(np.log(base / (1 - base)))))
    size = 1 << BITS
    there = [np.bincount(np.concatenate([r[1] for r in rows if r[0] == c]), minlength=size) for c in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p0, p1, p = there[0] / n0, there[1] / n1, (there[0] + there[1]) / len(y)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    z[there[0] + there[1] < LEAST_DOCS] = 0
    features = np.argsort(-z, kind="stable")[: min(FEATURES, int((z > 2).sum()))]
    features = np.union1d(features, np.array([a for r in rows for _, a, _ in r[2]], np.int64))
    column = np.full(size, -1)
    column[features] = np.arange(len(features))
    # Sentences that look alike to the model are one, as often as they come.
    changes: Counter = Counter()
    for r in rows:
        for feats, goes, comes in r[2]:
            own = set(column[feats].tolist()) - {-1}
            other = (own - {int(column[goes])}) | ({int(column[comes])} - {-1})
            changes[tuple(sorted(own)), tuple(sorted(other))] += 1
    kept = [c[c >= 0] for c in (column[r[1]] for r in rows)]
    loss = Loss(kept, y, changes, penalty)
    w, b, m, v = np.zeros(len(features)), 0.0, 0.0, 0.0
    gm, gv = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        grad, gb = loss.gradient(w, b)
        gm, gv = 0.9 * gm + 0.1 * grad, 0.99 * gv + 0.01 * grad**2
        m, v = 0.9 * m + 0.1 * gb, 0.99 * v + 0.01 * gb**2
        rate = 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = w - rate * gm / (np.sqrt(gv) + 1e-8)
        b -= rate * m / (np.sqrt(v) + 1e-8)
    if prior is not None:
        b += float(np.log(base / (1 - base)) - np.log(n1 / n0))
    return Model(features, w.astype(np.float32), float(b), sum(changes.values()))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = 5, penalty: float = PENALTY) -> Model:
    """The classifier from docs (doc_id, text) and labels (doc_id, toxic); other columns don't matter.

    Null labels and ids teach nothing, null texts are empty ones. Empty tables give a model without weights.
    """
    share = labels.where(F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    return calibrated(
        labelled(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample=sample, seed=seed),
        share,
        penalty=penalty,
    )


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row of docs, repeated ones and such without an id included; other columns, whatever
    their names, don't matter. A null or empty text has the score of no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch):
        dense = sent.value.dense()
        for a, b, data, offsets in slices(batch.column(1)):
            yield batch_of(doc_id=batch.column(0).slice(a, b - a), score=sent.value.scores(data, offsets, dense))

    return in_arrow(docs.select(id_col, text_col), per_batch, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of docs that score below the threshold, with their columns as they are.

    A null or empty text has the score of no words; repeated rows fare alike; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def per_batch(batch: pa.RecordBatch):
        dense = sent.value.dense()
        keep = [sent.value.scores(data, offsets, dense) < threshold for _, _, data, offsets in slices(batch.column(place))]
        yield batch.filter(pa.array(np.concatenate(keep)))

    return in_arrow(docs, per_batch, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = scored(docs, model)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.lit(model.swaps).cast("long").alias("fit_swaps"),
    )
