"""Benchmark decontamination: token windows of documents against a hash set of normalised benchmark n-grams.

A benchmark of bounded bytes is broadcast as sorted hashes with its normalised text, and hits are verified word by word.
Of a larger one only a bit filter of fixed size is broadcast: the windows that pass it meet the benchmark's windows in
a join on their words, with the few windows that are common among them dealt over many tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch_of, in_arrow, stored, streamed, table
from .kernels import ALNUM, LOWER, grams, mix, slices, word_hashes, words

U64 = np.uint64
WINDOW = 8
ITEMS = 2
#: Bytes of benchmark text that are broadcast as a whole, and in a block while it is read; a worker holds about six times as much.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter for a larger benchmark, as a power of two, and how many stand for a window.
FILTER_BITS, FILTER_HASHES = 26, 4
#: A window with more than one in so many of all rows counts as common (there are fewer of them than this), and goes to so many tasks.
COMMON, SALTS = 1000, 64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and the place of each text's first one."""
    low = LOWER[data]
    return low, *words(low, offsets, ALNUM)


def joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    """The words of a window with one blank between them."""
    return b" ".join([low[s:e].tobytes() for s, e in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist(), strict=True)])


class Grams:
    """The windows of some benchmark items by length: sorted hashes, and where each stands in the normalised text."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.window = window
        self.names = [str(k) for k, _ in items]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        texts, begins, stops, found, at, row = [], [], [], {}, 0, 0
        count = 0
        for _, _, data, offsets in slices(pa.array([t for _, t in items], pa.large_string())):
            low, starts, ends, first = tokens(data, offsets)
            hashes = word_hashes(low, starts, ends)
            size = ends - starts
            begin = at + np.cumsum(size + 1) - size - 1
            texts.append(b" ".join([low[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]))
            at += len(texts[-1]) + 1
            begins.append(begin)
            stops.append(begin + size)
            for a, b in itertools.pairwise(first.tolist()):
                if n := min(window, b - a):
                    own = grams(hashes[a:b], n)
                    own, place = np.unique(own, return_index=True)
                    found.setdefault(n, []).append((own, count + a + place, np.full(len(own), row)))
                row += 1
            count += len(starts)
        self.text = b" ".join(texts)
        self.begin, self.stop = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begins, stops))
        for n, parts in found.items():
            value, place, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(value, kind="stable")
            self.by_size[n] = value[order], place[order].astype(np.int32), item[order].astype(np.int32)

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, place of the window's first word in the slice, words, item) of each verified occurrence."""
        hashes = word_hashes(low, starts, ends)
        for size, (known, place, item) in self.by_size.items():
            runs = grams(hashes, size)
            if not len(runs):
                continue
            left = np.searchsorted(known, runs)
            at = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == runs)
            text = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[text + 1]
            at, text = at[inside], text[inside]
            right = np.searchsorted(known, runs[at], "right")
            for i, t, lo, hi in zip(at.tolist(), text.tolist(), left[at].tolist(), right.tolist(), strict=True):
                said = joined(low, starts, ends, i, size)
                for k in range(lo, hi):
                    p = place[k]
                    if self.text[self.begin[p] : self.stop[p + size - 1]] == said:
                        yield t, i, size, int(item[k])


@dataclass
class Verdict:
    """What was found in a text: starts and ends of its words in the slice, which are hit, and names of items."""

    starts: np.ndarray
    ends: np.ndarray
    hit: np.ndarray
    items: set[str]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of maximal runs of hit words."""
        edge = np.diff(np.concatenate([[0], self.hit.view(np.int8), [0]]))
        return self.starts[np.flatnonzero(edge == 1)], self.ends[np.flatnonzero(edge == -1) - 1]


def covered(first: np.ndarray, n_words: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(n_words + 1, np.int64)
    np.add.at(total, at, 1)
    np.add.at(total, at + size, -1)
    return np.cumsum(total[:-1]) > 0


def _scanner(held: Grams):
    """Verdicts for the texts of a slice, by scanning for what is broadcast."""

    def judge(data: np.ndarray, offsets: np.ndarray, _rows: pa.RecordBatch | None, _a: int) -> list[Verdict]:
        low, starts, ends, first = tokens(data, offsets)
        found = list(held.scan(low, starts, ends, first))
        names: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        for t, _, _, item in found:
            names[t].add(held.names[item])
        hit = covered(first, len(starts), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64))
        return [Verdict(starts[a:b], ends[a:b], hit[a:b], n) for (a, b), n in zip(itertools.pairwise(first.tolist()), names, strict=True)]

    return judge


def _reader(data: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch, a: int) -> list[Verdict]:
    """The same from what a join found: columns _at and _items beside the texts."""
    _, starts, ends, first = tokens(data, offsets)
    out = []
    for t, (x, y) in enumerate(itertools.pairwise(first.tolist())):
        places, items = rows.column("_at")[a + t].as_py() or [], rows.column("_items")[a + t].as_py() or []
        at, size = (np.array([p[k] for p in places], np.int64) for k in ("at", "size"))
        out.append(Verdict(starts[x:y], ends[x:y], covered(first, y - x, at, size), set(items)))
    return out


def _normalised(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(
        F.col(id_col).cast("string").alias("item"),
        F.col(text_col).alias("text"),
    ).where(F.col("item").isNotNull()).distinct()


def _windows(frame: DataFrame, keys: list[str], sizes: Callable[[int], list[int]], passes=None) -> DataFrame:
    """keys, at, size and gram of each window of frame's texts whose length is among sizes(words of the text)."""
    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column("text")):
            low, starts, ends, first = tokens(data, offsets)
            hashes = word_hashes(low, starts, ends)
            rows, ats, lengths, said = [], [], [], []
            counts = np.diff(first)
            for size in sorted({s for n in set(counts.tolist()) for s in sizes(n)}):
                runs = grams(hashes, size)
                text = np.searchsorted(first, np.arange(len(runs)), "right") - 1
                keep = np.arange(len(runs)) + size <= first[text + 1]
                keep &= np.isin(counts, [n for n in set(counts.tolist()) if size in sizes(n)])[text]
                if passes is not None:
                    keep &= passes(runs)
                for i in np.flatnonzero(keep).tolist():
                    rows.append(a + text[i])
                    ats.append(i - first[text[i]])
                    lengths.append(size)
                    said.append(joined(low, starts, ends, i, size))
            if rows:
                held = [batch.column(k).take(pa.array(rows)) for k in keys]
                yield batch_of(
                    **dict(zip(keys, held, strict=True)),
                    at=np.array(ats, np.int32),
                    size=np.array(lengths, np.int32),
                    gram=pa.array(said, pa.binary()),
                )

    return in_arrow(frame.select(*keys, "text"), per_batch, f"{kinds}, at int, size int, gram binary")


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of a filter of 2**bits for each hash."""
    return np.stack([(mix(hashes ^ U64(k + 1)) >> U64(64 - bits)).astype(np.int64) for k in range(FILTER_HASHES)])


def _filter(items: DataFrame, window: int, wide: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each place that a window of the benchmark sets, and the lengths of its windows; one row a task reaches
    the driver, which holds one filter."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = np.zeros(1 << wide, bool), set()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                low, starts, ends, first = tokens(data, offsets)
                hashes = word_hashes(low, starts, ends)
                for a, b in itertools.pairwise(first.tolist()):
                    if n := min(window, b - a):
                        sizes.add(n)
                        bits[bits_of(grams(hashes[a:b], n), wide).ravel()] = True
        if sizes:
            yield batch_of(bits=pa.array([np.packbits(bits).tobytes()], pa.binary()), sizes=pa.array([sorted(sizes)], pa.list_(pa.int32())))

    whole, sizes = np.zeros(1 << wide >> 3, np.uint8), set()
    for r in streamed(items.select("text").coalesce(64), per_task, "bits binary, sizes array<int>").toLocalIterator():
        whole |= np.frombuffer(r["bits"], np.uint8)
        sizes.update(r["sizes"])
    return whole, sorted(sizes)


def _met(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """_key, _at and _items of the documents (_key, text) in which windows of a benchmark of any size occur."""
    wide = FILTER_BITS
    bits, sizes = _filter(items, window, wide)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def passes(hashes: np.ndarray) -> np.ndarray:
        places = bits_of(hashes, wide)
        return ((sent.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(0)

    asked = stored(_windows(docs, ["_key"], lambda n: [s for s in sizes if s <= n], passes))
    known = _windows(items, ["item"], lambda n: [min(window, n)] if n else []).select("gram", "item").distinct()
    total = asked.count()
    common = F.broadcast(
        stored(asked.groupBy("gram").count().where(F.col("count") * COMMON > total).select(F.col("gram").alias("_common")))
    )

    def salted(rows: DataFrame, salt) -> DataFrame:
        return rows.join(common, F.col("gram") == F.col("_common"), "left").withColumn(
            "_salt",
            F.when(F.col("_common").isNotNull(), salt),
        ).drop("_common")

    asked = salted(asked, F.pmod(F.xxhash64("_key", "at"), F.lit(SALTS))).withColumn("_salt", F.coalesce("_salt", F.lit(0).cast("long")))
    known = salted(
        known,
        F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")),
    ).withColumn("_salt", F.explode(F.coalesce("_salt", F.array(F.lit(0).cast("long")))))
    hits = asked.join(known, ["gram", "_salt"])
    return hits.groupBy("_key").agg(F.collect_set(F.struct("at", "size")).alias("_at"), F.collect_set("item").alias("_items"))


def judged(docs: DataFrame, benchmark: DataFrame, text_col: str, *, window: int, item_col: str, item_text_col: str, broadcast_bytes: int):
    """docs with what judging needs, and the function that gives Verdicts for a slice of their texts."""
    items = _normalised(benchmark, item_col, item_text_col)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rows = items.sort("item", "text").toArrow()
        held = Grams(list(zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True)), window)
        sent = docs.sparkSession.sparkContext.broadcast(held)
        return docs, lambda *slice_: _scanner(sent.value)(*slice_)
    # Equal texts have equal hits, whatever their ids.
    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    met = stored(_met(keyed.select("_key", F.col(text_col).alias("text")).dropDuplicates(["_key"]), items, window))
    rows, places = met.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_at") + F.size("_items")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and places <= BROADCAST_ROWS
    return keyed.join(F.broadcast(met) if few else met, "_key", "left").select(*docs.columns, "_at", "_items"), _reader


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    min_items: int = ITEMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """For each document its words, the words inside occurrences of benchmark windows, the items found, and the spans.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of code point start and end,
    each the outermost of a maximal run of hit words). A benchmark beyond broadcast_bytes of text is met in a join.
    Null or empty text: no words, not contaminated. Items without words or without an id never occur; an item id that
    repeats counts once. Repeated rows come back each; other columns, whatever their names, don't matter; an empty
    table of documents gives an empty result, one of benchmarks no hits.
    """
    rows, judge = judged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        benchmark,
        "text",
        window=window,
        item_col=item_col,
        item_text_col=item_text_col,
        broadcast_bytes=broadcast_bytes,
    )
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(1)):
            found = judge(data, offsets, batch, a)
            spans = []
            for t, v in enumerate(found):
                if not v.hit.any():
                    spans.append([])
                    continue
                point = np.concatenate([[0], np.cumsum((data[offsets[t] : offsets[t + 1]] & 0xC0) != 0x80)])
                lo, hi = v.runs()
                spans.append(
                    [{"start": s, "end": e} for s, e in zip(point[lo - offsets[t]].tolist(), point[hi - offsets[t]].tolist(), strict=True)]
                )
            counts = np.array([len(v.items) for v in found], np.int64)
            yield batch_of(
                doc_id=batch.column(0).slice(a, b - a),
                n_words=np.array([len(v.hit) for v in found], np.int64),
                n_hit=np.array([int(v.hit.sum()) for v in found], np.int64),
                n_items=counts,
                items_sha256=[hashlib.sha256(",".join(sorted(v.items)).encode()).hexdigest() for v in found],
                contaminated=counts >= min_items,
                spans=pa.array(spans, span),
            )

    return in_arrow(rows, per_batch, schema)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    mode: str = "documents",
    window: int = WINDOW,
    min_items: int = ITEMS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the spans cut from their text (mode "spans").

    All columns stay as they were; n_chars, where there is one, follows a shortened text. Null and empty texts are
    clean and stay; repeated rows fare alike; an empty table gives an empty one, an empty benchmark takes nothing.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    rows, judge = judged(
        docs,
        benchmark,
        text_col,
        window=window,
        item_col=item_col,
        item_text_col=item_text_col,
        broadcast_bytes=broadcast_bytes,
    )
    names = docs.columns
    place, length = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def per_batch(batch: pa.RecordBatch):
        keep = np.ones(batch.num_rows, bool)
        cut: dict[int, str] = {}
        for a, _, data, offsets in slices(batch.column(place)):
            for t, v in enumerate(judge(data, offsets, batch, a)):
                if len(v.items) < min_items:
                    continue
                keep[a + t] = mode == "spans"
                if mode == "spans":
                    at, out = int(offsets[t]), []
                    for lo, hi in zip(*v.runs(), strict=True):
                        out.append(data[at:lo].tobytes())
                        at = int(hi)
                    cut[a + t] = b"".join([*out, data[at : offsets[t + 1]].tobytes()]).decode()
        batch = batch.select(names)
        for column, of in ((place, str), (length, len)):
            if cut and column is not None:
                values = batch.column(column).to_pylist()
                for i, text in cut.items():
                    values[i] = of(text)
                field = batch.schema.field(column)
                batch = batch.set_column(column, field, pa.array(values, field.type))
        yield batch.filter(pa.array(keep))

    return in_arrow(rows, per_batch, docs.schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        "contaminated",
        F.size("spans").cast("long").alias("n_spans"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (
  SELECT DISTINCT cast(item_id AS varchar) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL
), known AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), asked AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM known))
), hits AS (
  SELECT doc_id, i, asked.size AS size, item FROM asked JOIN known ON asked.gram = known.gram AND asked.size = known.size
), places AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits
), runs AS (
  SELECT doc_id, count(*) AS n_hit, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM places) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT docs.doc_id AS doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= {ITEMS} AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN runs ON docs.doc_id = runs.doc_id LEFT JOIN names ON docs.doc_id = names.doc_id
"""
