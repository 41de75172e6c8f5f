"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or before
in its own. Strings are judged on the input, so the result does not depend on the order of removal.

All suffixes of a corpus are too many for any one shard, so shards are made of places that can matter. In every
string of LENGTH bytes the least hashed gram of GRAM bytes is an anchor: equal strings have the same anchor at the same
place. Anchors, with a hash of all that strings over them can see (the context), meet by gram. Where the whole
context stood before, all strings over the anchor are repeats. Where a gram has several contexts, their bytes make up
the shards, whose suffixes are sorted by induction; neighbours that agree on LENGTH bytes are one string, and all but
its first place are repeats.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, batch_of, in_arrow, sorted_runs, stored, streamed, table
from .kernels import BYTE, mix, powers, ranges, slices
from .suffix_sort import suffix_order

U64 = np.uint64
LENGTH, GRAM = 100, 32
#: Contexts of one gram that a task holds; further ones follow in pieces, whose strings meet on disk.
HELD_ROWS = 40_000
#: A gram with more than one in so many of all places is common, if it has more than the other number; its contexts are
#: dealt by the bytes beside it.
COMMON, LEAST_COMMON = 1000, 64
#: Places, over all documents, that may be broadcast after counting them; more go through a shuffle.
BROADCAST_PLACES = 4_000_000
#: Positions of a slice whose windows are searched at once: they share 64 bits with the hash.
_STEP, _PLACE = 1 << 23, (1 << 24) - 1
_LATE = (1 << 63) - 1
#: The first place of a string in a piece, by the hash of the string, and how many of them are judged at once.
_FIRST = np.dtype([("value", U64), ("doc", np.int64), ("tie", np.int64), ("at", np.int64)])
FIRST_ROWS = 1 << 20


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of bytes, and the inverse powers that move a difference of two to the front."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[:-1], out=total[1:])
    return total, down


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it, gram hash and context hash of each anchor of a slice."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    total, down = running(data)
    hashes = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    reach, found = length - gram, []
    for at in range(0, len(data) - length + 1, _STEP):
        part = hashes[at : at + _STEP + reach]
        packed = (part & U64(~_PLACE & ((1 << 64) - 1))) | (U64(_PLACE) - np.arange(len(part), dtype=U64))
        least = sliding_least(packed, reach + 1)
        start = at + np.arange(len(least))
        inside = start + length <= offsets[np.searchsorted(offsets, start, "right")]
        found.append(np.unique(at + _PLACE - (least[inside] & U64(_PLACE)).astype(np.int64)))
    place = np.unique(np.concatenate(found))
    text = np.searchsorted(offsets, place, "right") - 1
    low, high = np.maximum(place - reach, offsets[text]), np.minimum(place + length, offsets[text + 1])
    context = mix((total[high] - total[low]) * down[low] + mix(((high - low) * (1 << 20) + place - low).astype(U64)))
    return text, place - offsets[text], hashes[place].view(np.int64), context.view(np.int64)


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges within groups, from ranges sorted by group and start; ranges that touch are one."""
    if not len(low):
        return group, low, high
    change = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(change) - 1
    far = int(high.max()) + 2
    reach = np.maximum.accumulate(high + number * far)
    new = change.copy()
    new[1:] |= low[1:] + number[1:] * far > reach[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(low)) - 1
    return group[starts], low[starts], reach[ends] - number[ends] * far


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _documents(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """0, 1, ... for each new document of rows sorted by document."""
    return np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])) if len(doc) else np.zeros(0, np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by route, context and place: those whose context stood before (gram null), and those whose
    gram has several contexts, one for each context. Rows that are known repeats pass."""
    hot, last = None, None
    names = ["context", "doc", "tie", "place"]
    for rows, more in sorted_runs(batches, "route", 1 << 20):
        known = rows.column("known").to_numpy(zero_copy_only=False)
        gram = rows.column("route").to_numpy()
        parts = [rows.column(c).to_numpy() for c in names]
        change = gram[1:] != gram[:-1]
        new = np.concatenate([[True], change | (parts[0][1:] != parts[0][:-1])])
        # A row that comes twice is one occurrence.
        again = np.concatenate([[False], ~(change | np.any([x[1:] != x[:-1] for x in parts], axis=0))])
        starts = np.flatnonzero(np.concatenate([[True], change]))
        wide = np.repeat(np.add.reduceat((new & ~known).astype(np.int64), starts) > 1, np.diff(np.append(starts, len(gram))))
        if hot is not None and gram[0] == hot:
            wide[gram == hot] = True
            new[0] = parts[0][0] != last[0]
            again[0] = all(x[0] == y for x, y in zip(parts, last, strict=True))
        if more:
            wide[:] = True
        hot, last = (int(gram[-1]), [x[-1] for x in parts]) if more or (hot is not None and gram[-1] == hot) else (None, None)
        shut = known | ~new
        keep = (known | ~again) & (shut | wide)
        if keep.any():
            rows = rows.select(["doc", "tie", "place"]).filter(pa.array(keep))
            yield batch_of(
                **{c: rows.column(c).combine_chunks() for c in ("doc", "tie", "place")},
                gram=pa.array(gram[keep], mask=shut[keep])
            )


def known_repeats(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether an anchor of a slice repeats one before it in the same slice, context and all."""
    order = np.lexsort((place, tie, doc, context, gram))
    g, c, d, t, p = (x[order] for x in (gram, context, doc, tie, place))
    same = np.concatenate([[False], (g[1:] == g[:-1]) & (c[1:] == c[:-1])])
    moved = np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
    # Not the first occurrence of its context: some earlier row of the run is at another place.
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    steps = np.cumsum(moved & same)
    out = np.empty(len(order), bool)
    out[order] = same & (steps > steps[start])
    return out


def _by_document(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From what _met gives, sorted by document and place: one row for each document."""
        for rows, _ in sorted_runs(batches, "row", 1 << 62):
            doc, tie, place = (rows.column(c).to_numpy() for c in ("doc", "tie", "place"))
            key = rows.column("gram").combine_chunks()
            open_ = key.is_valid().to_numpy(zero_copy_only=False)
            number = _documents(doc, tie)
            n = int(number[-1]) + 1
            first = np.searchsorted(number, np.arange(n))
            shut = ~open_
            of, low, high = merged(number[shut], np.maximum(place[shut] - (length - gram), 0), place[shut] + length)
            yield batch_of(
                doc=doc[first],
                tie=tie[first],
                low=_lists(np.bincount(of, minlength=n), low, pa.int64()),
                high=_lists(np.bincount(of, minlength=n), high, pa.int64()),
                place=_lists(np.bincount(number[open_], minlength=n), place[open_], pa.int64()),
                gram=_lists(np.bincount(number[open_], minlength=n), key.drop_null(), pa.int64()),
            )

    return run


def _contexts(length: int, gram: int, common: np.ndarray):
    reach = length - gram
    near = reach // 2

    def per_batch(batch: pa.RecordBatch):
        """The bytes around each place of a text, cut at its ends, and the key under which they are sorted.

        That is the gram, but for a common one: there strings that go on far to its right meet by the gram and the bytes
        next to it on the right, the others by the gram and the bytes on its left; each has the one or the other.
        """
        places, grams = batch.column("place"), batch.column("gram")
        at, flat, keys = places.offsets.to_numpy(), places.values.to_numpy(), grams.values.to_numpy()
        doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        for a, b, data, offsets in slices(batch.column("text")):
            own, key = flat[at[a] : at[b]], keys[at[a] : at[b]]
            text = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
            if not len(own):
                continue
            low, high = np.maximum(own - reach, 0), np.minimum(own + length, (offsets[1:] - offsets[:-1])[text])
            hot = np.isin(key, common)
            if hot.any():
                total, down = running(data)
                begin = offsets[text] + own
                right, left = np.flatnonzero(hot & (high >= own + gram + near)), np.flatnonzero(hot & (own - low >= reach - near + 1))
                value = lambda x, y: mix((total[y] - total[x]) * down[x] + (y - x).astype(U64)).view(np.int64)  # noqa: E731, B023
                to_right, to_left = value(begin[right], begin[right] + gram + near), value(
                    begin[left] - (reach - near + 1),
                    begin[left] + gram,
                )
                cold = np.flatnonzero(~hot)
                pick = np.concatenate([cold, right, left])
                key = np.concatenate([key[cold], to_right, to_left])
                low = np.concatenate([low[cold], np.maximum(low[right], own[right] - (reach - near)), low[left]])
                high = np.concatenate([high[cold], high[right], np.minimum(high[left], own[left] + gram + near - 1)])
                own, text = own[pick], text[pick]
                if not len(own):
                    continue
            size = high - low
            body = data[np.repeat(low + offsets[text], size) + ranges(size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield batch_of(
                gram=key,
                doc=doc[a:b][text],
                tie=tie[a:b][text],
                place=own,
                left=own - low,
                bytes=pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))]),
            )

    return per_batch


def reachable(
    keys: np.ndarray,
    total: np.ndarray,
    down: np.ndarray,
    at: np.ndarray,
    room: np.ndarray,
    reach: int,
    sign: int,
    gram: int,
) -> np.ndarray:
    """For each context, how far beside its gram another context of the gram may agree at most."""
    steps = [*range(reach // 8, reach, reach // 8), reach]
    out = np.zeros(len(keys), np.int64)
    open_ = np.ones(len(keys), bool)
    for k, far in enumerate(steps):
        rows = np.flatnonzero(open_ & (room >= far))
        low = at[rows] - far if sign < 0 else at[rows] + gram
        value = mix((total[low + far] - total[low]) * down[low] + mix(keys[rows].view(U64) + U64(far)))
        order = np.argsort(value, kind="stable")
        held = value[order]
        same = np.concatenate([[False], held[1:] == held[:-1]])
        same[:-1] |= same[1:].copy()
        agreed = np.zeros(len(keys), bool)
        agreed[rows[order]] = same
        out[open_ & ~agreed] = far - 1
        open_ &= agreed
        if k == len(steps) - 1:
            out[open_] = far
    return np.minimum(out, room)


class Firsts:
    """First places of strings in the pieces of a gram, in one unnamed file by the top byte of the string's hash."""

    def __init__(self) -> None:
        self.file, self.end = tempfile.TemporaryFile(), 0
        self.parts: list[list[tuple[int, int]]] = [[] for _ in range(256)]

    def put(self, rows: np.ndarray) -> None:
        top = (rows["value"] >> U64(56)).astype(np.int64)
        self.file.seek(self.end)
        rows[np.argsort(top, kind="stable")].tofile(self.file)
        for bucket, n in enumerate(np.bincount(top, minlength=256).tolist()):
            if n:
                self.parts[bucket].append((self.end, n))
                self.end += n * _FIRST.itemsize

    def _read(self, bucket: int, k: int, cuts: int) -> np.ndarray:
        """Of a bucket the k-th of so many ranges of hashes."""
        out = []
        for begin, n in self.parts[bucket]:
            self.file.seek(begin)
            rows = np.fromfile(self.file, _FIRST, n)
            out.append(rows[(rows["value"] >> U64(24)) % U64(cuts) == k] if cuts > 1 else rows)
        return np.concatenate(out)

    def repeats(self, length: int) -> Iterator[pa.RecordBatch]:
        """Ranges of the strings that stood in an earlier place."""
        for bucket, parts in enumerate(self.parts):
            cuts = -(-sum(n for _, n in parts) // FIRST_ROWS)
            for k in range(cuts):
                rows = self._read(bucket, k, cuts)
                rows = rows[np.lexsort((rows["at"], rows["tie"], rows["doc"], rows["value"]))]
                new = np.concatenate([[True], rows["value"][1:] != rows["value"][:-1]])
                first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
                again = rows[(rows["doc"] != first["doc"]) | (rows["tie"] != first["tie"]) | (rows["at"] != first["at"])]
                if len(again):
                    yield batch_of(
                        doc=np.ascontiguousarray(again["doc"]),
                        tie=np.ascontiguousarray(again["tie"]),
                        low=np.ascontiguousarray(again["at"]),
                        high=again["at"] + length,
                    )


def repeats(rows: pa.Table, length: int, gram: int, alone: bool = True) -> tuple[pa.RecordBatch | None, np.ndarray | None]:
    """Repeated strings among the contexts of a shard, as merged ranges of documents.

    alone: whether no gram has contexts in other shards; else the first places of all strings come too.
    """
    firsts = None
    reach = length - gram
    keys, doc, tie, place, left = (rows.column(c).to_numpy() for c in ("gram", "doc", "tie", "place", "left"))
    column = rows.column("bytes").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    total, down = running(data)
    at = ends[:-1] + left
    before, after = left, ends[1:] - at - gram
    if alone:
        before = reachable(keys, total, down, at, before, reach, -1, gram)
        after = reachable(keys, total, down, at, after, reach, 1, gram)
    used = np.flatnonzero(before + after >= reach)
    if not len(used):
        return None, firsts
    before, after, at = before[used], after[used], at[used]
    size = before + gram + after
    text = np.ones(int(size.sum()) + len(size) + 1, np.uint16)
    begin = np.cumsum(size + 1) - size - 1
    source = np.repeat(at - before, size) + ranges(size)
    text[np.repeat(begin, size) + ranges(size)] = data[source].astype(np.uint16) + 2
    text[-1] = 0
    # Places of the text where a string begins, and the row of each.
    windows = before + after - reach + 1
    starts = np.repeat(begin, windows) + ranges(windows)
    row = np.full(len(text), -1, np.int32)
    row[starts] = np.repeat(np.arange(len(used), dtype=np.int32), windows)
    order = suffix_order(text, length)
    kept = np.flatnonzero(row[order["at"]] >= 0)
    # What a string shares with the one before it: the least over the suffixes between them.
    shared = np.minimum.reduceat(order["lcp"][: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else np.zeros(0, np.int32)
    order = order["at"][kept]
    own = row[order]
    where = at[own] - before[own] + order - begin[own]
    value = mix((total[where + length] - total[where]) * down[where])
    equal = shared >= length
    equal[:1] = False
    pairs = np.flatnonzero(equal)
    span = np.arange(length)
    for k in range(0, len(pairs), 50_000):
        p = pairs[k : k + 50_000]
        equal[p] = (data[where[p][:, None] + span] == data[where[p - 1][:, None] + span]).all(1)
    d, t, s = doc[used][own], tie[used][own], place[used][own] - before[own] + order - begin[own]
    in_order = np.lexsort((s, t, d))
    d1, t1, s1 = d[in_order], t[in_order], s[in_order]
    rank = np.empty(len(d), np.int64)
    rank[in_order] = np.cumsum(np.concatenate([[False], (d1[1:] != d1[:-1]) | (t1[1:] != t1[:-1]) | (s1[1:] != s1[:-1])]))
    first = np.flatnonzero(~equal)
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(rank))))
    again = rank > least
    if not alone:
        first_rows = np.flatnonzero(~again)
        firsts = np.empty(len(first_rows), _FIRST)
        for name, column in zip(_FIRST.names, (value, d, t, s), strict=True):
            firsts[name] = column[first_rows]
    if not again.any():
        return None, firsts
    chosen = in_order[again[in_order]]
    d, t, s = d[chosen], t[chosen], s[chosen]
    number = _documents(d, t)
    begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    of, low, high = merged(number, s, s + length)
    return batch_of(doc=d[begin][of], tie=t[begin][of], low=low, high=high), firsts


def _sorted_shards(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, firsts = None, None
        for rows, more in sorted_runs(batches, "gram", HELD_ROWS):
            keys = rows.column("gram").to_numpy()
            parts = [(rows, more)]
            if hot is not None and keys[0] == hot and keys[-1] != hot:
                cut = int(np.searchsorted(keys, hot, "right"))
                parts = [(rows.slice(0, cut), False), (rows.slice(cut), more)]
            for part, further in parts:
                key = int(part.column("gram")[0].as_py())
                if firsts is not None and key != hot:
                    yield from firsts.repeats(length)
                    hot, firsts = None, None
                alone = key != hot and not further
                found, first = repeats(part, length, gram, alone)
                if not alone:
                    hot, firsts = key, firsts or Firsts()
                    if first is not None:
                        firsts.put(first)
                if found is not None:
                    yield found
        if firsts is not None:
            yield from firsts.repeats(length)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """doc_id, doc, text, tie, and whether ids are unique: a null id stands after all; rows that share an id and differ in
    text are told apart by tie. Ids that aren't whole numbers are numbered in their order."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LATE)))
    else:
        # Places in a sorted frame ascend from partition to partition.
        places = stored(
            docs.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().sort("_id").withColumn(
                "_doc",
                F.monotonically_increasing_id(),
            )
        )
        docs = docs.join(places, F.col("doc_id") == F.col("_id"), "left").select(
            "doc_id",
            "text",
            F.coalesce("_doc", F.lit(_LATE)).alias("doc"),
        )
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        return docs.withColumn("tie", F.lit(0).cast("long")), True
    return docs.withColumn("tie", F.xxhash64("text")), False


def by_row(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a document together, and in order: those that share an id, null or not, go by their texts, not to one task."""
    rows = rows.withColumn("row", F.xxhash64("doc", "tie"))
    return rows.repartition("row").sortWithinPartitions("row", "doc", "tie", *order)


def _with(docs: DataFrame, places: DataFrame, counted: str, how: str) -> DataFrame:
    """docs joined to places by doc and tie: by broadcast if places are few, as counted, else by a shuffle."""
    rows, total = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(counted), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and total <= BROADCAST_PLACES
    return docs.join(F.broadcast(places) if few else places, ["doc", "tie"], how)


def without_repeats(
    docs: DataFrame,
    *,
    length: int = LENGTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text as UTF-8 bytes, and low and high: the maximal removed runs of each row of docs.

    Null and short texts lose nothing. Rows that share an id and a text are one document, and so not each other's
    repeats; rows that share an id only are judged as one document by their starts. Null ids come last.
    """
    docs, unique = keyed(docs, id_col, text_col)

    def anchored(batch: pa.RecordBatch):
        doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        for a, b, data, offsets in slices(batch.column("text")):
            text, place, key, context = anchors(data, offsets, length, gram)
            d, t = doc[a:b][text], tie[a:b][text]
            # What repeats within the slice is a repeat already: it needn't meet its gram, however common that is.
            known = known_repeats(key, context, d, t, place)
            route = np.where(known, mix(place.astype(U64) + mix(d.astype(U64))).view(np.int64), key)
            yield batch_of(route=route, known=known, context=context, doc=d, tie=t, place=place)

    found = in_arrow(docs.select("doc", "tie", "text"), anchored, "route long, known boolean, context long, doc long, tie long, place long")
    found = found.repartition("route").sortWithinPartitions("route", "known", "context", "doc", "tie", "place")
    met = by_row(streamed(found, _met, "doc long, tie long, place long, gram long"), "place")
    met = stored(
        streamed(
            met,
            _by_document(length, gram),
            "doc long, tie long, low array<long>, high array<long>, place array<long>, gram array<long>",
        )
    )
    open_ = met.where("size(gram) > 0").select("doc", "tie", "place", "gram")
    texts = docs.select("doc", "tie", "text")
    around = _with(texts if unique else texts.dropDuplicates(["doc", "tie"]), open_, F.size("gram"), "inner")
    counts = open_.select(F.explode("gram").alias("gram")).groupBy("gram").count()
    total = open_.agg(F.coalesce(F.sum(F.size("gram")), F.lit(0))).first()[0]
    # Fewer than COMMON grams have so large a share of all places.
    common = np.array(
        [
            r["gram"] for r in counts.where(
                F.col("count") * COMMON > F.greatest(F.lit(total), F.lit(COMMON * LEAST_COMMON))
            ).select("gram").collect()
        ],
        np.int64
    )
    around = in_arrow(around, _contexts(length, gram, common), "gram long, doc long, tie long, place long, left long, bytes binary")
    shards = streamed(
        around.repartition("gram").sortWithinPartitions("gram", "doc", "tie", "place"),
        _sorted_shards(length, gram),
        "doc long, tie long, low long, high long",
    )
    both = shards.union(met.select("doc", "tie", F.explode(F.arrays_zip("low", "high")).alias("r")).select("doc", "tie", "r.low", "r.high"))
    both = streamed(by_row(both, "low"), _united, "doc long, tie long, low array<long>, high array<long>")
    return _with(docs, stored(both), F.size("low"), "left").select(
        "doc_id",
        F.encode("text", "utf-8").alias("text"),
        "low",
        F.transform("high", lambda x: F.least(x, F.octet_length("text"))).alias("high"),
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in sorted_runs(batches, "row", 1 << 62):
        doc, tie, low, high = (rows.column(c).to_numpy() for c in ("doc", "tie", "low", "high"))
        number = _documents(doc, tie)
        first = np.searchsorted(number, np.arange(int(number[-1]) + 1))
        of, low, high = merged(number, low, high)
        counts = np.bincount(of, minlength=len(first))
        yield batch_of(doc=doc[first], tie=tie[first], low=_lists(counts, low, pa.int64()), high=_lists(counts, high, pa.int64()))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))

    def per_batch(batch: pa.RecordBatch):
        sizes, removed, spans, digests = [], [], [], []
        for text, low, high in zip(batch.column("text"), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            text = text.as_py() or b""
            at, out, gone = 0, hashlib.sha256(), 0
            for a, b in zip(low or (), high or (), strict=True):
                b = min(b, len(text))
                out.update(text[at:a])
                at = b
                gone += b - a
            out.update(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            spans.append(len(low or ()))
            digests.append(out.hexdigest())
        yield batch_of(
            doc_id=batch.column("doc_id"),
            n_bytes=np.array(sizes, np.int64),
            n_removed=np.array(removed, np.int64),
            n_spans=np.array(spans, np.int64),
            kept_sha256=digests,
        )

    kind = found.schema["doc_id"].dataType.simpleString()
    return in_arrow(found, per_batch, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
