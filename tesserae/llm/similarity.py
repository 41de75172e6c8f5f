"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles. Two sets of Jaccard t or more share at least ceil(t n) tokens of either,
so each has at most d = n - ceil(t n) tokens that the other lacks, and together they have at most D = floor(n / t) - n.
All tokens stand in one order: those whose hash lies in a fixed range are counted over all sets, the rarest come first;
the others follow by hash. The steps:

1. A set with more than d counted tokens that no other set has can't have a partner: that leaves few sets.
2. Rare tokens are keys by themselves: if two partners share any, the first token that they share is rare, and stands
   among the first d + 1 of both. Frequent tokens are keys in combinations of two. If partners share no rare token,
   each of the r tokens of a set before its frequent ones is one that the other lacks; so D - r at most are left, and each
   parts at most one pair of neighbours among the shared frequent tokens. Hence of the first D - r + 2 that they share
   two are neighbours in both sets, and stand among the first D + d + 2 - 2 r frequent ones of a set: the extended prefix.
   A set of any size has fewer than D + d + 2 keys. Where a set is so small, or t so low, that partners may share fewer
   than D + 2 tokens, single frequent tokens of the plain prefix are keys as well.
3. Under each key, sets in order of size are chained where sizes allow; chains make candidate groups, and a group's
   sets are brought together and verified. A group larger than a block is compared with a few pivots of its own first:
   what links to one another that way is settled, and only sets outside of the largest settled part meet the blocks of
   the others. So a large group of copies is not compared with itself.

No step lists the pairs under a key, and no partner is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch_of, in_arrow, semi, sorted_runs, stored, streamed, table
from .components import components
from .kernels import mix, shingle_sets, slices

U64 = np.uint64
#: Sets of a token from which it counts as frequent.
FREQUENT = 64
#: Rows under one token that a task holds; a token with more counts as one with as many.
HELD_ROWS = 200_000
#: Tokens, with 500 more for each set, in a block of sets that are verified together.
BLOCK = 1_000_000
#: Sets of a group larger than that which all its sets are compared with first, and tasks that share a group then.
PIVOTS, SALTS = 4, 64


def spare(n, num: int, den: int):
    """Tokens of a set of n that a partner may lack."""
    return n - (n * num + den - 1) // den


def differing(n, num: int, den: int):
    """Tokens at most that only one of two partners has, where one of them has n."""
    return n * (den - num) // num


def small_sets(num: int, den: int) -> int:
    """The largest size at which partners may share fewer than D + 2 tokens; no bound where that goes on for ever."""
    sizes = [n for n in range(1, 4 * den) if n - spare(n, num, den) < differing(n, num, den) + 2]
    return (1 << 62) if sizes and sizes[-1] == 4 * den - 1 else max(sizes, default=0)


def counted_range(num: int, den: int) -> int:
    """Hashes below this are counted: a share of tokens that leaves half as many again as may be spared."""
    return int(min(1.0, 1.5 * (den - num) / den + 0.05) * (1 << 64)) - 1


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values of a set."""
    n = U64(len(tokens))
    return tuple(int((mix(tokens ^ U64(salt)).sum(dtype=U64) + n).view(np.int64)) for salt in (0x1F83D9AB, 0x5BE0CD19))


def member_sets(docs: DataFrame, words: int, num: int, den: int, *, whole: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, s1, s2, counted and tokens of each row: all tokens if whole, else those that steps 1 and 2 need."""
    kind = docs.schema[id_col].dataType.simpleString()
    below = U64(counted_range(num, den))

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(1)):
            sizes, one, two, counted, tokens = [], [], [], [], []
            for s in shingle_sets(data, offsets, words):
                x, y = signature(s) if len(s) else (0, 0)
                c = int(np.searchsorted(s, below))
                sizes.append(len(s))
                one.append(x)
                two.append(y)
                counted.append(c)
                tokens.append((s if whole else s[: max(c, spare(len(s), num, den) + differing(len(s), num, den) + 2)]).view(np.int64))
            ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))
            yield batch_of(
                doc_id=batch.column(0).slice(a, b - a),
                n=np.array(sizes, np.int64),
                s1=np.array(one, np.int64),
                s2=np.array(two, np.int64),
                counted=np.array(counted, np.int64),
                tokens=lists,
            )

    return in_arrow(docs.select(id_col, text_col), per_batch, f"doc_id {kind}, n long, s1 long, s2 long, counted long, tokens array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h, s1) sorted by both: (s1, h, df) of the tokens that more than one set lists."""
    hot = None
    for rows, more in sorted_runs(batches, "h", HELD_ROWS):
        h, s = (rows.column(c).to_numpy() for c in ("h", "s1"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[new], s[new]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.repeat(np.diff(np.concatenate([starts, [len(h)]])), np.diff(np.concatenate([starts, [len(h)]])))
        if hot is not None:
            df[h == hot] = HELD_ROWS
        hot = int(h[-1]) if more else None
        df = np.full(len(h), HELD_ROWS) if more else np.minimum(df, HELD_ROWS)
        keep = df > 1
        if keep.any():
            yield batch_of(s1=s[keep], h=h[keep], df=df[keep].astype(np.int64))


def prefix_keys(h: np.ndarray, df: np.ndarray, n: int, counted: int, num: int, den: int) -> list[int]:
    """Keys of one set from its tokens that other sets have too (hashes without sign), their counts and its sizes."""
    below = U64(counted_range(num, den))
    h, at = np.unique(h, return_index=True)
    df = df[at]
    first = h < below
    d, both, alone = spare(n, num, den), differing(n, num, den), counted - int(first.sum())
    if not both or alone > d:
        return []
    order = np.lexsort((h[first], df[first]))
    h, frequent = np.concatenate([h[first][order], h[~first]]), np.concatenate(
        [df[first][order] >= FREQUENT, np.ones(int((~first).sum()), bool)]
    )
    plain = slice(0, d + 1 - alone)
    out = [mix(h[plain][~frequent[plain]])]
    before = alone + int((~frequent).sum())
    if before <= d:
        small = small_sets(num, den)
        if n * num <= small * den:
            out.append(mix(h[plain][frequent[plain]] ^ U64(1)))
        if n > small:
            own = h[frequent][: both + d + 2 - 2 * before]
            out.append(mix(mix(own[:-1]) + own[1:]))
    return np.concatenate(out).view(np.int64).tolist()


def _keys(num: int, den: int):
    below = U64(counted_range(num, den))

    def per_batch(batch: pa.RecordBatch):
        n, counted = (batch.column(c).to_numpy() for c in ("n", "counted"))
        lists = batch.column("shared")
        offsets = lists.offsets.to_numpy()
        flat = lists.values
        h, df = flat.field("h").to_numpy().view(U64), flat.field("df").to_numpy()
        inside = np.concatenate([[0], np.cumsum(h < below)])
        alone = counted - (inside[offsets[1:]] - inside[offsets[:-1]])
        s1 = batch.column("s1").to_numpy()
        keys, ids, sizes = [], [], []
        # A token may stand twice among those of a set, so this test keeps a few sets too many; prefix_keys is exact.
        for i in np.flatnonzero(alone <= spare(n, num, den)).tolist():
            own = slice(offsets[i], offsets[i + 1])
            found = prefix_keys(h[own], df[own], int(n[i]), int(counted[i]), num, den)
            keys += found
            ids += [s1[i]] * len(found)
            sizes += [n[i]] * len(found)
        if keys:
            yield batch_of(key=np.array(keys, np.int64), s1=np.array(ids, np.int64), n=np.array(sizes, np.int64))

    return per_batch


def _chains(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (key, n, s1) in that order: neighbours under a key whose sizes allow the threshold."""
        last = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "n", "s1")]
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols, strict=True)]
            key, n, s = cols
            at = np.flatnonzero((key[1:] == key[:-1]) & (s[1:] != s[:-1]) & (n[1:] * num <= n[:-1] * den))
            if len(at):
                pairs = np.unique(np.stack([np.maximum(s[at], s[at + 1]), np.minimum(s[at], s[at + 1])]), axis=1)
                yield batch_of(a=pairs[0], b=pairs[1])
            last = [c[-1] for c in cols]

    return run


def links(sets: list[np.ndarray], num: int, den: int, settled: list[bool] | None = None) -> list[tuple[int, int]]:
    """Places of linked pairs that connect all sets that links connect. Every pair of fitting sizes is compared exactly;
    settled sets are known to be connected."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    known = np.array(settled, bool)[order] if settled else np.zeros(len(sets), bool)
    sizes = np.array([len(sets[i]) for i in order])
    _, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(int(ids.max()) + 1, np.uint8)
    label = np.arange(len(order))
    out = []
    for i in range(1, len(order)):
        low = int(np.searchsorted(sizes * den, sizes[i] * num))
        if low >= i or known[i] and known[low:i].all():
            continue
        own = ids[starts[i] : ends[i]]
        marks[own] = 1
        both = np.add.reduceat(marks[ids[starts[low] : ends[i - 1]]], starts[low:i] - starts[low], dtype=np.int64)
        marks[own] = 0
        near = low + np.flatnonzero((both * den >= num * (sizes[i] + sizes[low:i] - both)) & ~(known[i] & known[low:i]))
        for j in near[np.unique(label[near], return_index=True)[1]].tolist():
            out.append((order[i], order[j]))
            label[label == label[j]] = label[i]
    return out


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (gid, node, settled, tokens) sorted by gid: edges (a, b) between linked nodes of a block."""

        def of(names: list[str], settled: list[bool], sets: list[np.ndarray]) -> pa.RecordBatch | None:
            at = list(dict(zip(names, range(len(names)), strict=True)).values())
            pairs = links([sets[i] for i in at], num, den, [settled[i] for i in at]) if len(at) > 1 else []
            if not pairs:
                return None
            return batch_of(a=[max(names[at[i]], names[at[j]]) for i, j in pairs], b=[min(names[at[i]], names[at[j]]) for i, j in pairs])

        gid, held = None, ([], [], [])
        for batch in batches:
            lists = batch.column("tokens")
            flat, offsets = lists.values.to_numpy().view(U64), lists.offsets.to_numpy()
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("gid", "node", "settled")), strict=True)):
                if row[0] != gid:
                    if (found := of(*held)) is not None:
                        yield found
                    gid, held = row[0], ([], [], [])
                for part, value in zip(held, (*row[1:], flat[offsets[i] : offsets[i + 1]].copy()), strict=True):
                    part.append(value)
        if (found := of(*held)) is not None:
            yield found

    return run


def beside(left: DataFrame, right: DataFrame, key: str, salt: Column) -> DataFrame:
    """left joined to right, which has few rows for a key, however many left has: by broadcast if right has few rows, as
    counted, else each key is dealt over SALTS tasks."""
    if right.limit(SALTS * SALTS + 1).count() <= SALTS * SALTS:
        return left.join(F.broadcast(right), key)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("_salt", F.pmod(salt, F.lit(SALTS).cast("long"))).join(right, [key, "_salt"]).drop("_salt")


def _settled(whole: DataFrame, giant: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For groups larger than a block: edges from their sets to pivots, and (node, key, settled) of the comparisons that
    are left. whole: gid, node, s2, n, tokens; giant: gid, weight."""
    own = beside(whole.select("gid", "node", "s2", "n"), giant, "gid", F.col("s2"))
    picks = F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)])
    pivots = own.groupBy("gid").agg(F.array_distinct(picks).alias("_p")).select("gid", F.explode("_p").alias("pivot"))
    pivots = stored(pivots)
    held = semi(
        whole.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("tokens").alias("ptokens")),
        pivots.select("pivot"),
        "pivot",
    )
    pivots = stored(pivots.join(held.dropDuplicates(["pivot"]), "pivot"))
    met = beside(whole, pivots, "gid", F.col("s2")).where("node != pivot")
    both = F.size(F.array_intersect("tokens", "ptokens"))
    met = met.select("node", "pivot", "n", "pn", both.alias("both")).where(
        F.col("both") * den >= num * (F.col("n") + F.col("pn") - F.col("both"))
    )
    edges = stored(met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")))
    labels = components(edges).toDF("node", "_label")
    own = stored(own.join(labels, "node", "left").withColumn("_label", F.coalesce("_label", "node")))
    parts = own.groupBy("gid", "_label").agg(F.sum(F.col("n") + 500).alias("_part"))
    parts = parts.groupBy("gid").agg(F.max_by("_label", F.struct("_part", "_label")).alias("_main"), F.max("_part").alias("_main_weight"))
    own = beside(own, parts, "gid", F.col("s2")).withColumn("settled", F.col("_label") == F.col("_main"))
    count = lambda weight: F.ceil(weight / BLOCK).cast("long")
    own = own.withColumns({"_mains": count(F.col("_main_weight")), "_rests": count(F.col("weight") - F.col("_main_weight"))})
    own = own.withColumn("_own", F.pmod("s2", F.greatest(F.lit(1), F.when(F.col("settled"), F.col("_mains")).otherwise(F.col("_rests")))))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    place = lambda kind, i, j: F.xxhash64("gid", F.lit(kind), i, j)
    main = F.transform(upto("_rests"), lambda j: place("main", F.col("_own"), j))
    rest = F.concat(
        F.transform(upto("_mains"), lambda i: place("main", i, F.col("_own"))),
        F.transform(upto("_rests"), lambda k: place("rest", F.least("_own", k), F.greatest("_own", k))),
    )
    return edges, own.select("node", "settled", F.explode(F.when(F.col("settled"), main).otherwise(rest)).alias("key"))


def node() -> Column:
    """One name for both values of a signature."""
    return F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0"))


def jaccard_groups(
    docs: DataFrame,
    *,
    words: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: documents linked when den * both >= num * either.

    Component: the least doc_id that links reach, equal sets included. A text of fewer than `words` words is one
    shingle. Null texts and texts without words have no shingles and are their own component. A null id takes part
    in links and gets the component's least id, or null if there is none. Repeated rows come back each.
    """
    members = stored(member_sets(docs, words, num, den, whole=False, id_col=id_col, text_col=text_col))
    sets = members.where("n > 0")
    tokens = sets.select(F.explode("tokens").alias("h"), "s1").repartition("h").sortWithinPartitions("h", "s1")
    shared = streamed(tokens, _shared, "s1 long, h long, df long")
    shared = shared.groupBy("s1").agg(F.collect_list(F.struct("h", "df")).alias("shared"))
    nodes = sets.groupBy("s1").agg(F.max("n").alias("n"), F.max("counted").alias("counted"))
    # A set without shared tokens among those counted still has keys if it has too few counted ones.
    keys = in_arrow(nodes.join(shared, "s1").select("s1", "n", "counted", "shared"), _keys(num, den), "key long, s1 long, n long")
    chained = streamed(keys.repartition("key").sortWithinPartitions("key", "n", "s1"), _chains(num, den), "a long, b long")
    groups = stored(components(chained)).toDF("s1", "gid")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups

    chosen = members.select("doc_id", "n", "s1", "s2").join(groups, "s1")
    ids = chosen.where("doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    some = semi(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), stored(ids), "_id")
    some = some.union(docs.where(F.col(id_col).isNull()).select(id_col, text_col))
    whole = member_sets(
        some,
        words,
        num,
        den,
        whole=True,
        id_col="_id",
        text_col="_text",
    ).where("n > 0").select("s1", "s2", "n", "tokens").join(groups, "s1")
    whole = whole.withColumn("node", node())
    weights = chosen.groupBy("gid", "s1").agg(F.max("n").alias("n")).groupBy("gid").agg(F.sum(F.col("n") + 500).alias("weight"))
    giant = stored(weights.where(F.col("weight") > BLOCK))
    some_giant = not giant.isEmpty()
    if some_giant:
        whole = stored(whole)
        large = semi(whole, giant.select("gid"), "gid")
        pivoted, left = _settled(large, giant, num, den)
        left = stored(left)
        left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
        small = whole.join(giant, "gid", "left_anti")
        again = large.select("node", "tokens").join(left, "node").select(F.col("key").alias("gid"), "node", "settled", "tokens")
        blocks = small.select("gid", "node", F.lit(False).alias("settled"), "tokens").union(again)
    else:
        blocks = whole.select("gid", "node", F.lit(False).alias("settled"), "tokens")
    edges = streamed(blocks.repartition("gid").sortWithinPartitions("gid"), _verified(num, den), "a string, b string")
    linked = components(edges.union(pivoted) if some_giant else edges).toDF("_node", "_label")

    members = members.select("doc_id", "n", F.when(F.col("n") > 0, node()).alias("node"))
    labelled = members.join(linked, F.col("node") == F.col("_node"), "left").select(
        "doc_id",
        "n",
        F.coalesce("_label", "node").alias("label"),
    )
    least = labelled.where("label is not null").groupBy(F.col("label").alias("_of")).agg(F.min("doc_id").alias("_least"))
    out = labelled.join(least, F.col("label") == F.col("_of"), "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, that of the least id; columns stay as they are.

    Rows without an id can't be told apart and stay. Rows that repeat an id and text are one document.
    """
    found = stored(jaccard_groups(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "component_id"))
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    if not twice.isEmpty():
        again = semi(kept, twice, id_col).dropDuplicates([id_col, text_col])
        kept = kept.join(twice, id_col, "left_anti").select(*docs.columns).union(again.select(*docs.columns))
    return kept


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT words.doc_id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM words LEFT JOIN sizes ON words.doc_id = sizes.doc_id JOIN reach ON reach.a = words.doc_id GROUP BY words.doc_id
"""
