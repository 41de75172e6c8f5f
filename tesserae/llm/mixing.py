"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get integer quotas of blocks by highest quotients; each source's quota is
apportioned to its shards in the same way; in a shard, documents stand in a seeded order,
and the quota is taken as whole passes plus a run of blocks from a seeded block onwards.
Nothing lists blocks or documents in one place: quotients are looked at only between two
divisors that bracket the right one, at most three for each source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Times that a source, and each of its documents, is taken at most.
MOST = 2
#: Words in a shard, about, and shards of a source at most: those of a very large source are larger.
SHARD_TOKENS, MOST_SHARDS = 250_000, 1 << 16
#: Words in a block at most; a block is also a thousandth of the smallest target at most, so that rounding stays small.
BLOCK_TOKENS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): share of all words by weight, no source above most times its size.

    Weights go round in code point order of the names, null last. What a capped source can't take goes to the
    others by weight: sources are capped in the order of size by weight, so the level follows from running sums.
    One row for each source stands in a window; texts and documents don't.
    """
    # Parquet and Spark order strings by UTF-8 bytes, which is code point order.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumns({"_weight": weight, "_cap": F.col("source_size") * F.lit(float(most))})
    out = out.withColumn("_want", F.sum("source_size").over(full) * F.lit(float(share)))
    # The level if this source and all after it were not capped.
    left = F.col("_want") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(full) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / rest)
    # The first source that isn't capped fixes the level for itself and all after it.
    free = F.col("_level") * F.col("_weight") < F.col("_cap")
    level = F.first(F.when(free, F.col("_level")), ignorenulls=True).over(
        full.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    )
    out = out.withColumn("_final", level)
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")))
    return out.withColumn("target", target).drop("_weight", "_cap", "_want", "_level", "_final")


def apportion(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each row of a group by Sainte-Lague, ties by key.

    votes has one row for each key of a group; seats is the same for all rows of a group. A divisor d gives
    round(vote / d) seats each. With n rows that is within n / 2 of the sum of vote / d, so the divisors for
    seats - n and seats + n seats bracket the right one: the quotients between them, at most about 3 n, are ranked.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(whole), F.sum(vote).over(whole)
    rounded = lambda d: F.floor(F.col(vote) / d + 0.5).cast("long")
    d = votes.withColumns({"_n": n, "_total": total})
    d = d.withColumn(
        "_low",
        F.when(F.col(seats) > F.col("_n"), rounded(F.col("_total") / (F.col(seats) - F.col("_n")))).otherwise(F.lit(0).cast("long")),
    )
    d = d.withColumn(
        "_high",
        F.when(
            (F.col("_total") > 0) & (F.col(seats) > 0),
            rounded(F.col("_total") / (F.col(seats) + F.col("_n"))) + 1,
        ).otherwise(F.lit(0).cast("long")),
    )
    base = d.withColumn("_need", F.col(seats) - F.sum("_low").over(whole))
    each = base.where("_high > _low").select(*group, *key, vote, "_need", F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k"))
    ranked = Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key])
    won = each.withColumn(
        "_rank",
        F.row_number().over(ranked),
    ).where("_rank <= _need").groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias("_w_" + c) for c in [*group, *key]], "_won")
    same = [F.col(c).eqNullSafe(F.col("_w_" + c)) for c in [*group, *key]]
    joined = base.join(won, same, "left").select(*base.columns, F.coalesce("_won", F.lit(0)).alias("_won"))
    return joined.withColumn(out, F.col("_low") + F.col("_won")).drop("_n", "_total", "_low", "_high", "_need", "_won")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 17,
    shard_tokens: int = SHARD_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    keep: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; taken counts words, repeats included.

    keep: all columns of docs, followed by size, source_size, target and taken, which replace columns of these names.
    A null text has size 0; null sources are one source, which comes last. A null id is an id like any other;
    repeated rows are separate documents. An empty table gives an empty result; sources without words get target 0.
    """
    held = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *([F.struct("*").alias("_row")] if keep else []),
    )
    sized = stored(held.drop("_row"))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / 1000))).cast("long"))
    sources = sources.withColumns({"_all": F.lit(0), "seats": F.round(F.sum("target").over(everything) / F.col("block")).cast("long")})
    sources = apportion(sources, ["_all"], ["source"], "target", "seats", "quota").drop("_all", "seats")
    sources = stored(
        sources.withColumn(
            "shards",
            F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_tokens))).cast("long"),
        )
    )

    def sharded(rows: DataFrame) -> DataFrame:
        out = rows.join(sources.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
        return out.withColumns(
            {"_order": F.xxhash64(F.lit(seed), "doc_id"), "shard": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards"))}
        )

    shards = sharded(sized).groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"),
        F.first("quota").alias("source_quota"),
        F.first("block").alias("block"),
        F.first("target").alias("target"),
        F.first("source_size").alias("source_size"),
    )
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_quota", "shard_quota")
    # A capped source is taken most times whole, its last blocks included though they may be short.
    words = F.when(
        F.col("target") >= most * F.col("source_size"),
        most * F.col("shard_size"),
    ).otherwise(F.least(F.col("shard_quota") * F.col("block"), most * F.col("shard_size")))
    shards = stored(shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", words.alias("words")))
    # One row for each shard: documents are shuffled once, for the window over their shard.
    shards = F.broadcast(shards) if shards.count() <= BROADCAST_ROWS else shards

    joined = sharded(held if keep else sized)
    placed = joined.join(shards, joined["source"].eqNullSafe(F.col("_source")) & (joined["shard"] == F.col("_shard")))
    order = Window.partitionBy("source", "shard").orderBy(
        "_order",
        F.col("doc_id").asc_nulls_last(),
        "size",
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")
    placed = placed.withColumns(
        {"_passes": passes, "_blocks": F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")}
    )
    placed = placed.withColumn("_rest", F.col("words") - F.col("_passes") * F.col("shard_size"))
    placed = placed.withColumn("_from", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("_blocks")) * F.col("block"))
    placed = placed.withColumn("_to", F.col("_from") + F.col("_rest"))
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_end"), hi) - F.greatest(F.col("_start"), lo))
    run = overlap(F.col("_from"), F.col("_to")) + overlap(F.lit(0), F.col("_to") - F.col("shard_size"))
    out = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target").cast("double"),
        "taken": (F.col("size") * F.col("_passes") + run).cast("long"),
    }
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in out] if keep else [F.col("doc_id")]
    return placed.select(*own, *[c.alias(name) for name, c in out.items()])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
