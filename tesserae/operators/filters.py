"""Metadata filters: terms match as substrings, and a filter that would leave a query nothing is not applied."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREFIX = "filter__"


def _listed(raw: Column) -> Column:
    """Strings of a JSON list, lower-cased, without blank ones; null if it isn't one."""
    items = F.from_json(raw, "array<string>")
    return F.when(F.substring(F.ltrim(raw), 1, 1) == "[", F.transform(F.filter(items, lambda x: x.rlike(r"\S")), F.lower))


def _separated(raw: Column) -> Column:
    parts = F.transform(F.split(raw, "[;,]"), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(parts, lambda x: x != "")


def filter_terms(raw: Column) -> Column:
    return F.coalesce(_listed(raw), _separated(raw))


def metadata_values(raw: Column) -> Column:
    """As terms, but what consists of separators only is one value."""
    parts = _separated(raw)
    return F.coalesce(_listed(raw), F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lower(raw))))


def query_filters(metadata: Column) -> Column:
    """map<field, terms> of the keys that carry filters; fields without terms are left out."""
    own = F.map_filter(metadata, lambda k, v: k.startswith(PREFIX))
    terms = F.transform_values(own, lambda k, v: filter_terms(v))
    named = F.transform_keys(terms, lambda k, v: F.substring(k, len(PREFIX) + 1, 1 << 20))
    return F.map_filter(named, lambda k, v: F.size(v) > 0)


def matches(metadata: Column, filters: Column) -> Column:
    """Every field has a value that holds one of its terms; a missing field fails."""

    def fits(entry: Column) -> Column:
        value = F.try_element_at(metadata, entry["key"])
        values = metadata_values(value)
        return F.coalesce(F.exists(entry["value"], lambda t: F.exists(values, lambda v: F.contains(v, t))), F.lit(False))

    return F.forall(F.map_entries(filters), fits)


def soft(ranked: DataFrame, key: str = "query_id", match: str = "matched") -> DataFrame:
    """Rows that match, or all rows of a query none of whose rows do; ranks stay as they are."""
    some = F.max(F.col(match).cast("int")).over(Window.partitionBy(key))
    return ranked.withColumn("_some", some).where(F.col(match) | (F.col("_some") == 0)).drop("_some")


def limited(ranked: DataFrame, k: int | None, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of a query by place, not by stored rank."""
    if k is None:
        return ranked
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank))
    return ranked.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def filter_metadata(locations: list[str] | None = None, filters: list[str] | None = None) -> dict[str, str]:
    """Metadata from command-line values: locations, and `FIELD=a,b` filters."""
    out = {f"{PREFIX}locations": json.dumps(locations)} if locations else {}
    for given in filters or []:
        field, sign, values = given.partition("=")
        if not sign or not field.strip():
            raise ValueError(f"not FIELD=VALUES: {given}")
        out[f"{PREFIX}{field.strip()}"] = json.dumps([v.strip() for v in values.split(",") if v.strip()])
    return out
