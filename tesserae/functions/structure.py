"""Expressions about the structure of tables, and about what a question hints at.

Structure records: struct<table_description:string, columns:array<struct<name,type,samples>>, rows:int, patterns:array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = "array<struct<name:string,type:string,samples:array<string>>>"
STRUCTURE = f"struct<table_description:string,columns:{COLUMNS},rows:int,patterns:array<string>>"

#: Hint and the words (as substrings) that give it.
HINTS = (
    ("has_columns", ("column", "columns", "field", "fields")),
    ("has_rows", ("row", "rows", "record", "records")),
    ("has_identifiers", ("name", "title", "label")),
    ("has_numeric_data", ("number", "count", "amount", "value")),
    ("has_temporal_data", ("date", "time", "year", "month")),
)
#: The richer set of hints.
RICH_HINTS = (
    ("column-focused", ("column", "columns", "field", "fields", "attribute", "attributes")),
    ("row-focused", ("row", "rows", "record", "records", "entry", "entries")),
    ("has-identifiers", ("name", "title", "label", "id", "identifier")),
    ("has-numeric", ("number", "count", "amount", "value", "price", "cost")),
    ("has-temporal", ("date", "time", "year", "month", "day", "when")),
    ("has-categorical", ("category", "type", "kind", "class", "group")),
    ("comprehensive", ("all", "every", "total", "complete", "full")),
    ("selective", ("first", "last", "top", "bottom", "few", "some")),
    ("comparative", ("compare", "comparison", "versus", "vs", "between")),
    ("tabular", ("list", "table", "chart", "data")),
)


def _hinted(text: Column, groups, prefix: str, nothing: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in groups]))
    return F.when(F.size(found) > 0, F.concat(F.lit(prefix), F.array_join(found, ", "))).otherwise(F.lit(nothing))


def query_structure(text: Column) -> Column:
    """What table a question expects, as a text to embed."""
    return _hinted(text, HINTS, "Expected structure: ", "General table structure query")


def rich_query_structure(text: Column) -> Column:
    return _hinted(text, RICH_HINTS, "Query structure: ", "General table query")


def structure_text(s: Column) -> Column:
    """A structure record on one line; parts that are absent (null) are left out."""
    column = lambda c: F.concat(c["name"], F.lit(" ("), F.coalesce(c["type"], F.lit("unknown")), F.lit("): "), F.array_join(F.slice(F.coalesce(c["samples"], F.array().cast("array<string>")), 1, 3), ", "))
    parts = F.array(
        F.concat(F.lit("Table: "), s["table_description"]),
        F.when(F.size(s["columns"]) > 0, F.concat(F.lit("Columns: "), F.array_join(F.transform(s["columns"], column), " | "))),
        F.when(F.size(s["patterns"]) > 0, F.concat(F.lit("Patterns: "), F.array_join(s["patterns"], ", "))),
        F.concat(F.lit("Rows: "), s["rows"].cast("string")),
    )
    return F.array_join(F.array_compact(parts), " ")


def normalized_structure(s: Column) -> Column:
    """The other rendering: short description and samples, size and width as patterns, patterns sorted."""
    said = F.trim(s["table_description"])
    description = F.when(F.length(said) > 200, F.concat(F.substring(said, 1, 200), F.lit("..."))).otherwise(said)

    def column(c: Column) -> Column:
        samples = F.filter(F.slice(F.coalesce(c["samples"], F.array().cast("array<string>")), 1, 3), lambda x: x.rlike(r"\S"))
        shown = F.when(
            F.size(samples) > 0,
            F.concat(F.lit(": "), F.array_join(F.transform(samples, lambda x: F.substring(x, 1, 50)), ", ")),
        ).otherwise(F.lit(""))
        return F.concat(c["name"], F.lit(" ("), F.coalesce(c["type"], F.lit("unknown")), F.lit(")"), shown)

    named = F.filter(s["columns"], lambda c: c["name"] != "")
    size = F.when(s["rows"] > 100, F.lit("large")).when(s["rows"] < 5, F.lit("small"))
    width = F.when(F.size(s["columns"]) > 8, F.lit("wide")).when(F.size(s["columns"]) <= 2, F.lit("narrow"))
    patterns = F.array_sort(
        F.array_distinct(F.array_compact(F.concat(F.coalesce(s["patterns"], F.array().cast("array<string>")), F.array(size, width))))
    )
    parts = F.array(
        F.when(description.isNotNull() & (s["table_description"] != ""), F.concat(F.lit("Description: "), description)),
        F.when(F.size(named) > 0, F.concat(F.lit("Columns: "), F.array_join(F.transform(named, column), " | "))),
        F.when(F.size(patterns) > 0, F.concat(F.lit("Patterns: "), F.array_join(patterns, ", "))),
        F.concat(F.lit("Rows: "), s["rows"].cast("string")),
    )
    return F.array_join(F.array_compact(parts), " | ")


def cache_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))
