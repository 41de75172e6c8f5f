"""All named queries of the library's own operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import tables, text, vectors

QUERIES = {**text.QUERIES, **vectors.QUERIES, **tables.QUERIES}
SQL = {**text.SQL, **vectors.SQL, **tables.SQL}
