"""Question records with tables: extraction, chunk files, prompt examples, structure records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import structure, text as tx
from .ingest import numbered


def interactions(records: DataFrame) -> DataFrame:
    """Of each record the first annotation whose long answer is a top-level, table-like candidate.

    records: schemas.NQ_RECORD. Records without one give no row.
    """
    tops = F.filter("long_answer_candidates", lambda c: c["top_level"])
    records = records.where(F.size(tops) > 0)
    span = lambda a, b: F.array_join(F.transform(F.slice("document_tokens", a + 1, F.greatest(F.lit(0), b - a)), lambda t: t["token"]), " ")

    def read(a):
        answer = a["long_answer"]
        at = answer["candidate_index"]
        there = (at >= 0) & (at < F.size("long_answer_candidates"))
        candidate = F.when(there, F.try_element_at("long_answer_candidates", at + 1))
        first, last = candidate["start_token"], candidate["end_token"]
        usable = F.coalesce(candidate["top_level"] & (first >= 0) & (last > first) & (last <= F.size("document_tokens")), F.lit(False))
        body = F.when(usable, span(first, last))
        answers = F.transform(
            F.filter(a["short_answers"], lambda s: (s["start_token"] >= 0) & (s["end_token"] > s["start_token"])),
            lambda s: span(s["start_token"], s["end_token"]),
        )
        return F.struct(
            body.alias("table_text"),
            answers.alias("answers"),
            first.alias("table_start_token"),
            last.alias("table_end_token"),
            answer["start_token"].alias("long_answer_start"),
            answer["end_token"].alias("long_answer_end"),
        )

    found = F.filter(F.transform("annotations", read), lambda x: x["table_text"].isNotNull() & tx.table_like(x["table_text"]))
    rows = records.select(
        F.coalesce("example_id", F.lit("unknown")).alias("example_id"),
        F.col("question_text").alias("question"),
        tx.once(F.try_element_at(found, F.lit(1))).alias("x"),
    )
    return rows.where("x is not null").select("example_id", "question", "x.*")


def nq_records(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Records from JSON lines, gzip too; lines that aren't JSON are left out. sample: the first so many lines."""
    lines = spark.read.text(path)
    if sample:
        lines = numbered(lines, "_place").where(F.col("_place") < sample)
    return lines.select(
        tx.once(F.from_json("value", schemas.NQ_RECORD, {"mode": "PERMISSIVE"})).alias("r")
    ).where("r.annotations is not null or r.document_tokens is not null").select("r.*")


def extraction_counts(records: DataFrame, found: DataFrame) -> DataFrame:
    seen = records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.exists("long_answer_candidates", lambda c: c["top_level"])).alias("candidates"),
    )
    got = found.agg(F.count(F.lit(1)).alias("extracted"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return seen.join(got).withColumns(
        {"candidate_rate": rate(F.col("candidates"), F.col("total")), "extraction_rate": rate(F.col("extracted"), F.col("total"))}
    )


def chunk_text() -> F.Column:
    """Content, else text, else the table as compact JSON."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(some("content"), some("text"), some("table"))


def table_chunks(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """id, chunk_type, table_id, text from chunk JSON lines, of some types."""
    f = F.from_json("value", "id string, chunk_id string, chunk_type string, table_id string, content string, text string, `table` string")
    rows = spark.read.text(path).select(f.alias("f")).select("f.*")
    if types:
        rows = rows.where(F.col("chunk_type").isin(*types))
    ident = F.coalesce("id", "chunk_id")
    return rows.select(
        ident.alias("id"),
        "chunk_type",
        F.coalesce("table_id", F.substring_index(ident, "_", 1)).alias("table_id"),
        chunk_text().alias("text"),
    )


def json_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def structures(chunks: DataFrame) -> DataFrame:
    """table_id and structure record from chunks of that type, the last (by id) of each table."""
    latest = Window.partitionBy("table_id").orderBy(F.desc("id"))
    kind = "struct<table_description:string,columns:map<string,struct<type:string,samples:array<string>>>,rows:int,patterns:array<string>>"
    rows = chunks.where("chunk_type = 'table_structure'").withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    parsed = rows.select("table_id", F.from_json("content", kind).alias("s"))
    columns = F.transform(
        F.map_entries("s.columns"),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), e["value"]["samples"].alias("samples")),
    )
    return parsed.select(
        "table_id",
        F.struct(
            F.col("s.table_description"),
            columns.alias("columns"),
            F.col("s.rows"),
            F.col("s.patterns"),
        ).cast(structure.STRUCTURE).alias("structure"),
    )


def prompt_examples(spark: SparkSession, path: str) -> DataFrame:
    """Questions with reference answers from JSON lines, a JSON list or an object with examples; incomplete ones go."""
    whole = spark.read.text(path, wholetext=True)
    kind = "struct<question:string,reference_answer:string,ideal_answer:string,answer:string,query_id:string,metadata:map<string,string>>"
    listed = F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})
    head = F.substring(tx.stripped(F.col("value")), 1, 1)
    held = F.get_json_object("value", "$.examples")
    by_line = F.transform(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"\S")), lambda x: F.from_json(x, kind))
    rows = F.when(head == "[", listed).when(held.isNotNull(), F.from_json(held, f"array<{kind}>")).otherwise(by_line)
    each = whole.select(F.posexplode(rows).alias("_i", "e")).select("_i", "e.*")
    answer = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("reference_answer", "ideal_answer", "answer")])
    ident = F.coalesce(F.when(F.col("query_id") != "", F.col("query_id")), F.format_string("textgrad-%04d", "_i"))
    return each.select(
        ident.alias("query_id"),
        "question",
        answer.alias("reference_answer"),
        "metadata",
    ).where("question != '' and reference_answer is not null")
