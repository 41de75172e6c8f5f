"""Command lines: run, chat, evaluate, tables, collection."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .engine import Engine
from .operators import evaluation, filters, generation, html_tables, prompt_search, table_chunks
from .schemas import TABLE_CHUNK
from .sources import beir, ingest, store, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("tesserae").getOrCreate()


def settings(path: str | None) -> config.Settings:
    return config.from_dict(json.loads(Path(path).read_text(encoding="utf-8"))) if path else config.Settings()


def asked(spark: SparkSession, text: str, metadata: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([("q-0", text, metadata)], "query_id string, text string, metadata map<string,string>")


def run(args: argparse.Namespace) -> None:
    spark = session()
    engine = Engine(spark, settings(args.config))
    options = {"metadata": json.loads(args.metadata)} if args.metadata and not args.source.endswith(".jsonl") else {}
    engine.add_documents(engine.ingest_path(args.source, **options))
    for row in engine.answer(asked(spark, args.question, {})).select("answer", "references").collect():
        print(row["answer"], "\nReferences:", ", ".join(row["references"]))


def chat(args: argparse.Namespace) -> None:
    spark = session()
    engine = Engine(spark, settings(args.config))
    engine.add_documents(ingest.pdf_documents(spark, args.source))
    prompt = engine.settings.generation.system_prompt
    if args.examples:
        examples = tables.prompt_examples(spark, args.examples)
        queries = examples.select("query_id", F.col("question").alias("text"), "metadata")
        held = generation.contexts(queries, engine.retrieve(queries))
        prompt, history = prompt_search.optimize(prompt, held, examples, replace(prompt_search.Search(), max_steps=args.steps))
        print(json.dumps(history, indent=1))
    query = asked(spark, args.question, filters.filter_metadata(args.locations, args.filter))
    ranked = engine.retrieve(query)
    shown = ranked.select(
        "rank",
        "chunk_id",
        "similarity",
        F.col("metadata")["title"].alias("title"),
        F.substring("text", 1, 200).alias("preview"),
    )
    for row in shown.orderBy("rank").limit(args.show).collect():
        print(f"{row['rank']}. {row['title']} [{row['chunk_id']}] {row['similarity']:.4f}\n   {row['preview']}")
    if args.save_chunks:
        ranked.drop("scores").write.mode("overwrite").json(args.save_chunks)
    print(
        generation.answers(
            generation.contexts(query, ranked),
            prompt,
            engine.plugins.generator_of(engine.settings.generation),
        ).first()["answer"]
    )


def evaluate(args: argparse.Namespace) -> None:
    spark = session()
    began = time.time()
    engine = Engine(spark, settings(args.config))
    data = beir.split(spark, args.dataset_root)
    if args.cache_dir:
        key = store.content_key({"corpus": data.corpus}, engine.settings)
        if args.rebuild or not engine.load(args.cache_dir, key):
            engine.add_documents(data.corpus)
            store.save({"chunks": engine.chunks, "vectors": engine.vectors}, args.cache_dir, key)
            engine.load(args.cache_dir, key)
    else:
        engine.add_documents(data.corpus)
    queries = evaluation.first_queries(data.queries, args.max_queries, "query_id").join(
        evaluation.relevant(data.qrels).select("query_id").distinct(),
        "query_id",
        "left_semi",
    )
    ranked, hits = engine.retrieve_with_details(queries)
    docs = engine.chunks.select("chunk_id", "doc_id")
    final = evaluation.unique_documents(
        ranked.select("query_id", "chunk_id", "rank").join(docs, "chunk_id").withColumn("stage", F.lit("final")),
        ["stage", "query_id"],
    )
    staged = evaluation.unique_documents(
        hits.select("query_id", "stage", "chunk_id", F.col("stage_rank").alias("rank")).join(docs, "chunk_id"),
        ["stage", "query_id"],
    )
    per = evaluation.metrics(final.unionByName(staged), data.qrels, args.ks, ("stage",))
    means = evaluation.averages(per, ("stage",)).cache()
    for row in means.orderBy("stage", "k").collect():
        print(row.asDict())
    n = means.agg(F.max("queries")).first()[0] or 0
    print(f"{n} queries, {n / max(time.time() - began, 1e-9):.3f} a second, with indexing")
    if args.save_results:
        store.write_results(means, per, args.save_results)


def process_tables(args: argparse.Namespace) -> None:
    spark = session()
    records = tables.nq_records(spark, args.input, args.max_entries or None)
    found = tables.interactions(records)
    done = html_tables.processed(found)
    done.write.mode("overwrite").parquet(f"{args.output}/processed_tables")
    done = spark.read.parquet(f"{args.output}/processed_tables")
    chunks = table_chunks.general_chunks(done)
    store.write_chunks(chunks, f"{args.output}/retrieval_chunks")
    tables.extraction_counts(records, found).show(truncate=False)
    store.chunk_statistics(chunks).orderBy("chunk_type").show(truncate=False)


def collection(args: argparse.Namespace) -> None:
    spark = session()
    chunks = spark.read.schema(TABLE_CHUNK).json(args.chunks)
    if args.chunk_types:
        chunks = chunks.where(F.col("chunk_type").isin(*args.chunk_types))
    done = spark.read.parquet(args.tables)
    data = beir.Split(beir.corpus_rows(chunks), beir.query_rows(done), beir.qrel_rows(done, chunks))
    kept, counts = beir.restricted(data, args.chunk_types)
    beir.write(kept, args.output_dir)
    counts.show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run")
    p.set_defaults(call=run)
    p.add_argument("--source", required=True)
    p.add_argument("--question", required=True)
    p.add_argument("--config")
    p.add_argument("--metadata")
    p = sub.add_parser("chat")
    p.set_defaults(call=chat)
    p.add_argument("--source", required=True)
    p.add_argument("--question", required=True)
    p.add_argument("--config")
    p.add_argument("--locations", nargs="*")
    p.add_argument("--filter", action="append")
    p.add_argument("--examples")
    p.add_argument("--steps", type=int, default=3)
    p.add_argument("--show", type=int, default=5)
    p.add_argument("--save-chunks")
    p = sub.add_parser("evaluate")
    p.set_defaults(call=evaluate)
    p.add_argument("--dataset-root", required=True)
    p.add_argument("--config")
    p.add_argument("--ks", type=int, nargs="+", default=[1, 3, 5, 10])
    p.add_argument("--max-queries", type=int)
    p.add_argument("--save-results")
    p.add_argument("--cache-dir")
    p.add_argument("--rebuild", action="store_true")
    p = sub.add_parser("tables")
    p.set_defaults(call=process_tables)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--max-entries", type=int, default=0)
    p = sub.add_parser("collection")
    p.set_defaults(call=collection)
    p.add_argument("--tables", required=True)
    p.add_argument("--chunks", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--chunk-types", nargs="*")
    return top


def main(argv: list[str] | None = None) -> int:
    store.load_environment()
    args = parser().parse_args(argv)
    args.call(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
