from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import config
from tesserae.engine import Engine, Plugins
from tesserae.operators import bm25, embedding, evaluation, filters, fusion, generation, index, prompt_search, rerank, structural


def vectors(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} string, vector array<double>")


def test_top_k(spark):
    corpus = vectors(spark, "item_id", [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])])
    asked = vectors(spark, "query_id", [("q", [1.0, 0.0])])
    assert [(r["item_id"], r["stage_rank"]) for r in index.top_k(asked, corpus, 2).orderBy("stage_rank").collect()] == [("a", 1), ("c", 2)]
    assert [r["item_id"] for r in index.top_k(asked, corpus, 3, metric="inverse_l2").orderBy("stage_rank").collect()] == ["a", "c", "b"]
    assert {r["item_id"] for r in index.top_k_blocks(asked, corpus, 2).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        index.top_k(asked, corpus, 1, metric="other")
    assert index.top_k(asked, corpus.limit(0), 2).count() == 0


def test_top_k_blocks_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 3)
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(10)]
    items, asked = spark.createDataFrame(rows, "item_id long, vector array<double>"), spark.createDataFrame(
        rows,
        "query_id long, vector array<double>",
    )
    want = {(q, sorted(range(10), key=lambda i: (-np.dot(v, rows[i][1]), i))[0]) for q, v in rows}
    assert {(r["query_id"], r["item_id"]) for r in index.top_k_blocks(asked, items, 1).collect()} == want


def test_compare_many_queries(spark):
    asked = spark.range(5000).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("text"))
    held = spark.createDataFrame([("c", "a text")], "candidate_id string, text string")
    got = structural.compare(asked, held, 4)
    assert got.count() == got.select("query_id").distinct().count() == 5000


@pytest.mark.parametrize("metric", ["dot", "inverse_l2"])
def test_near_candidates(spark, metric):
    """At its defaults the cell search finds 0.9 of the exact neighbours; with all cells it finds all."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(10, 32))
    points = middle[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32)) * 0.8
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(str(i), [float(x) for x in v]) for i, v in enumerate(points)]
    corpus, asked = vectors(spark, "item_id", rows), vectors(spark, "query_id", rows[::50])
    pairs = lambda df: {(r["query_id"], r["item_id"]) for r in df.collect()}
    exact = pairs(index.top_k(asked, corpus, 10, metric=metric))
    assert len(exact & pairs(index.near_candidates(asked, corpus, 10, metric=metric))) / len(exact) >= 0.9
    assert pairs(index.near_candidates(asked, corpus, 10, metric=metric, probes=1000)) == exact
    assert index.near_candidates(asked, corpus.limit(0), 10).count() == 0


def test_cells_as_a_stage(spark):
    rows = [(str(i), "s", [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    held = spark.createDataFrame(rows, "chunk_id string, stage string, vector array<double>")
    asked = held.where("chunk_id in ('1', '2')").withColumnRenamed("chunk_id", "query_id")
    found = [
        index.search(
            asked,
            held,
            config.Retrieval(stages=(config.Stage("s", 3, 5, 1.0, search=how, probes=100),)),
        ) for how in ("exact", "cells")
    ]
    rows = [sorted((r["query_id"], r["chunk_id"], r["stage_rank"]) for r in f.collect()) for f in found]
    assert rows[0] == rows[1] and len(rows[0]) == 10


def test_stages_need_vectors(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    one = spark.createDataFrame([("a", "coarse", [1.0])], "chunk_id string, stage string, vector array<double>")
    with pytest.raises(ValueError, match="chunk b"):
        index.checked_stages(chunks, one, config.Retrieval())


def test_bm25(spark):
    docs = spark.createDataFrame(
        [("a", "cat cat dog"), ("b", "dog bird"), ("c", " "), ("d", "fish bird bird bird")],
        "id string, text string",
    )
    known = bm25.fit(docs, "id")
    assert known.n == 3 and known.mean_length == pytest.approx(3.0)
    asked = spark.createDataFrame([("q", "cat dog dog")], "query_id string, text string")
    got = {r["item_id"]: r["score"] for r in bm25.scores(asked, known).collect()}

    def part(tf, qtf, df, n):
        idf = max(0.1, math.log(max(1.1, (3 - df + 0.5) / (df + 0.5))))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3)) * qtf * 2.2 / (qtf + 1.2)

    assert got == pytest.approx({"a": part(2, 1, 1, 3) + part(1, 2, 2, 3), "b": part(1, 2, 2, 2)})
    row = spark.range(1).select(bm25.normalized(F.lit(None).cast("double"), 3.0).alias("x")).first()
    assert row["x"] == 0.5


def test_filters(spark):
    rows = [("json", '["HR", " "]'), ("list", "hr; Finance,,"), ("none", ";,")]
    got = {
        r["k"]: r["t"] for r in spark.createDataFrame(rows, "k string, v string").select(
            "k",
            filters.filter_terms(F.col("v")).alias("t"),
        ).collect()
    }
    assert got == {"json": ["hr"], "list": ["hr", "finance"], "none": []}
    meta = spark.createDataFrame([("HR dept", 1), ("Ops", 2)], "d string, i int").select(
        "i",
        F.create_map(F.lit("department"), F.col("d")).alias("m"),
    )
    wanted = filters.query_filters(
        F.create_map(F.lit("filter__department"), F.lit("hr"), F.lit("x"), F.lit("y"), F.lit("filter__none"), F.lit(","))
    )
    assert [r["i"] for r in meta.where(filters.matches(F.col("m"), wanted)).collect()] == [1]
    ranked = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("r", 1, False)], "query_id string, rank int, matched boolean")
    assert sorted((r["query_id"], r["rank"]) for r in filters.soft(ranked).collect()) == [("q", 2), ("r", 1)]
    assert filters.filter_metadata(["Rome"], ["a=b, c"]) == {"filter__locations": '["Rome"]', "filter__a": '["b", "c"]'}
    with pytest.raises(ValueError):
        filters.filter_metadata(None, ["nothing"])


def test_rerank(spark):
    rows = spark.createDataFrame(
        [("q", "cats", "a", "dogs run", 1, 0.9), ("q", "cats", "b", "cats run", 2, 0.8), ("q", "cats", "c", "other words", 3, 0.7)],
        "query_id string, question string, chunk_id string, text string, rank int, similarity double",
    )
    assert [(r["chunk_id"], r["rank"]) for r in rerank.pairs(rows, 2).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    assert rerank.pairs(rows, 0).count() == 3 and rerank.pairs(rows, 1, None).count() == 3
    got = {r["chunk_id"]: (r["rank"], r["degree"], round(r["similarity"], 6)) for r in rerank.graph(rows).collect()}
    assert got == {"a": (1, 1, 0.95), "b": (2, 1, 0.85), "c": (3, 0, 0.7)}
    model = rerank.pair_scorer(lambda: lambda pairs: [float(len(t)) for _, t in pairs], 2)
    assert rerank.pairs(rows, 1, model).first()["chunk_id"] == "c"


@pytest.mark.parametrize(("at", "mrr", "ndcg"), [(6, 1 / 6, 1 / math.log2(7)), (2, 0.5, 1 / math.log2(3))])
def test_metrics_of_one_hit(spark, at, mrr, ndcg):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 11)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame(
        [("q", f"d{at}", 1.0), ("q", "zero", 0.0), ("other", "d1", 1.0)],
        "query_id string, doc_id string, relevance double",
    )
    rows = evaluation.metrics(run, qrels, [1, 10]).collect()
    ten = next(r for r in rows if r["k"] == 10)
    assert (ten["precision"], ten["recall"]) == (0.1, 1.0) and ten["mrr"] == pytest.approx(mrr) and ten["ndcg"] == pytest.approx(ndcg)
    assert {r["query_id"] for r in rows} == {"q"}


def test_metrics_edges(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("n", "x", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 1.0), ("n", "y", 1.0)], "query_id string, doc_id string, relevance double")
    got = {(r["query_id"], r["k"]): r for r in evaluation.metrics(run, qrels, [5]).collect()}
    assert got["q", 5]["precision"] == 0.2 and got["q", 5]["recall"] == 0.5
    assert got["q", 5]["ndcg"] == pytest.approx(1 / math.log2(3)) and got["q", 5]["ndcg_full"] < got["q", 5]["ndcg"]
    assert (got["n", 5]["mrr"], got["n", 5]["ndcg"]) == (0.0, 0.0)
    again = spark.createDataFrame([("q", "d", 1), ("q", "d", 2), ("q", "e", 3)], "query_id string, doc_id string, rank int")
    assert sorted((r["doc_id"], r["rank"]) for r in evaluation.unique_documents(again, ["query_id"]).collect()) == [("d", 1), ("e", 2)]


def test_generation(spark):
    asked = spark.createDataFrame([("q", "Why?"), ("r", "How?")], "query_id string, text string")
    ranked = spark.createDataFrame(
        [("q", "b", " second ", 2), ("q", "a", "first", 1)],
        "query_id string, chunk_id string, text string, rank int",
    )
    rows = {r["query_id"]: r for r in generation.answers(generation.contexts(asked, ranked), "S").collect()}
    assert rows["q"]["prompt"] == "S\n\nContext:\n[a] first\n\n[b] second\n\nQuestion: Why?\nAnswer:"
    assert rows["r"]["prompt"] == f"S\n\nContext:\n{generation.NO_CONTEXT}\n\nQuestion: How?\nAnswer:"
    assert rows["q"]["answer"] == f"{generation.NO_MODEL}\n- [a] first...\n- [b]  second ..." and rows["q"]["references"] == ["a", "b"] and rows["q"]["metadata"] == {"retrieved_chunks": 2.0}
    model = generation.generator(lambda: lambda prompts: ["" if "How" in p else "said" for p in prompts])
    rows = {r["query_id"]: r["answer"] for r in generation.answers(generation.contexts(asked, ranked), "S", model).collect()}
    assert rows == {"q": "said", "r": generation.NO_MODEL}


def test_prompt_search(spark):
    examples = spark.createDataFrame([("q", "red fox")], "query_id string, reference_answer string")
    held = generation.contexts(
        spark.createDataFrame([("q", "Which?")], "query_id string, text string"),
        spark.createDataFrame([], "query_id string, chunk_id string, text string, rank int"),
    )
    model = generation.generator(lambda: lambda prompts: ["red fox" if "magic" in p else "blue" for p in prompts])
    search = prompt_search.Search(instructions=("Use magic.", "Be brief."))
    best, history = prompt_search.optimize("Base ", held, examples, search, model)
    assert best == "Base\n\nUse magic." and [h["score"] for h in history] == [0.0, 1.0]
    trial = lambda score: prompt_search.Trial(1, score, str(score))
    assert prompt_search.chosen(trial(0.5), [trial(0.505), trial(0.6), trial(0.605)], 0.01).score == 0.6
    assert prompt_search.optimize(
        "Base",
        held,
        examples,
        prompt_search.Search(max_steps=0),
        model,
    )[1] == [{"step": 0, "score": 0.0, "prompt": "Base"}]
    with pytest.raises(ValueError):
        prompt_search.optimize("Base", held, examples.limit(0))


def test_multi_resolution(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0, 12.0])], "id string, vector array<double>")
    got = {r["dimension"]: r["vector"] for r in embedding.multi_resolution(rows, [2, 4], id_col="id").collect()}
    assert got[2] == pytest.approx([0.6, 0.8]) and got[4] == pytest.approx([3 / 13, 4 / 13, 12 / 13, 0.0])


def test_engine(spark, tmp_path):
    stages = (config.Stage("s", 32, 5, 1.0),)
    settings = config.Settings(
        chunking=config.Chunking(8, 2),
        retrieval=config.Retrieval(stages=stages, epsilon_bm25=0.5),
        cross_encoder=config.CrossEncoder(top_n=3),
        use_graph_rerank=True,
    )
    engine = Engine(spark, settings, Plugins())
    asked = spark.createDataFrame([("q", "red fox", {})], "query_id string, text string, metadata map<string,string>")
    with pytest.raises(RuntimeError):
        engine.retrieve(asked)
    docs = spark.createDataFrame([("a", "the red fox jumps over dogs"), ("b", "quiet water runs deep " * 4)], "doc_id string, text string")
    engine.add_documents(docs)
    key = engine.save(str(tmp_path))
    rows = engine.retrieve(asked).orderBy("rank").collect()
    assert rows[0]["chunk_id"] == "a__00000" and len(rows) == 3 and set(rows[0]["scores"]) >= {"combined", "bm25", "weighted"}
    assert "red fox" in engine.answer(asked).first()["answer"]
    other = Engine(spark, settings)
    assert other.load(str(tmp_path), key) and not other.load(str(tmp_path), "none")
    assert other.chunks.count() == engine.chunks.count()
    assert fusion.stage_sums(engine.search(asked), settings.retrieval).count() == engine.chunks.count() == 4


def test_engine_batches_and_models(spark, tmp_path):
    """A failing batch is left out; makers of models get their settings; saving goes where the settings say."""
    seen = tmp_path / "seen"

    def encoder(settings, model):
        return lambda: lambda texts: [[float(len(t)), float(settings.batch_size), 1.0] for t in texts]

    def generator(settings):
        return lambda: lambda prompts: [f"{settings.max_new_tokens} {settings.temperature}" for _ in prompts]

    stages = (config.Stage("s", 3, 5, 1.0, model_name="m"),)
    settings = config.Settings(
        retrieval=config.Retrieval(stages=stages),
        generation=config.Generation(max_new_tokens=7, temperature=0.5),
        cross_encoder=config.CrossEncoder(top_n=1),
        storage_dir=str(seen),
        run_name="r",
    )
    scorer = lambda settings: lambda: lambda pairs: [float(settings.top_n)] * len(pairs)
    engine = Engine(spark, settings, Plugins(make_encoder=encoder, make_generator=generator, make_scorer=scorer))
    good = spark.createDataFrame([("a", "the red fox")], "doc_id string, text string")
    bad = good.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    failed = engine.add_batches([good, bad, good.withColumn("doc_id", F.lit("b"))])
    assert [i for i, _ in failed] == [1], failed[0][1][:600]
    assert "broken" in failed[0][1] and engine.chunks.count() == 2
    asked = spark.createDataFrame([("q", "red fox")], "query_id string, text string")
    row = engine.retrieve(asked).collect()
    assert len(row) == 1 and row[0]["similarity"] == 1.0
    assert engine.answer(asked).first()["answer"] == "7 0.5"
    key = engine.save()
    assert (seen / "r" / key / "chunks").is_dir()


def test_structure_cache(spark, tmp_path):
    """A structure text is encoded once, whichever table says it and whenever it comes."""
    kind = "struct<table_description:string,columns:array<struct<name:string,type:string,samples:array<string>>>,rows:int,patterns:array<string>>"
    rows = [(t, (said, [], 3, [])) for t, said in (("a", "x"), ("b", "x"), ("c", "y"))]
    frame = spark.createDataFrame(rows, f"table_id string, structure {kind}")
    got = {r["table_id"]: r["vector"] for r in structural.cached_vectors(frame.where("table_id != 'c'"), str(tmp_path), 8).collect()}
    assert got["a"] == got["b"] and spark.read.parquet(f"{tmp_path}/structures-8/vectors").count() == 1
    other = structural.cached_vectors(frame, str(tmp_path), 8, lambda text, n: F.array_repeat(F.lit(9.0), n))
    found = {r["table_id"]: r["vector"] for r in other.collect()}
    assert found["a"] == got["a"] and found["c"] == [9.0] * 8
    plain = {r["table_id"]: r["vector"] for r in structural.structure_vectors(frame, 8).collect()}
    assert plain["a"] == got["a"]


def test_engine_tables(spark):
    from tesserae.operators import html_tables

    engine = Engine(
        spark,
        config.Settings(
            chunking=config.Chunking(enabled_chunk_types=("table_row",)),
            retrieval=config.Retrieval(stages=(config.Stage("s", 8, 5, 1.0),)),
        ),
    )
    html = "<table><tr><th>id</th><th>name</th></tr><tr><td>1</td><td>x</td></tr><tr><td>2</td><td>y</td></tr></table>"
    tables = html_tables.processed(
        spark.createDataFrame([("e", "q?", html, ["x"])], "example_id string, question string, table_text string, answers array<string>")
    )
    assert sorted(r["text"] for r in engine.add_tables(tables).collect()) == ["id: 1 | name: x", "id: 2 | name: y"]
    with pytest.raises(ValueError):
        Engine(spark, config.Settings(chunking=config.Chunking(enabled_chunk_types=("other",)))).add_tables(tables)


def test_seeded_vectors(spark):
    from tesserae.functions import vectors as vx

    rows = spark.createDataFrame([("a",), ("b",), (None,)], "t string").select(vx.seeded_vector(F.col("t"), 5).alias("v")).collect()
    assert all(len(r["v"]) == 5 and all(0 <= x < 1 for x in r["v"]) for r in rows) and rows[0]["v"] != rows[1]["v"]
    assert rows[0]["v"] == spark.createDataFrame([("a",)], "t string").select(vx.seeded_vector(F.col("t"), 5)).first()[0]


def test_streaming(spark, tmp_path):
    from tesserae.streaming import ingest as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"id":"a","text":"one two"}\n{"id":"b"}\n')
    settings = config.Settings(retrieval=config.Retrieval(stages=(config.Stage("s", 8, 5, 1.0),)))
    for _ in range(2):
        query = stream.index_stream(
            stream.json_stream(spark, str(tmp_path / "in")),
            settings,
            str(tmp_path / "out"),
            str(tmp_path / "check"),
        )
        query.awaitTermination(60)
        (tmp_path / "in/2.jsonl").write_text('{"id":"c","text":"three"}\n')
    assert {r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()} == {"a__00000", "c__00000"}
    assert spark.read.parquet(str(tmp_path / "out/vectors")).count() == 2


@pytest.mark.parametrize("metric", ["dot", "inverse_l2"])
def test_blocks_hold_bounded_scores(spark, monkeypatch, metric):
    """Parts of a few items, ties within and across them, ids that are texts: the same as all pairs sorted."""
    monkeypatch.setattr(index, "SCORES", 300)
    vectors = {f"v{i}": [float(i % 7), float(i % 5), float(i % 3)] for i in range(200)}
    items = spark.createDataFrame(list(vectors.items()), "item_id string, vector array<double>").repartition(3)
    asked = [(i, list(vectors[f"v{i}"])) for i in range(40)]
    rows = index.top_k_blocks(spark.createDataFrame(asked, "query_id int, vector array<double>"), items, 6, metric=metric).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    far = lambda a, b: 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    score = dot if metric == "dot" else far
    for i, q in asked:
        want = sorted(vectors, key=lambda n: (-round(score(q, vectors[n]), 12), n))[:6]
        assert [r["item_id"] for r in sorted(rows, key=lambda r: r["stage_rank"]) if r["query_id"] == i] == want


def test_texts_of_what_was_found_are_not_shuffled(spark):
    """The prompt search sent all documents through a shuffle, twice, for the few that were found."""
    from tesserae.plans import text as plans

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "item_id int, text string")
    top = spark.createDataFrame([(1, 7), (2, 9)], "query_id int, item_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plans._with_texts(top, docs)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert {(r["query_id"], r["text"]) for r in rows.collect()} == {(1, "t7"), (2, "t9")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
