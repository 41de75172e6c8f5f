from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from tesserae import config
from tesserae.operators import chunking
from tesserae.sources import beir, ingest, store, tables


def test_text_and_json(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("Ä text\nwith lines", encoding="utf-8")
    (tmp_path / "t/sub/b.txt").write_text("b")
    rows = {r["doc_id"]: r for r in ingest.documents(spark, str(tmp_path / "t"), metadata={"k": 1}).collect()}
    assert rows["a"]["text"] == "Ä text\nwith lines"
    assert rows["b"]["metadata"] == {"k": "1", "source_path": str(tmp_path / "t/sub/b.txt")}
    lines = [
        {"id": "x", "text": "one", "reliability": "0.8"},
        {"id": 0, "doc_id": "y", "text": "two"},
        {"id": "", "text": "three", "n": {"a": 1}}
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r["text"]: r for r in ingest.documents(spark, str(tmp_path / "d.jsonl")).collect()}
    assert got["one"]["doc_id"] == "x" and got["one"]["metadata"] == {"reliability": "0.8"}
    assert got["two"]["doc_id"] == "y" and got["two"]["metadata"] == {"doc_id": "y"}
    assert len(got["three"]["doc_id"]) == 64 and got["three"]["metadata"] == {"n": '{"a":1}'}
    (tmp_path / "bad.jsonl").write_text('{"id": 1}')
    with pytest.raises(PySparkException):
        ingest.documents(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        ingest.documents(spark, str(tmp_path / "d.csv"))


def test_numbering(spark):
    rows = spark.range(1000).repartition(7)
    got = ingest.numbered(rows, "place").collect()
    assert sorted(r["place"] for r in got) == list(range(1000))
    got = ingest.numbered(rows, "place", ["id"]).collect()
    assert all(r["place"] == r["id"] for r in got)
    norm = ingest.normalized(
        spark.createDataFrame([("", "a", None), ("k", "b", {"m": "1"})], "doc_id string, text string, metadata map<string,string>")
    ).collect()
    assert {r["doc_id"] for r in norm} >= {"k"} and any(r["doc_id"].startswith("doc-0000000") for r in norm)


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","title":"T","text":"x"}\n{"_id":"1","title":"","text":"last","table_id":"t"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q","text":"ask","more":1}\n')
    (tmp_path / "qrels/test.tsv").write_text("q\t0\t1\t1\n")
    data = beir.split(spark, str(tmp_path))
    assert [(r["doc_id"], r["text"], r["metadata"]) for r in data.corpus.collect()] == [("1", "last", {"table_id": "t"})]
    assert data.qrels.first().asDict() == {"query_id": "q", "doc_id": "1", "relevance": 1.0}
    (tmp_path / "qrels/bad.tsv").write_text("query-id\tcorpus-id\tscore\n")
    with pytest.raises(PySparkException):
        beir.qrels(spark, str(tmp_path / "qrels/bad.tsv")).collect()


def test_beir_keeps_every_line(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "T", "x", "t"), ("1", "T", "y", "t"), ("1", "T", "y", "t")], "_id string, title string, text string, table_id string")
    asked = spark.createDataFrame([("q", "a"), ("q", "b")], "_id string, text string")
    judged = spark.createDataFrame([("q", "1", 1.0)], "query_id string, doc_id string, relevance double")
    beir.write(beir.Split(corpus, asked, judged), str(tmp_path))
    data = beir.split(spark, str(tmp_path), every=True)
    assert sorted((r["doc_id"], r["text"], r["metadata"]["table_id"]) for r in data.corpus.collect()) == [("1", "T\n" + x, "t") for x in "xyy"]
    assert sorted(map(tuple, data.queries.collect())) == [("q", "a"), ("q", "b")]
    assert beir.split(spark, str(tmp_path)).corpus.count() == 1


def nq(**more):
    tokens = ["<Table>", "<Tr>", "a", "</Tr>", "</Table>", "b"]
    base = {
        "example_id": "e",
        "question_text": "q",
        "document_tokens": [{"token": t} for t in tokens],
        "long_answer_candidates": [
            {"start_token": 0, "end_token": 5, "top_level": True},
            {"start_token": 5, "end_token": 6, "top_level": True}
        ],
        "annotations": [
            {"long_answer": {"start_token": 5, "end_token": 6, "candidate_index": 1}, "short_answers": []},
            {"long_answer": {"start_token": 0, "end_token": 5, "candidate_index": 0}, "short_answers": [{"start_token": 2, "end_token": 3}]}
        ],
    }
    return json.dumps(base | more)


def test_interactions(spark, tmp_path):
    lines = [
        nq(),
        "not json",
        nq(annotations=[{"long_answer": {"start_token": -1, "end_token": -1, "candidate_index": -1}, "short_answers": []}]),
        nq(long_answer_candidates=[]),
        nq(annotations=[])
    ]
    (tmp_path / "n.jsonl").write_text("\n".join(lines))
    records = tables.nq_records(spark, str(tmp_path / "n.jsonl"))
    rows = tables.interactions(records).collect()
    assert len(rows) == 1 and rows[0]["table_text"] == "<Table> <Tr> a </Tr> </Table>" and rows[0]["answers"] == ["a"]
    counts = tables.extraction_counts(records, tables.interactions(records)).first()
    assert (counts["total"], counts["candidates"], counts["extracted"]) == (4, 3, 1)


def test_prompt_examples(spark, tmp_path):
    rows = [{"question": "a", "answer": "x"}, {"question": "", "answer": "y"}, {"question": "c", "ideal_answer": "z", "query_id": "k"}]
    for name, text in (
        ("l.jsonl", "\n".join(map(json.dumps, rows))),
        ("a.json", json.dumps(rows)),
        ("o.json", json.dumps({"examples": rows})),
    ):
        (tmp_path / name).write_text(text)
        got = sorted(
            (r["query_id"], r["question"], r["reference_answer"]) for r in tables.prompt_examples(spark, str(tmp_path / name)).collect()
        )
        assert got == [("k", "c", "z"), ("textgrad-0000", "a", "x")], name


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    key = store.content_key({"x": df}, {"a": 1})
    assert key == store.content_key({"x": df.orderBy("t", ascending=False)}, {"a": 1}) != store.content_key({"x": df}, {"a": 2})
    calls = []

    def build():
        calls.append(1)
        return {"x": df}

    for _ in range(2):
        assert store.load_or_build(spark, str(tmp_path), key, ["x"], build)["x"].count() == 2
    assert len(calls) == 1


def test_environment(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# no\nTESSERAE_A='1'\nTESSERAE_B=2\nnothing\n")
    monkeypatch.setenv("TESSERAE_B", "kept")
    monkeypatch.setenv("TESSERAE_A", "x")
    monkeypatch.delenv("TESSERAE_A")
    (tmp_path / "sub").mkdir()
    assert store.load_environment(str(tmp_path / "sub")) == {"TESSERAE_A": "1"}
    assert store.load_environment(str(tmp_path / "sub")) == {}


def test_config():
    got = config.from_dict(
        {
            "retrieval": {"stages": [{"name": "a", "dimension": 8, "top_k": 5, "weight": 1.0}], "epsilon_bm25": 0.1},
            "cross_encoder": {"top_n": 3},
            "unknown": 1,
            "chunking": None,
        }
    )
    assert got.retrieval.stages[0].dimension == 8 and got.cross_encoder.top_n == 3 and got.chunking.max_tokens == 512
    with pytest.raises(ValueError):
        _ = config.Chunking(4, 4).stride
    with pytest.raises(ZeroDivisionError):
        _ = config.Retrieval(lambda_similarity=0, zeta_structural_similarity=0).total_weight


def test_chunks(spark):
    docs = spark.createDataFrame([("d", " ".join(map(str, range(10)))), ("e", " "), ("f", None)], "doc_id string, text string")
    rows = chunking.token_chunks(docs, config.Chunking(4, 1)).orderBy("chunk_id").collect()
    assert [r["text"] for r in rows] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"]
    assert rows[0]["chunk_id"] == "d__00000" and rows[3]["metadata"] == {"chunk_index": "3"}


def test_texts_are_split_once(spark):
    """A filter that splits each text again, and tokens as a column, made half of the time of chunking."""
    docs = spark.createDataFrame([("d", "\t a  b\u000b\n c\u00a0d "), ("e", "\n"), ("f", ""), ("g", None)], "doc_id string, text string")
    rows = chunking.token_chunks(docs, config.Chunking(2, 1))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted((r["chunk_id"], r["text"], r["token_count"]) for r in rows.collect()) == [
        ("d__00000", "a b", 2), ("d__00001", "b c\u00a0d", 2), ("d__00002", "c\u00a0d", 1),
    ]


def test_character_chunks(spark):
    text = "\n\n".join("word " * 30 for _ in range(8))
    pieces = chunking.split_characters(text, 200, 50)
    assert all(len(p) <= 200 for p in pieces) and len(pieces) > 5
    assert chunking.split_characters("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    assert chunking.character_chunks(docs, 200, 50).count() == len(pieces)


def test_records_are_parsed_once(spark, tmp_path):
    """Parsing again for each field, filter and answer is what made a large collection run out of time."""
    from tesserae.sources import tables

    (tmp_path / "r.jsonl").write_text("")
    rows = tables.interactions(tables.nq_records(spark, str(tmp_path / "r.jsonl")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert rows.count() == 0
