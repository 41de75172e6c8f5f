from __future__ import annotations

import json

from test_sources import nq as record

from tesserae import cli


def nq(**more):
    tokens = "<Table> <Tr> <Td> cell </Td> </Tr> </Table> b".split()
    candidates = [{"start_token": 0, "end_token": 7, "top_level": True}]
    annotations = [{"long_answer": {"start_token": 0, "end_token": 7, "candidate_index": 0}, "short_answers": []}]
    return record(document_tokens=[{"token": t} for t in tokens], long_answer_candidates=candidates, annotations=annotations, **more)


def test_tables_collection_evaluation(spark, tmp_path, capsys):
    (tmp_path / "nq.jsonl").write_text("\n".join([nq(), nq(example_id="f", question_text="other question"), "junk"]))
    assert cli.main(["tables", "--input", str(tmp_path / "nq.jsonl"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/processed_tables")).count() == 2
    assert cli.main(
        [
            "collection",
            "--tables",
            str(tmp_path / "out/processed_tables"),
            "--chunks",
            str(tmp_path / "out/retrieval_chunks"),
            "--output-dir",
            str(tmp_path / "beir"),
            "--chunk-types",
            "full_table"
        ]
    ) == 0
    assert "corpus" in capsys.readouterr().out
    config = {
        "retrieval": {"stages": [{"name": "coarse", "dimension": 16, "top_k": 5, "weight": 1.0}], "epsilon_bm25": 0.2},
        "cross_encoder": {"top_n": 3},
        "use_graph_rerank": True,
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    args = [
        "evaluate",
        "--dataset-root",
        str(tmp_path / "beir"),
        "--config",
        str(tmp_path / "c.json"),
        "--ks",
        "1",
        "3",
        "--save-results",
        str(tmp_path / "res"),
        "--cache-dir",
        str(tmp_path / "cache")
    ]
    for _ in range(2):
        assert cli.main(args) == 0
        assert "2 queries" in capsys.readouterr().out
    rows = {(r["stage"], r["k"]): r for r in spark.read.json(str(tmp_path / "res/metrics")).collect()}
    assert rows["final", 3]["recall"] == 1.0 and rows["coarse", 3]["queries"] == 2


def test_run_and_chat(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("The red fox jumps.")
    (tmp_path / "c.json").write_text(json.dumps({"retrieval": {"stages": [{"name": "s", "dimension": 8, "top_k": 2, "weight": 1.0}]}}))
    assert cli.main(["run", "--source", str(tmp_path / "docs"), "--question", "red fox?", "--config", str(tmp_path / "c.json")]) == 0
    assert "a__00000" in capsys.readouterr().out
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/p.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Rome office opens at nine) Tj ET\nendstream\nendobj\n")
    (tmp_path / "e.jsonl").write_text(json.dumps({"question": "When?", "answer": "Rome office opens at nine"}))
    args = [
        "chat",
        "--source",
        str(tmp_path / "pdf"),
        "--question",
        "When does it open?",
        "--config",
        str(tmp_path / "c.json"),
        "--filter",
        "document_type=HR, Financial, Technical, Memo",
        "--examples",
        str(tmp_path / "e.jsonl"),
        "--steps",
        "1",
        "--save-chunks",
        str(tmp_path / "chunks")
    ]
    assert cli.main(args) == 0
    out = capsys.readouterr().out
    assert "p.pdf" in out and "Rome office" in out
    assert spark.read.json(str(tmp_path / "chunks")).count() == 1
