"""Each opN query over its whole table of the smallest size, against brute force that shares no code with the operators."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pytest

from tesserae.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def found(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, DATA).collect()}


def test_op1(spark):
    larger = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
    )
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secret_scans"](spark, larger).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for i, r in got.items():
        text = docs[i]["text"] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        spans = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("guess")] == spans
        some += bool(spans)
    assert some


def test_op2(spark, docs):
    got = found(spark, "op2_source_mixing")
    assert got.keys() == docs.keys()
    total, target = {}, {}
    for i, r in got.items():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[i]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        source = docs[i]["source"]
        total[source] = total.get(source, 0) + r["taken"]
        target[source] = r["target"]
        assert r["target"] <= 2 * r["source_size"] + 1e-6
    for source, want in target.items():
        assert total[source] == pytest.approx(want, rel=0.02, abs=16)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got.values()))


def test_op4(spark, docs):
    got = found(spark, "op4_suffix_array_dedup")
    assert got.keys() == docs.keys()
    seen, gone_somewhere = set(), 0
    for i in sorted(docs):
        data = (docs[i]["text"] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            part = data[p : p + 100]
            if part in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        r = got[i]
        assert (
            r["n_bytes"],
            r["n_removed"],
            r["n_spans"],
            r["kept_sha256"],
        ) == (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        gone_somewhere += sum(gone)
    assert gone_somewhere > 1000


def test_op5(spark, docs):
    got = found(spark, "op5_toxicity")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op7(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    model.no_truncation()
    got = found(spark, "op7_token_counts")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        text = docs[i]["text"] or ""
        n = len(model.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_op8(spark, docs):
    got = found(spark, "op8_media_columns")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        data = (docs[i]["text"] or "").encode()
        payload = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(data),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
        )
        assert r["media_bytes"] >= r["payload_bytes"] and re.fullmatch(
            "[0-9a-f]{64}",
            r["media_sha256"],
        ) and re.fullmatch("[0-9a-f]{16}", r["feature"])


def test_op10(spark, docs):
    got = found(spark, "op10_language_id")
    assert got.keys() == docs.keys()
    right = wrong = 0
    for i, r in got.items():
        text = docs[i]["text"] or ""
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and docs[i]["lang"] is not None:
            right, wrong = right + (r["lang_pred"] == docs[i]["lang"]), wrong + (r["lang_pred"] != docs[i]["lang"])
    assert right >= 0.9 * (right + wrong) and right
