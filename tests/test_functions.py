from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import structure as sx
from tesserae.functions import text as tx
from tesserae.functions import vectors as vx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_rank_tokens(spark):
    assert one(spark, tx.rank_tokens(F.col("t")), t="The Co-op's a x_1 café, ÉTÉ!") == ["co", "op", "x_1", "café", "été"]
    assert one(spark, tx.rank_tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    ("a", "b", "answer", "prompt"),
    [("", "", 1.0, 0.0), ("x", "", 0.0, 0.0), ("the cat", "The  cat!", 1.0, 1.0), ("co-op", "coop", 1.0, 0.0), ("a b b", "b c", 0.4, 0.4)],
)
def test_f1(spark, a, b, answer, prompt):
    assert one(spark, tx.answer_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(answer)
    assert one(spark, tx.prompt_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(prompt)


def test_sentences_and_cells(spark):
    assert one(spark, tx.sentences(F.col("t")), t=" One. Two!\nThree? ") == ["One.", "Two!", "Three?"]
    assert one(spark, tx.cell_text(F.col("t")), t="a\n\tb " + "x" * 600) == ("a b " + "x" * 600)[:500]
    assert one(spark, tx.ascii_title(F.col("t")), t="Città (it) of  Rome") == "Citt of Rome"


@pytest.mark.parametrize(
    ("text", "like"),
    [
        ("<TABLE>", True),
        ("<li>a<li>b<li>c", True),
        ("<li>a<li>b", False),
        ("a\tb\nc\nd", True),
        ("a|b\nc|d|e\nf|g", True),
        ("one two three\nfour five six\nseven eight nine\nten eleven twelve", True),
        ("one line", False)
    ],
)
def test_table_like(spark, text, like):
    assert one(spark, tx.table_like(F.col("t")), t=text) is like


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.l2_normalized(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vx.l2_normalized(zero)) == [0.0, 0.0]
    assert one(spark, vx.fitted(v, 3)) == [3.0, 4.0, 0.0]
    assert one(spark, vx.fitted(v, 1)) == [3.0]
    assert one(spark, vx.cosine(v, zero)) == 0.0
    assert one(spark, vx.inverse_distance(v, zero)) == pytest.approx(1 / 26)
    assert one(spark, vx.unit_interval(F.lit(-3.0))) == 0.0


def test_hash_vector(spark):
    import hashlib

    want = [b / 255 for b in hashlib.sha256(b"abc").digest()]
    got = one(spark, vx.hash_vector(F.col("t"), 40), t="abc")
    assert got == pytest.approx(want + want[:8])


def test_hints(spark):
    assert one(spark, sx.query_structure(F.col("t")), t="What width? sometimes") == "Expected structure: has_temporal_data"
    assert one(spark, sx.query_structure(F.col("t")), t="hm") == "General table structure query"


def test_normalized_structure(spark):
    s = F.expr(
        "named_struct('table_description', '', 'columns', array(named_struct('name','a','type',cast(null as string),'samples',array('x',' '))), 'rows', 3, 'patterns', array('keyed'))"
    ).cast(sx.STRUCTURE)
    assert one(spark, sx.normalized_structure(s)) == "Columns: a (unknown): x | Patterns: keyed, narrow, small | Rows: 3"
    assert one(spark, sx.structure_text(s)) == "Table:  Columns: a (unknown): x,   Patterns: keyed Rows: 3"


def test_number(spark):
    assert one(spark, tx.number(F.col("t")), t="0.5") == 0.5
    assert one(spark, tx.number(F.col("t")), t="none") == 0.0
    assert math.isclose(one(spark, tx.number(F.lit(None).cast("string"), 2.0)), 2.0)


def test_f1_counts_words_as_multisets(spark):
    from collections import Counter
    from random import Random

    draw = Random(5)
    for size in (0, 1, 7, 60):
        a, b = ([draw.choice("abcdefgh") + draw.choice(("", "1", "10")) for _ in range(size)] for _ in range(2))
        shared = sum((Counter(a) & Counter(b)).values())
        got = one(spark, tx.shared_count(F.split("a", " "), F.split("b", " ")), a=" ".join(a), b=" ".join(b))
        assert got == (shared if size else 1)  # a split of an empty text is one empty text


def test_f1_of_null_texts_is_that_of_sql(spark):
    import duckdb

    from tesserae.plans import text as plans

    rows = [("a b", None), (None, "a"), (None, None), ("", None), (None, ""), ("", ""), ("a a b", "b a a a")]
    spoken = [(i, t, ("user", "assistant")[t], x) for i, pair in enumerate(rows) for t, x in enumerate(pair)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", spoken)
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(rows)], "conv_id long, q string, a string")
    for name, f1 in (("answer_f1", tx.answer_f1(F.col("q"), F.col("a"))), ("prompt_f1", tx.prompt_f1(F.col("a"), F.col("q")))):
        got = {r[0]: r[1] for r in df.select("conv_id", F.round(f1, 6)).collect()}
        assert got == {r[0]: r[2] for r in con.execute(plans.SQL[name]).fetchall()}


def test_f1_of_long_texts_is_not_quadratic(spark):
    import time

    a = " ".join(f"w{i}" for i in range(20_000))
    began = time.monotonic()
    assert one(spark, tx.answer_f1(F.col("a"), F.col("b")), a=a, b=a) == 1.0
    assert time.monotonic() - began < 30


def test_vectors_are_measured_once(spark):
    """A length that each number of a vector computes again makes the work grow with the square of the dimension."""
    import time

    long_ = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("double")).alias("v"))
    for normal in (vx.l2_normalized, vx.query_normalized):
        began = time.monotonic()
        got = long_.select(normal(F.col("v")).alias("v")).select(vx.norm(F.col("v")).alias("n")).first()["n"]
        assert got == pytest.approx(1.0) and time.monotonic() - began < 10
