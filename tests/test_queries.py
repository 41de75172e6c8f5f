"""Every named query that SQL can express gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tesserae.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def shared_id(tmp_path_factory):
    """Lines of two orders that share a table_id, and of a third. Their first lines are alike: the SQL leaves open which of
    two lines at one place comes first."""
    folder = tmp_path_factory.mktemp("shared")
    con = duckdb.connect()
    con.sql(
        """create table lineitem as select k::bigint as l_orderkey, p::bigint as l_partkey, 7::bigint as l_suppkey, n::int as l_linenumber,
        n::double as l_quantity, p + 0.5::double as l_extendedprice, 'N' as l_returnflag
        from (values (271769, 4, 11), (7733795, 4, 11), (7733795, 5, 12), (7733795, 6, 13), (5, 1, 11)) t(k, n, p)"""
    )
    con.sql(f"copy lineitem to '{folder}/lineitem.parquet' (format parquet)")
    return con, str(folder)


@pytest.mark.parametrize("name", ["beir_corpus", "beir_files", "beir_qrels", "beir_filter", "chunk_statistics"])
def test_orders_that_share_a_table_id(spark, shared_id, name):
    con, folder = shared_id
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    want = con.sql(catalogue.SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(got.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def tied_id(tmp_path_factory):
    """Lines of the two orders whose first lines differ, and of a third, in either order of the file."""
    con = duckdb.connect()
    folders = [tmp_path_factory.mktemp("tied") for _ in range(2)]
    for folder, way in zip(folders, ("asc", "desc")):
        con.sql(
            f"""create or replace table lineitem as select k::bigint as l_orderkey, p::bigint as l_partkey, 7::bigint as l_suppkey, n::int as l_linenumber,
            n::double as l_quantity, p + 0.5::double as l_extendedprice, 'N' as l_returnflag
            from (values (271769, 4, 21), (7733795, 4, 11), (7733795, 5, 12), (5, 1, 11)) t(k, n, p) order by k {way}, n {way}"""
        )
        con.sql(f"copy lineitem to '{folder}/lineitem.parquet' (format parquet)")
    return con, [str(f) for f in folders]


def test_beir_corpus_ties_of_a_shared_table_id(spark, tied_id):
    """The one pure table is an answer that the SQL allows: its ties by order, whichever line the file has first."""
    con, folders = tied_id
    sql = catalogue.SQL["beir_corpus"]
    assert sql.count("ORDER BY i)") == 1
    want = con.sql(sql.replace("ORDER BY i)", "ORDER BY i, l_orderkey)")).df()
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].itertuples(index=False, name=None)))
    for folder in folders:
        assert rows(catalogue.QUERIES["beir_corpus"](spark, folder).toPandas()) == rows(want)


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
