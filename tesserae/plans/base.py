"""What the named queries share: table readers and inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS
from ..operators import html_tables

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their other columns as metadata."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "text",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): user turns and the assistant turn right after."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns(
        {"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)}
    )
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, question, table_text, answers): an HTML table of each order's lines."""
    money = lambda c: F.col(c).cast("decimal(15,2)").cast("string")
    cells = (
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        money("l_quantity"),
        money("l_extendedprice"),
        F.col("l_returnflag"),
    )
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("row")).alias("x"),
        money("l_extendedprice").alias("price"),
    )
    body = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("price").alias("price"))
    head = "<table><caption>Order lines</caption><tr><th>line id</th><th>part</th><th>qty</th><th>price</th><th>flag</th></tr>"
    html = F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["row"]), ""), F.lit("</table>"))
    return body.select(
        F.col("l_orderkey").cast("string").alias("example_id"),
        F.concat(F.lit("What is on order "), F.col("l_orderkey").cast("string"), F.lit("?")).alias("question"),
        html.alias("table_text"),
        F.array("price").alias("answers"),
    )


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns: a box of four properties of each part."""
    values = (("Name", "p_name"), ("Brand", "p_brand"), ("Type", "p_type"), ("Size", "p_size"))
    rows = F.concat(
        F.lit("<table>"),
        *[F.concat(F.lit(f"<tr><th>{n}</th><td>"), F.col(c).cast("string"), F.lit("</td></tr>")) for n, c in values],
        F.lit("</table>")
    )
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("example_id"),
        F.lit("Which part is this?").alias("question"),
        rows.alias("table_text"),
        F.array("p_brand").alias("answers"),
    )


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns: a long table of the orders of each customer nation."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    row = F.concat(
        F.lit("<tr><td>"),
        F.col("o_orderkey").cast("string"),
        F.lit("</td><td>"),
        F.col("o_orderpriority"),
        F.lit("</td><td>"),
        F.col("c_name"),
        F.lit("</td></tr>"),
    )
    body = joined.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("x"))
    html = F.concat(
        F.lit("<table><tr><th>order id</th><th>priority</th><th>customer</th></tr>"),
        F.array_join(F.transform("x", lambda x: x["row"]), ""),
        F.lit("</table>"),
    )
    return body.select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("example_id"),
        F.lit("Who ordered?").alias("question"),
        html.alias("table_text"),
        F.array().cast("array<string>").alias("answers"),
    )


def processed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.processed(order_tables(spark, sf_dir))


# --- the same in SQL ------------------------------------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2 AND x NOT IN ({STOP_SQL}))"


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


ANSWERS_SQL = """pairs AS (
  SELECT * FROM (
    SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'user' AND next_role = 'assistant'
)"""

ORDERS_SQL = """cells AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         cast(l_linenumber AS varchar) AS c0, cast(l_partkey AS varchar) AS c1, cast(cast(l_quantity AS decimal(15,2)) AS varchar) AS c2,
         cast(cast(l_extendedprice AS decimal(15,2)) AS varchar) AS c3, l_returnflag AS c4,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS i
  FROM lineitem
), named AS (
  SELECT *, substr(md5(cast(l_orderkey AS varchar) || '_What is on order ' || cast(l_orderkey AS varchar) || '?'), 1, 12) AS table_id,
         'What is on order ' || cast(l_orderkey AS varchar) || '?' AS question FROM cells
)"""
