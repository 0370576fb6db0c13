"""The tables at hand, seen as predictions, ledgers, candidates and runs; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import dealt, parts, table

TOK = """tok AS (
  SELECT o_orderkey AS problem_id, o_orderpriority AS dataset, o_orderstatus AS gen_model, l_returnflag AS sample_id, CAST(l_linenumber AS BIGINT) AS line_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS pos,
         ROUND(l_quantity / CAST(50 AS DOUBLE), 7) AS p,
         CAST(CASE WHEN l_extendedprice / CAST(106000 AS DOUBLE) < CAST(0.15 AS DOUBLE) + CAST(0.7 AS DOUBLE) * l_quantity / CAST(50 AS DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def pred(spark: SparkSession, sf: str, at: list[Column] = ()) -> DataFrame:
    """Token predictions without their place: problem_id, dataset, gen_model, sample_id, line_id, p, y; and `at`, columns of the lineitem files."""
    item = table(spark, sf, "lineitem").select(*at, "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    n = parts(table(spark, sf, "lineitem"))
    item, order = dealt(item, n, "l_orderkey"), dealt(order, n, "o_orderkey")
    y = (F.col("l_extendedprice") / 106000.0 < F.lit(0.15) + F.lit(0.7) * F.col("l_quantity") / 50.0).cast("long")
    return item.join(order, item.l_orderkey == order.o_orderkey).select(
        F.col("o_orderkey").alias("problem_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderstatus").alias("gen_model"),
        F.col("l_returnflag").alias("sample_id"),
        F.col("l_linenumber").cast("long").alias("line_id"),
        F.round(F.col("l_quantity") / 50.0, 7).alias("p"),
        y.alias("y"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        *[c for c in item.columns if not c.startswith("l_")],
    )


def tok(spark: SparkSession, sf: str) -> DataFrame:
    """Token predictions with pos, their place in the problem."""
    order = Window.partitionBy("problem_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return pred(spark, sf).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


EVENTS = """ev AS (
  SELECT user_id, event_type AS name, value >= 50 AS passed, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Filter outcomes of each user in order: user_id, name, passed, seq."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), (F.col("value") >= 50).alias("passed"), F.row_number().over(order).cast("long").alias("seq"))


CAND = """cand AS (
  SELECT l_partkey AS problem_id, CAST(s_nationkey AS BIGINT) AS adder, MIN(l_extendedprice) AS distance, COUNT(*) FILTER (l_quantity > 25) AS passed_filters, MAX(l_quantity) / CAST(50 AS DOUBLE) AS similarity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate repairs: problem_id, adder, distance, passed_filters, similarity."""
    item = table(spark, sf, "lineitem")
    return item.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("problem_id"), F.col("s_nationkey").cast("long").alias("adder")).agg(
        F.min("l_extendedprice").alias("distance"), F.count_if(F.col("l_quantity") > 25).alias("passed_filters"), (F.max("l_quantity") / 50.0).alias("similarity")
    )


WORDS = r"""words AS (
  SELECT doc_id AS problem_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS token
  FROM (SELECT doc_id, regexp_extract_all(text, '\n|[A-Za-z_]+|[0-9]+|[^\sA-Za-z0-9_]') AS t FROM documents) AS d, LATERAL (SELECT UNNEST(range(1, len(t) + 1)) AS i) AS u)"""


def words(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Tokens of documents: problem_id, pos, token; dealt by problem_id, if asked."""
    from plumbline.operators.tokens import explode_tokens

    d = table(spark, sf, "documents")
    found = explode_tokens(d.withColumnRenamed("doc_id", "problem_id"), dealt=dealt, parts=parts(d) if dealt else None)
    return found.withColumn("pos", F.col("pos").cast("long"))


def word_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of documents as arrays, with the text: problem_id, text, tokens. What can be told from a text's row alone needs no row for each token."""
    from plumbline.operators.tokens import PATTERN

    return table(spark, sf, "documents").select(F.col("doc_id").alias("problem_id"), "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("tokens"))
