"""Queries that look things up: terms in texts, moments in windows, windows near others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import normalize_text, tokens
from quarrylight.operators.lookups import near, term_hits, totals_in_ranges
from quarrylight.plans.common import NORMAL, table


def doc_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The openings of the benchmark's items, of three to six words, as a table of terms:
    which documents hold which, and how often."""
    words = tokens(normalize_text(F.col("text")))
    opening = F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 4 + 3).cast("int")), " ")
    terms = table(spark, sf_dir, "benchmark").select(opening.alias("term"))
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return term_hits(docs, "text", terms).select(F.col("id").alias("doc_id"), "term", "hits")


DOC_TERMS = rf"""WITH t AS (SELECT DISTINCT array_to_string(string_split({NORMAL.format("text")}, ' ')[1:item_id % 4 + 3], ' ') AS term FROM benchmark),
s AS (SELECT term, len(string_split(term, ' ')) AS n FROM t WHERE term <> ''),
w AS (SELECT doc_id, string_split({NORMAL.format("text")}, ' ') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(range(1, CAST(len(w) - n AS BIGINT) + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)
SELECT doc_id, term, count(*) AS hits FROM g JOIN s ON g = term GROUP BY doc_id, term"""


def _day(column):
    return F.unix_date(F.col(column).cast("date")).cast("long")


def order_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as campaigns of 14, 45 or 120 days: the orders made in each."""
    k = F.col("s_suppkey")
    start = F.lit(8766) + (k * 37) % 2400  # from 1994-01-01 on
    windows = table(spark, sf_dir, "supplier").select("s_suppkey", start.cast("long").alias("from_day"), (start + F.element_at(F.array(F.lit(14), F.lit(45), F.lit(120)), (k % 3 + 1).cast("int"))).cast("long").alias("to_day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _day("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    totals = totals_in_ranges(orders.withColumn("one", F.lit(1).cast("long")), windows, "day", "from_day", "to_day", n=("sum", "one"), cents=("sum", "cents"), first_order=("min", "o_orderkey"))
    return totals.select("s_suppkey", "n", "cents", "first_order")


ORDER_WINDOWS = """WITH w AS (SELECT s_suppkey, 8766 + (s_suppkey * 37) % 2400 AS a, CASE s_suppkey % 3 WHEN 0 THEN 14 WHEN 1 THEN 45 ELSE 120 END AS n FROM supplier),
o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT s_suppkey, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, min(o_orderkey) AS first_order FROM w JOIN o ON day >= a AND day < a + n GROUP BY s_suppkey"""


def order_near_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' largest orders (one each) and the suppliers' anchor days that lie at
    most two days from them."""
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderdate", F.struct("o_totalprice", "o_orderkey")).alias("at"))
    anchors = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(8766) + (F.col("s_suppkey") * 53) % 2400).cast("long").alias("anchor"))
    return near(top.select("o_custkey", _day("at").alias("day")), anchors, "day", "anchor", 2).select("o_custkey", "s_suppkey", (F.col("day") - F.col("anchor")).alias("gap"))


ORDER_NEAR = """WITH t AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(arg_max(o_orderdate, struct_pack(p := o_totalprice, k := o_orderkey)) AS DATE)) AS day FROM orders GROUP BY o_custkey),
a AS (SELECT s_suppkey, 8766 + (s_suppkey * 53) % 2400 AS anchor FROM supplier)
SELECT o_custkey, s_suppkey, CAST(day - anchor AS BIGINT) AS gap FROM t JOIN a ON abs(day - anchor) <= 2"""

QUERIES = {f.__name__: f for f in (doc_term_hits, order_in_windows, order_near_purchase)}
SQL = {"doc_term_hits": DOC_TERMS, "order_in_windows": ORDER_WINDOWS, "order_near_purchase": ORDER_NEAR}
