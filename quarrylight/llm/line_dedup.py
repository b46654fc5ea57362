"""Boilerplate lines by site-relative frequency.

A line is boilerplate on a host if more than a given ratio of the host's pages
contain it.  Pages are counted, not copies: pages of a host with equal texts count
as one, so that a page copied a thousand times does not turn into boilerplate.  A
host needs ``least_pages`` such pages with the line before it is dropped.

Lines are counted as (host, 64-bit hash) rows, pre-aggregated before the shuffle;
texts are never shuffled.  The boilerplate hashes of a host come to at most the
lines of an average page divided by the ratio.  Their table is broadcast if it was
counted and is small, and otherwise joined with the host's pages dealt over
:data:`SALTS` parts, since one host may hold a third of all pages.

Defined results: blank lines are kept and never counted; a null text stays null
with no lines; a null host is a host of its own; repeated rows get equal results; a
page that consists of boilerplate alone keeps an empty text; all other columns are
kept, ``n_lines`` and ``n_dropped`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import written

#: Boilerplate hashes up to which their table is broadcast (8 bytes each).
BROADCAST_LINES = 1 << 20
#: Parts over which a host's pages are dealt in the other case.
SALTS = 64
WORDY = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str, ratio: float, least_pages: int) -> DataFrame:
    """-> ``host``, ``line`` (hash): the lines to drop."""
    pages = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("text")).filter("text is not null")
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", "page", F.explode(F.filter(_lines(F.col("text")), lambda x: x.rlike(WORDY))).alias("x"))
    seen = lines.select("host", "page", F.xxhash64("x").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    often = seen.filter(F.col("n") >= least_pages)
    # a row a host; hosts may be many, so Spark chooses the join
    return often.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines dropped from the text, and
    ``n_lines`` and ``n_dropped`` (long)."""
    lines = written(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, least_pages=least_pages), "boilerplate")
    small = lines.count() <= BROADCAST_LINES
    # the input's other columns travel in a struct, where no name can clash
    others = [c for c in docs.columns if c != text_col]
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*map(column, others)).alias("row"), F.coalesce(column(host_col), F.lit("")).alias("host"), column(text_col).alias("text"))
    by_host = lines.groupBy("host").agg(F.collect_set("line").alias("drop"))
    if small:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        dealt = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = rows.join(dealt, ["host", "salt"], "left")
    split = joined.withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(x.rlike(WORDY) & F.array_contains("drop", F.xxhash64(x)))))
    counted = split.withColumn("kept", kept).withColumns({"n_lines": F.coalesce(F.size("lines"), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long")})
    made = {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped"), text_col: F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))}
    columns = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return counted.select(*(made.get(c, F.col("row")[c]).alias(c) for c in columns))
