"""The corpus pipeline: quality rules, boilerplate lines, near copies, personal data,
packing.  Counted as part of the subpackage ``quarrylight.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``; ``n_chars`` follows the text.  Null and empty texts fail
the first stage; each row is judged by its own text, whether its id is null or shared
with other rows; columns of ``docs`` beyond those of ``documents``, whatever their names,
pass through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import small, table, written
from quarrylight.llm.line_dedup import drop_boilerplate
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.pii import redact
from quarrylight.llm.quality_rules import apply_rules
from quarrylight.llm.queries import tokenizer_path
from quarrylight.llm.simhash import near_copies


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    held = docs.select(F.struct("*").alias("row"), "doc_id", "text")  # no name can clash in a struct
    return apply_rules(held, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    held = docs.select(F.struct("*").alias("row"), "source", "text")
    cleaned = drop_boilerplate(held, host_col="source", ratio=0.05, least_pages=5)
    return _counted(cleaned.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*"), docs.columns)


def _digest(docs: DataFrame) -> Column:
    """Hash of all columns of a row; maps have none of their own."""
    column = lambda f: F.col(f"`{f.name}`")
    return F.xxhash64(*(F.to_json(F.struct(column(f))) if "map<" in f.dataType.simpleString() else column(f) for f in docs.schema))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null last, and
    of several such the one with the least hash; of rows equal in all columns, any."""
    digest = _digest(docs)
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), digest.alias("hash")).alias("key"), "text")
    found = written(near_copies(keyed, id_col="key").groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.count("*").alias("n")), "near-rows")
    first = F.col("doc_id") == F.col("group_id")
    surplus = written(found.filter(~first).select(F.col("doc_id.hash").alias("hash")), "near-surplus")
    marked = docs.select(F.struct("*").alias("row"), digest.alias("hash"))
    once = marked.join(small(surplus), "hash", "left_anti")
    repeated = written(found.filter(first & (F.col("n") > 1)).select(F.col("doc_id.hash").alias("hash")), "near-repeated")
    if not repeated.isEmpty():
        once = once.join(small(repeated), "hash", "left_anti").unionByName(marked.join(small(repeated), "hash", "left_semi").dropDuplicates(["hash"]))
    return once.select("row.*")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("personal data", redaction),
    ("packing", packing),
]

#: Not expressible: learned rules, boosted trees and differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage-{number}")
    return docs
