"""From fetched documents to a ranked table of events: the whole path as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import content_prefix_hash
from quarrylight.functions.urls import authority, host_of
from quarrylight.operators.decide import score, verify
from quarrylight.operators.extract import extract_facts
from quarrylight.operators.resolve import edition_leaders
from quarrylight.plans.common import staged


def judged(docs: DataFrame, as_of: Column, domains: dict[str, int] | None = None) -> DataFrame:
    """Documents (id, url, title, snippet, text, organizer, published, links) with facts,
    gates, rejections and score."""
    facts = staged(extract_facts(docs, as_of).withColumn("authority", authority(host_of(F.col("url")), domains)), "facts")
    return score(staged(verify(facts, as_of), "verified"), as_of)


def detections(docs: DataFrame, as_of: Column, domains: dict[str, int] | None = None) -> DataFrame:
    """Accepted documents, one for each announcement: of those that open alike, or have
    one address, and whose editions don't differ, the first by (published, id)."""
    rows = staged(judged(docs, as_of, domains), "judged").filter("accepted")
    rows = rows.withColumns({"prefix": content_prefix_hash(F.concat_ws(" ", "facts.title", "facts.description")), "address": F.col("facts.canonical_url"), "edition": F.col("facts.edition_key")})
    by_text = edition_leaders(rows, "prefix", "edition", ["published"]).filter("leader = id").drop("leader")
    return edition_leaders(by_text, "address", "edition", ["published"]).filter("leader = id").drop("leader", "address", "prefix", "edition")
