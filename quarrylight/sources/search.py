"""Search results and catalogues as JSON payloads -> seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.urls import normalize_url

RESULTS = "results array<struct<url:string,title:string,content:string,publishedDate:string>>, unresponsive_engines array<array<string>>"
FRESHNESS = {"pd": "day", "pw": "week", "pm": "month", "py": "year"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def time_range(freshness: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FRESHNESS.items() for x in pair))[freshness]


def unescape(value: Column) -> Column:
    """The named entities that results use; the ampersand comes last."""
    for name, sign in ENTITIES.items():
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def metasearch_seeds(pages: DataFrame) -> DataFrame:
    """Payloads (query, payload) -> a row a result; results without a web address go."""
    parsed = pages.withColumn("p", F.from_json("payload", RESULTS))
    rows = parsed.select("query", F.posexplode("p.results").alias("rank", "r"))
    rows = rows.filter(F.lower("r.url").rlike("^https?://[^/]"))
    return rows.select("query", "rank", F.col("r.url").alias("url"), normalize_url(F.col("r.url")).alias("normalized_url"), unescape(F.col("r.title")).alias("title"), unescape(F.col("r.content")).alias("snippet"), F.try_to_timestamp("r.publishedDate").alias("published_hint"))


def degraded(pages: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """Payloads with whether every primary engine failed to answer, and which did."""
    parsed = pages.withColumn("p", F.from_json("payload", RESULTS))
    down = F.coalesce("p.unresponsive_engines", F.array().cast("array<array<string>>"))
    names = F.transform(down, lambda e: F.get(e, 0))
    told = F.transform(down, lambda e: F.array_join(e, ": "))
    return parsed.select("query", (F.size(F.array_except(F.array(*map(F.lit, primary)), names)) == 0).alias("degraded"), told.alias("unresponsive"))


def catalogue_seeds(pages: DataFrame) -> DataFrame:
    """Open entries of a structured catalogue; of equal addresses the last stays."""
    schema = "hackathons array<struct<id:bigint,title:string,url:string,open_state:string,displayed_location:struct<location:string>,submission_period_dates:string,organization_name:string>>"
    rows = pages.select("page", F.posexplode(F.from_json("payload", schema)["hackathons"]).alias("at", "h")).filter("h.open_state = 'open' and h.url is not null")
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("h.url").orderBy(F.desc("page"), F.desc("at")))).filter("n = 1")
    snippet = F.concat_ws("; ", F.col("h.organization_name"), F.col("h.displayed_location.location"), F.col("h.submission_period_dates"))
    return last.select(F.col("h.url").alias("url"), F.col("h.title").alias("title"), snippet.alias("snippet"))


def paid_seeds(pages: DataFrame) -> DataFrame:
    """Payloads (query, payload) of a search service that nests its results under ``web``
    -> a row a result; results without a web address go."""
    schema = "web struct<results:array<struct<url:string,title:string,description:string>>>"
    rows = pages.select("query", F.posexplode(F.from_json("payload", schema)["web"]["results"]).alias("rank", "r")).filter(F.lower("r.url").rlike("^https?://[^/]"))
    return rows.select("query", "rank", F.col("r.url").alias("url"), normalize_url(F.col("r.url")).alias("normalized_url"), F.col("r.title").alias("title"), F.col("r.description").alias("snippet"))


def prefetched(seeds: DataFrame) -> DataFrame:
    """Seeds (url, title, content, links) whose content came with them, as fetched pages:
    every later stage applies to them."""
    text = F.coalesce("content", F.lit(""))
    return seeds.withColumns({"text": text, "links": F.coalesce("links", F.array().cast("array<string>"))}).select(
        F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit("prefetched").alias("fetch_method"), F.lit(200).alias("status_code"), F.lit("text/plain").alias("content_type"),
        "title", "text", "links", F.sha2("text", 256).alias("content_hash"), F.col("text").rlike(r"\S").alias("usable"),
    )
