"""Operational reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.text import summarise
from quarrylight.functions.urls import displayable_image, organizer_icon
from quarrylight.operators.decide import tier


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """How often each reason occurs, the most frequent first."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def top_then_filter(df: DataFrame, order: list[Column], k: int, condition: Column) -> DataFrame:
    """The first k rows, of which those that meet the condition: the limit comes first."""
    return df.orderBy(*order).limit(k).filter(condition)


def month_total(runs: DataFrame, at: str, amount: str, start: Column) -> DataFrame:
    return runs.filter(F.col(at) >= start).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"))


def announced(events: DataFrame, notifications: DataFrame, key: str) -> DataFrame:
    """Events with whether a notification of theirs was sent."""
    sent = notifications.filter("state = 'SENT'").select(key).distinct().withColumn("_sent", F.lit(True))
    return events.join(sent, key, "left").withColumn("announced", F.coalesce("_sent", F.lit(False))).drop("_sent")


def interleave(lists: dict[str, DataFrame], order: list[Column]) -> DataFrame:
    """Work lists of bounded length in turns: first of each, second of each, ..."""
    from pyspark.sql import Window

    parts = [df.withColumn("_list", F.lit(i)).withColumn("turn", F.row_number().over(Window.partitionBy("_list").orderBy(*order))) for i, df in enumerate(lists.values())]
    return reduce(DataFrame.unionByName, parts).orderBy("turn", "_list").drop("_list")


def accuracy(judged: DataFrame, pairs: dict[str, tuple[str, str]], seconds: str) -> DataFrame:
    """How many rows a model got right for each measure (found, expected), and its mean
    time."""
    right = [F.sum(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(n) for n, (a, b) in pairs.items()]
    return judged.groupBy("model").agg(F.count("*").alias("documents"), *right, F.avg(seconds).alias("seconds"))


def kind_histogram(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """Rows of each kind before and after a change of rules."""
    counted = [df.groupBy(kind).agg(F.count("*").alias(n)) for df, n in ((before, "before"), (after, "after"))]
    return counted[0].join(counted[1], kind, "full").select(kind, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def rejections(candidates: DataFrame, code: str, k: int) -> DataFrame:
    """The k candidates touched last that have a reason, by exact membership."""
    return candidates.filter(F.array_contains("reasons", code)).orderBy(F.desc("updated_at"), "id").limit(k)


def upcoming(events: DataFrame, as_of: Column, k: int, place: Column | None = None) -> DataFrame:
    """Of the k events that start next (without a date: last), those that start later
    than now or have no date, and are in a place: the limit comes first."""
    first = events.orderBy(F.col("start").asc_nulls_last(), "id").limit(k)
    rows = first.filter(F.col("start").isNull() | (F.col("start") >= as_of))
    return rows if place is None else rows.filter(place)


def cards(events: DataFrame, notifications: DataFrame, *, domains: dict[str, int] | None = None, logos: dict[str, str] | None = None) -> DataFrame:
    """A card an event (id, facts, image_url, total; null points count as none): what is needed to
    judge it, images by the trust in their hosts, and whether it was announced."""
    f = lambda path: F.col(f"facts.{path}")
    place = F.nullif(F.concat_ws(" — ", F.nullif(f("location.city"), F.lit("")), F.nullif(f("location.region"), F.lit(""))), F.lit(""))
    kind, points = f("location.location_type"), F.coalesce("total", F.lit(0))
    ranked = F.when(points >= dict(rules.TIERS)["POSSIBLE"], tier(points)).otherwise("WEAK")
    return announced(events, notifications, "id").select(
        "id", f("title").alias("title"), f("organizer").alias("organizer"), F.initcap(F.replace(F.coalesce(f("category"), F.lit("")), F.lit("_"), F.lit(" "))).alias("category"),
        summarise(f("description")).alias("summary"), displayable_image(F.col("image_url"), domains).alias("image_url"), organizer_icon(f("canonical_url"), logos, domains).alias("icon_url"),
        f("canonical_url").alias("canonical_url"), f("registration_url").alias("registration_url"), F.when(kind == "ONLINE", F.lit("Online")).otherwise(F.coalesce(place, F.initcap(kind))).alias("location"),
        f("registration_deadline.value").alias("deadline"), f("event_start.value").alias("event_start"), f("prize_information").alias("prize"), points.alias("score"), ranked.alias("tier"),
        f("registration_state").alias("registration"), f("event_phase").alias("phase"), "announced",
    )
