"""Alerts: what is said about new events and changes, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.urls import is_trusted_registration_url, link_trust

#: Changes that a reader must act on soon.
URGENT = ("DEADLINE_CHANGED", "EVENT_CANCELLED", "EVENT_POSTPONED", "REGISTRATION_OPENED")


def new_event_alerts(events: DataFrame, domains: dict[str, int] | None = None) -> DataFrame:
    """A payload for each event (id, facts, total, tier); links only where they are
    trusted."""
    f = lambda path: F.col(f"facts.{path}")
    trusted = lambda url: F.when(link_trust(url, domains) == "CLICKABLE", url)
    registers = F.when(F.coalesce(is_trusted_registration_url(f("registration_url"), domains), F.lit(False)), f("registration_url"))
    return events.select(
        F.concat(F.lit("event:"), F.col("id")).alias("dedupe_key"), F.lit("NEW_EVENT").alias("kind"), f("title").alias("title"), f("organizer").alias("organizer"),
        trusted(f("canonical_url")).alias("url"), registers.alias("registration_url"), F.coalesce(f("location.city"), F.initcap(f("location.location_type"))).alias("place"),
        f("registration_deadline.value").alias("deadline"), "total", "tier",
    )


def change_alerts(changes: DataFrame) -> DataFrame:
    """Changes (event_id, version, change, notify) -> a payload for each version that has
    one to tell: the change itself if it is alone, else how many there are."""
    told = changes.filter("notify").groupBy("event_id", "version").agg(F.array_sort(F.collect_set("change")).alias("changes"))
    headline = F.when(F.size("changes") == 1, F.initcap(F.replace(F.get("changes", 0), F.lit("_"), F.lit(" ")))).otherwise(F.concat(F.size("changes").cast("string"), F.lit(" changes")))
    urgent = F.arrays_overlap("changes", F.array(*map(F.lit, URGENT)))
    return told.select(F.concat_ws(":", F.lit("change"), "event_id", "version").alias("dedupe_key"), "event_id", "version", headline.alias("headline"), F.array_join("changes", ",").alias("changes"), urgent.alias("urgent"))


def pending(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Outbox rows without a receipt that says they were sent."""
    return outbox.join(receipts.filter("state = 'SENT'").select("dedupe_key"), "dedupe_key", "left_anti")


def redacted(text: Column) -> Column:
    """Credentials in log lines replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b(token|secret|password|api[_-]?key)(\s*[=:]\s*)\S+", "$1$2[redacted]"), r"://[^/\s:@]+:[^/\s@]+@", "://[redacted]@")


def manual_alerts(events: DataFrame, at: Column, domains: dict[str, int] | None = None) -> DataFrame:
    """Payloads of events that someone sends by hand: keys of their own, which neither an
    earlier alert nor a second press in the same second can meet."""
    nonce = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)
    told = new_event_alerts(events, domains)
    key = F.concat_ws(":", F.lit("manual"), F.substring_index("dedupe_key", ":", -1), F.date_format(at, "yyyyMMddHHmmss"), nonce)
    return told.withColumns({"dedupe_key": key, "kind": F.lit("MANUAL_SEND")})
