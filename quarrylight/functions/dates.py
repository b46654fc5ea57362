"""Dates in text, and the waiting times that decide what is due.

Every function takes the moment it judges from (``as_of``) as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules

ISO = r"\b(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b"
NAMED = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?(?:,?\s+(20[0-9]{2}))?\b"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def context_year(text: Column, published: Column) -> Column:
    """The first year in the opening of the text, else that of publication."""
    found = F.nullif(F.regexp_extract(F.substring(text, 1, 300), r"\b(20[0-9]{2})\b", 1), F.lit(""))
    return F.coalesce(found.cast("int"), F.year(published))


def labelled_date(text: Column, labels: tuple[str, ...], year: Column) -> Column:
    """Struct of value (UTC), evidence, confidence and year_inferred: the date in the
    window after the first label, in order, whose window holds one."""
    lowered = F.lower(text)

    def window(label: str) -> Column:
        at = F.instr(lowered, label)
        return F.when(at > 0, F.substring(text, at, F.lit(rules.DATE_WINDOW)))

    def dated(label: str) -> Column:
        return let(window(label), lambda w: F.when(w.rlike(ISO) | w.rlike(NAMED), w))

    def fact(held: Column) -> Column:
        iso = held.rlike(ISO)
        evidence = F.when(iso, F.regexp_extract(held, ISO, 0)).otherwise(F.regexp_extract(held, NAMED, 0))
        explicit = F.nullif(F.when(iso, F.regexp_extract(held, ISO, 1)).otherwise(F.regexp_extract(held, NAMED, 3)), F.lit("")).cast("int")
        name = F.lower(F.substring(F.regexp_extract(held, NAMED, 1), 1, 3))
        named_month = F.array_position(F.array(*(F.lit(m[:3]) for m in rules.MONTHS)), name).cast("int")
        month = F.when(iso, F.regexp_extract(held, ISO, 2).try_cast("int")).otherwise(named_month)
        day = F.when(iso, F.regexp_extract(held, ISO, 3).try_cast("int")).otherwise(F.regexp_extract(held, NAMED, 2).try_cast("int"))
        own = F.coalesce(explicit, year)
        local = F.try_make_timestamp(own, month, day, F.lit(0), F.lit(0), F.lit(0))
        value = F.to_utc_timestamp(local, rules.ZONE)
        return F.struct(value.alias("value"), evidence.alias("evidence"), own.alias("year"), explicit.isNull().alias("inferred"), held.isNotNull().alias("found"))

    def judged(f: Column) -> Column:
        confidence = F.when(~f["found"], 0.0).when(f["year"].isNull(), 0.25).when(f["value"].isNull(), 0.0).when(f["inferred"], 0.65).otherwise(0.95)
        inferred = f["found"] & f["value"].isNotNull() & f["inferred"]
        return F.struct(f["value"].alias("value"), f["evidence"].alias("evidence"), confidence.alias("confidence"), inferred.alias("year_inferred"))

    return let(let(F.coalesce(*map(dated, labels)), fact), judged)


def trustworthy(fact: Column) -> Column:
    return F.coalesce(fact["value"].isNotNull() & (fact["confidence"] >= rules.TRUSTWORTHY) & ~fact["year_inferred"], F.lit(False))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400.0


def dates_contradict(a: Column, b: Column) -> Column:
    return trustworthy(a) & trustworthy(b) & (days_apart(a["value"], b["value"]) > rules.EDITION_GAP_DAYS)


def lead_days(target: Column, as_of: Column) -> Column:
    """Whole days until the target, rounded down."""
    return F.floor((F.unix_timestamp(target) - F.unix_timestamp(as_of)) / 86400)


def backoff_days(runs: Column) -> Column:
    """7, 14, 28, 56, then 60."""
    doublings = F.least(F.greatest(F.lit(0), runs - 1), F.lit(8))
    return F.least(F.lit(rules.UNRESOLVED_DAYS) * F.pow(F.lit(2), doublings), F.lit(rules.UNRESOLVED_MOST)).cast("int")


def lead_due(state: Column, runs: Column, searched: Column, as_of: Column) -> Column:
    days = F.when(state.isin("RESOLVED", "DISCARDED"), F.lit(rules.RESOLVED_DAYS)).otherwise(backoff_days(runs))
    return searched.isNull() | (F.unix_timestamp(searched) + days * 86400 <= F.unix_timestamp(as_of))


def refresh_due(seen: Column, deadline: Column, state: Column, as_of: Column) -> Column:
    """Daily; every third day if the deadline is far or unknown and nothing is open."""
    far = (F.unix_timestamp(deadline) > F.unix_timestamp(as_of) + 30 * 86400) | (deadline.isNull() & ~state.eqNullSafe("OPEN"))
    days = F.when(far, 3).otherwise(1)
    return seen.isNull() | (F.unix_timestamp(seen) + days * 86400 <= F.unix_timestamp(as_of))


def recheck_reason(channel: Column, event_id: Column, state: Column, reasons: Column, judged: Column, as_of: Column, historical: bool = False) -> Column:
    """Why a candidate is skipped, or null."""
    settled = F.arrays_overlap(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*map(F.lit, rules.SETTLED_REASONS)))
    days = F.when((state == "REJECTED") & settled, rules.SETTLED_DAYS).when(state.isin("REJECTED", "AMBIGUOUS"), rules.RECHECK_DAYS)
    recent = F.unix_timestamp(judged) + days * 86400 > F.unix_timestamp(as_of)
    deliberate = F.lit(historical) | F.coalesce(channel.isin(*rules.DELIBERATE_CHANNELS), F.lit(False))
    return F.when(deliberate, None).when(event_id.isNotNull() & state.isin(*rules.EVENT_STATES), "already_an_event").when(recent, "judged_recently")


def parse_epoch(value: Column, milliseconds_from: float = 1e12) -> Column:
    """Seconds or milliseconds since 1970, or an ISO date; null otherwise."""
    number = value.try_cast("double")
    seconds = F.when(number >= milliseconds_from, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(value))


def retry_at(value: Column, now: Column) -> Column:
    """Moment that a Retry-After header names: seconds (1 to a day), an HTTP date, or an
    hour from now."""
    seconds = F.greatest(F.lit(1), F.least(F.trim(value).try_cast("bigint"), F.lit(86400)))
    # the weekday is left to the date; its zone is always GMT
    dated = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*|\s*GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    later = F.when(F.trim(value).try_cast("bigint").isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + seconds)).when(dated.isNotNull(), F.greatest(F.timestamp_seconds(F.unix_timestamp(now) + 1), dated))
    return F.coalesce(later, F.timestamp_seconds(F.unix_timestamp(now) + 3600))


def freshness_since(since: Column, today: Column) -> Column:
    """The narrowest search period that reaches back to a day."""
    days = F.greatest(F.lit(0), F.datediff(today, since))
    return F.when(days <= 1, "pd").when(days <= 7, "pw").when(days <= 31, "pm").otherwise("py")


def local_day(value: Column) -> Column:
    """A UTC moment as a day where the events take place."""
    return F.date_format(F.from_utc_timestamp(value, rules.ZONE), "d MMM yyyy")
