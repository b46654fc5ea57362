"""State tables: upserts, versions, changes, overrides, retention, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.text import content_prefix_hash
from quarrylight.operators.scan import beside, decayed


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark limits ranks before it
    shuffles, so a frequent key costs a row a task."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current rows with the newest incoming ones in their place."""
    newest = latest(incoming, keys, order)
    return current.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: one for every key that is not there yet (an outbox)."""
    return latest(incoming, keys, order).join(current.select(*keys), keys, "left_anti")


def versions(rows: DataFrame, key: str, order: list[str], facts: list[str]) -> DataFrame:
    """Rows whose facts differ from the row before, numbered from 1 for each key."""
    digest = F.sha2(F.to_json(F.struct(*sorted(facts)), {"ignoreNullFields": "false"}), 256)
    told = beside(rows.withColumn("_digest", digest), key, order, "_digest")
    kept = told.filter(F.col("_first") | ~F.col("_digest").eqNullSafe(F.col("_before")))
    return kept.select(*rows.columns, F.col("_changes").cast("int").alias("version"))


def accept_update(stored: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Offered rows that are news and come from a source no less trusted than the best
    so far: ``digest`` and ``authority`` on both sides, ``version`` on the stored one."""
    s = stored.select(key, F.col("digest").alias("_d"), F.coalesce("authority", F.lit(0)).alias("_a"), "version")
    news = offered.join(s, key).filter((F.col("digest") != F.col("_d")) & (F.col("authority") >= F.col("_a")))
    return news.withColumn("version", F.col("version") + 1).drop("_d", "_a")


def change_columns(before: str, after: str) -> Column:
    """Array of (change, notify) between two versions' facts (column names)."""
    b, a = (lambda p: F.col(f"{before}.{p}")), (lambda p: F.col(f"{after}.{p}"))
    moved = lambda p: F.coalesce(b(p) != a(p), F.lit(False))
    differs = lambda p: ~b(p).eqNullSafe(a(p))
    becomes = lambda p, v: differs(p) & a(p).eqNullSafe(v)
    deadline = "registration_deadline.value"
    tests = [
        ("REGISTRATION_OPENED", True, becomes("registration_state", "OPEN")),
        ("REGISTRATION_CLOSED", False, becomes("registration_state", "CLOSED")),
        ("DEADLINE_EXTENDED", True, F.coalesce(a(deadline) > b(deadline), F.lit(False))),
        ("DEADLINE_CHANGED", True, F.coalesce(a(deadline) < b(deadline), F.lit(False))),
        ("DATES_CHANGED", True, moved("event_start.value") | moved("event_end.value")),
        ("LOCATION_CHANGED", True, differs("location.city")),
        ("VENUE_CHANGED", True, differs("location.venue")),
        ("ELIGIBILITY_CHANGED", True, F.exists(F.array(*(differs(f"eligibility.{r}") for r in rules.ELIGIBILITY_RULES)), lambda x: x)),
        ("PRIZE_CHANGED", False, differs("prize_information")),
        ("EVENT_CANCELLED", True, becomes("event_phase", "CANCELLED")),
        ("EVENT_POSTPONED", True, becomes("event_phase", "POSTPONED")),
    ]
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("change"), F.lit(t).alias("notify"))) for n, t, c in tests)))


def debounce(changes: DataFrame, key: str, at: str, minutes: int = rules.DEBOUNCE_MINUTES) -> DataFrame:
    """``quiet``: another change of the key came in the minutes before."""
    told = beside(changes.withColumn("_second", F.unix_seconds(F.col(at).cast("timestamp"))), key, ["_second"], "_second")
    recent = F.col("_second") - F.col("_before") <= 60 * minutes
    # a change of the same second counts, whichever of the two comes first
    quiet = F.coalesce(recent, F.lit(False)) | F.coalesce(F.col("_after") == F.col("_second"), F.lit(False))
    return told.withColumn("quiet", quiet).select(*changes.columns, "quiet")


def overlay(rows: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with manual edits: a map of the edited fields, in which null is a value."""
    merged = rows.join(edits.select(key, F.col("edits").alias("_edits")), key, "left")
    pinned = lambda c: F.coalesce(F.map_contains_key("_edits", c), F.lit(False))
    cast = {c: F.col("_edits")[c].cast(rows.schema[c].dataType) for c in fields}
    return merged.withColumns({c: F.when(pinned(c), cast[c]).otherwise(F.col(c)) for c in fields}).drop("_edits")


def retain(snapshots: DataFrame, key: str, row_id: str, at: str, before: Column, text: str) -> DataFrame:
    """Snapshots that stay: the newest of each key, and what is not older than
    ``before``; old ones that stay lose their text."""
    newest = snapshots.groupBy(key).agg(F.max(row_id).alias(row_id)).select(row_id)
    old = F.col(at) < before
    young = snapshots.filter(~old)
    kept = snapshots.filter(old).join(newest, row_id, "left_semi").withColumn(text, F.lit(None).cast(snapshots.schema[text].dataType))
    return young.unionByName(kept.select(*young.columns))


def last_judged(trace: Column) -> Column:
    """Moment of the last step of a trace (array of structs) that can be read."""
    return F.try_element_at(F.filter(F.transform(trace, lambda s: F.try_to_timestamp(s["at"])), lambda t: t.isNotNull()), F.lit(-1))


def smoothed(rows: DataFrame, key: str, order: str, value: str, weight: float = 0.2) -> DataFrame:
    """Exponentially weighted mean of each key's values in order; the first starts it."""
    return decayed(rows, key, order, value, weight)


def failures_in_a_row(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """How many of a key's latest rows failed without a success after them."""
    marked = rows.select(key, F.col(order).alias("_o"), failed.alias("_f"))
    last = marked.groupBy(key).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("_ok"))
    return marked.join(last, key).groupBy(key).agg(F.sum((F.col("_ok").isNull() | (F.col("_o") > F.col("_ok"))).cast("int")).alias("failures"))


def touch(current: DataFrame, seen: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """Candidates with sightings merged in: new keys come in with their latest sighting,
    known ones get the later moment and, of the columns to ``keep``, a new value only
    where the sighting has one."""
    # of sightings of one moment the one with the largest values, null last
    newest = latest(seen, [key], [F.desc(at), *map(F.desc, keep)]).select(key, F.col(at).alias("_at"), *(F.nullif(c, F.lit("")).alias(f"_{c}") for c in keep))
    both = current.join(newest, key, "full")
    return both.select(key, F.greatest(at, "_at").alias(at), *(F.coalesce(f"_{c}", c).alias(c) for c in keep), *(c for c in current.columns if c not in (key, at, *keep)))


def append_snapshots(held: DataFrame, fetched: DataFrame, key: str, digest: str, tie: str | None = None) -> DataFrame:
    """Fetched rows to append: those whose content isn't that of the key's newest
    snapshot.  ``fetched_at`` orders them, then ``tie`` (an id that grows), then the
    digest: of snapshots of one moment always the same one is the newest."""
    newest = latest(held, [key], [F.desc("fetched_at"), *([F.desc(tie)] if tie else []), F.desc(digest)]).select(key, F.col(digest).alias("_digest"))
    return fetched.join(newest, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")


def created(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New events (id, facts, source_url, at) as rows of three tables: the event, its
    first version with the digest of its facts, and its canonical source."""
    events = found.select("id", "facts", F.col("at").alias("created_at"), F.lit("EVENT_CREATED").alias("state"))
    first = found.select(F.col("id").alias("event_id"), F.lit(1).alias("version"), F.sha2(F.to_json("facts"), 256).alias("digest"), "at")
    sources = found.select(F.col("id").alias("event_id"), F.col("source_url").alias("url"), F.lit(True).alias("canonical"), F.col("at").alias("last_seen"))
    return events, first, sources


def attach_sources(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources (event_id, url, canonical, last_seen) with sightings (event_id, url, at):
    new ones are attached, known ones get the later moment."""
    newest = seen.groupBy("event_id", "url").agg(F.max("at").alias("_at"))
    both = sources.join(newest, ["event_id", "url"], "full")
    return both.select("event_id", "url", F.coalesce("canonical", F.lit(False)).alias("canonical"), F.greatest("last_seen", "_at").alias("last_seen"))


def run_totals(steps: DataFrame) -> DataFrame:
    """Steps of runs (run_id, kind, status, at) as a row a run: when it began and ended,
    how many steps of each kind it made, and errors."""
    kinds = ("query", "candidate", "processed", "lead", "lead_search")
    each = [F.sum((F.col("kind") == k).cast("int")).alias(f"n_{k}") for k in kinds]
    return steps.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), *each, F.sum((F.col("status") == "FAILED").cast("int")).alias("n_error"))


def with_prefix(events: DataFrame) -> DataFrame:
    """Stored events (title, facts with a description) with the key of their opening, so
    that those stored before it existed are met, too; a key that is there stays."""
    opening = content_prefix_hash(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif(F.col("facts.description"), F.lit(""))))
    return events.withColumn("content_prefix_hash", F.coalesce("content_prefix_hash", opening) if "content_prefix_hash" in events.columns else opening)
