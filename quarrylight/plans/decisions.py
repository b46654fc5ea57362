"""Queries that run the decisions (gates, scores, matches, changes, state writers) over
facts made of ``orders`` and ``events``, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import dates, urls
from quarrylight.functions.text import lead_key, normalize_organizer
from quarrylight.operators import decide, history, leads, notify, reports, resolve
from quarrylight.plans.common import table
from quarrylight.sources.html import failure_of

NOW = "1996-01-01 00:00:00"
KINDS = ("REGISTRATION_OPEN", "EVENT_ANNOUNCEMENT", "REGISTRATION_OPEN", "WINNER_ANNOUNCEMENT", "NEWS_ARTICLE", "REGISTRATION_OPEN")
PHASES = ("UPCOMING", "ANNOUNCED", "PAST", "UPCOMING", "CANCELLED")
STATES = ("OPEN", "FORTHCOMING", "CLOSED", "UNKNOWN")
PLACES = ("ONLINE", "ONSITE", "HYBRID", "UNKNOWN")
CITIES = ("Makati", "Manila", "Cebu", None)


def _at() -> Column:
    return F.lit(NOW).cast("timestamp")


def _pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (number % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, number: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"list_extract([{listed}], CAST({number} % {len(values)} + 1 AS INTEGER))"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the facts that their key and date stand for."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.when(k % 11 != 0, F.col("o_orderdate").cast("timestamp"))
    fact = lambda value, inferred: F.struct(value.alias("value"), F.when(inferred, 0.65).otherwise(0.95).alias("confidence"), inferred.alias("year_inferred"))
    facts = F.struct(
        F.when(k % 7 == 0, "UNKNOWN").when(k % 5 == 0, "OTHER_COMPETITION").otherwise("HACKATHON").alias("category"),
        _pick(KINDS, k).alias("document_kind"), _pick(PHASES, k).alias("event_phase"), _pick(STATES, k).alias("registration_state"),
        fact(day, k % 3 == 0).alias("registration_deadline"), fact(F.when(k % 13 != 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")), F.lit(False)).alias("event_start"),
        fact(F.when(k % 4 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 32 DAYS")), F.lit(False)).alias("event_end"),
        F.struct(F.when(k % 2 == 0, "PH").alias("country"), F.lit("Metro Manila").alias("region"), _pick(CITIES, k).alias("city"), F.when(k % 6 == 0, "hall").alias("venue"), _pick(PLACES, F.floor(k / 4)).alias("location_type")).alias("location"),
        F.struct(F.when(k % 10 == 0, True).alias("student_only"), F.lit(None).cast("boolean").alias("university_students_allowed"), F.lit(None).cast("boolean").alias("professionals_allowed"), F.when(k % 9 == 0, False).when(k % 4 == 1, True).alias("philippines_allowed")).alias("eligibility"),
        F.when(k % 3 == 0, F.array(F.lit("ai"))).otherwise(F.array(F.lit("art"))).alias("topics"), F.when(k % 8 == 0, F.lit("a prize")).alias("prize_information"),
    )
    return o.select("o_orderkey", "o_custkey", "o_orderdate", facts.alias("facts"), (k % 100).cast("int").alias("authority"), (k % 50 / 50.0).alias("overall_confidence"))


_FACTS = f"""f AS (SELECT o_orderkey AS k, o_custkey, o_orderdate AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 5 = 0 THEN 'OTHER_COMPETITION' ELSE 'HACKATHON' END AS category,
{_sql_pick(KINDS, 'o_orderkey')} AS kind, {_sql_pick(PHASES, 'o_orderkey')} AS phase, {_sql_pick(STATES, 'o_orderkey')} AS state, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS deadline,
o_orderkey % 3 = 0 AS inferred, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS start, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 32 DAY END AS stop,
o_orderkey % 2 = 0 AS home, {_sql_pick(CITIES, 'o_orderkey')} AS city, CASE WHEN o_orderkey % 6 = 0 THEN 'hall' END AS venue, {_sql_pick(PLACES, '(o_orderkey // 4)')} AS place, o_orderkey % 10 = 0 AS student,
CASE WHEN o_orderkey % 9 = 0 THEN false WHEN o_orderkey % 4 = 1 THEN true END AS allowed, CASE WHEN o_orderkey % 8 = 0 THEN 'a prize' END AS prize FROM orders)"""


def order_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an event through the gates, for a professional."""
    judged = decide.verify(_facts(spark, sf_dir), _at(), roles=("professional",), corroborating=F.col("o_orderkey") % 3)
    return judged.select("o_orderkey", "accepted", F.array_join("rejections", ",").alias("rejections"), F.array_join("warnings", ",").alias("warnings"))


ORDER_VERIFY = f"""WITH {_FACTS}, g AS (SELECT *, coalesce(deadline < TIMESTAMP '{NOW}' AND NOT inferred, false) AS past,
CASE WHEN allowed = false THEN false WHEN home THEN true WHEN place IN ('ONLINE', 'HYBRID') THEN coalesce(allowed, false) ELSE false END AS enter FROM f),
h AS (SELECT *, state IN ('OPEN', 'FORTHCOMING') AND NOT past AS open FROM g),
r AS (SELECT k, list_filter([CASE WHEN category = 'UNKNOWN' THEN 'NO_COMPETITION' END,
CASE WHEN kind = 'WINNER_ANNOUNCEMENT' THEN 'RESULTS_ONLY' WHEN kind = 'NEWS_ARTICLE' AND category <> 'UNKNOWN' THEN 'NO_COMPETITION' END, CASE WHEN phase IN ('PAST', 'CANCELLED') THEN 'PAST_EVENT' END,
CASE WHEN NOT open AND (state = 'CLOSED' OR past) THEN 'REGISTRATION_CLOSED' END,
CASE WHEN NOT enter THEN CASE WHEN allowed = false OR place IN ('ONLINE', 'HYBRID') THEN 'NOT_PHILIPPINES_ELIGIBLE' ELSE 'INTERNATIONAL_ONSITE' END END,
CASE WHEN student THEN 'PROFILE_INCOMPLETE' END, CASE WHEN k % 100 < 60 AND k % 3 < 2 THEN 'LOW_AUTHORITY' END, CASE WHEN k % 50 < 38 THEN 'LOW_CONFIDENCE' END], lambda x: x IS NOT NULL) AS codes,
open, state = 'CLOSED' OR past AS closed FROM h)
SELECT k AS o_orderkey, len(codes) = 0 AND open AS accepted, array_to_string(codes, ',') AS rejections, CASE WHEN NOT open AND NOT closed THEN 'REGISTRATION_UNCONFIRMED' ELSE '' END AS warnings FROM r"""


def order_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and tier of every order as an event, for someone in Makati."""
    scored = decide.score(_facts(spark, sf_dir), _at(), preferred_cities=("makati",))
    return scored.select("o_orderkey", "components.*", "total", "tier")


ORDER_SCORE = f"""WITH {_FACTS}, d AS (SELECT *, date_diff('second', TIMESTAMP '{NOW}', coalesce(deadline, start)) // 86400 AS days FROM f),
p AS (SELECT k AS o_orderkey, CASE WHEN city = 'Makati' THEN 30 WHEN city = 'Manila' THEN 27 WHEN home THEN 18 WHEN place IN ('ONLINE', 'HYBRID') AND allowed THEN 24 ELSE 0 END AS geography,
CASE WHEN coalesce(allowed, false) OR home THEN 20 WHEN allowed IS NULL THEN 5 ELSE 0 END AS eligibility, CASE category WHEN 'HACKATHON' THEN 15 WHEN 'OTHER_COMPETITION' THEN 7 ELSE 0 END AS category,
CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END AS topic, CASE state WHEN 'OPEN' THEN 15 WHEN 'FORTHCOMING' THEN 10 ELSE 0 END AS actionability, CAST(round_even(5 * (k % 100) / 100.0::DOUBLE, 0) AS INTEGER) AS authority,
CASE WHEN days >= 21 THEN 5 WHEN days >= 7 THEN 3 ELSE 0 END AS lead_time FROM d),
t AS (SELECT *, least(100, geography + eligibility + category + topic + actionability + authority + lead_time) AS total FROM p)
SELECT *, CASE WHEN total >= 80 THEN 'HIGH_PRIORITY' WHEN total >= 65 THEN 'RECOMMENDED' WHEN total >= 50 THEN 'POSSIBLE' ELSE 'LOW' END AS tier FROM t"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.struct(F.when(k % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("value"), F.lit(0.95).alias("confidence"), F.lit(False).alias("year_inferred"))
    year = F.when(k % 7 != 0, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("https://x.test/"), (k % 997).cast("string")).alias("canonical_url"), F.when(k % 13 == 0, F.concat(F.lit("https://r.test/"), (k % 89).cast("string"))).alias("registration_url"),
        F.md5((k % 3).cast("string")).alias("title"), F.concat(F.lit("org "), F.col("o_custkey").cast("string")).alias("organizer"), start.alias("start"), year.cast("string").alias("edition_key"), year.alias("edition_year"),
        F.when(k % 17 == 0, F.concat(F.lit("p"), (k % 101).cast("string"))).alias("prefix"), (F.floor(k / 32) % 2).alias("half"),
    )


def order_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other block of orders resolved against the rest: by either address, by a
    shared opening, by title within an organizer."""
    rows = _entities(spark, sf_dir)
    got = resolve.match(rows.filter("half = 1").drop("half"), rows.filter("half = 0").drop("half"), {"url": ["canonical_url", "registration_url"], "prefix": ["prefix"]})
    return got.select("id", "match", "rung", "action")


ORDER_MATCH = """WITH e AS (SELECT o_orderkey AS id, o_orderkey % 997 AS url, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 89 END AS reg, o_orderkey % 3 AS title, o_custkey AS org,
CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS start, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 101 END AS prefix, (o_orderkey // 32) % 2 AS half FROM orders),
i AS (SELECT * FROM e WHERE half = 1), s AS (SELECT * FROM e WHERE half = 0),
u AS (SELECT i.id, min(s.id) AS match FROM i JOIN s ON (i.url = s.url OR i.reg = s.reg) AND coalesce(i.y = s.y, true) AND coalesce(abs(date_diff('second', i.start, s.start)) / 86400.0::DOUBLE <= 45, true) GROUP BY i.id),
p AS (SELECT i.id, min(s.id) AS match FROM i JOIN s ON i.prefix = s.prefix AND coalesce(i.y = s.y, true) AND coalesce(abs(date_diff('second', i.start, s.start)) / 86400.0::DOUBLE <= 45, true) WHERE i.id NOT IN (SELECT id FROM u) GROUP BY i.id),
c AS (SELECT i.id, s.id AS match, CASE WHEN abs(date_diff('second', i.start, s.start)) / 86400.0::DOUBLE <= 14 THEN 'MERGE' ELSE 'POSSIBLE_DUPLICATE' END AS action FROM i JOIN s ON i.org = s.org AND i.title = s.title
AND coalesce(i.y = s.y, true) AND i.url <> s.url AND NOT coalesce(i.reg = s.reg, false) AND coalesce(abs(date_diff('second', i.start, s.start)) / 86400.0::DOUBLE <= 120, true)
WHERE i.id NOT IN (SELECT id FROM u) AND i.id NOT IN (SELECT id FROM p)),
t AS (SELECT id, match, action FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY action <> 'MERGE', match) = 1)
SELECT id, match, 'url' AS rung, 'MERGE' AS action FROM u UNION ALL SELECT id, match, 'prefix', 'MERGE' FROM p UNION ALL SELECT id, match, 'title', action FROM t"""


def order_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's next one: merge, possible duplicate or separate."""
    rows = _entities(spark, sf_dir)
    window = Window.partitionBy("organizer").orderBy("id")
    both = rows.withColumns({f"s_{c}": F.lead(c).over(window) for c in rows.columns}).filter("s_id is not null")
    return both.withColumns({f"i_{c}": F.col(c) for c in rows.columns}).select("id", F.col("s_id").alias("other"), resolve.compare("i_", "s_").alias("action"))


ORDER_COMPARE = """WITH e AS (SELECT o_orderkey AS id, o_orderkey % 997 AS url, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 89 END AS reg, o_orderkey % 3 AS title, o_custkey AS org,
CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS start, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS y FROM orders),
w AS (SELECT *, lead(id) OVER o AS other, lead(url) OVER o AS url2, lead(reg) OVER o AS reg2, lead(title) OVER o AS title2, lead(y) OVER o AS y2, abs(date_diff('second', start, lead(start) OVER o)) / 86400.0::DOUBLE AS gap FROM e WINDOW o AS (PARTITION BY org ORDER BY id))
SELECT id, other, CASE WHEN y <> y2 THEN 'SEPARATE' WHEN url = url2 OR reg = reg2 THEN CASE WHEN gap > 45 THEN 'SEPARATE' ELSE 'MERGE' END WHEN gap > 120 THEN 'SEPARATE' WHEN title = title2 AND gap <= 14 THEN 'MERGE'
WHEN title = title2 THEN 'POSSIBLE_DUPLICATE' ELSE 'SEPARATE' END AS action FROM w WHERE other IS NOT NULL"""


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions of one event: what changed with each."""
    window = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = _facts(spark, sf_dir).withColumn("before", F.lag("facts").over(window)).filter("before is not null")
    found = history.change_columns("before", "facts")
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda c: c["change"]), ",").alias("changes"), F.size(F.filter(found, lambda c: c["notify"])).alias("n_told"))


_was = ("state", "deadline", "start", "stop", "city", "venue", "student", "allowed", "phase", "prize")
ORDER_CHANGES = f"""WITH {_FACTS}, w AS (SELECT *, lag(k) OVER o AS k0, {', '.join(f'lag({c}) OVER o AS {c}0' for c in _was)} FROM f WINDOW o AS (PARTITION BY o_custkey ORDER BY d, k)),
c AS (SELECT k, list_filter([CASE WHEN state0 <> 'OPEN' AND state = 'OPEN' THEN 'REGISTRATION_OPENED' END, CASE WHEN state0 <> 'CLOSED' AND state = 'CLOSED' THEN 'REGISTRATION_CLOSED' END,
CASE WHEN deadline > deadline0 THEN 'DEADLINE_EXTENDED' END, CASE WHEN deadline < deadline0 THEN 'DEADLINE_CHANGED' END, CASE WHEN start <> start0 OR stop <> stop0 THEN 'DATES_CHANGED' END,
CASE WHEN city IS DISTINCT FROM city0 THEN 'LOCATION_CHANGED' END, CASE WHEN venue IS DISTINCT FROM venue0 THEN 'VENUE_CHANGED' END,
CASE WHEN student <> student0 OR allowed IS DISTINCT FROM allowed0 THEN 'ELIGIBILITY_CHANGED' END, CASE WHEN prize IS DISTINCT FROM prize0 THEN 'PRIZE_CHANGED' END, CASE WHEN phase0 <> 'CANCELLED' AND phase = 'CANCELLED' THEN 'EVENT_CANCELLED' END], lambda x: x IS NOT NULL) AS l FROM w WHERE k0 IS NOT NULL)
SELECT k AS o_orderkey, array_to_string(l, ',') AS changes, CAST(len(list_filter(l, lambda x: x NOT IN ('REGISTRATION_CLOSED', 'PRIZE_CHANGED'))) AS INTEGER) AS n_told FROM c"""


def order_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts about orders as new events: links only where they are trusted."""
    hosts = ("https://devpost.com/e/", "https://bit.ly/", "https://facebook.com/login/", "https://forms.gle/", "https://blog.test/")
    k = F.col("o_orderkey")
    url = F.concat(_pick(hosts, k), k.cast("string"))
    facts = F.struct(F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.lit("acme").alias("organizer"), url.alias("canonical_url"), url.alias("registration_url"), F.struct(_pick(CITIES, k).alias("city"), _pick(PLACES, k).alias("location_type")).alias("location"), F.struct(F.col("o_orderdate").alias("value")).alias("registration_deadline"))
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), facts.alias("facts"), (k % 101).alias("total"), F.lit("LOW").alias("tier"))
    return notify.new_event_alerts(rows).select("dedupe_key", "title", "url", "registration_url", "place", "total")


ORDER_ALERTS = f"""WITH u AS (SELECT o_orderkey AS k, {_sql_pick(('https://devpost.com/e/', 'https://bit.ly/', 'https://facebook.com/login/', 'https://forms.gle/', 'https://blog.test/'), 'o_orderkey')} || o_orderkey AS url FROM orders)
SELECT 'event:' || k AS dedupe_key, 'Order ' || k AS title, CASE WHEN k % 5 IN (0, 3) THEN url END AS url, CASE WHEN k % 5 = 3 THEN url END AS registration_url,
coalesce({_sql_pick(CITIES, 'k')}, {_sql_pick(('Online', 'Onsite', 'Hybrid', 'Unknown'), 'k')}) AS place, k % 101 AS total FROM u"""


def event_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due about each event's row, at a fixed moment."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    now, ts = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.date_trunc("second", "ts").cast("timestamp")
    state = F.when(i % 3 == 0, "REJECTED").when(i % 3 == 1, "AMBIGUOUS").otherwise("NOTIFIED")
    reasons = F.when(i % 2 == 0, F.array(F.lit("LOW_AUTHORITY"))).otherwise(F.array(F.lit("PAST_EVENT")))
    deadline = F.when(i % 4 != 0, ts + F.expr("INTERVAL 20 DAYS"))
    return e.select(
        "event_id", dates.lead_days(deadline, now).alias("days"), dates.freshness_since(F.to_date(ts), F.to_date(now)).alias("period"),
        dates.refresh_due(ts + F.expr("INTERVAL 30 DAYS"), deadline, F.when(i % 5 == 0, "OPEN").otherwise("CLOSED"), now).alias("refresh"),
        dates.recheck_reason(F.when(i % 7 == 0, "manual").otherwise("search"), F.when(i % 6 == 0, i), state, reasons, ts, now).alias("skip"),
        failure_of(_pick(("200", "401", "403", "404", "429", "503"), i).cast("int")).alias("failure"), dates.local_day(ts).alias("day"),
        F.date_format(dates.parse_epoch(F.when(i % 2 == 0, (F.unix_timestamp(ts) * 1000).cast("string")).otherwise(F.unix_timestamp(ts).cast("string"))), "yyyy-MM-dd HH:mm:ss").alias("epoch"),
        F.date_format(dates.retry_at(F.when(i % 3 == 0, (i % 90000).cast("string")).when(i % 3 == 1, "soon"), now), "yyyy-MM-dd HH:mm:ss").alias("retry"),
        leads.needs_replies(_pick(("recap", "question", "event"), i), _pick(("group", "page"), i), F.when(i % 4 == 0, F.lit(3))).alias("replies"),
    )


EVENT_TIMERS = f"""WITH t AS (SELECT event_id AS i, date_trunc('second', ts) AS ts, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) + INTERVAL 20 DAY END AS deadline FROM events)
SELECT i AS event_id, CAST(floor(date_diff('second', TIMESTAMP '2024-02-01', deadline) / 86400.0::DOUBLE) AS BIGINT) AS days,
CASE WHEN greatest(0, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) <= 1 THEN 'pd' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') <= 7 THEN 'pw' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') <= 31 THEN 'pm' ELSE 'py' END AS period,
ts + INTERVAL 30 DAY + CASE WHEN deadline > TIMESTAMP '2024-03-02' OR (deadline IS NULL AND i % 5 <> 0) THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END <= TIMESTAMP '2024-02-01' AS refresh,
CASE WHEN i % 7 = 0 THEN NULL WHEN i % 6 = 0 AND i % 3 = 2 THEN 'already_an_event' WHEN ts + CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN INTERVAL 30 DAY WHEN i % 3 < 2 THEN INTERVAL 7 DAY END > TIMESTAMP '2024-02-01' THEN 'judged_recently' END AS skip,
{_sql_pick((None, 'AUTH_REQUIRED', 'FORBIDDEN', 'NOT_FOUND', 'RATE_LIMITED', 'SERVER_ERROR'), 'i')} AS failure, strftime(ts + INTERVAL 8 HOUR, '%-d %b %Y') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS epoch,
strftime(TIMESTAMP '2024-02-01' + to_seconds(CASE WHEN i % 3 = 0 THEN greatest(1, least(i % 90000, 86400)) ELSE 3600 END), '%Y-%m-%d %H:%M:%S') AS retry,
CASE WHEN i % 2 = 1 THEN false WHEN i % 3 = 0 THEN false WHEN i % 3 = 1 THEN true ELSE i % 4 = 0 END AS replies FROM t"""


def event_lead_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as leads after a month of searches, an event found with each purchase."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("hack "), F.col("user_id").cast("string"))
    none = F.lit(None).cast("string")
    found = e.filter("event_type = 'view'").select(lead_key(name, none).alias("lead_key"), name.alias("normalized_name"), none.alias("edition_hint"), name.alias("query"))
    empty = spark.createDataFrame([], "lead_key string, normalized_name string, edition_hint string, query string, state string, sightings long, search_runs int, last_searched_at timestamp_ntz")
    held = leads.record_mentions(empty, found)
    searches = e.filter("event_type <> 'view'").select(lead_key(name, none).alias("lead_key"), F.col("ts").alias("searched_at"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("event_id"))
    return leads.mark_searched(held, searches).select("lead_key", "query", "state", "sightings", "search_runs")


EVENT_LEADS = """WITH l AS (SELECT user_id, count(*) AS sightings FROM events WHERE event_type = 'view' GROUP BY user_id),
s AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, bool_or(event_type = 'purchase') AS found FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT left(sha256('hack ' || l.user_id || '|'), 48) AS lead_key, 'hack ' || l.user_id AS query, CASE WHEN found THEN 'RESOLVED' WHEN n IS NOT NULL THEN 'UNRESOLVED' ELSE 'NEW' END AS state, sightings, coalesce(n, 0) AS search_runs
FROM l LEFT JOIN s ON l.user_id = s.user_id"""


def event_due_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 leads to search next: never searched first, then the most sighted."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("sightings"), F.sum((F.col("event_type") == "error").cast("int")).cast("int").alias("search_runs"), F.max(F.when(F.col("event_type") == "error", F.date_trunc("second", "ts"))).alias("last_searched_at"))
    rows = users.select(F.lpad(F.col("user_id").cast("string"), 9, "0").alias("lead_key"), F.lit("UNRESOLVED").alias("state"), "sightings", "search_runs", "last_searched_at")
    return leads.due_leads(rows, F.lit("2024-03-20 00:00:00").cast("timestamp_ntz"), 25).select("lead_key", "sightings", "search_runs")


EVENT_DUE_LEADS = """WITH u AS (SELECT lpad(CAST(user_id AS VARCHAR), 9, '0') AS lead_key, count(*) AS sightings, CAST(sum((event_type = 'error')::INT) AS INTEGER) AS search_runs, max(CASE WHEN event_type = 'error' THEN date_trunc('second', ts) END) AS last FROM events GROUP BY user_id),
p AS (SELECT * FROM u ORDER BY last IS NOT NULL, sightings DESC, lead_key LIMIT 200)
SELECT lead_key, sightings, search_runs FROM p WHERE last IS NULL OR last + to_days(CAST(least(7 * pow(2, least(8, greatest(0, search_runs - 1))), 60) AS INTEGER)) <= TIMESTAMP '2024-03-20' ORDER BY last IS NOT NULL, sightings DESC, lead_key LIMIT 25"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of events as a run of the pipeline: its counters."""
    kinds = F.create_map(*(F.lit(x) for pair in {"view": "query", "click": "candidate", "purchase": "processed", "signup": "lead", "error": "lead_search"}.items() for x in pair))
    e = table(spark, sf_dir, "events")
    steps = e.select(F.dayofyear("ts").alias("run_id"), kinds[F.col("event_type")].alias("kind"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"), F.col("ts").alias("at"))
    return history.run_totals(steps).drop("started_at", "ended_at")


EVENT_RUNS = """SELECT dayofyear(ts) AS run_id, CAST(sum((event_type = 'view')::INT) AS BIGINT) AS n_query, CAST(sum((event_type = 'click')::INT) AS BIGINT) AS n_candidate, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS n_processed,
CAST(sum((event_type = 'signup')::INT) AS BIGINT) AS n_lead, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS n_lead_search, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS n_error FROM events GROUP BY 1"""


def event_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each user's latest events in a row."""
    return history.failures_in_a_row(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("error", "view")).select("user_id", F.col("failures").cast("long").alias("failures"))


EVENT_FAILURES = """WITH l AS (SELECT user_id, max(CASE WHEN event_type NOT IN ('error', 'view') THEN event_id END) AS ok FROM events GROUP BY user_id)
SELECT user_id, CAST(sum((ok IS NULL OR event_id > ok)::INT) AS BIGINT) AS failures FROM events JOIN l USING (user_id) GROUP BY user_id"""


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' state after January's second half is merged in: the later moment, and the
    new snippet where there is one."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("snippet"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    held = history.latest(e.filter(F.col("ts") < cut), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "ts", "snippet")
    return history.touch(held, history.latest(e.filter(F.col("ts") >= cut), ["user_id"], [F.desc("ts"), F.desc("event_id")]), "user_id", "ts", ["snippet"]).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), "snippet")


EVENT_CANDIDATES = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS snippet FROM events),
a AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, strftime(coalesce(b.ts, a.ts), '%Y-%m-%d %H:%M:%S') AS seen, coalesce(nullif(b.snippet, ''), a.snippet) AS snippet FROM a FULL JOIN b ON a.user_id = b.user_id"""


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and event types as an event's sources: the first week held, the rest seen."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("url"), F.col("ts").alias("at"))
    cut = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    held = e.filter(F.col("at") < cut).groupBy("event_id", "url").agg(F.max("at").alias("last_seen")).withColumn("canonical", F.col("url") == "signup")
    return history.attach_sources(held, e.filter(F.col("at") >= cut)).select("event_id", "url", "canonical", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


EVENT_SOURCES = """SELECT user_id AS event_id, event_type AS url, event_type = 'signup' AND min(ts) < TIMESTAMP '2024-01-08' AS canonical, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id, event_type"""


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of the month as a fetch: appended unless the newest
    snapshot of the first half has the same content."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("fetched_at"), F.sha2("event_type", 256).alias("digest"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    fetched = history.latest(e.filter(F.col("fetched_at") >= cut), ["user_id"], [F.desc("fetched_at"), F.desc("event_id")])
    return history.append_snapshots(e.filter(F.col("fetched_at") < cut), fetched, "user_id", "digest").select("user_id", "event_id")


EVENT_SNAPSHOTS = """WITH a AS (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
b AS (SELECT user_id, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT b.user_id, event_id FROM b LEFT JOIN a ON a.user_id = b.user_id WHERE b.event_type IS DISTINCT FROM a.event_type"""


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's latest order as an update of the first: accepted if it says something
    new from a source no less trusted."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("digest"), (F.col("o_orderkey") % 10).cast("int").alias("authority"))
    stored = history.latest(o, ["o_custkey"], [F.col("o_orderkey")]).withColumn("version", F.lit(1))
    offered = history.latest(o, ["o_custkey"], [F.desc("o_orderkey")])
    return history.accept_update(stored, offered, "o_custkey").select("o_custkey", "o_orderkey", "version")


ORDER_UPDATES = """WITH a AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), b AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT b.o_custkey, b.o_orderkey, 2 AS version FROM a JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_orderpriority <> b.o_orderpriority AND b.o_orderkey % 10 >= a.o_orderkey % 10"""


def order_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alerts without a receipt."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dedupe_key"), F.when(F.col("o_orderstatus") == "F", "SENT").otherwise("FAILED").alias("state"))
    return notify.pending(o.select("dedupe_key"), o)


ORDER_PENDING = "SELECT 'order:' || o_orderkey AS dedupe_key FROM orders WHERE o_orderstatus <> 'F'"


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states before and after the year, and how often the guess was right."""
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1995-06-01").cast("timestamp_ntz")
    counted = reports.kind_histogram(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), "o_orderstatus")
    judged = o.select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("got"), F.lit("1-URGENT").alias("want"), F.lit(1.0).alias("s"))
    return counted.join(reports.accuracy(judged, {"right": ("got", "want")}, "s"), counted.o_orderstatus == F.col("model")).select("o_orderstatus", "before", "after", "documents", F.col("right").cast("long").alias("right"))


ORDER_REPORTS = """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') AS before, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') AS after, count(*) AS documents,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "right" FROM orders GROUP BY o_orderstatus"""


def order_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 40 orders that start next those still to come, and of those rejected for a
    reason the last 10."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("start"), F.array(F.col("o_orderpriority")).alias("reasons"), F.col("o_orderdate").alias("updated_at"))
    cut = F.lit("1992-01-05").cast("timestamp_ntz")
    return reports.upcoming(o, cut, 40).select("id", F.lit("upcoming").alias("list")).unionByName(reports.rejections(o, "1-URGENT", 10).select("id", F.lit("rejected").alias("list")))


ORDER_UPCOMING = """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS start, o_orderpriority, o_orderdate FROM orders),
u AS (SELECT * FROM o ORDER BY start NULLS LAST, id LIMIT 40), r AS (SELECT id FROM o WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, id LIMIT 10)
SELECT id, 'upcoming' AS list FROM u WHERE start IS NULL OR start >= TIMESTAMP '1992-01-05' UNION ALL SELECT id, 'rejected' FROM r"""


HOSTS = ("http://127.0.0.1", "http://[::1]", "https://[2606:4700::1111]", "http://2130706433", "https://8.8.8.8", "http://10.1.2.3.", "https://[fd00::1]", "https://134744072", "ftp://example.org", "https://u:p@example.org", "https://example.org", "http://0x7f.1", "http://localhost", "https://[2001:db8::1]")
PUBLIC = (4, 2, 7, 10)


def page_public_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths under one of fourteen hosts: whether the address is public, the host."""
    url = F.concat(_pick(HOSTS, F.col("page_id")), F.lit("/p"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", urls.is_public_url(url).alias("public"), urls.host_of(url).alias("host"))


PAGE_PUBLIC_HOSTS = f"""SELECT page_id, page_id % {len(HOSTS)} IN {PUBLIC} AS public, {_sql_pick(tuple(h.split('//')[1].split('@')[-1].lower() for h in HOSTS), 'page_id')} AS host FROM pages"""


def supplier_organizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as organizers'."""
    name = F.concat(F.regexp_replace("s_name", "#", " "), F.lit(", Inc. Corp."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalize_organizer(name).alias("organizer"))


SUPPLIER_ORGANIZERS = "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS organizer FROM supplier"

QUERIES = {f.__name__: f for f in (order_verify, order_score, order_match, order_compare, order_changes, order_alerts, event_timers, event_lead_state, event_due_leads, event_runs, event_failures, event_candidates, event_sources, event_snapshots, order_updates, order_pending, order_reports, order_upcoming, page_public_hosts, supplier_organizers)}
SQL = {
    "order_verify": ORDER_VERIFY, "order_score": ORDER_SCORE, "order_match": ORDER_MATCH, "order_compare": ORDER_COMPARE, "order_changes": ORDER_CHANGES, "order_alerts": ORDER_ALERTS, "event_timers": EVENT_TIMERS,
    "event_lead_state": EVENT_LEADS, "event_due_leads": EVENT_DUE_LEADS, "event_runs": EVENT_RUNS, "event_failures": EVENT_FAILURES, "event_candidates": EVENT_CANDIDATES, "event_sources": EVENT_SOURCES,
    "event_snapshots": EVENT_SNAPSHOTS, "order_updates": ORDER_UPDATES, "order_pending": ORDER_PENDING, "order_reports": ORDER_REPORTS, "order_upcoming": ORDER_UPCOMING, "page_public_hosts": PAGE_PUBLIC_HOSTS, "supplier_organizers": SUPPLIER_ORGANIZERS,
}
