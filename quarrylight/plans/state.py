"""Queries over the state-like tables: ``events``, ``orders``, ``customer``, ``nation``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import dates
from quarrylight.operators import commands, history, leads, notify, reports
from quarrylight.operators.buckets import merge_bucketed, read_bucketed
from quarrylight.plans.common import shared_folder, table

NOW = "2024-02-15 00:00:00"


def _as_of() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


EVENT_LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots after retention: old ones go unless they are a user's newest, which lose
    their payload."""
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return history.retain(_events(spark, sf_dir), "user_id", "event_id", "ts", cut, "props").select("event_id", "user_id", "props")


EVENT_RETENTION = """SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN props END AS props FROM events
WHERE ts >= TIMESTAMP '2024-01-20' OR event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)"""


def event_asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last purchase before each event (as-of)."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return _events(spark, sf_dir).select("event_id", F.last(bought, ignorenulls=True).over(window).alias("purchase"))


EVENT_ASOF = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase FROM events"


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive events of a user as versions of one row: what changed, and how."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumns({"before": F.lag("event_type").over(window), "old": F.lag("value").over(window)})
    kind = F.when(~F.col("event_type").eqNullSafe(F.col("before")) & (F.col("event_type") == "signup"), "OPENED").when(~F.col("event_type").eqNullSafe(F.col("before")) & (F.col("event_type") == "error"), "CLOSED").when(F.col("value") > F.col("old"), "EXTENDED").when(F.col("value") < F.col("old"), "CHANGED")
    return rows.filter(F.col("before").isNotNull()).withColumn("change", kind).filter("change is not null").groupBy("user_id", "change").agg(F.count("*").alias("n"))


EVENT_CHANGES = """WITH l AS (SELECT user_id, event_type, value, lag(event_type) OVER w AS before, lag(value) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, CASE WHEN event_type <> before AND event_type = 'signup' THEN 'OPENED' WHEN event_type <> before AND event_type = 'error' THEN 'CLOSED' WHEN value > old THEN 'EXTENDED' WHEN value < old THEN 'CHANGED' END AS change FROM l WHERE before IS NOT NULL)
SELECT user_id, change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY ALL"""


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a user's state: an event that repeats the type before is none."""
    return history.versions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "version")


EVENT_VERSIONS = """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version FROM l WHERE before IS DISTINCT FROM event_type"""


def event_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("at", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return history.debounce(rows, "user_id", "at").select("event_id", "quiet")


EVENT_DEBOUNCE = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) > 1 AS quiet FROM events"


def event_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_events(spark, sf_dir), "event_type")


EVENT_STATES = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


def event_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons held as JSON lists, unnested and counted."""
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.to_json(F.array_compact(F.array(F.when(k % 2 == 0, "LOW_AUTHORITY"), F.when(k % 3 == 0, "RESULTS_ONLY"), F.when(k % 5 == 0, "PAST_EVENT"))))
    return reports.reason_counts(_events(spark, sf_dir).select(codes.alias("codes")), F.from_json("codes", "array<string>"))


EVENT_REASONS = """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT unnest(list_filter([CASE WHEN k % 2 = 0 THEN 'LOW_AUTHORITY' END, CASE WHEN k % 3 = 0 THEN 'RESULTS_ONLY' END, CASE WHEN k % 5 = 0 THEN 'PAST_EVENT' END], lambda x: x IS NOT NULL)) AS reason FROM k)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""


def event_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).filter(k > 90).select("event_id", k.alias("k"))


EVENT_JSON = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90"


def event_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))


EVENT_SUCCESS = "SELECT user_id, event_type, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type"


def event_due_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as leads: searched as often as they failed, due again after a backoff."""
    users = _events(spark, sf_dir).groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("int")).cast("int").alias("errors"), F.max("ts").alias("searched"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    runs, state = F.col("errors") % 6, F.when(F.col("last_type") == "purchase", "RESOLVED").otherwise("UNRESOLVED")
    return users.select("user_id", dates.backoff_days(runs).alias("days"), dates.lead_due(state, runs, F.col("searched"), _as_of()).alias("due"))


EVENT_BACKOFF = f"""WITH u AS (SELECT user_id, CAST(sum((event_type = 'error')::INT) AS INTEGER) % 6 AS runs, date_trunc('second', max(ts)) AS searched, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS t FROM events GROUP BY user_id),
d AS (SELECT *, CAST(least(7 * pow(2, greatest(0, runs - 1)), 60) AS INTEGER) AS days FROM u)
SELECT user_id, days, searched + to_days(CASE WHEN t = 'purchase' THEN 30 ELSE days END) <= TIMESTAMP '{NOW}' AS due FROM d"""


def event_overdue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most overdue of the users as scheduled queries."""
    e = _events(spark, sf_dir)
    queries = e.groupBy(F.col("user_id").cast("string").alias("query")).agg((F.max("value") * 100).cast("long").alias("weight")).withColumn("every_hours", F.lit(24))
    runs = e.select(F.col("user_id").cast("string").alias("query"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"), F.date_trunc("hour", "ts").alias("started_at"))
    return leads.due_queries(queries, runs, _as_of(), 20).select("query", "weight", F.round("overdue", 3).alias("overdue"))


EVENT_OVERDUE = f"""WITH q AS (SELECT CAST(user_id AS VARCHAR) AS query, CAST(trunc(max(value) * 100) AS BIGINT) AS weight, max(CASE WHEN event_type <> 'error' THEN date_trunc('hour', ts) END) AS last FROM events GROUP BY user_id)
SELECT query, weight, round(coalesce(date_diff('second', last, TIMESTAMP '{NOW}') / 3600.0::DOUBLE - 24, 10000.0::DOUBLE), 3) AS overdue FROM q ORDER BY overdue DESC, weight DESC, query DESC LIMIT 20"""


def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month as held state, the second half merged into it."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    cut, order = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), [F.desc("ts"), F.desc("event_id")]
    current = history.latest(e.filter(F.col("ts") < cut), ["user_id"], order)
    return history.upsert(current, e.filter((F.col("ts") >= cut) & (F.col("value") > 30)), ["user_id"], order).select("user_id", "event_id")


EVENT_UPSERT = """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND value > 30)
SELECT user_id, event_id FROM b WHERE n = 1 UNION ALL SELECT user_id, event_id FROM a WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM b)"""


def event_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys (user and type) to append to an outbox that has the first day's."""
    e = _events(spark, sf_dir).withColumn("dedupe_key", F.concat_ws(":", "user_id", "event_type"))
    day = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return history.insert_if_absent(e.filter(F.col("ts") < day), e.filter(F.col("ts") >= day), ["dedupe_key"], [F.col("ts"), F.col("event_id")]).select("dedupe_key", "event_id")


EVENT_OUTBOX = """WITH e AS (SELECT *, user_id || ':' || event_type AS dedupe_key FROM events)
SELECT dedupe_key, arg_min(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id FROM e WHERE ts >= TIMESTAMP '2024-01-02' AND dedupe_key NOT IN (SELECT dedupe_key FROM e WHERE ts < TIMESTAMP '2024-01-02') GROUP BY dedupe_key"""


def event_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.smoothed(_events(spark, sf_dir), "user_id", "event_id", "value").select("user_id", F.round("smoothed", 6).alias("smoothed"))


EVENT_SMOOTHED = """WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda m, x: 0.8::DOUBLE * m + 0.2::DOUBLE * x), 6) AS smoothed FROM s"""


def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events as a table of each user's newest, in buckets; the rest of
    every fifth user's merged in, which rewrites their buckets alone."""
    path, e = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", _events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    newest = [F.desc("ts"), F.desc("event_id")]
    merge_bucketed(e.filter("event_id % 3 <> 0"), path, ["user_id"], newest)
    merge_bucketed(e.filter("event_id % 3 = 0 and user_id % 5 = 0"), path, ["user_id"], newest)
    return read_bucketed(spark, path).select("user_id", "event_id", "event_type")


EVENT_MERGE = """WITH r AS (SELECT *, event_id % 3 = 0 AS late FROM events WHERE event_id % 3 <> 0 OR user_id % 5 = 0)
SELECT user_id, event_id, event_type FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY late DESC, ts DESC, event_id DESC) = 1"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, appended by a stream of micro-batches."""
    from quarrylight.streaming.seeds import append_new, read

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = _events(spark, sf_dir)
    stream = read(spark, sf_dir, source.schema, only="events.parquet")
    first = lambda df: df.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    append_new(stream, ["user_id", "event_type"], f"{folder}/out", f"{folder}/checkpoint", first).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type", "event_id")


EVENT_STREAM = "SELECT user_id, event_type, arg_min(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id FROM events GROUP BY user_id, event_type"


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands on customers: edits, resets and deletes, which take the
    customer's orders along; customers and orders that are left."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    named, moved = F.concat(F.lit("n"), k.cast("string")), F.when(k % 4 > 0, F.concat(F.lit("s"), k.cast("string")))
    op = F.when((kind == "error") & (k < 8), "DELETE").when(kind == "signup", "SEARCH_NOW").otherwise("EDIT")
    fields = F.when(kind == "click", F.create_map(F.lit("name"), named)).when(kind == "view", F.create_map(F.lit("state"), moved)).when(kind == "purchase", F.create_map(F.lit("name"), named, F.lit("state"), moved))
    log = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), fields.alias("fields"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"), F.col("c_nationkey").cast("int").alias("search_runs"))
    left = commands.cascade(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), log, "id").groupBy("id").agg(F.count("*").alias("n"))
    return commands.apply_commands(rows, log, "id").join(left, "id", "left").select("id", "name", "state", "search_runs", F.coalesce("n", F.lit(0)).alias("n_orders"))


EVENT_COMMANDS = """WITH l AS (SELECT event_id AS seq, user_id AS id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
d AS (SELECT DISTINCT id FROM l WHERE t = 'error' AND k < 8),
n AS (SELECT id, arg_max('n' || k, seq) AS v FROM l WHERE t IN ('click', 'purchase') GROUP BY id),
s AS (SELECT id, CASE WHEN t = 'signup' THEN 'NEW' WHEN k % 4 > 0 THEN 's' || k END AS v FROM l WHERE t IN ('view', 'purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
r AS (SELECT DISTINCT id FROM l WHERE t = 'signup'), o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(n.v, c_name) AS name, CASE WHEN s.id IS NULL THEN c_mktsegment ELSE s.v END AS state, CAST(CASE WHEN r.id IS NULL THEN c_nationkey ELSE 0 END AS INTEGER) AS search_runs, coalesce(o.n, 0) AS n_orders
FROM customer LEFT JOIN n ON n.id = c_custkey LEFT JOIN s ON s.id = c_custkey LEFT JOIN r ON r.id = c_custkey LEFT JOIN o ON o.id = c_custkey WHERE c_custkey NOT IN (SELECT id FROM d)"""


def event_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users as hosts, judged by a circuit breaker in a stream."""
    from quarrylight.streaming.breaker import STORE, guarded
    from quarrylight.streaming.seeds import read

    folder = f"{shared_folder(spark)}/breaker-{uuid.uuid4().hex}"
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "purchase", "OK").when((F.col("event_type") == "signup") & (k % 2 == 0), "LIMITED").otherwise("FAILED")
    stream = read(spark, sf_dir, _events(spark, sf_dir).schema, only="events.parquet")
    requests = stream.select("user_id", F.col("event_id").alias("id"), (k % 9).cast("string").alias("url"), F.col("ts").cast("timestamp").alias("moment"), kind.alias("kind"), (k * 600).alias("delay"))
    before = {name: spark.conf.get(name, None) for name in STORE}
    try:
        for name, value in STORE.items():
            spark.conf.set(name, value)
        query = guarded(requests, "user_id").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", F.col("id").alias("event_id"), "admitted")


EVENT_BREAKER = """WITH RECURSIVE
r AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events),
e AS (SELECT user_id, event_id, sec, CAST(k % 9 AS VARCHAR) AS url, CAST(k * 600 AS BIGINT) AS delay, CASE WHEN event_type = 'purchase' THEN 'OK' WHEN event_type = 'signup' AND k % 2 = 0 THEN 'LIMITED' ELSE 'FAILED' END AS kind,
      row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM r),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, true AS admitted, CAST([] AS VARCHAR[]) AS failed, CAST(0 AS BIGINT) AS ends, CAST(NULL AS BIGINT) AS seen FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, n, event_id, lets, CASE WHEN NOT lets THEN f WHEN kind = 'OK' OR (kind = 'FAILED' AND len(g) >= 5) THEN [] WHEN kind = 'FAILED' THEN g ELSE f END,
             CASE WHEN NOT lets THEN ends WHEN kind = 'LIMITED' THEN greatest(ends, sec + delay) WHEN kind = 'FAILED' AND len(g) >= 5 THEN sec + 3600 ELSE ends END, sec
      FROM (SELECT e.*, s.ends, s.ends <= e.sec AS lets, CASE WHEN e.sec - s.seen > 86400 THEN [] ELSE s.failed END AS f,
                   list_distinct(list_append(CASE WHEN e.sec - s.seen > 86400 THEN [] ELSE s.failed END, e.url)) AS g
            FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, event_id, admitted FROM s WHERE n > 0"""


def event_change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts about the changes of a user's day, one for each."""
    kinds = {"signup": "REGISTRATION_OPENED", "purchase": "DEADLINE_EXTENDED", "click": "LOCATION_CHANGED", "error": "EVENT_CANCELLED", "view": "PRIZE_CHANGED"}
    change = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("event_id"), F.dayofmonth("ts").alias("version"), change.alias("change"), (F.col("event_type") != "view").alias("notify"))
    return notify.change_alerts(rows).select("dedupe_key", "headline", "changes", "urgent")


EVENT_ALERTS = """WITH c AS (SELECT user_id, day(ts) AS version, list_sort(list(DISTINCT CASE event_type WHEN 'signup' THEN 'REGISTRATION_OPENED' WHEN 'purchase' THEN 'DEADLINE_EXTENDED' WHEN 'click' THEN 'LOCATION_CHANGED' ELSE 'EVENT_CANCELLED' END)) AS l FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT 'change:' || user_id || ':' || version AS dedupe_key, CASE WHEN len(l) > 1 THEN len(l) || ' changes' ELSE CASE l[1] WHEN 'REGISTRATION_OPENED' THEN 'Registration Opened' WHEN 'DEADLINE_EXTENDED' THEN 'Deadline Extended' WHEN 'LOCATION_CHANGED' THEN 'Location Changed' ELSE 'Event Cancelled' END END AS headline,
array_to_string(l, ',') AS changes, list_contains(l, 'EVENT_CANCELLED') OR list_contains(l, 'REGISTRATION_OPENED') AS urgent FROM c"""


def order_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched to customers by either of two keys: a union of equi-joins."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by_customer = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey")
    by_order = o.join(c, o.o_orderkey == c.c_custkey).select("o_orderkey", "c_custkey")
    return by_customer.unionByName(by_order).distinct().groupBy("o_orderkey").agg(F.min("c_custkey").alias("match"))


ORDER_KEYS = "SELECT o_orderkey, min(c_custkey) AS match FROM (SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_orderkey = c_custkey) GROUP BY o_orderkey"


def customer_announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with whether an order of theirs was filled."""
    sent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "SENT").otherwise("PENDING").alias("state"))
    return reports.announced(table(spark, sf_dir, "customer").select("c_custkey"), sent, "c_custkey")


CUSTOMER_ANNOUNCED = "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS announced FROM customer"


def order_month_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("requests"))
    return reports.month_total(runs, "o_orderdate", "requests", F.lit("1998-01-01").cast("timestamp_ntz"))


ORDER_TOTAL = "SELECT CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


def order_top_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest orders, of which the open ones: the limit comes first."""
    return reports.top_then_filter(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")


ORDER_TOP = "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) WHERE o_orderstatus = 'O'"


def order_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with manual edits, in which an explicit null is a value."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    edits = o.filter(k % 7 == 0).select("o_orderkey", F.when(k % 2 == 0, F.create_map(F.lit("o_orderstatus"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("o_orderpriority"), F.lit("edited"))).alias("edits"))
    return history.overlay(o, edits, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


ORDER_OVERLAY = "SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 14 = 7 THEN 'edited' ELSE o_orderpriority END AS o_orderpriority FROM orders"


def query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's name in every region's template (two small fixed tables)."""
    organizers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organizer_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lower("n_name"))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    templates = table(spark, sf_dir, "region").select(F.concat(F.lit("{organizer} in "), "r_name").alias("template"), F.col("r_regionkey").alias("weight"))
    return leads.search_queries(organizers, templates)


QUERY_TEMPLATES = "SELECT n_nationkey AS organizer_id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END || ' in ' || r_name AS query, r_regionkey AS weight FROM nation, region"


def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals({n: table(spark, sf_dir, n) for n in ("events", "orders", "customer", "pages")})


TABLE_TOTALS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("events", "orders", "customer", "pages"))

QUERIES = {f.__name__: f for f in (event_latest_per_user, event_retention, event_asof_purchase, event_changes, event_versions, event_debounce, event_state_counts, event_reason_counts, event_json_filter, event_last_success, event_due_backoff, event_overdue_topk, event_upsert, event_outbox, event_smoothed, event_merge, event_commands, event_breaker, event_stream, event_change_alerts, order_two_keys, customer_announced, order_month_total, order_top_then_filter, order_overlay, query_templates, table_totals)}
SQL = {
    "event_latest_per_user": EVENT_LATEST, "event_retention": EVENT_RETENTION, "event_asof_purchase": EVENT_ASOF, "event_changes": EVENT_CHANGES, "event_versions": EVENT_VERSIONS,
    "event_debounce": EVENT_DEBOUNCE, "event_state_counts": EVENT_STATES, "event_reason_counts": EVENT_REASONS, "event_json_filter": EVENT_JSON, "event_last_success": EVENT_SUCCESS,
    "event_due_backoff": EVENT_BACKOFF, "event_overdue_topk": EVENT_OVERDUE, "event_upsert": EVENT_UPSERT, "event_outbox": EVENT_OUTBOX, "event_smoothed": EVENT_SMOOTHED, "event_merge": EVENT_MERGE, "event_commands": EVENT_COMMANDS, "event_breaker": EVENT_BREAKER,
    "event_stream": EVENT_STREAM, "event_change_alerts": EVENT_ALERTS, "order_two_keys": ORDER_KEYS, "customer_announced": CUSTOMER_ANNOUNCED, "order_month_total": ORDER_TOTAL, "order_top_then_filter": ORDER_TOP,
    "order_overlay": ORDER_OVERLAY, "query_templates": QUERY_TEMPLATES, "table_totals": TABLE_TOTALS,
}
