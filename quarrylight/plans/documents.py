"""Queries over ``documents``, ``labels``, ``orders`` texts and ``conversations``."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import dates
from quarrylight.functions.text import content_prefix_hash, edition_key, editions_conflict, normalize_text, normalize_title, summarise, summarise_eligibility, tokens
from quarrylight.operators.classify import classify_category, classify_document, classify_mention, detect_country, is_plausibly_relevant
from quarrylight.operators.decide import authority_points, tier
from quarrylight.operators.extract import confidence, extract_eligibility, extract_location, merge_fill_only
from quarrylight.operators.leads import mentions
from quarrylight.operators.resolve import leaders, similar_recent
from quarrylight.operators.similar import similar_contents
from quarrylight.sources.search import prefetched
from quarrylight.sources.threads import clean_lines, extract_urls, json_records, merge_threads, outbound, replayed
from quarrylight.plans.common import LOWER, NORMAL, any_of, first_of, table

#: A rules table whose terms occur in the invented prose of ``documents``.
PROSE = SimpleNamespace(
    ACTION_TERMS=("licensed under", "token ="),
    HEADLINE_RESULT_TERMS=("thathe", "erver", "tionth"),
    HEADLINE_RECAP_TERMS=("ouelle", "queau", "osar"),
    RESULT_TERMS=("anding", "ingbe"),
    RECAP_TERMS=("ciónes", "enbe"),
    JOB_TERMS=("@mail1.", "@mail2."),
    CATEGORY_TERMS=(("HACKATHON", ("thtion", "hathe")), ("DATATHON", ("keit",)), ("IDEATHON", ("eaux",))),
    HEADLINE_CHARS=200,
)
SQL_TITLE = r"regexp_extract(text, '^([^\n]*)', 1)"


def _title() -> Column:
    return F.regexp_extract("text", r"^([^\n]*)", 1)


def doc_prefix_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that open with the same 24 words: key, how many, the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_prefix_hash(F.col("text")).alias("prefix"))
    return docs.filter("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


PREFIX = f"CASE WHEN len(string_split({NORMAL.format('text')}, ' ')) >= 4 THEN left(sha256(array_to_string(list_slice(string_split({NORMAL.format('text')}, ' '), 1, 24), ' ')), 32) END"
DOC_PREFIX = f"SELECT prefix, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {PREFIX} AS prefix FROM documents) WHERE prefix IS NOT NULL GROUP BY prefix HAVING count(*) > 1"


def doc_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the leader of its opening."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content_prefix_hash(F.col("text")).alias("prefix"))
    return leaders(docs, "prefix", ["id"]).select(F.col("id").alias("doc_id"), "leader")


DOC_LEADERS = f"WITH p AS (SELECT doc_id, {PREFIX} AS prefix FROM documents) SELECT doc_id, CASE WHEN prefix IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY prefix) END AS leader FROM p"


def doc_normalized_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_title(_title()).alias("title"), F.size(tokens(normalize_text(F.col("text")))).alias("n_tokens"))


DOC_TITLE = f"""SELECT doc_id, array_to_string(list_filter(string_split({NORMAL.format(SQL_TITLE)}, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(repr(t) for t in rules.TITLE_NOISE)})), ' ') AS title,
CAST(len(list_filter(string_split({NORMAL.format('text')}, ' '), lambda t: t <> '')) AS INTEGER) AS n_tokens FROM documents"""


def doc_rule_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify_category(F.col("text"), PROSE.CATEGORY_TERMS, ("ción", "sch")).alias("category"))


DOC_CATEGORY = f"SELECT doc_id, coalesce({first_of('x', PROSE.CATEGORY_TERMS)}, CASE WHEN {any_of('x', ('ción', 'sch'))} THEN 'OTHER_COMPETITION' END, 'UNKNOWN') AS category FROM (SELECT doc_id, {LOWER.format('text')} AS x FROM documents)"


def doc_kind_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify_document(F.col("text"), _title(), F.lit(None).cast("string"), PROSE).alias("kind"))


_act, _head = any_of("w", PROSE.ACTION_TERMS), any_of("h", PROSE.ACTION_TERMS)
DOC_KIND = f"""SELECT doc_id, CASE WHEN NOT {_head} AND {any_of('h', PROSE.HEADLINE_RESULT_TERMS)} THEN 'WINNER_ANNOUNCEMENT'
WHEN NOT {_head} AND {any_of('h', PROSE.HEADLINE_RECAP_TERMS)} THEN 'PAST_EVENT_RECAP'
WHEN NOT {_act} AND {any_of('w', PROSE.RESULT_TERMS)} THEN 'WINNER_ANNOUNCEMENT' WHEN NOT {_act} AND {any_of('w', PROSE.RECAP_TERMS)} THEN 'PAST_EVENT_RECAP'
WHEN NOT {_act} AND contains(w, 'results') THEN 'RESULTS_POST' WHEN contains(w, 'webinar') AND NOT {any_of('w', ('competition', 'hackathon'))} THEN 'WEBINAR'
WHEN contains(w, 'conference') AND NOT contains(w, 'hackathon') AND (NOT contains(w, 'competition') OR contains(w, 'no competition')) THEN 'CONFERENCE'
WHEN {any_of('w', PROSE.JOB_TERMS)} THEN 'JOB_POSTING' WHEN {_act} THEN 'REGISTRATION_OPEN'
WHEN {any_of('w', [t for _, ts in PROSE.CATEGORY_TERMS for t in ts] + list(rules.OTHER_TERMS))} THEN 'EVENT_ANNOUNCEMENT' ELSE 'UNRELATED' END AS kind
FROM (SELECT doc_id, {LOWER.format("CASE WHEN " + SQL_TITLE + " <> '' THEN " + SQL_TITLE + " || chr(10) || text ELSE text END")} AS w,
{LOWER.format("CASE WHEN " + SQL_TITLE + " <> '' THEN " + SQL_TITLE + " ELSE left(text, 200) END")} AS h FROM documents)"""


def doc_relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = is_plausibly_relevant(F.col("text"), ("thtion", "keit"), ("ing", "eaux"), ("licensed under", "token ="))
    return table(spark, sf_dir, "documents").filter(relevant).select("doc_id", "source")


DOC_RELEVANCE = f"SELECT doc_id, source FROM (SELECT doc_id, source, {LOWER.format('text')} AS x FROM documents) WHERE trim(x) <> '' AND ({any_of('x', ('thtion', 'keit'))} OR ({any_of('x', ('ing', 'eaux'))} AND {any_of('x', ('licensed under', 'token ='))}))"
MARKERS = ("keit", "ung", "schen", "lich", "heit")
PLACES = (("FR", ("eaux", "tionoi")), ("ES", ("ción",)))


def doc_language_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", detect_country(F.col("text"), ("that the", "of the"), PLACES, MARKERS, 2, "DE").alias("country"))


DOC_MARKERS = f"SELECT doc_id, coalesce(CASE WHEN {any_of('x', ('that the', 'of the'))} THEN 'PH' END, {first_of('x', PLACES)}, CASE WHEN {' + '.join(f'contains(x, {m!r})::INT' for m in MARKERS)} >= 2 THEN 'DE' END) AS country FROM (SELECT doc_id, {LOWER.format('text')} AS x FROM documents)"


def doc_edition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition keys of titles made of the source, a year and sometimes a season, and
    whether they contradict the year before the document's own."""
    i = F.col("doc_id")
    title = F.concat(F.col("source"), F.when(i % 4 != 0, F.concat(F.lit(" "), (2000 + i % 30).cast("string"))).otherwise(""), F.when(i % 3 == 0, F.concat(F.lit(" Season "), (i % 12 + 1).cast("string"))).otherwise(""))
    key = edition_key(normalize_title(title), F.when(i % 8 == 0, 2000 + i % 7), F.when(i % 5 == 0, i % 12 + 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("edition_key"))
    return docs.withColumn("conflict", editions_conflict(F.col("edition_key"), (2000 + (i - 1) % 30).cast("string")))


DOC_EDITION = """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(2000 + doc_id % 30 AS VARCHAR) WHEN doc_id % 8 = 0 THEN CAST(2000 + doc_id % 7 AS VARCHAR) END AS y,
CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 12 + 1 AS VARCHAR) END AS e, CASE WHEN doc_id % 5 = 0 THEN lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') END AS m FROM documents),
k AS (SELECT doc_id, CASE WHEN y IS NOT NULL AND e IS NOT NULL THEN y || ':edition-' || e WHEN y IS NOT NULL AND m IS NOT NULL THEN y || '-' || m WHEN y IS NOT NULL THEN y WHEN e IS NOT NULL THEN 'edition-' || e END AS edition_key FROM t)
SELECT doc_id, edition_key, coalesce(split_part(edition_key, '-', 1) <> CAST(2000 + (doc_id - 1) % 30 AS VARCHAR), false) AS conflict FROM k"""


def doc_confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    signals = [F.col("quality") == 1, F.col("toxic") == 0, F.col("lang") == "en", F.col("n_chars") > 1000, F.col("text").contains("\n"), F.col("source").isNotNull()]
    return d.join(lab, "doc_id").select("doc_id", F.round(confidence(signals), 6).alias("confidence"))


DOC_CONFIDENCE = "SELECT d.doc_id, round(least(0.95::DOUBLE, 0.35::DOUBLE + ((quality = 1)::INT + (toxic = 0)::INT + (lang = 'en')::INT + (n_chars > 1000)::INT + contains(text, chr(10))::INT + (source IS NOT NULL)::INT) * 0.12::DOUBLE), 6) AS confidence FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def doc_score_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points rounded half to even, and the tier of their sum."""
    points = authority_points(F.col("n_chars") % 131)
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", points.alias("points"), (F.when(F.col("quality") == 1, 50).otherwise(10) + F.when(F.col("toxic") == 0, 15).otherwise(0) + points + F.col("n_chars") % 40).cast("int").alias("total"))
    return d.withColumn("tier", tier(F.col("total")))


DOC_SCORE = """WITH p AS (SELECT d.doc_id, CAST(round_even(5 * least(100, n_chars % 131) / 100.0::DOUBLE, 0) AS INTEGER) AS points, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT doc_id, points, CAST(CASE WHEN quality = 1 THEN 50 ELSE 10 END + CASE WHEN toxic = 0 THEN 15 ELSE 0 END + points + n_chars % 40 AS INTEGER) AS total FROM p)
SELECT *, CASE WHEN total >= 80 THEN 'HIGH_PRIORITY' WHEN total >= 65 THEN 'RECOMMENDED' WHEN total >= 50 THEN 'POSSIBLE' ELSE 'LOW' END AS tier FROM t"""
OPENINGS = ("Online and in Makati: ", "A hybrid meeting. ", "Held at BGC for college students only. ", "Open to Filipinos, professionals welcome. ", "Not open to Philippines residents. ", "Virtual. ", "")
_sql_opening = f"list_extract([{', '.join(repr(o) for o in OPENINGS)}], CAST(doc_id % {len(OPENINGS)} + 1 AS INTEGER))"


def _opened() -> Column:
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return F.concat(opening, "text")


def doc_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = extract_location(_opened(), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", place.alias("p")).select("doc_id", "p.country", "p.city", "p.location_type", "p.confidence")


_city = first_of("x", [(name, (alias,)) for alias, name in rules.CITY_ALIASES])
DOC_LOCATION = f"""WITH t AS (SELECT doc_id, {NORMAL.format(_sql_opening + ' || text')} AS x FROM documents),
c AS (SELECT doc_id, x, {_city} AS city, {any_of('x', rules.PH_TERMS)} AS named, {any_of('x', rules.ONLINE_TERMS)} AS online FROM t)
SELECT doc_id, CASE WHEN named OR city IS NOT NULL THEN 'PH' END AS country, city,
CASE WHEN contains(x, 'hybrid') OR (online AND city IS NOT NULL) THEN 'HYBRID' WHEN online THEN 'ONLINE' WHEN named OR city IS NOT NULL THEN 'ONSITE' ELSE 'UNKNOWN' END AS location_type,
CASE WHEN city IS NOT NULL THEN 0.9::DOUBLE WHEN named THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM c"""


def doc_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_eligibility(_opened())
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("e")).select("doc_id", "e.student_only", "e.professionals_allowed", "e.philippines_allowed", "e.confidence")


DOC_ELIGIBILITY = f"""WITH t AS (SELECT doc_id, {NORMAL.format(_sql_opening + ' || text')} AS x FROM documents),
e AS (SELECT doc_id, x, CASE WHEN {any_of('x', rules.EXCLUDES_TERMS)} THEN false WHEN {any_of('x', rules.ALLOWS_TERMS)} THEN true END AS philippines_allowed, {any_of('x', rules.STUDENT_TERMS)} AS student FROM t)
SELECT doc_id, CASE WHEN student AND {any_of('x', rules.STUDENT_ONLY_TERMS)} THEN true END AS student_only, CASE WHEN {any_of('x', rules.PROFESSIONAL_TERMS)} THEN true END AS professionals_allowed,
philippines_allowed, CASE WHEN philippines_allowed IS NOT NULL OR student THEN 0.9::DOUBLE ELSE 0.25::DOUBLE END AS confidence FROM e"""


def doc_merge_fill_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing source is filled with the language if the quoted words are in the text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    base, quote = F.when(F.col("quality") == 1, F.col("source")), F.when(F.col("doc_id") % 2 == 0, "tion").otherwise("keit")
    return d.select("doc_id", merge_fill_only(base, F.col("lang"), quote, F.col("text")).alias("value"))


DOC_MERGE = "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN nullif(source, '') END, CASE WHEN contains(lower(text), CASE WHEN d.doc_id % 2 = 0 THEN 'tion' ELSE 'keit' END) THEN lang END) AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", summarise(F.col("text")).alias("summary"))


def doc_eligibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each text, cut at 200 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", summarise_eligibility(F.col("text")).alias("summary"))


DOC_SENTENCE = r"""WITH f AS (SELECT doc_id, regexp_extract(trim(text), '^((?s:.*?[.!?]))[ \t\n\x0B\f\r]', 1) AS ended, trim(text) AS whole FROM documents),
s AS (SELECT doc_id, CASE WHEN ended <> '' THEN ended ELSE whole END AS first FROM f)
SELECT doc_id, nullif(CASE WHEN length(first) > 200 THEN regexp_replace(left(first, 200), ' [^ ]*$', '') || '…' ELSE first END, '') AS summary FROM s"""


def doc_prefetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as seeds that brought their content along."""
    seeds = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://x.test/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("links"))
    return prefetched(seeds).select(F.col("final_url").alias("url"), "fetch_method", "content_hash", "usable")


DOC_PREFETCHED = r"""SELECT 'https://x.test/' || doc_id AS url, 'prefetched' AS fetch_method, sha256(coalesce(text, '')) AS content_hash, regexp_matches(coalesce(text, ''), '[^ \t\n\x0B\f\r]') AS usable FROM documents"""


def doc_similar_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class (equal words), and how many other classes have most
    of its words."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return similar_contents(d, "text").withColumnRenamed("id", "doc_id")


def doc_similar_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document announces (its summary) against the recent announcements, seen
    in the order of their ids, one a second: which of the 500 seen last have its words."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), summarise(F.col("text")).alias("announced"))
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("id") % 15552000)
    return similar_recent(d, d.withColumn("seen", at), "announced", "seen", F.timestamp_seconds(F.lit(1767225600 + 15552000)))


def order_labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written into announcements in three ways, read back."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date") + F.expr("INTERVAL 22 YEARS"))
    iso, named = F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "MMMM d, yyyy")
    way = F.col("o_orderkey") % 3
    text = F.when(way == 0, F.concat(F.lit("Entries. Registration deadline: "), iso)).when(way == 1, F.concat(F.lit("Open until "), named)).otherwise(F.concat(F.lit("Season 2031. Apply until "), F.date_format("d", "MMM d")))
    year = dates.context_year(text, F.lit(None).cast("timestamp"))
    fact = dates.labelled_date(text, dict(rules.DATE_LABELS)["registration_deadline"], year)
    return o.select("o_orderkey", fact.alias("f")).select("o_orderkey", F.date_format("f.value", "yyyy-MM-dd HH:mm").alias("value"), "f.confidence", "f.year_inferred")


ORDER_DATES = """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 22 YEARS AS d FROM orders),
v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN d WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE make_date(2031, month(d), day(d)) END AS d FROM t)
SELECT o_orderkey, strftime(d - INTERVAL 8 HOURS, '%Y-%m-%d %H:%M') AS value, CASE WHEN d IS NULL THEN 0.0::DOUBLE WHEN o_orderkey % 3 < 2 THEN 0.95::DOUBLE ELSE 0.65::DOUBLE END AS confidence, o_orderkey % 3 = 2 AND d IS NOT NULL AS year_inferred FROM v"""
ASKS = ("anyone know ", "looking for teammates ", "The hackathon 2026: register now ", "we are hiring ", "champions of ", "")
_sql_ask = f"list_extract([{', '.join(repr(a) for a in ASKS)}], CAST((conv_id + turn) % {len(ASKS)} + 1 AS INTEGER))"


def thread_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a thread, opened in one of six ways, by the ladder for posts."""
    ask = F.element_at(F.array(*map(F.lit, ASKS)), ((F.col("conv_id") + F.col("turn")) % len(ASKS) + 1).cast("int"))
    kind = classify_mention(F.concat(ask, "text"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))


_country = f"coalesce(CASE WHEN {any_of('x', rules.PH_TERMS)} THEN 'PH' END, {first_of('x', rules.FOREIGN_PLACES)}, CASE WHEN {' + '.join(f'contains(x, {m!r})::INT' for m in rules.MALAY_MARKERS)} >= 2 THEN 'MY' END)"
_cat = f"({any_of('x', rules.COMPETITION_TERMS)} OR regexp_matches(x, '\\bhack(?:athon|[a-z]*[0-9]|\\s*[0-9])') OR {any_of('x', [t for _, ts in rules.CATEGORY_TERMS for t in ts] + list(rules.OTHER_TERMS))})"
THREAD_KIND = f"""WITH t AS (SELECT conv_id, turn, {_sql_ask} || text AS b, {LOWER.format(_sql_ask + ' || text')} AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN b = '' THEN 'unrelated' WHEN {any_of('x', rules.RESULT_TERMS + rules.RECAP_TERMS)} THEN 'recap' WHEN {any_of('x', rules.JOB_HINTS)} THEN 'job'
WHEN coalesce({_country}, 'PH') <> 'PH' THEN 'foreign' WHEN {any_of('x', rules.TEAMMATE_HINTS)} THEN 'teammate'
WHEN {any_of('x', rules.QUESTION_HINTS)} OR (length(b) <= 400 AND contains(b, '?') AND {_cat} AND NOT {any_of('x', rules.ACTION_TERMS)}) THEN 'question'
WHEN NOT {any_of('x', rules.TALK_FORMATS)} AND {any_of('x', rules.TALK_WORDS)} THEN 'unrelated'
WHEN ({_cat} AND ({any_of('x', rules.ACTION_HINTS)} OR regexp_matches(b, '\\b20[0-9][0-9]\\b'))) OR ({any_of('x', rules.ACTION_HINTS)} AND regexp_matches(b, '\\b20[0-9][0-9]\\b')) THEN 'event' ELSE 'unrelated' END AS kind FROM t"""


def thread_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dumps of posts and replies with the kinds that they once had, read
    back and judged again: rows of each kind before and now."""
    ask = F.element_at(F.array(*map(F.lit, ASKS)), ((F.col("conv_id") + F.col("turn")) % len(ASKS) + 1).cast("int"))
    item = F.struct(F.element_at(F.array(*map(F.lit, ONCE)), (F.col("turn") % len(ONCE) + 1).cast("int")).alias("kind"), F.concat(ask, "text").alias("text"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("reply_to"))
    dump = F.to_json(F.struct(F.array(F.struct(item.alias("node"))).alias("posts")))
    dumps = table(spark, sf_dir, "conversations").select(dump.alias("payload"))
    return replayed(dumps, "payload", lambda text: classify_mention(text, F.array().cast("array<string>")))


ONCE = ("event", "question", "unrelated", "job")
THREAD_REPLAY = f"""WITH k AS ({THREAD_KIND}),
r AS (SELECT CASE WHEN k.turn > 0 THEN 'reply' ELSE 'post' END AS "where", list_extract([{", ".join(map(repr, ONCE))}], CAST(k.turn % {len(ONCE)} AS INTEGER) + 1) AS was, kind AS now FROM k),
b AS (SELECT "where", was AS kind, 1 AS b, 0 AS n FROM r UNION ALL SELECT "where", now, 0, 1 FROM r)
SELECT "where", kind, CAST(sum(b) AS BIGINT) AS before, CAST(sum(n) AS BIGINT) AS now FROM b GROUP BY "where", kind"""


def thread_merge_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread's turns as sightings of one post: its longest text (the earliest of
    equals), the roles in order as addresses, the first author of odd turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    seen = rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("seen"), "text", F.array("role").alias("urls"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("author"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("permalink"))
    return merge_threads(seen).select(F.col("id").alias("conv_id"), "text", F.array_join("urls", ",").alias("roles"), "author")


THREAD_LONGEST = """WITH t AS (SELECT conv_id, turn, min(text) AS text, min(role) AS role FROM conversations GROUP BY conv_id, turn),
r AS (SELECT conv_id, role, min(turn) AS first_at FROM t GROUP BY conv_id, role), l AS (SELECT conv_id, string_agg(role, ',' ORDER BY first_at) AS roles FROM r GROUP BY conv_id),
b AS (SELECT conv_id, arg_max(text, length(text) * 1000000 - turn) AS text, arg_min(role, turn) FILTER (WHERE turn % 2 = 1) AS author FROM t GROUP BY conv_id)
SELECT b.conv_id, text, roles, author FROM b JOIN l ON b.conv_id = l.conv_id"""


def thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as payloads of nested JSON, read back: posts, remarks, their addresses, and
    what of them leads off the platform; lines that the platform wrote are gone."""
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("Like\n"), F.col("text"), F.lit("\n3 h\nsee https://out.test/a), https://www.facebook.com/x"))
    post = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(body.alias("text")).alias("message"), (F.col("conv_id") * 100 + F.col("turn")).alias("post_id"))).alias("edges")).alias("data")))
    remark = F.to_json(F.struct(F.struct(body.alias("text")).alias("body"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id")))
    payload = F.concat(F.lit("for (;;);"), F.when(F.col("role") == "user", post).otherwise(remark), F.lit(" broken"))
    rows = c.select("conv_id", "turn", F.explode(json_records(payload)).alias("r"))
    links = extract_urls(F.col("r.text"), F.array().cast("array<string>"))
    return rows.select("conv_id", "turn", F.col("r.kind").alias("kind"), F.col("r.post_id").alias("post_id"), F.col("r.comment_id").alias("comment_id"), F.array_join(outbound(links), ",").alias("links"), F.md5(clean_lines(F.col("r.text"), F.lit(None).cast("string"))).alias("said"))


_line = "list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '' AND NOT regexp_matches(replace(lower(l), ' ', ''), '^[0-9]+[smhdwy]$') AND NOT regexp_matches(l, '^[0-9]{1,4}$'))"
THREAD_RECORDS = f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'post' ELSE 'comment' END AS kind, CASE WHEN role = 'user' THEN CAST(conv_id * 100 + turn AS VARCHAR) END AS post_id,
CASE WHEN role <> 'user' THEN 'c' || conv_id END AS comment_id, 'https://out.test/a' AS links, md5(array_to_string(list_append({_line}, 'see https://out.test/a), https://www.facebook.com/x'), chr(10))) AS said FROM conversations"""


def thread_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that turns mention, each turn a post or reply of its own: the turn's first
    word before a head term."""
    named = F.concat(F.lit("anyone joining the "), F.regexp_extract("text", r"^([A-Za-z]+)", 1), F.lit(" hackathon 2026? "), F.col("text"))
    posts = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("source_url"), F.lit("group").alias("platform"), named.alias("body"), F.lit("question").alias("kind"))
    found = mentions(posts)
    return found.groupBy("lead_key").agg(F.min("normalized_name").alias("normalized_name"), F.min("query").alias("query"), F.count("*").alias("sightings"))


_names = ", ".join(repr(w) for w in (*rules.NAME_STOPS, *rules.NAME_WEAK, *sorted({w + e for h in rules.NAME_HEADS for w in h.split() for e in ("", "s")})))
THREAD_LEADS = f"""WITH n AS (SELECT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS w FROM conversations)
SELECT left(sha256(w || ' hackathon|2026'), 48) AS lead_key, w || ' hackathon' AS normalized_name, w || ' hackathon 2026' AS query, count(*) AS sightings FROM n WHERE w <> '' AND w NOT IN ({_names}) GROUP BY w"""

QUERIES = {f.__name__: f for f in (doc_prefix_duplicates, doc_leaders, doc_normalized_title, doc_rule_category, doc_kind_ladder, doc_relevance_filter, doc_language_markers, doc_edition_key, doc_confidence_signals, doc_score_tier, doc_location, doc_eligibility, doc_merge_fill_only, doc_summary, doc_eligibility_summary, doc_prefetched, doc_similar_contents, doc_similar_recent, order_labelled_dates, thread_classify, thread_replay, thread_merge_longest, thread_records, thread_leads)}
SQL = {
    "doc_prefix_duplicates": DOC_PREFIX, "doc_leaders": DOC_LEADERS, "doc_normalized_title": DOC_TITLE, "doc_rule_category": DOC_CATEGORY, "doc_kind_ladder": DOC_KIND,
    "doc_relevance_filter": DOC_RELEVANCE, "doc_language_markers": DOC_MARKERS, "doc_edition_key": DOC_EDITION, "doc_confidence_signals": DOC_CONFIDENCE,
    "doc_score_tier": DOC_SCORE, "doc_location": DOC_LOCATION, "doc_eligibility": DOC_ELIGIBILITY, "doc_merge_fill_only": DOC_MERGE, "order_labelled_dates": ORDER_DATES,
    "doc_eligibility_summary": DOC_SENTENCE, "doc_prefetched": DOC_PREFETCHED, "thread_classify": THREAD_KIND, "thread_replay": THREAD_REPLAY, "thread_merge_longest": THREAD_LONGEST, "thread_records": THREAD_RECORDS, "thread_leads": THREAD_LEADS,
}
