from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarrylight.operators import classify, history, leads, resolve
from quarrylight.plans.discovery import detections, judged
from quarrylight.sources import html, search

NOW = dt.datetime(2026, 8, 30)
DOC = "id string, url string, title string, snippet string, text string, organizer string, published timestamp, links array<string>"
OPEN = "Registration is now open for college students nationwide. The hackathon takes place in Makati. Registration deadline: October 20, 2026. Event date: November 2, 2026."


def doc(i, title="City Hackathon 2026", text=OPEN, url=None, **kw):
    return (i, url or f"https://devpost.com/{i}", title, kw.get("snippet"), text, kw.get("organizer", "Acme"), dt.datetime(2026, 8, 25), kw.get("links", ["https://devpost.com/register/1"]))


def judge(spark, *docs):
    return {r.id: r for r in judged(spark.createDataFrame(list(docs), DOC), F.lit(NOW)).collect()}


@pytest.mark.parametrize(
    ("title", "text", "url", "kind"),
    [
        ("Team wins City Hackathon", "Register now", None, "WINNER_ANNOUNCEMENT"),
        ("City Hackathon wrapped up", "x", None, "PAST_EVENT_RECAP"),
        ("A school", "hackathon", "https://a.test/2026/08/03/x", "NEWS_ARTICLE"),
        ("Hackathon", "congratulations to all", None, "WINNER_ANNOUNCEMENT"),
        ("Hackathon", "winning team gets a prize. register now", None, "REGISTRATION_OPEN"),
        ("Hackathon", "the results are out", None, "RESULTS_POST"),
        ("A webinar", "on data", None, "WEBINAR"),
        ("Conference", "no competition here", None, "CONFERENCE"),
        ("Work", "we are hiring", None, "JOB_POSTING"),
        ("Datathon", "in May", None, "EVENT_ANNOUNCEMENT"),
        (None, "nothing at all", None, "UNRELATED"),
    ],
)
def test_document_kinds(spark, title, text, url, kind):
    df = spark.createDataFrame([(title, text, url)], "title string, text string, url string")
    assert df.select(classify.classify_document(F.col("text"), F.col("title"), F.col("url"))).first()[0] == kind


@pytest.mark.parametrize(
    ("body", "urls", "kind"),
    [
        ("", [], "unrelated"),
        ("anyone know a hackathon?", [], "question"),
        ("any upcoming hackathon", ["https://devpost.com/x"], "question_with_link"),
        ("need teammates for the datathon", [], "teammate"),
        ("Jakarta hackathon, register now", [], "foreign"),
        ("summit on hiring, register", [], "unrelated"),
        ("City Hackathon, register", [], "event"),
        ("Data Fair 2026: sign up", [], "event"),
        ("congratulations to the winners", [], "recap"),
    ],
)
def test_mention_kinds(spark, body, urls, kind):
    df = spark.createDataFrame([(body, urls)], "b string, u array<string>")
    assert df.select(classify.classify_mention(F.col("b"), F.col("u"))).first()[0] == kind


def test_gates_and_scores(spark):
    got = judge(
        spark,
        doc("good"),
        doc("abroad", text=OPEN.replace("Makati", "Berlin").replace(" nationwide", "")),
        doc("closed", text=OPEN.replace("October 20, 2026", "January 5, 2026")),
        doc("weak", url="https://unknown.test/x"),
        doc("won", title="Champions crowned at City Hackathon"),
    )
    good = got["good"]
    assert good.accepted and good.rejections == [] and good.tier == "HIGH_PRIORITY"
    assert (good.facts.location.city, good.facts.registration_state, good.facts.edition_key) == ("Makati", "OPEN", "2026-11")
    assert good.total == 30 + 20 + 15 + 0 + 15 + 4 + 5
    assert got["abroad"].rejections == ["INTERNATIONAL_ONSITE"]
    assert got["closed"].rejections == ["REGISTRATION_CLOSED"]
    assert got["weak"].rejections == ["LOW_AUTHORITY"]
    assert "RESULTS_ONLY" in got["won"].rejections


def test_null_documents_are_judged(spark):
    r = judge(spark, ("n", None, None, None, None, None, None, None))["n"]
    assert not r.accepted and "NO_COMPETITION" in r.rejections and r.facts.title is None


def test_detections_fold_reposts_and_addresses(spark):
    docs = [doc("a"), doc("b"), doc("c", title="Other Hackathon 2026", text="Other words first. " + OPEN, url="https://devpost.com/a")]
    assert rows(detections(spark.createDataFrame(docs, DOC), F.lit(NOW)), "id") == [("a",)]


EVENT = "id string, canonical_url string, registration_url string, title string, organizer string, start struct<value:timestamp,confidence:double,year_inferred:boolean>, edition_key string, edition_year int, prefix string"


def event(i, url=None, title="city hackathon", organizer="acme", day=None, key=None, prefix=None):
    start = (dt.datetime(2026, *day), 0.95, False) if day else None
    return (i, url, None, title, organizer, start, key, int(key[:4]) if key else None, prefix)


def test_resolution_rungs(spark):
    stored = spark.createDataFrame([event("s1", "u1", day=(3, 1), key="2026-03"), event("s2", "u2", title="river data challenge", organizer="delta", day=(5, 1), prefix="p")], EVENT)
    incoming = spark.createDataFrame(
        [
            event("i1", "u1", title="renamed"),
            event("i2", "u1", title="city hackathon", day=(9, 1), key="2026-09"),
            event("i3", "u9", title="x", organizer="", prefix="p"),
            event("i4", "u8", title="river data challenge!", organizer="delta", day=(5, 9)),
            event("i5", "u7", title="river data contests", organizer="delta"),
            event("i6", "u6", title="quite another", organizer="delta"),
        ],
        EVENT,
    )
    got = resolve.match(incoming, stored, {"url": ["canonical_url", "registration_url"], "prefix": ["prefix"]})
    assert rows(got, "id", "match", "rung", "action") == [("i1", "s1", "url", "MERGE"), ("i3", "s2", "prefix", "MERGE"), ("i4", "s2", "title", "MERGE")]


def test_rows_of_a_key_against_all_pairs(spark):
    """Groups of rows meet, and each row gets the smallest compatible one: of years,
    editions and dates up to the very gap, before 1970, too; none is its own match."""
    draw = random.Random(4)
    gap, base = 45 * 86400, -20 * 86400
    moments = [base + d for d in (0, gap, gap + 1, -gap, -gap - 1, gap // 16, gap - gap // 16, 7, 2 * gap)]
    data = []
    for i in range(240):
        t = draw.choice([None, *moments, draw.randrange(-4 * gap, 4 * gap)])
        start = None if t is None else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t), draw.choice([0.95, 0.95, 0.95, 0.1]), draw.random() < 0.1)
        key = draw.choice([None, "", "2026", "2026-03", "2027", "2027-09"])
        data.append((i, draw.choice([None, "", "u1", "u2"]), draw.choice([None, None, "u1", "r1"]), start, key, draw.choice([None, int(key[:4]) if key else None]), t))
    df = spark.createDataFrame(data, "id int, canonical_url string, registration_url string, start struct<value:timestamp,confidence:double,year_inferred:boolean>, edition_key string, edition_year int, t long").repartition(3)
    i, s = df.filter("id % 2 = 0 or id % 5 = 0"), df.filter("id % 2 = 1")
    got = resolve.same_key(i, s, ["canonical_url", "registration_url"])
    side = lambda d, p: d.select(*(F.col(c).alias(p + c) for c in d.columns))
    same = "((i_canonical_url = s_canonical_url and i_canonical_url <> '') or (i_registration_url = s_registration_url and i_registration_url <> '')) and i_id <> s_id"
    want = side(i, "i_").join(side(s, "s_"), F.expr(same)).filter(resolve.compatible("i_", "s_")).groupBy(F.col("i_id").alias("id")).agg(F.min("s_id").alias("match"))
    assert rows(got, "id", "match") == rows(want, "id", "match")
    assert got.count() > 60
    assert resolve.same_key(i.limit(0), s, ["canonical_url"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaders(spark):
    df = spark.createDataFrame([("b", 1, "k"), ("a", 2, "k"), ("c", 1, None)], "id string, at int, key string")
    assert rows(resolve.leaders(df, "key", ["at"]), "id", "leader") == [("a", "b"), ("b", "b"), ("c", "c")]


FACTS = "registration_state:string,registration_deadline:struct<value:timestamp>,event_start:struct<value:timestamp>,location:struct<city:string,venue:string>,eligibility:struct<student_only:boolean,university_students_allowed:boolean,professionals_allowed:boolean,philippines_allowed:boolean>,event_phase:string,event_end:struct<value:timestamp>,prize_information:string"


def test_changes(spark):
    d = lambda *x: (dt.datetime(2026, *x),)
    before = ("UNKNOWN", d(5, 1), d(6, 1), ("A", None), (None,) * 4, "UPCOMING", d(6, 2), None)
    after = ("OPEN", d(5, 9), (None,), ("A", "hall"), (True, None, None, None), "CANCELLED", d(6, 3), "a cup")
    df = spark.createDataFrame([(before, after), (before, before)], f"b struct<{FACTS}>, a struct<{FACTS}>")
    got = [[c.change for c in r[0]] for r in df.select(history.change_columns("b", "a")).collect()]
    assert got == [["REGISTRATION_OPENED", "DEADLINE_EXTENDED", "DATES_CHANGED", "VENUE_CHANGED", "ELIGIBILITY_CHANGED", "PRIZE_CHANGED", "EVENT_CANCELLED"], []]


def test_retention_keeps_the_newest_of_each_key(spark):
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 8, 1)
    df = spark.createDataFrame([(1, "a", old, "x"), (2, "a", old, "y"), (3, "b", old, "x"), (4, "b", new, "z")], "id int, k string, at timestamp, text string")
    got = history.retain(df, "k", "id", "at", F.lit(dt.datetime(2026, 6, 1)), "text")
    assert rows(got, "id", "text") == [(2, None), (4, "z")]


def test_override_with_null(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    edits = spark.createDataFrame([(1, {"v": None}), (2, {"w": "q"})], "id int, edits map<string,string>")
    assert rows(history.overlay(df, edits, "id", ["v"])) == [(1, None), (2, "y"), (3, "z")]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("pwede ba manuod sa egov hackaton?", ("egov hackaton", "egov hackathon", None)),
        ("anyone joining the eGov hackathon September 2026", ("eGov hackathon", "egov hackathon", "2026 september")),
        ("any upcoming hackathons near us", None),
        ("hackathon 2026", None),
        ("Hack4Gov is back", ("Hack4Gov", "hack4gov", None)),
        ("we registered. Hackathon soon", None),
        ("", None),
        (None, None),
    ],
)
def test_competition_names(spark, body, want):
    got = spark.createDataFrame([(body,)], "b string").select(leads.competition_name(F.col("b")).alias("n")).first().n
    assert (tuple(got) if got and got.name else None) == want


def test_organizers_words_dont_stop_a_name(spark):
    row = spark.createDataFrame([("the may hackathon, others",)], "b string")
    assert row.select(leads.competition_name(F.col("b"))).first()[0] is None or row.select(leads.competition_name(F.col("b"))["name"]).first()[0] is None
    assert row.select(leads.competition_name(F.col("b"), ("may",))["name"]).first()[0] == "may hackathon"


def test_editions_of_one_address_stay_apart(spark):
    data = [("a", "u", "2026-03", 1), ("b", "u", "2026-09", 2), ("c", "u", "2026-03", 3), ("d", "u", None, 4), ("e", "v", None, 1), ("f", None, "2026", 1)]
    df = spark.createDataFrame(data, "id string, url string, edition string, at int")
    assert rows(resolve.edition_leaders(df, "url", "edition", ["at"]), "id", "leader") == [("a", "a"), ("b", "b"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "f")]


def test_models_only_lower_a_kind_and_need_proof(spark):
    from quarrylight.operators.extract import downgraded, model_confidence, unproven

    df = spark.createDataFrame([("REGISTRATION_OPEN", "WEBINAR", True), ("REGISTRATION_OPEN", "WEBINAR", False), ("WEBINAR", "REGISTRATION_OPEN", True)], "k string, o string, p boolean")
    assert [r[0] for r in df.select(downgraded(F.col("k"), F.col("o"), F.col("p"))).collect()] == ["WEBINAR", "REGISTRATION_OPEN", "WEBINAR"]
    texts = spark.createDataFrame([(1, "The prize is a cup"), (2, "nothing"), (3, None)], "id int, text string")
    told = spark.createDataFrame([(1, "prize", "cup", "a CUP"), (2, "prize", "cup", "a cup"), (2, "title", None, ""), (3, "title", "x", "x")], "id int, field string, value string, quote string")
    assert rows(unproven(told, texts), "id") == [(2,), (3,)]
    assert spark.range(1).select(model_confidence([F.lit(True)] * 6)).first()[0] == 0.83


def test_state_writers(spark):
    found = spark.createDataFrame([("e", ("t",), "u", 5)], "id string, facts struct<title:string>, source_url string, at int")
    events, first, sources = history.created(found)
    assert rows(events, "id", "state") == [("e", "EVENT_CREATED")] and rows(first, "event_id", "version") == [("e", 1)] and rows(sources, "url", "canonical") == [("u", True)]


def test_leads_are_counted_and_due(spark):
    posts = spark.createDataFrame([("u1", "g", "anyone joining the eGov hackathon?", "question"), ("u2", "g", "egov hackathon, who is in?", "teammate"), ("u3", "g", "x", "event")], "source_url string, platform string, body string, kind string")
    none = spark.createDataFrame([], "lead_key string, normalized_name string, edition_hint string, query string, state string, sightings long, search_runs int, last_searched_at timestamp")
    held = leads.record_mentions(none, leads.mentions(posts))
    assert rows(held, "normalized_name", "state", "sightings") == [("egov hackathon", "NEW", 2)]
    assert leads.due_leads(held, F.lit(NOW), 5).count() == 1


def test_search_payloads(spark):
    payload = '{"results":[{"url":"https://a.test/x?utm_source=q","title":"A &amp; B","content":"c"},{"url":"nonsense"},{"title":"none"}],"unresponsive_engines":[["one","timeout"],["two","captcha"]]}'
    pages = spark.createDataFrame([("q", payload), ("bad", "{"), ("none", None)], "query string, payload string")
    assert rows(search.metasearch_seeds(pages), "query", "normalized_url", "title") == [("q", "https://a.test/x", "A & B")]
    got = {r.query: r.degraded for r in search.degraded(pages, ("one", "two")).collect()}
    assert got == {"q": True, "bad": False, "none": False}


def test_catalogue_keeps_the_last_of_an_address(spark):
    entry = '{"hackathons":[{"title":"A","url":"u","open_state":"open","organization_name":"O"},{"title":"B","url":"u","open_state":"open"},{"title":"C","url":"v","open_state":"ended"}]}'
    assert rows(search.catalogue_seeds(spark.createDataFrame([(1, entry)], "page int, payload string")), "url", "title") == [("u", "B")]


def test_html_pages(spark):
    page = '<html><head><title> A &amp;\n B </title><meta property="og:title" content="T"><link rel="canonical" href="https://a.test/c"><script type="application/ld+json">{"@type":"Event"}</script><script>no</script></head><body><p>One <b>two</b></p><a href="/x">x</a><a href="/x">y</a><a href="mailto:z">z</a></body></html>'
    df = spark.createDataFrame([(page, "https://a.test/p"), ("<broken", None), (None, None)], "h string, u string")
    got = [r.p for r in df.select(html.parse_html("h", "u").alias("p")).collect()]
    assert (got[0].title, got[0].links, got[0].metadata["canonical"], got[0].json_ld) == ("A & B", ["https://a.test/x"], "https://a.test/c", ['{"@type":"Event"}'])
    assert "One two" in got[0].text and "no" not in got[0].text.split()
    assert got[2].title is None and got[2].links == []


def test_stream_appends_each_key_once(spark, tmp_path):
    from quarrylight.streaming.seeds import append_new, read

    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(source)
    run = lambda: append_new(read(spark, source, "k string, v int"), ["k"], target, check).awaitTermination()
    run()
    spark.createDataFrame([("b", 4), ("c", 5)], "k string, v int").write.mode("append").parquet(source)
    run()
    assert rows(spark.read.parquet(target), "k") == [("a",), ("b",), ("c",)]


def test_thread_records_and_merging(spark):
    from quarrylight.sources import threads

    payload = 'for (;;);{"a":[{"message":{"text":"A call for entries"},"post_id":12345,"url":"https://x.test/1"}]} {"body":{"text":"a comment of some length"},"id":"c1"} broken'
    df = spark.createDataFrame([(payload,), (None,), ("[" * 2000,)], "p string")
    got = [r.r for r in df.select(F.explode(threads.json_records(F.col("p"))).alias("r")).collect()]
    assert [(r["kind"], r["post_id"], r["comment_id"]) for r in got] == [("post", "12345", None), ("comment", None, "c1")]
    said = spark.createDataFrame([("p", 1, "c", "ann", "Like\na long remark"), ("p", 2, "c", "bob", "another remark"), ("p", 3, None, "eve", "short"), ("p", 4, None, "eve", "no id but long")], "post string, at int, id string, author string, text string")
    assert rows(threads.dom_comments(said), "at", "text") == [(1, "a long remark"), (4, "no id but long")]
    keys = spark.createDataFrame([("https://x.test/groups/1/posts/77/",), ("https://x.test/story.php?story_fbid=5&id=1",), ("/r/a/comments/t9/x",), ("https://x.test/",)], "u string")
    assert [r[0] for r in keys.select(threads.post_key(F.col("u"))).collect()] == ["77", "5", "t9", None]
    assert keys.filter(threads.matches_terms(F.col("u"), F.lit(None), ("STORY".lower(),))).count() == 1
    row = spark.createDataFrame([("see https://a.test/x). and https://l.facebook.com/l.php?u=https%3A%2F%2Fb.test%2Fy", ["https://a.test/x", None, "https://www.facebook.com/events/5"], "Ann\n3 h\nLike\nHello there\n12", "ann")], "t string, h array<string>, b string, a string")
    urls = threads.extract_urls(F.col("t"), F.col("h"))
    r = row.select(urls.alias("u"), threads.outbound(urls).alias("o"), threads.clean_lines(F.col("b"), F.col("a")).alias("c")).first()
    assert r.u == ["https://a.test/x", "https://b.test/y", "https://www.facebook.com/events/5"] and r.o == r.u and r.c == "Hello there"
    seen = spark.createDataFrame([("p", 1, "short", ["u1"], None, None, "l1"), ("p", 2, "much longer", ["u2", "u1"], "ann", None, "l2")], "id string, seen int, text string, urls array<string>, author string, created_at timestamp, permalink string")
    m = threads.merge_threads(seen).first()
    assert (m.text, m.urls, m.author, m.permalink) == ("much longer", ["u1", "u2"], "ann", "l1")


def test_custom_elements(spark):
    from quarrylight.sources import threads

    page = '<shreddit-post id="t3_a" post-title="T" score="5" created-timestamp="2026-01-02T03:04:05Z"><p>body</p></shreddit-post><shreddit-post id="t3_b" ad-type="x" created-timestamp="2026-01-02T03:04:05Z"></shreddit-post><shreddit-post id="t3_c" created-timestamp="never"></shreddit-post>'
    got = threads.submissions(spark.createDataFrame([("p", page), ("q", None)], "page string, html string"))
    assert rows(got, "id", "title", "body", "score") == [("a", "T", "body", 5)]


@pytest.mark.parametrize(("url", "want"), [("https://a.test/x", True), ("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("https://u:p@a.test/", False), ("ftp://a.test", False), ("http://localhost/", False)])
def test_public_urls(spark, url, want):
    from quarrylight.functions.urls import is_public_url

    assert spark.createDataFrame([(url,)], "u string").select(is_public_url(F.col("u"))).first()[0] is want


def test_alerts_and_outbox(spark):
    from quarrylight.operators import notify

    changes = spark.createDataFrame([("e", 2, "DATES_CHANGED", True), ("e", 2, "VENUE_CHANGED", True), ("e", 3, "EVENT_CANCELLED", True), ("e", 4, "PRIZE_CHANGED", False)], "event_id string, version int, change string, notify boolean")
    alerts = notify.change_alerts(changes)
    assert rows(alerts, "dedupe_key", "headline", "urgent") == [("change:e:2", "2 changes", False), ("change:e:3", "Event Cancelled", True)]
    receipts = spark.createDataFrame([("change:e:2", "SENT"), ("change:e:3", "FAILED")], "dedupe_key string, state string")
    assert rows(notify.pending(alerts, receipts), "dedupe_key") == [("change:e:3",)]
    assert spark.range(1).select(notify.redacted(F.lit("token=abc http://u:p@h/"))).first()[0] == "token=[redacted] http://[redacted]@h/"


@pytest.mark.parametrize(
    ("header", "want"),
    [("90", dt.datetime(2026, 8, 30, 0, 1, 30)), ("0", dt.datetime(2026, 8, 30, 0, 0, 1)), ("999999", dt.datetime(2026, 8, 31)), ("Sun, 30 Aug 2026 02:00:00 GMT", dt.datetime(2026, 8, 30, 2)), ("soon", dt.datetime(2026, 8, 30, 1)), (None, dt.datetime(2026, 8, 30, 1))],
)
def test_retry_at(spark, header, want):
    from quarrylight.functions.dates import retry_at

    assert spark.createDataFrame([(header,)], "h string").select(retry_at(F.col("h"), F.lit(NOW))).first()[0] == want


def test_thread_seeds(spark):
    at = dt.datetime(2026, 8, 20)
    posts = spark.createDataFrame(
        [("p1", False, "event", "Title\nbody", ["https://devpost.com/x", "https://b.test"], "perma1", at), ("p1:c", True, "event", "reply", [], "perma2", None), ("p2", False, "question_with_link", "q", ["https://devpost.com/x"], "perma3", dt.datetime(2026, 8, 21)), ("p3", True, "question_with_link", "q", ["https://kaggle.com/y"], "perma4", at), ("p4", False, "event", "old", [], "perma5", dt.datetime(2025, 1, 1))],
        "source_key string, reply boolean, kind string, body string, urls array<string>, permalink string, created_at timestamp",
    )
    got = rows(leads.thread_seeds(posts, F.lit(dt.datetime(2026, 1, 1))), "source_key", "url", "title", "content")
    assert got == [("p1", "https://devpost.com/x", "Title", None), ("p1:c", "perma2", "reply", "reply")]


def test_models_fill_and_never_replace(spark):
    from quarrylight.operators.extract import merge_models

    docs = spark.createDataFrame([(1, "The City Hack by Acme", "kept", None), (2, "nothing", None, None)], "id int, text string, title string, organizer string")
    outputs = spark.createDataFrame([(1, 0, "title", "other", "City Hack"), (1, 1, "organizer", "Second", "Acme"), (1, 0, "organizer", "Acme", "by Acme"), (2, 0, "organizer", "Made up", "not there")], "id int, tier int, field string, value string, quote string")
    assert rows(merge_models(docs, outputs, ["title", "organizer"]), "id", "title", "organizer") == [(1, "kept", "Acme"), (2, None, None)]


def test_reports(spark):
    from quarrylight.operators import reports

    j = spark.createDataFrame([("m", "A", "A", 1.0), ("m", None, "B", 3.0)], "model string, got string, want string, s double")
    assert rows(reports.accuracy(j, {"kind": ("got", "want")}, "s")) == [("m", 2, 1, 2.0)]
    a, b = (spark.createDataFrame([(k,) for k in ks], "kind string") for ks in ("xxy", "xz"))
    assert rows(reports.kind_histogram(a, b, "kind")) == [("x", 2, 1), ("y", 1, 0), ("z", 0, 1)]
    e = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 9, 1)), (3, None)], "id int, start timestamp")
    assert rows(reports.upcoming(e, F.lit(NOW), 2), "id") == [(2,)] and rows(reports.upcoming(e, F.lit(NOW), 3), "id") == [(2,), (3,)]


def test_streams_keep_state_by_key(spark, tmp_path):
    from quarrylight.streaming.seeds import debounced, first_sightings, not_older, read

    at = lambda minute: dt.datetime(2026, 8, 1, 10, minute)
    source = str(tmp_path / "in")
    data = [("a", at(0)), ("a", at(10)), ("a", at(45)), ("b", at(5)), ("a", at(59))]
    spark.createDataFrame(data, "k string, at timestamp").coalesce(1).write.parquet(source)
    for name, make in (("calm", lambda s: debounced(s, "k", "at")), ("first", lambda s: first_sightings(not_older(s, "at", F.lit(dt.datetime(2026, 1, 1))), "k", "at").select("k"))):
        query = make(read(spark, source, "k string, at timestamp")).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    calm = [(k, dt.datetime.fromtimestamp(s, dt.UTC).minute) for k, s in rows(spark.table("calm"))]
    assert calm == [("a", 0), ("a", 45), ("b", 5)]
    assert rows(spark.table("first")) == [("a",), ("b",)]


def test_recent_rows_with_the_same_words(spark):
    """Against brute force, on texts from nearly equal to unlike, and with rows too old."""
    import itertools
    import random

    from quarrylight.functions.similarity import set_ratio

    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.sample(vocabulary, rng.randint(1, 12))) for _ in range(30)]
    texts += [f"{t} {rng.choice(vocabulary)}" for t in texts] + ["", "Dear all! " + texts[0]]
    at = lambda i: NOW - dt.timedelta(days=i * 4)
    df = spark.createDataFrame([(i, t, at(i)) for i, t in enumerate(texts)] + [(99, None, NOW)], "id int, t string, seen timestamp")
    plain = [t.lower().replace("!", "") for t in texts]
    held = [i for i in range(len(texts)) if i * 4 <= 180][:39]  # the row without a text is held, too
    want = sorted((i, j) for i, j in itertools.product(range(len(texts)), held) if i != j and set_ratio(plain[i], plain[j]) >= 85)
    for room in (1 << 25, 100):
        got = resolve.similar_recent(df, df, "t", "seen", F.lit(NOW), most=40, room=room)
        assert rows(got, "id", "match") == want
    assert resolve.similar_recent(df, df.limit(0), "t", "seen", F.lit(NOW)).count() == 0


def test_reworded_posts_resolve_by_content(spark):
    kind = EVENT + ", words string, last_seen timestamp"
    stored = spark.createDataFrame([(*event("s1", key="2026"), "join the river data challenge of delta", dt.datetime(2026, 8, 1)), (*event("s2", key="2025"), "join the river data challenge of delta", dt.datetime(2026, 8, 2)), (*event("s3"), "an old announcement of something", dt.datetime(2025, 8, 2))], kind)
    incoming = spark.createDataFrame([(*event("i1", key="2026", title="x", organizer=""), "Sharing this: join the river data challenge of Delta!", NOW), (*event("i2", title="y", organizer=""), "an old announcement of something", NOW)], kind)
    got = resolve.match(incoming, stored, {"url": ["canonical_url"]}, text="words", as_of=F.lit(NOW))
    assert rows(got, "id", "match", "rung", "action") == [("i1", "s1", "content", "MERGE")]


def test_first_sentence_and_escaping(spark):
    from quarrylight.functions.text import escaped, summarise_eligibility

    long = "word " * 60
    df = spark.createDataFrame([("Open to all. And more.",), (long,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(summarise_eligibility(F.col("t"))).collect()] == ["Open to all.", ("word " * 40).rsplit(" ", 1)[0] + "…", None, None]
    df = spark.createDataFrame([("[Click](https://e.test) *now*\n> quote",), (None,)], "t string")
    assert [r[0] for r in df.select(escaped(F.col("t"))).collect()] == ["\\[Click\\](https://e.test) \\*now\\*\n\\> quote", ""]


def test_rendered_links_and_icons(spark):
    from quarrylight.functions.urls import organizer_icon, rendered_links

    df = spark.createDataFrame([(["https://devpost.com/a", "https://bit.ly/b", "https://x.test/c", "https://youtu.be/d", None],), (None,), (["https://youtu.be/d"],), ([f"https://x.test/{i}" for i in range(9)],)], "u array<string>")
    got = [r[0] for r in df.select(rendered_links(F.col("u"))).collect()]
    assert got[0] == "[devpost.com](https://devpost.com/a)\n`https://bit.ly/b` (shortened link)\n`https://x.test/c`"
    assert got[1] is None and got[2] is None and got[3].count("\n") == 4
    df = spark.createDataFrame([("https://devpost.com/a",), ("https://x.test/a",), ("https://www.org.test/a",), (None,)], "u string")
    assert [r[0] for r in df.select(organizer_icon(F.col("u"), {"org.test": "https://org.test/l.png"})).collect()] == ["https://devpost.com/favicon.ico", None, "https://org.test/l.png", None]


def test_targets(spark):
    from quarrylight.sources.threads import targets

    df = spark.createDataFrame([("group", "https://www.facebook.com/groups/hacks/?x=1", None, None), ("group", " /makers/ ", "m", "Cebu"), ("page", "https://facebook.com/acme", "", None), ("page", "", "none", None), ("page", None, None, None)], "kind string, url string, name string, location string")
    feed = "/?sorting_setting=CHRONOLOGICAL"
    assert rows(targets(df)) == [("group", f"https://www.facebook.com/groups/hacks{feed}", "hacks", "Philippines"), ("group", f"https://www.facebook.com/groups/makers{feed}", "m", "Cebu"), ("page", "https://www.facebook.com/acme", "acme", "Philippines")]


def test_cards_and_manual_alerts(spark):
    from quarrylight.operators import notify, reports

    judged_ = judged(spark.createDataFrame([doc("a"), doc("b", url="https://x.test/b")], DOC), F.lit(NOW)).withColumn("image_url", F.concat("url", F.lit("/i.png")))
    sent = spark.createDataFrame([("a", "SENT"), ("b", "FAILED")], "id string, state string")
    got = {r.id: r for r in reports.cards(judged_, sent).collect()}
    assert got["a"].announced and not got["b"].announced
    assert got["a"].image_url == "https://devpost.com/a/i.png" and got["b"].image_url is None and got["b"].icon_url is None
    assert got["a"].category == "Hackathon" and got["a"].location.startswith("Makati")
    alerts = notify.manual_alerts(judged_.unionByName(judged_), F.lit(NOW)).collect()
    assert len({r.dedupe_key for r in alerts}) == 4 and all(r.dedupe_key.startswith("manual:") and r.kind == "MANUAL_SEND" for r in alerts)


def test_openings_are_filled_in(spark):
    df = spark.createDataFrame([(1, "One title of four", ("words here",), None), (2, "short", (None,), None), (3, "kept", (None,), "k")], "id int, title string, facts struct<description:string>, content_prefix_hash string")
    got = {r.id: r.content_prefix_hash for r in history.with_prefix(df).collect()}
    assert len(got[1]) == 32 and got[2] is None and got[3] == "k"


def test_snapshots_of_one_moment_have_one_newest(spark):
    """Two held snapshots of the same moment: the answer doesn't depend on their order."""
    at = NOW
    fetched = spark.createDataFrame([("k", "a", at)], "k string, digest string, fetched_at timestamp")
    for order in (1, -1):
        held = spark.createDataFrame([("k", "a", at, 1), ("k", "b", at, 2)][::order], "k string, digest string, fetched_at timestamp, row int").coalesce(1)
        assert history.append_snapshots(held, fetched, "k", "digest").count() == 1
        assert history.append_snapshots(held, fetched, "k", "digest", tie="row").count() == 1
        seen = spark.createDataFrame([("k", at, "x"), ("k", at, None)][::order], "k string, at timestamp, title string").coalesce(1)
        current = spark.createDataFrame([("k", at, "old")], "k string, at timestamp, title string")
        assert history.touch(current, seen, "k", "at", ["title"]).first().title == "x"
