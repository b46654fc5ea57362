from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import dates, similarity, text, urls


def one(spark, value, kind, function):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User@Example.COM:80//a//b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"),
        ("https://example.com:8443/", "https://example.com:8443/"),
        ("//example.com/a/", "https://example.com/a"),
        ("https://example.com?q=a+b&empty=&REF=1", "https://example.com/?empty=&q=a+b"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, "string", urls.normalize_url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, "DROP"),
        ("ftp://devpost.com/x", "DROP"),
        ("https://www.facebook.com/settings/x", "DROP"),
        ("https://www.facebook.com/groups/1", "CLICKABLE"),
        ("https://www.facebook.com/somebody", "DROP"),
        ("https://youtu.be/x", "DROP"),
        ("https://bit.ly/x", "PLAIN"),
        ("https://devpost.com/x", "CLICKABLE"),
        ("https://forms.gle/x", "CLICKABLE"),
        ("https://evil.example/register", "PLAIN"),
        ("https://contest.gov.test/x", "CLICKABLE"),
    ],
)
def test_link_trust(spark, url, want):
    assert one(spark, url, "string", lambda c: urls.link_trust(c, {"gov.test": 90})) == want


def test_choose_urls(spark):
    df = spark.createDataFrame(
        [("https://a.test/event/1", None, ["https://a.test/"], ["https://b.test/x", "https://b.test/register"]), ("https://a.test/e?x=1", "https://a.test/e", ["https://other.test/e", "https://www.a.test/f/"], [])],
        "r string, f string, d array<string>, l array<string>",
    )
    c, r = urls.choose_urls(F.col("r"), F.col("f"), F.col("d"), F.col("l"))
    got = [tuple(x) for x in df.select(c, r).collect()]
    # a site's root is no address of a deep page; another site's is none at all
    assert got == [("https://a.test/event/1", "https://b.test/register"), ("https://www.a.test/f", None)]


def test_text_normalisation(spark):
    assert one(spark, "  Straße,\n“HACK-a-thon” ﬁn ", "string", lambda c: text.normalize_text(text.fold_text(c))) == "strasse hack a thon fin"
    assert one(spark, None, "string", text.normalize_text) == ""
    assert one(spark, "Official Registration: Code Fest", "string", text.normalize_title) == "code fest"
    assert one(spark, None, "string", text.normalize_organizer) == ""
    assert one(spark, "a b c", "string", text.content_prefix_hash) is None
    same = [one(spark, t, "string", text.content_prefix_hash) for t in ("A b, c D!", "a B c d")]
    assert same[0] == same[1] and len(same[0]) == 32


@pytest.mark.parametrize(("a", "b", "want"), [("2026", "2026-09", False), ("2026-03", "2026-09", True), ("2026", "2027", True), (None, "2026", False), ("2026", "2026", False), ("", "2026", False)])
def test_editions(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.editions_conflict(F.col("a"), F.col("b"))).first()[0] is want


@pytest.mark.parametrize(
    ("words", "year", "want"),
    [
        ("Registration deadline: 2026-09-01", None, (dt.datetime(2026, 8, 31, 16), 0.95, False)),
        ("In 2026. Apply until Sept. 3rd", 2026, (dt.datetime(2026, 9, 2, 16), 0.65, True)),
        ("Deadline February 30, 2026", None, (None, 0.0, False)),
        ("Deadline May 3", None, (None, 0.25, False)),
        ("nothing", 2026, (None, 0.0, False)),
        ("deadline soon; apply until May 5, 2027", None, (dt.datetime(2027, 5, 4, 16), 0.95, False)),
    ],
)
def test_labelled_dates(spark, words, year, want):
    from quarrylight import rules

    df = spark.createDataFrame([(words, year)], "t string, y int")
    f = df.select(dates.labelled_date(F.col("t"), dict(rules.DATE_LABELS)["registration_deadline"], F.col("y")).alias("f")).first().f
    assert (f.value, f.confidence, f.year_inferred) == want


def test_backoff(spark):
    got = [r[0] for r in spark.range(8).select(dates.backoff_days(F.col("id"))).orderBy("id").collect()]
    assert got == [7, 7, 14, 28, 56, 60, 60, 60]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_lcs_against_the_table(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)


def test_ratios():
    assert similarity.indel_ratio("", "") == 0
    assert similarity.indel_ratio("abcd", "abxd") == 75
    assert similarity.set_ratio("join the code fest now", "code fest") == 100
    assert similarity.set_ratio("", "code") == 0
    assert 0 < similarity.set_ratio("alpha beta", "beta gamma") < 100


def test_summary_stops_at_the_first_sentence_that_does_not_fit(spark):
    a, b = "This sentence is long enough to count as prose here.", "Another sentence that would fit but comes after a long one, truly."
    long = "x" * 300 + " words and words and words."
    assert one(spark, f"{a} {long} {b}", "string", text.summarise) == a
    assert one(spark, None, "string", text.summarise) in (None, "")
