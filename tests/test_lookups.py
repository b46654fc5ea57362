"""Joins by range, nearness and terms against all pairs."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarrylight.operators import lookups
from quarrylight.operators.leads import competition_name


def test_ranges_against_all_pairs(spark):
    draw = random.Random(1)
    points = [(i, draw.choice([None, 5, 5, draw.randrange(-3000, 3000)])) for i in range(200)]
    ranges = [(i, draw.choice([None, draw.randrange(-3000, 3000)]), draw.randrange(0, 12)) for i in range(60)] + [(60, 5, 0), (61, 5, 2), (62, -(1 << 40), 42)]
    spans = [(i, a, None if a is None else a + (1 << n) - draw.choice([0, 1])) for i, a, n in ranges] + [(70, 9, 3), (71, 1, None)]
    p, r = spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "r int, lo long, hi long")
    got = lookups.in_ranges(p, r, "at", "lo", "hi")
    assert got.columns == ["p", "at", "r", "lo", "hi"]
    want = [(i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a <= x < b]
    assert rows(got, "p", "r") == sorted(want) and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    close = lookups.near(p, r.select("r", "lo"), "at", "lo", 10)
    assert rows(close, "p", "r") == sorted((i, j) for i, x in points for j, a, _ in spans if None not in (x, a) and abs(x - a) <= 10)
    for some, others in ((p.limit(0), r), (p, r.limit(0))):
        assert lookups.in_ranges(some, others, "at", "lo", "hi").count() == 0
    with pytest.raises(ValueError):
        lookups.in_ranges(p, p, "at", "at", "at")


def test_totals_in_ranges_against_all_pairs(spark):
    draw = random.Random(3)
    points = [(i, draw.choice([None, 5, 5, -1, 0, draw.randrange(-300, 300)]), draw.choice([None, draw.randrange(-50, 50)])) for i in range(300)]
    spans = [(i, a, a + draw.randrange(0, 200)) for i, a in enumerate(draw.randrange(-300, 300) for _ in range(80))] + [(80, 5, 5), (81, 9, 3), (82, None, 4), (83, 1, None), (84, -(1 << 40), 1 << 40), (85, -1, 1), (86, 5, 6), (87, 5, 6)]
    p, r = spark.createDataFrame(points, "p int, at long, v long"), spark.createDataFrame(spans, "r int, lo long, hi long")
    got = lookups.totals_in_ranges(p, r, "at", "lo", "hi", total=("sum", "v"), first=("min", "p"), last=("max", "p"))
    assert got.columns == ["r", "lo", "hi", "total", "first", "last"]
    want = []
    for j, a, b in spans:
        inside = [(i, v) for i, x, v in points if None not in (x, a, b) and a <= x < b]
        values = [v for _, v in inside if v is not None]
        if inside:
            want.append((j, sum(values) if values else None, min(inside)[0], max(inside)[0]))
    assert rows(got, "r", "total", "first", "last") == sorted(want) and len(want) > 70
    for some, others in ((p.limit(0), r), (p, r.limit(0))):
        assert lookups.totals_in_ranges(some, others, "at", "lo", "hi", first=("min", "p")).count() == 0
    with pytest.raises(ValueError):
        lookups.totals_in_ranges(p, r, "at", "lo", "hi", mean=("avg", "v"))


def test_terms_against_a_search(spark, monkeypatch):
    draw = random.Random(2)
    words = ["one", "two", "Three", "four", "É", "a"]
    texts = [(i, " ".join(draw.choice(words) + draw.choice(["", ",", "!"]) for _ in range(draw.randrange(0, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "a " * 500)]
    terms = ["one two", "One, two!", "three", "a a a", "é four one", "absent here", "", "..."]
    df, table = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(t,) for t in terms] + [(None,), ("three",)], "term string")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()).split()
    want = sorted((i, term, n) for i, t in texts for term in terms if (w := plain(term)) and (n := sum(plain(t)[k : k + len(w)] == w for k in range(len(plain(t))))))
    assert rows(lookups.term_hits(df, "t", table), "id", "term", "hits") == want
    monkeypatch.setattr(lookups, "BROADCAST_TERMS", -1)
    assert rows(lookups.term_hits(df, "t", table), "id", "term", "hits") == want
    assert lookups.term_hits(df, "t", table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lookups.term_hits(df, "t", spark.createDataFrame([("w " * 17,)], "term string"))


def test_ten_thousand_terms_are_one_pass(spark):
    df = spark.range(2000).select("id", F.format_string("opening t%d end", F.col("id") % 50).alias("t"))
    table = spark.range(10_000).select(F.format_string("t%d end", F.col("id")).alias("term"))
    got = lookups.term_hits(df, "t", table)
    assert got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Python" not in plan


def test_vocabulary_of_organizers(spark):
    data = [("Department of Trade", ["DoT", "University of the River", "a b"], True), ("Gone", ["gone"], False), (None, None, None), ("", [" ", "HERE"], None)]
    terms = lookups.organizer_terms(spark.createDataFrame(data, "name string, aliases array<string>, enabled boolean"))
    assert [r[0] for r in rows(terms)] == ["a b", "department of trade", "dot", "here", "river", "university", "university of the river"]
    known = lookups.known_stops(terms.unionByName(spark.createDataFrame([("here",), ("join",)], "term string")))
    assert "join" in known
    df = spark.createDataFrame([("come to Join Manila Hackathon",)], "t string")
    named = df.select(competition_name(F.col("t"), known)["name"].alias("a"), competition_name(F.col("t"))["name"].alias("b")).first()
    assert named.a == "Join Manila Hackathon" and named.b == "Manila Hackathon"


def test_terms_of_several_lengths_meet_texts_once(spark):
    """A place of a text is one row, whatever lengths terms have; ends of texts and terms
    that open alike count once each."""
    df = spark.createDataFrame([(1, "a b c d a b"), (2, "a b"), (3, "a"), (4, None), (5, "b c d e f")], "id int, t string")
    table = spark.createDataFrame([("a b",), ("a b c",), ("a b c d a b c",), ("b c d",), ("b c d e f",), ("d a b",)], "term string")
    found = lookups.term_hits(df, "t", table)
    assert rows(found, "id", "term", "hits") == [(1, "a b", 2), (1, "a b c", 1), (1, "b c d", 1), (1, "d a b", 1), (2, "a b", 1), (5, "b c d", 1), (5, "b c d e f", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("flatten") == 0
