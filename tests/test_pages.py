"""Page parsing: main text, metadata, malformed pages."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.sources.html import parse, parse_html
from quarrylight.sources.threads import custom_elements, elements, outbound

BASE = "https://site.test/a/b?x=1"


def told(html, base=BASE):
    return dict(zip(("title", "text", "links", "metadata", "json_ld"), parse(html, base), strict=True))


def test_main_text_leaves_furniture_out():
    page = """<html><head><title> The
    Title </title></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class="top-menu">Menu item</div>
    <article><h1>Heading</h1><p>One <b>bold</b> sentence.<br>Second line with <a href="/l">a link</a> inside.</p><table><tr><td><a href="/t">Cell</a></td><td>12</td></tr></table>
    <aside>Read also</aside><script>no()</script></article><p>Outside.</p><footer>(c) us</footer><svg><title>icon</title></svg></body></html>"""
    got = told(page)
    assert got["title"] == "The Title"
    assert got["text"].split("\n") == ["Heading", "One bold sentence.", "Second line with a link inside.", "Cell", "12"]
    assert got["links"] == ["https://site.test/x", "https://site.test/l", "https://site.test/t"]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>plain</p><div><a href=a>only</a> <a href=b>links here</a></div>", "plain"),
        ("<nav>all of it is furniture</nav>", "all of it is furniture"),
        ("text <b>without</b> blocks", "text without blocks"),
        ("<main><p>in</p></main><p>" + "much more outside " * 20 + "</p>", "in\n" + " ".join(["much more outside"] * 20)),
        ("<p>unclosed <div>blocks <nav>menu</div> after", "unclosed\nblocks\nafter"),
        ("<div id='cookie-banner'>We use cookies</div><p>news</p>", "news"),
        ("", ""),
        (None, ""),
    ],
)
def test_text(html, text):
    assert told(html)["text"] == text


def test_metadata():
    event = {"@type": "Event", "name": "From the event"}
    many = [{"@type": "CourseEvent"}, *({"n": i} for i in range(30)), event]
    page = f"""<link rel="alternate Canonical" href="/c"><meta name="Description" content="first"><meta property="description" content="last"><meta name=empty content="">
    <script type="application/ld+json">{json.dumps(many)}</script><script type="application/ld+json">not json</script>"""
    got = told(page)
    assert got["metadata"] == {"canonical": "https://site.test/c", "description": "last", "event_json_ld": json.dumps(event, separators=(",", ":"))}
    assert got["title"] == "From the event" and len(got["json_ld"]) == 20 and got["json_ld"][0] == '{"@type":"CourseEvent"}'
    assert "event_json_ld" not in told('<script type="application/ld+json">{"@type": ["Event"]}</script>')["metadata"]


def test_any_string_parses():
    draw = random.Random(1)
    bits = ["<![foo[bar]]>", "<![1x[", "<!DOCTYPE [", "<![CDATA[x]]>", "<!--", "-->", "<a href='", "<p", "</", "&#x110000;", "&#99999999999;", "<?", "]]>", "<title>", "<script>", "text", "\x00", "\ud800", "é", ">", "<", '"', "<meta content=", "<![if IE]>"]
    for _ in range(4000):
        page = "".join(draw.choice(bits) for _ in range(draw.randrange(12)))
        parse(page, BASE)
        elements(page, ("p", "shreddit-post"))
    for _ in range(500):
        parse(bytes(draw.randrange(256) for _ in range(80)).decode("latin-1"), None)
    assert told("<![foo[bar]]>x <p>after</p>")["text"].endswith("after")


def test_malformed_pages_in_spark(spark):
    df = spark.createDataFrame([("<![foo[bar]]>x",), ("<![1x[",), (None,), ('<script type="application/ld+json">{"@type":"Event","name":"\\\\ud800"}</script>',), ("<p>ok</p>",)], "html string")
    got = df.select(parse_html(F.col("html"), F.lit(BASE)).alias("p"), custom_elements(F.col("html"), ("p",)).alias("e")).collect()
    assert len(got) == 5 and got[4].p.text == "ok" and got[4].e[0].text == "ok"


def test_outbound_skips_platforms(spark):
    urls = ["https://x.test/a", "https://www.instagram.com/p", "https://youtu.be/v", "https://x.com/s", "https://vm.tiktok.com/t", "https://fb.me/e", "https://www.facebook.com/events/1", "https://facebook.com/groups/g/events/2", "https://instagram.com/events/3", "nothing"]
    df = spark.createDataFrame([(urls,)], "u array<string>")
    assert df.select(outbound(F.col("u"))).first()[0] == ["https://x.test/a", "https://www.facebook.com/events/1"]
