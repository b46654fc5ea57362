"""What a document or post is, from its folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.dates import let
from quarrylight.functions.text import casefold, contains_any, first_match
from quarrylight.functions.urls import host_in, host_of, is_news_url


def classify_category(text: Column, table=rules.CATEGORY_TERMS, other=rules.OTHER_TERMS) -> Column:
    """The first category with a term in the text; the text is folded once."""
    return let(casefold(text), lambda lowered: _category(lowered, table, other))


def _category(lowered: Column, table, other=rules.OTHER_TERMS) -> Column:
    return F.coalesce(first_match(lowered, table), F.when(contains_any(lowered, other), "OTHER_COMPETITION"), F.lit("UNKNOWN"))


def classify_document(text: Column, title: Column, url: Column, r=rules) -> Column:
    """The kind of a document: the headline first, on a broad vocabulary, then the
    whole text on a narrow one unless it calls for action."""
    whole = casefold(F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n"), text)).otherwise(text))
    headline = casefold(F.coalesce(F.nullif(title, F.lit("")), F.substring(text, 1, r.HEADLINE_CHARS)))
    return let(F.struct(whole.alias("whole"), headline.alias("headline")), lambda folded: _kind(folded["whole"], folded["headline"], url, r))


def _kind(whole: Column, headline: Column, url: Column, r) -> Column:
    action, headline_action = contains_any(whole, r.ACTION_TERMS), contains_any(headline, r.ACTION_TERMS)
    has = lambda *terms: contains_any(whole, terms)
    return (
        F.when(~headline_action & contains_any(headline, r.HEADLINE_RESULT_TERMS), "WINNER_ANNOUNCEMENT")
        .when(~headline_action & contains_any(headline, r.HEADLINE_RECAP_TERMS), "PAST_EVENT_RECAP")
        .when(~headline_action & is_news_url(url), "NEWS_ARTICLE")
        .when(~action & contains_any(whole, r.RESULT_TERMS), "WINNER_ANNOUNCEMENT")
        .when(~action & contains_any(whole, r.RECAP_TERMS), "PAST_EVENT_RECAP")
        .when(~action & has("results"), "RESULTS_POST")
        .when(has("webinar") & ~has("competition", "hackathon"), "WEBINAR")
        .when(has("conference") & (~has("competition") | has("no competition")) & ~has("hackathon"), "CONFERENCE")
        .when(contains_any(whole, r.JOB_TERMS), "JOB_POSTING")
        .when(action, "REGISTRATION_OPEN")
        .when(_category(whole, r.CATEGORY_TERMS) != "UNKNOWN", "EVENT_ANNOUNCEMENT")
        .otherwise("UNRELATED")
    )


def looks_like_old_news(title: Column, snippet: Column) -> Column:
    headline = casefold(title)
    context = casefold(F.concat_ws("\n", title, snippet))
    return ~contains_any(context, rules.ACTION_TERMS) & contains_any(headline, rules.HEADLINE_RESULT_TERMS + rules.HEADLINE_RECAP_TERMS)


def is_plausibly_relevant(text: Column, strong=rules.COMPETITION_TERMS + rules.CONTEST_TERMS, weak=rules.WEAK_HINTS, action=rules.ACTION_TERMS) -> Column:
    lowered = casefold(text)
    return (F.trim(lowered) != "") & (contains_any(lowered, strong) | (contains_any(lowered, weak) & contains_any(lowered, action)))


def detect_country(text: Column, home=rules.PH_TERMS, places=rules.FOREIGN_PLACES, markers=rules.MALAY_MARKERS, least=rules.MALAY_LEAST, marked="MY") -> Column:
    """The home country wins, then the first foreign place, then enough markers."""
    return let(casefold(text), lambda lowered: _country(lowered, home, places, markers, least, marked))


def _country(lowered: Column, home, places, markers, least: int, marked: str) -> Column:
    hits = reduce(lambda n, m: n + lowered.contains(m).cast("int"), markers, F.lit(0))
    return F.coalesce(F.when(contains_any(lowered, home), "PH"), first_match(lowered, places), F.when(hits >= least, marked))


NAMED_HACK = r"\bhack(?:athon|[a-z]*[0-9]|\s*[0-9])"


def classify_mention(body: Column, urls: Column) -> Column:
    """What a post does when it names a competition; ``urls``: its outbound links."""
    lowered = casefold(body)
    has = lambda terms: contains_any(lowered, terms)
    links = F.coalesce(urls, F.array().cast("array<string>"))
    follow = F.exists(links, lambda u: host_in(host_of(u), rules.FOLLOW_HOSTS))
    form = F.exists(links, lambda u: host_in(host_of(u), rules.FORM_HOSTS))
    country = detect_country(body)
    category = has(rules.COMPETITION_TERMS) | lowered.rlike(NAMED_HACK) | (classify_category(body) != "UNKNOWN")
    action, dated = has(rules.ACTION_HINTS), body.rlike(r"\b20[0-9]{2}\b")
    asks = has(rules.QUESTION_HINTS) | ((F.char_length(body) <= 400) & body.contains("?") & category & ~has(rules.ACTION_TERMS))
    talk = ~has(rules.TALK_FORMATS) & has(rules.TALK_WORDS)
    event = follow | (form & category) | (category & action) | (action & dated) | (category & dated)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "unrelated")
        .when(has(rules.RESULT_TERMS + rules.RECAP_TERMS), "recap")
        .when(has(rules.JOB_HINTS), "job")
        .when(country.isNotNull() & (country != "PH"), "foreign")
        .when(has(rules.TEAMMATE_HINTS), "teammate")
        .when(asks, F.when(follow, "question_with_link").otherwise("question"))
        .when(talk, "unrelated")
        .when(event, "event")
        .otherwise("unrelated")
    )
