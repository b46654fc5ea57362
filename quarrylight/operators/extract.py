"""Structured facts from folded text: one projection, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import dates
from quarrylight.functions.text import contains_any, edition_key, edition_year, fold_text, normalize_organizer, normalize_text, normalize_title, sealed, sentences, tokens
from quarrylight.functions.urls import host_of, is_listing_url, is_registration_url, normalize_url
from quarrylight.operators.classify import classify_category, classify_document


def combined_text(title: Column, snippet: Column, text: Column) -> Column:
    """Title, snippet and text, without a part that another one contains.  A part equal
    to or inside an earlier one goes; an earlier one inside a later one goes."""
    t, s, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, snippet, text))
    keep_s = (s != "") & ~t.contains(s)
    head = F.when(keep_s, F.when(s.contains(t), s).otherwise(F.concat(t, F.lit("\n"), s))).otherwise(t)
    second = F.when(keep_s, s).otherwise(F.lit(""))
    first = F.when(keep_s & s.contains(t), F.lit("")).otherwise(t)
    keep_b = (b != "") & ~first.contains(b) & ~second.contains(b)
    parts = F.array(F.when(b.contains(first), F.lit("")).otherwise(first), F.when(b.contains(second), F.lit("")).otherwise(second), b)
    return F.when(keep_b, F.array_join(F.filter(parts, lambda p: p != ""), "\n")).otherwise(head)


def extract_location(text: Column, url: Column) -> Column:
    """Where it takes place; the text is normalized once."""
    return dates.let(normalize_text(text), lambda lowered: _location(lowered, url))


def _location(lowered: Column, url: Column) -> Column:
    online, hybrid = contains_any(lowered, rules.ONLINE_TERMS), lowered.contains("hybrid")
    city = F.coalesce(*(F.when(lowered.contains(alias), F.lit(name)) for alias, name in rules.CITY_ALIASES))
    home = contains_any(lowered, rules.PH_TERMS) | city.isNotNull() | F.coalesce(host_of(url).endswith(".ph"), F.lit(False))
    kind = F.when(hybrid | (online & city.isNotNull()), "HYBRID").when(online, "ONLINE").when(home, "ONSITE").otherwise("UNKNOWN")
    confidence = F.when(city.isNotNull(), 0.9).when(home, 0.75).otherwise(0.0)
    return F.struct(F.when(home, "PH").alias("country"), F.when(city.isNotNull(), rules.CITY_REGION).alias("region"), city.alias("city"), F.lit(None).cast("string").alias("venue"), kind.alias("location_type"), confidence.alias("confidence"))


def extract_eligibility(text: Column) -> Column:
    """Three-valued answers: true, false, or null where the text doesn't say."""
    return dates.let(normalize_text(text), lambda lowered: _eligibility(lowered, text))


def _eligibility(lowered: Column, text: Column) -> Column:
    allowed = F.when(contains_any(lowered, rules.EXCLUDES_TERMS), False).when(contains_any(lowered, rules.ALLOWS_TERMS), True)
    student = contains_any(lowered, rules.STUDENT_TERMS)
    only = student & contains_any(lowered, rules.STUDENT_ONLY_TERMS)
    told = F.array_join(F.transform(F.filter(sentences(text), lambda s: contains_any(F.lower(s), rules.ELIGIBILITY_MARKERS)), lambda s: F.trim(s)), " ")
    true_or_null = lambda c: F.when(c, True)
    return F.struct(
        F.nullif(F.substring(told, 1, 1000), F.lit("")).alias("text"),
        true_or_null(only).alias("student_only"),
        true_or_null(student).alias("university_students_allowed"),
        true_or_null(contains_any(lowered, rules.PROFESSIONAL_TERMS)).alias("professionals_allowed"),
        allowed.alias("philippines_allowed"),
        F.when(allowed.isNotNull() | student, 0.9).otherwise(0.25).alias("confidence"),
    )


def confidence(signals: list[Column]) -> Column:
    """0.35 and 0.12 for each signal, 0.95 at most."""
    n = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return F.least(F.lit(0.95), F.lit(0.35) + n * F.lit(0.12))


def event_phase(description: Column, start: Column, end: Column, kind: Column, as_of: Column) -> Column:
    lowered = normalize_text(description)
    return (
        F.when(contains_any(lowered, ("cancelled", "canceled")), "CANCELLED")
        .when(lowered.contains("postponed"), "POSTPONED")
        .when(end < as_of, "PAST")
        .when(start <= as_of, "ONGOING")
        .when(start.isNotNull(), "UPCOMING")
        .when(kind.isin(*rules.EVENT_KINDS), "ANNOUNCED")
        .otherwise("UNKNOWN")
    )


def registration_state(description: Column, deadline: Column, kind: Column, as_of: Column) -> Column:
    """A past deadline that isn't trusted leaves the state unknown, whatever follows."""
    lowered = normalize_text(description)
    return (
        F.when(contains_any(lowered, rules.CLOSED_TERMS), "CLOSED")
        .when(deadline["value"] < as_of, F.when(deadline["confidence"] >= rules.TRUSTWORTHY, "CLOSED").otherwise("UNKNOWN"))
        .when(kind == "REGISTRATION_OPEN", "OPEN")
        .when(contains_any(lowered, rules.FORTHCOMING_TERMS), "FORTHCOMING")
        .otherwise("UNKNOWN")
    )


def extract_facts(docs: DataFrame, as_of: Column) -> DataFrame:
    """Documents (url, title, snippet, text, organizer, published, links) with
    ``facts``, ``overall_confidence`` and ``ambiguities``.  Text is folded here."""
    folded = docs.withColumns({f"_{c}": fold_text(F.col(c)) for c in ("title", "snippet", "text")})
    df = folded.withColumn("_all", combined_text(F.col("_title"), F.col("_snippet"), F.col("_text")))
    df = df.withColumn("_year", dates.context_year(F.col("_all"), F.col("published")))
    labelled = {name: dates.labelled_date(F.col("_all"), labels, F.col("_year")) for name, labels in rules.DATE_LABELS}
    listing = F.coalesce(is_listing_url(F.col("url")), F.lit(False))
    kind = F.when(listing, "DIRECTORY").otherwise(classify_document(F.col("_all"), F.col("_title"), F.col("url")))
    registers = F.filter(F.coalesce("links", F.array().cast("array<string>")), is_registration_url)
    df = df.withColumns({
        **{f"_{n}": c for n, c in labelled.items()},
        "_category": classify_category(F.col("_all")),
        "_kind": kind,
        "_location": sealed(extract_location(F.col("_all"), F.col("url"))),
        "_eligibility": sealed(extract_eligibility(F.col("_all"))),
        "_registration": F.when(F.size(registers) > 0, normalize_url(F.get(registers, 0))),
        "_norm": normalize_title(F.col("_title")),
        "_org": normalize_organizer(F.col("organizer")),
        "_words": tokens(normalize_text(F.col("_all"))),
    })
    start = F.col("_event_start")
    month = F.when(dates.trustworthy(start), F.month(start["value"]))
    year = F.year(start["value"])
    # no text labels an end or a prize that can be trusted: models fill these in
    nowhere = F.lit(None).cast(df.schema["_event_start"].dataType)
    description = F.substring(F.coalesce("text", F.lit("")), 1, 4000)
    series = F.concat(F.col("_org"), F.lit(":"), F.trim(F.regexp_replace("_norm", r"\b20[0-9]{2}\b", "")))
    facts = F.struct(
        F.nullif("title", F.lit("")).alias("title"), F.col("_norm").alias("normalized_title"), F.col("_category").alias("category"), "organizer",
        F.col("_org").alias("organizer_normalized"), description.alias("description"), F.col("_registration_open_date").alias("registration_open_date"),
        F.col("_registration_deadline").alias("registration_deadline"), start.alias("event_start"), nowhere.alias("event_end"), F.col("_location").alias("location"),
        F.col("_eligibility").alias("eligibility"), normalize_url(F.col("url")).alias("canonical_url"), F.col("_registration").alias("registration_url"),
        F.lit(None).cast("string").alias("prize_information"), F.col("_kind").alias("document_kind"), F.filter(F.array(*map(F.lit, rules.TOPICS)), lambda t: F.array_contains("_words", t)).alias("topics"),
        edition_key(F.col("_norm"), year, month).alias("edition_key"), edition_year(F.col("_norm"), year).alias("edition_year"), series.alias("series_key"),
        event_phase(description, start["value"], nowhere["value"], F.col("_kind"), as_of).alias("event_phase"),
        registration_state(description, F.col("_registration_deadline"), F.col("_kind"), as_of).alias("registration_state"),
    )
    df = df.withColumn("facts", sealed(facts))
    has_date = F.col("facts.registration_deadline.value").isNotNull() | F.col("facts.event_start.value").isNotNull()
    unknown = F.col("facts.category") == "UNKNOWN"
    no_title = F.col("facts.title").isNull()
    signals = [~unknown, ~no_title, F.col("facts.registration_url").isNotNull(), has_date, F.col("facts.location.confidence") >= 0.7, F.col("facts.document_kind").isin(*rules.EVENT_KINDS)]
    missing = F.array_compact(F.array(F.when(no_title, "missing_title"), F.when(~has_date, "missing_dates"), F.when(unknown, "unknown_category")))
    return df.withColumns({"overall_confidence": confidence(signals), "ambiguities": missing}).select(*docs.columns, "facts", "overall_confidence", "ambiguities")


def should_use_model(confidence: Column, ambiguities: Column, least: float = 0.75, critical=("missing_title", "missing_dates", "unknown_category")) -> Column:
    return (confidence < least) | F.arrays_overlap(ambiguities, F.array(*map(F.lit, critical)))


def merge_fill_only(base: Column, offered: Column, evidence: Column, corpus: Column) -> Column:
    """The base value; where it is missing, the offered one if its quote is in the text."""
    proven = F.coalesce((F.trim(evidence) != "") & F.lower(corpus).contains(F.lower(F.trim(evidence))), F.lit(False))
    return F.coalesce(F.nullif(base, F.lit("")), F.when(proven, offered))


def escalations(rows: DataFrame, budget: int, order: list[Column], least: float = 0.70) -> DataFrame:
    """Rows (overall_confidence, ambiguities) that the second model may see: those still
    thin after the first, as many as the budget allows."""
    thin = rows.filter(should_use_model(F.col("overall_confidence"), F.col("ambiguities"), least))
    return thin.orderBy(*order).limit(budget)


#: Confidence of what a model had a part in, at most; kinds from the strongest claim to
#: act down, a model may only go down.
MODEL_MOST = 0.83


def downgraded(kind: Column, offered: Column, proven: Column) -> Column:
    """The kind after a model's word: an event may turn out to be none, if its quote is
    in the text; what is no event never becomes one."""
    weaker = kind.isin(*rules.EVENT_KINDS) & offered.isin(*rules.NON_ACTIONABLE)
    return F.when(weaker & proven, offered).otherwise(kind)


def unproven(outputs: DataFrame, texts: DataFrame, key: str = "id", corpus: str = "text") -> DataFrame:
    """Keys whose extraction is rejected: a model (key, field, value, quote) gives a value
    whose quote is empty or not in the text."""
    told = outputs.filter(F.coalesce("value", F.lit("")) != "").join(texts.select(key, F.col(corpus).alias("_corpus")), key)
    quote = F.lower(F.trim(F.coalesce("quote", F.lit(""))))
    return told.filter((quote == "") | ~F.coalesce(F.lower("_corpus").contains(quote), F.lit(False))).select(key).distinct()


def model_confidence(signals: list[Column]) -> Column:
    """Confidence recomputed after a model filled fields in, at most :data:`MODEL_MOST`."""
    return F.least(F.lit(MODEL_MOST), confidence(signals))


def merge_models(rows: DataFrame, outputs: DataFrame, fields: list[str], key: str = "id", corpus: str = "text") -> DataFrame:
    """Fill missing fields from models' outputs (key, tier, field, value, quote), lower
    tiers first; a value counts only if its quote is in the text.  What was read
    directly is never replaced, and nor is a lower tier's answer."""
    quoted = outputs.join(rows.select(key, F.col(corpus).alias("_corpus")), key)
    proven = quoted.filter((F.trim("quote") != "") & F.lower("_corpus").contains(F.lower(F.trim("quote"))) & (F.coalesce("value", F.lit("")) != ""))
    best = proven.groupBy(key).agg(*(F.min_by("value", F.when(F.col("field") == f, F.col("tier"))).alias(f"_{f}") for f in fields))
    joined = rows.join(best, key, "left")
    return joined.withColumns({f: F.coalesce(F.nullif(f, F.lit("")), F.col(f"_{f}")) for f in fields}).drop(*(f"_{f}" for f in fields))
