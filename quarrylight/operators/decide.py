"""Gates and scores over extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.text import sealed


def verify(events: DataFrame, as_of: Column, *, roles: tuple[str, ...] = ("university_student",), online_abroad: bool = True, historical: bool = False, corroborating: Column | None = None) -> DataFrame:
    """``facts``, ``overall_confidence``, ``authority`` -> with ``gates``, ``rejections``
    (ordered, distinct), ``warnings`` and ``accepted``."""
    f = lambda path: F.col(f"facts.{path}")
    kind, phase, state = f("document_kind"), f("event_phase"), f("registration_state")
    deadline = f("registration_deadline")
    past = F.coalesce((deadline["value"] < as_of) & (deadline["confidence"] >= rules.TRUSTWORTHY) & ~deadline["year_inferred"], F.lit(False))
    allowed, country = f("eligibility.philippines_allowed"), f("location.country")
    online = F.coalesce(f("location.location_type").isin("ONLINE", "HYBRID"), F.lit(False)) & F.lit(online_abroad)
    enterable = F.when(allowed.eqNullSafe(False), False).when(country.eqNullSafe("PH"), True).when(online, allowed.eqNullSafe(True)).otherwise(False)
    why_not = F.when(allowed.eqNullSafe(False) | online, "NOT_PHILIPPINES_ELIGIBLE").otherwise("INTERNATIONAL_ONSITE")
    gates = {
        "competition": f("category") != "UNKNOWN",
        "actionable_document": ~kind.isin(*rules.NON_ACTIONABLE),
        "future": ~phase.isin("PAST", "CANCELLED") | (F.lit(historical) & (phase == "PAST")),
        "registration": F.lit(historical) | (state.isin("OPEN", "FORTHCOMING") & ~past),
        "philippines_eligible": enterable,
        "profile_match": ~(F.coalesce(f("eligibility.student_only"), F.lit(False)) & F.lit("university_student" not in roles)),
        "authority": (F.col("authority") >= rules.TRUSTED_AUTHORITY) | ((corroborating if corroborating is not None else F.lit(1)) >= 2),
        "confidence": F.col("overall_confidence") >= 0.75,
    }
    df = events.withColumn("gates", sealed(F.struct(*(F.coalesce(g, F.lit(False)).alias(n) for n, g in gates.items()))))
    failed = lambda n: ~F.col(f"gates.{n}")
    closed = (state == "CLOSED") | past
    codes = [
        F.when(failed("competition"), "NO_COMPETITION"),
        F.when(failed("actionable_document"), F.when(kind.isin(*rules.RESULT_KINDS), "RESULTS_ONLY").otherwise("NO_COMPETITION")),
        F.when(failed("future"), "PAST_EVENT"),
        F.when(failed("registration") & closed, "REGISTRATION_CLOSED"),
        F.when(failed("philippines_eligible"), why_not),
        F.when(failed("profile_match"), "PROFILE_INCOMPLETE"),
        F.when(failed("authority"), "LOW_AUTHORITY"),
        F.when(failed("confidence"), "LOW_CONFIDENCE"),
    ]
    df = df.withColumns({
        "rejections": F.array_distinct(F.array_compact(F.array(*codes))),
        "warnings": F.array_compact(F.array(F.when(failed("registration") & ~closed, "REGISTRATION_UNCONFIRMED"))),
    })
    passed = F.lit(True)
    for n in gates:
        passed = passed & F.col(f"gates.{n}")
    return df.withColumn("accepted", passed & (F.size("rejections") == 0))


def authority_points(authority: Column, weight: int = rules.WEIGHTS["authority"]) -> Column:
    """Rounded half to even."""
    return F.bround(F.lit(weight) * F.least(F.lit(100), authority) / F.lit(100.0), 0).cast("int")


def tier(total: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, least in rules.TIERS:
        chain = chain.when(total >= least, name)
    return chain.otherwise("LOW")


def score(events: DataFrame, as_of: Column, *, preferred_cities: tuple[str, ...] = rules.METRO_CITIES) -> DataFrame:
    """-> with ``components``, ``total`` and ``tier``."""
    w, f = rules.WEIGHTS, lambda path: F.col(f"facts.{path}")
    city = F.lower(F.coalesce(f("location.city"), F.lit("")))
    home, allowed = f("location.country").eqNullSafe("PH"), f("eligibility.philippines_allowed")
    away = f("location.location_type").isin("ONLINE", "HYBRID") & allowed.eqNullSafe(True)
    geography = (
        F.when(city.isin(*preferred_cities), w["geography"])
        .when(city.isin(*rules.METRO_CITIES), min(27, w["geography"]))
        .when(F.lower(f("location.region")).isin(*rules.NEARBY_REGIONS), min(22, w["geography"]))
        .when(home, min(18, w["geography"]))
        .when(away, min(24, w["geography"]))
        .otherwise(0)
    )
    category = (
        F.when(f("category").isin(*rules.PREFERRED_CATEGORIES), w["category"])
        .when(~f("category").isin("UNKNOWN", "OTHER_COMPETITION"), min(12, w["category"]))
        .when(f("category") == "OTHER_COMPETITION", min(7, w["category"]))
        .otherwise(0)
    )
    target = F.coalesce(f("registration_deadline.value"), f("event_start.value"))
    days = F.floor((F.unix_timestamp(target) - F.unix_timestamp(as_of)) / 86400)
    parts = {
        "geography": geography,
        "eligibility": F.when(allowed.eqNullSafe(True) | home, w["eligibility"]).when(allowed.isNull(), 5).otherwise(0),
        "category": category,
        "topic": F.when(F.arrays_overlap(f("topics"), F.array(*map(F.lit, rules.PREFERRED_TOPICS))), w["topic"]).otherwise(0),
        "actionability": F.when(f("registration_state") == "OPEN", w["actionability"]).when(f("registration_state") == "FORTHCOMING", min(10, w["actionability"])).otherwise(0),
        "authority": authority_points(F.col("authority")),
        "lead_time": F.when(days >= 21, w["lead_time"]).when(days >= 7, min(3, w["lead_time"])).otherwise(0),
    }
    df = events.withColumn("components", sealed(F.struct(*(c.cast("int").alias(n) for n, c in parts.items()))))
    total = F.least(F.lit(100), sum((F.col(f"components.{n}") for n in parts), F.lit(0)))
    return df.withColumn("total", total).withColumn("tier", tier(F.col("total")))
