"""Text functions over string columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import rules
from quarrylight.shipping import ship_package


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if v and not v.isascii() else v or "")


def fold_text(value: Column) -> Column:
    """Compatibility composition, case and punctuation kept; null gives ''.

    The only text function without a built-in; apply it once, at the source."""
    ship_package()
    return _nfkc(value)


def casefold(value: Column) -> Column:
    """Lower case with the sharp s spelt out, as full case folding does."""
    return F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("ß"), F.lit("ss"))


def normalize_text(value: Column) -> Column:
    """Folded case, punctuation as blanks, single blanks.  The value is folded text."""
    plain = F.regexp_replace(casefold(value), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def _without(value: Column, noise: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(tokens(normalize_text(value)), lambda t: ~t.isin(*noise)), " ")


def normalize_title(value: Column) -> Column:
    return _without(value, rules.TITLE_NOISE)


def normalize_organizer(value: Column) -> Column:
    """Null gives ''."""
    return _without(value, rules.ORGANIZER_SUFFIXES)


def sealed(value: Column) -> Column:
    """The same value, which the optimizer computes once and doesn't take apart: for
    wide structs whose fields are used many times over."""
    return F.element_at(F.transform(F.array(value), lambda v: v), 1)


def contains_any(value: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda out, term: out | value.contains(term), terms, F.lit(False))


def first_match(value: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Name of the first entry that has a term in the value; null if none has."""
    (name, terms), *rest = table
    chain = F.when(contains_any(value, terms), F.lit(name))
    for name, terms in rest:
        chain = chain.when(contains_any(value, terms), F.lit(name))
    return chain


def content_prefix_hash(value: Column) -> Column:
    """Key of a text's first words; null if it has too few.  The text is folded once."""
    start = sealed(F.slice(tokens(sealed(normalize_text(value))), 1, rules.PREFIX_WORDS))
    return F.element_at(F.transform(F.array(start), lambda w: F.when(F.size(w) >= rules.PREFIX_LEAST, F.substring(F.sha2(F.array_join(w, " "), 256), 1, 32))), 1)


def edition_key(normalized_title: Column, year: Column, month: Column) -> Column:
    """``2026:edition-3``, ``2026-09``, ``2026``, ``edition-3`` or null."""
    found = F.nullif(F.regexp_extract(normalized_title, r"\b(20[0-9]{2})\b", 1), F.lit(""))
    own = F.coalesce(found, year.cast("string"))
    edition = F.nullif(F.regexp_extract(normalized_title, r"\b(?:edition|season)\s*([0-9]{1,2})\b", 1), F.lit(""))
    return (
        F.when(own.isNotNull() & edition.isNotNull(), F.concat(own, F.lit(":edition-"), edition))
        .when(own.isNotNull() & month.isNotNull(), F.concat(own, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
        .when(own.isNotNull(), own)
        .when(edition.isNotNull(), F.concat(F.lit("edition-"), edition))
    )


def edition_year(normalized_title: Column, year: Column) -> Column:
    found = F.nullif(F.regexp_extract(normalized_title, r"\b(20[0-9]{2})\b", 1), F.lit(""))
    return F.coalesce(found.cast("int"), year.cast("int"))


def editions_conflict(left: Column, right: Column) -> Column:
    """Keys disagree over the parts that both have; absent keys never do."""
    a, b = F.split(left, "-"), F.split(right, "-")
    shared = F.least(F.size(a), F.size(b))
    return F.coalesce((left != "") & (right != "") & (F.slice(a, 1, shared) != F.slice(b, 1, shared)), F.lit(False))


def sentences(value: Column) -> Column:
    return F.filter(F.split(value, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def summarise(value: Column, limit: int = 240) -> Column:
    """Leading sentences that are prose, as many as fit before the first that doesn't."""

    def prose(s: Column) -> Column:
        letters = F.char_length(F.regexp_replace(s, r"[^\p{L}\s]", ""))
        return (F.char_length(s) >= 40) & (letters >= 0.75 * F.char_length(s))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(state: Column, s: Column) -> Column:
        joined = F.when(state["text"] == "", s).otherwise(F.concat(state["text"], F.lit(" "), s))
        full = state["full"] | (F.char_length(joined) > limit)
        return F.struct(F.when(full, state["text"]).otherwise(joined).alias("text"), full.alias("full"))

    return F.aggregate(F.filter(F.transform(sentences(value), lambda s: F.trim(s)), prose), start, add, lambda s: s["text"])


def summarise_eligibility(value: Column, limit: int = 200) -> Column:
    """The first sentence, cut at a blank if it is longer; null if there is none."""
    first = F.get(F.split(F.trim(value), r"(?<=[.!?])\s+"), 0)
    head = F.substring(first, 1, limit)
    cut = F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))
    return F.nullif(F.when(F.char_length(first) > limit, cut).otherwise(first), F.lit(""))


def escaped(value: Column) -> Column:
    """Scraped text whose markdown shows as it is written: signs that would format it and
    both brackets of a link are escaped, as are a line's leading quote or heading."""
    signs = F.regexp_replace(F.coalesce(value, F.lit("")), r"([\\*_~`|\[\]])", r"\\$1")
    return F.regexp_replace(signs, r"(?m)^(\s*)([>#-])", r"$1\\$2")


def lead_key(name: Column, hint: Column) -> Column:
    material = F.concat(F.trim(F.coalesce(name, F.lit(""))), F.lit("|"), F.trim(F.coalesce(hint, F.lit(""))))
    return F.substring(F.sha2(material, 256), 1, 48)
