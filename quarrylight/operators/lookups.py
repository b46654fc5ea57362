"""Joins without an equality of their own: points in ranges, moments near one another,
terms of a table inside texts.  Each becomes an equi-join on keys that both sides can
compute, so that Spark deals it out and no side meets all of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.text import casefold, normalize_text, tokens

#: Words in a term, at most; terms up to which their table is broadcast once counted.
TERM_WORDS, BROADCAST_TERMS = 16, 1 << 20


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of both sides, joined where start <= at < end (longs; the sides share no column
    name).  Ranges of any mix of lengths: a range of up to 2**k units lies in at most two
    bins of that width, so it is a row or two, and a point is a row for each k in use (at
    most 64).  A pair meets in one bin only.  Null bounds and empty ranges hold nothing."""
    clash = set(points.columns) & set(ranges.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    known = ranges.filter(F.col(start) < F.col(end)).withColumn("_level", F.ceil(F.log2((F.col(end) - F.col(start)).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in known.select("_level").distinct().collect())
    bin_of = lambda value, level: F.call_function("shiftright", value, level)
    binned = known.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), F.col("_level")), bin_of(F.col(end) - 1, F.col("_level")))))
    keyed = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), bin_of(F.col(at), F.lit(k)).alias("b")) for k in levels or [0])))
    placed = points.filter(F.col(at).isNotNull()).withColumn("_k", keyed)
    joined = placed.join(binned, (F.col("_k.l") == F.col("_level")) & (F.col("_k.b") == F.col("_bin")))
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).select(*points.columns, *ranges.columns)


def totals_in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, **totals: tuple[str, str]) -> DataFrame:
    """The ranges that hold a point, with totals of the points in each: name = (function,
    column), the function ``sum``, ``min`` or ``max``.  No pair of a point and a range is made.

    Points are summed up by moment, and these by dyadic cells; a range is the union of at
    most two cells of each width, so it meets twice as many totals as it has bits."""
    combine = lambda f, c: getattr(F, f)(c)
    if set(totals) & set(ranges.columns) or any(f not in ("sum", "min", "max") for f, _ in totals.values()):
        raise ValueError("totals are sums, minima or maxima, and no columns of the ranges")
    known = ranges.select(start, end).filter(F.col(start) < F.col(end)).distinct()
    longest = known.agg(F.max(F.col(end) - F.col(start))).first()[0] or 1
    levels = range(longest.bit_length())
    bin_of = lambda value, level: F.call_function("shiftright", value, F.lit(level))

    def cells(level: int) -> Column:
        low, high = -bin_of(-F.col(start), level), bin_of(F.col(end), level)
        one = lambda odd, cell: F.when((low < high) & (odd % 2 != 0), F.struct(F.lit(level).alias("l"), cell.alias("b")))
        return F.array(one(low, low), one(high, high - 1))

    moments = points.filter(F.col(at).isNotNull()).groupBy(at).agg(*(combine(f, c).alias(n) for n, (f, c) in totals.items()))
    placed = moments.withColumn("_k", F.explode(F.array(*(F.struct(F.lit(k).alias("l"), bin_of(F.col(at), k).alias("b")) for k in levels))))
    summed = placed.groupBy("_k.l", "_k.b").agg(*(combine(f, n).alias(n) for n, (f, _) in totals.items()))
    pieces = known.withColumn("_c", F.explode(F.flatten(F.array(*map(cells, levels))))).filter("_c is not null").select(start, end, "_c.l", "_c.b")
    told = pieces.join(summed, ["l", "b"]).groupBy(start, end).agg(*(combine(f, n).alias(n) for n, (f, _) in totals.items()))
    return ranges.join(told, [start, end]).select(*ranges.columns, *totals)


def near(left: DataFrame, right: DataFrame, a: str, b: str, within: int) -> DataFrame:
    """Rows of both sides whose longs ``a`` and ``b`` are at most ``within`` apart."""
    around = right.withColumns({"_from": F.col(b) - within, "_to": F.col(b) + within + 1})
    return in_ranges(left, around, a, "_from", "_to").drop("_from", "_to")


def term_hits(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """-> id, term, ``hits``: how often each term of a table (``term``: words, of which
    punctuation and case don't matter) stands in each row's text, as whole words.

    Texts become a word sequence a place, of the longest term's length; as many of its
    first words as the shortest term has meet those of terms by equality, whatever lengths
    terms have, so a table of any size is one pass over the texts.  Terms without a word
    are in no text; a term of more than :data:`TERM_WORDS` words is an error."""
    known = terms.select(F.col("term").alias("term"), F.array_join(tokens(normalize_text(F.col("term"))), " ").alias("_words")).filter("_words <> ''").distinct()
    sizes = sorted(r[0] for r in known.select(F.size(F.split("_words", " "))).distinct().limit(TERM_WORDS + 2).collect())
    if sizes and sizes[-1] > TERM_WORDS:
        raise ValueError(f"a term has {sizes[-1]} words")
    least, most = (sizes[0], sizes[-1]) if sizes else (1, 1)
    words = rows.select("id", tokens(normalize_text(F.col(text))).alias("w")).filter(F.size("w") >= least)
    # a run of words from each place on, as long as the longest term; its first words meet those of terms
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - least + 1), lambda i: F.array_join(F.slice("w", i, most), " "))
    spoken = words.select("id", F.explode(runs).alias("_run")).select("id", "_run", _head(F.col("_run"), least).alias("_head"))
    size = F.size(F.split("_words", " "))
    heads = known.groupBy(_head(F.col("_words"), least).alias("_head")).agg(F.collect_set(size).alias("_sizes"))
    heads, table = (F.broadcast(heads), F.broadcast(known)) if known.count() <= BROADCAST_TERMS else (heads, known)
    # a row a length that terms of that head have, however many terms those are
    met = spoken.join(heads, "_head").select("id", "_run", F.explode("_sizes").alias("_size")).filter(F.size(F.split("_run", " ")) >= F.col("_size"))
    met = met.select("id", F.call_function("substring_index", F.col("_run"), F.lit(" "), F.col("_size")).alias("_words"))
    return met.join(table, "_words").groupBy("id", "term").agg(F.count("*").alias("hits"))


def _head(words: Column, size: int) -> Column:
    """The first words of a text of single blanks."""
    return F.substring_index(words, " ", size)


def organizer_terms(organizers: DataFrame) -> DataFrame:
    """-> term: every way in which enabled organizers (name, aliases, enabled) are written,
    in lower case: names whole, aliases whole and by their words of two letters or more
    that aren't connectives."""
    on = organizers.filter(F.coalesce("enabled", F.lit(True)))
    alias = on.select(F.explode("aliases").alias("term")).select(F.trim(casefold(F.col("term"))).alias("term"))
    part = alias.select(F.explode(F.split("term", r"\s+")).alias("term")).filter((F.char_length("term") > 1) & ~F.col("term").isin(*rules.ALIAS_CONNECTIVES))
    return on.select(F.trim(casefold(F.col("name"))).alias("term")).unionByName(alias).unionByName(part).filter("term <> ''").distinct()


def known_stops(terms: DataFrame) -> tuple[str, ...]:
    """The terms that would otherwise stop a name: what ``leads.competition_name`` has to
    be told of a vocabulary, however large it is."""
    return tuple(sorted(r[0] for r in terms.filter(F.col("term").isin(*rules.NAME_STOPS)).select("term").distinct().collect()))
