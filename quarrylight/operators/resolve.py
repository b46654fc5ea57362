"""Entity resolution: which incoming events are ones that we hold already.

Rungs, each on the rows that the one before left over: a shared URL, a shared opening of
the text (joins of groups of rows, not of rows), the words of one of the most recent rows, then similar titles
within a block.  Merging is not
transitive (editions and dates veto it), so rows attach to the block's leader and not
to one another; in a batch the leader is its smallest row by ``order``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import rules
from quarrylight.functions import dates
from quarrylight.functions.similarity import Crowd, title_ratio
from quarrylight.functions.text import editions_conflict, normalize_text, tokens
from quarrylight.operators.similar import title_links
from quarrylight.plans.common import staged
from quarrylight.shipping import ship_package


#: Ratio of two titles from which on they may be of one event.
POSSIBLE = 85.0
#: Seconds that dates of one edition are apart at most, and in a bin of time.
GAP = rules.EDITION_GAP_DAYS * 86400
BIN = GAP // 16


def compatible(a: str, b: str) -> Column:
    """The editions and dates of two rows (column prefixes) don't contradict."""
    ya, yb = F.col(f"{a}edition_year"), F.col(f"{b}edition_year")
    years = F.coalesce(ya != yb, F.lit(False))
    return ~years & ~editions_conflict(F.col(f"{a}edition_key"), F.col(f"{b}edition_key")) & ~dates.dates_contradict(F.col(f"{a}start"), F.col(f"{b}start"))


def compare(a: str, b: str, ratio: Column | None = None) -> Column:
    """MERGE, POSSIBLE_DUPLICATE or SEPARATE for two rows with canonical_url,
    registration_url (normalised), title and organizer (normalised), start, editions.
    ``ratio``: that of the titles, if it is known."""
    c = lambda side, n: F.col(f"{side}{n}")
    same = lambda n: F.coalesce((c(a, n) == c(b, n)) & (c(a, n) != ""), F.lit(False))
    years = F.coalesce(c(a, "edition_year") != c(b, "edition_year"), F.lit(False))
    gap = dates.days_apart(c(a, "start")["value"], c(b, "start")["value"])
    close = F.coalesce(gap <= 14, F.lit(False))
    ratio, organizer = title_ratio(c(a, "title"), c(b, "title")) if ratio is None else ratio, same("organizer")
    far = dates.dates_contradict(c(a, "start"), c(b, "start"))
    return (
        F.when(years | editions_conflict(c(a, "edition_key"), c(b, "edition_key")), "SEPARATE")
        .when(same("canonical_url") | same("registration_url"), F.when(far, "SEPARATE").otherwise("MERGE"))
        .when(gap > 120, "SEPARATE")
        .when((ratio >= 92) & organizer & close, "MERGE")
        .when((ratio >= POSSIBLE) & (organizer | close), "POSSIBLE_DUPLICATE")
        .otherwise("SEPARATE")
    )


def _sides(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}{c}") for c in df.columns))


def _keyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each key: ``k``, ``key``, ``y`` and ``e`` (year and edition, empty if
    there is none), ``t`` (seconds, of trustworthy dates only) and its bin, ``id``."""
    year, edition = F.coalesce(F.col("edition_year").cast("string"), F.lit("")), F.coalesce("edition_key", F.lit(""))
    t = F.when(dates.trustworthy(F.col("start")), F.unix_timestamp(F.col("start")["value"]))
    each = [rows.select(F.lit(n).alias("k"), F.col(c).cast("string").alias("key"), year.alias("y"), edition.alias("e"), t.alias("t"), "id") for n, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, each).filter("key <> ''").withColumn("bin", F.expr(f"t div {BIN} - if(t % {BIN} < 0, 1, 0)"))


def _least(rows: DataFrame, by: list[str], held: str = "id") -> DataFrame:
    """The two smallest ids of each group: one of them is no row's own."""
    ranked = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy(held))).filter("_n <= 2")
    return ranked.select(*by, F.col(held).alias("s_id")).distinct()


def same_key(incoming: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """-> id, ``match``: the smallest compatible stored row that has one of the keys, for
    incoming rows that have such a row.

    Rows of a key don't meet: groups of rows do, of one year and edition, each with its
    smallest ids.  Dates split time into bins of a sixteenth of the gap that is allowed:
    rows up to fifteen bins away are near enough, whatever their dates, so bins meet bins;
    only in the sixteenth bin do dates meet dates.  Without a date all of a key are near."""
    i, s = _keyed(incoming, columns), _keyed(stored, columns)
    group = ["k", "key", "y", "e"]
    dated, undated = i.filter("t is not null"), i.filter("t is null")

    def found(rows: DataFrame, sides: DataFrame, by: list[str], on: list[str], near: DataFrame | None = None) -> DataFrame:
        """``by``: what rows have in common that are near the same; ``on``: equal columns."""
        wanted = (rows.select(*by).distinct() if near is None else near).alias("i")
        held = sides.select(*on, *(F.col(c).alias(f"s_{c}") for c in ("y", "e")), "s_id", *(F.col(c).alias("s_t") for c in ("t",) if c in sides.columns))
        met = wanted.join(held, on).filter(((F.col("y") == "") | (F.col("s_y") == "") | (F.col("y") == F.col("s_y"))) & ~editions_conflict(F.col("e"), F.col("s_e")))
        if "s_t" in held.columns:
            met = met.filter(F.abs(F.col("t") - F.col("s_t")) <= GAP)
        return rows.join(_least(met, by, "s_id"), by).filter("id <> s_id").select("id", "s_id")

    def around(by: list[str], *bins: int) -> DataFrame:
        near = F.explode(F.sequence(F.col("bin") + bins[0], F.col("bin") + bins[1], F.lit(bins[2]).cast("long")))
        return dated.select(*by).distinct().withColumn("bin_", near)

    far, there = 16, s.filter("t is not null").withColumn("bin_", F.col("bin"))
    pairs = [
        found(undated, _least(s, group), group, ["k", "key"]),
        found(dated, _least(s.filter("t is null"), group), group, ["k", "key"]),
        found(dated, _least(there, [*group, "bin_"]), [*group, "bin"], ["k", "key", "bin_"], around([*group, "bin"], 1 - far, far - 1, 1)),
        found(dated, _least(there, [*group, "bin_", "t"]), [*group, "bin", "t"], ["k", "key", "bin_"], around([*group, "bin", "t"], -far, far, 2 * far)),
    ]
    return reduce(DataFrame.unionByName, pairs).groupBy("id").agg(F.min("s_id").alias("match"))


def _like_titles(i: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs of a block that titles or an address can bring together, with the ratio of
    their titles: equal titles and equal addresses by equi-joins, others by
    :func:`similar.title_links`.  No other pair of the block is looked at."""
    titles = i.select("block", F.col("i_title").alias("text")).unionByName(t.select("block", F.col("s_title").alias("text")))
    links = title_links(titles, POSSIBLE)
    links = links.unionByName(links.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    same = [i.join(t.withColumnRenamed("block", "_b"), (F.col("block") == F.col("_b")) & (F.col(f"i_{k}") == F.col(f"s_{k}")) & (F.col(f"i_{k}") != "")).drop("_b").withColumn("ratio", F.lit(r)) for k, r in (("title", 100.0), ("canonical_url", 0.0), ("registration_url", 0.0))]
    like = i.join(links.select("block", F.col("a").alias("i_title"), F.col("b").alias("s_title"), "ratio"), ["block", "i_title"]).join(t, ["block", "s_title"])
    return reduce(DataFrame.unionByName, [*same, like])


def _like_any(shared, least: float):
    """Arrays of words -> the numbers of the shared (number, words) that are like them."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def like(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers = [n for n, _ in shared.value]
        crowd = Crowd([other for _, other in shared.value])
        for batch in batches:
            yield pd.Series([[numbers[i] for i in crowd.like(frozenset(own), least)] for own in batch], dtype=object)

    return like


def similar_recent(incoming: DataFrame, stored: DataFrame, text: str, seen: str, as_of: Column, *, days: int = rules.CONTENT_DAYS, most: int = rules.CONTENT_RECENT, least: float = rules.CONTENT_RATIO, room: int = 1 << 25) -> DataFrame:
    """Incoming rows with the stored rows whose words are theirs, at least to that ratio:
    id, match, newness (1: seen last).

    Stored are the ``most`` rows seen last (ties: the smaller id) within ``days`` before
    ``as_of``: a stated set of at most so many rows, of which every one is compared with
    every incoming row, so no block can hide a copy that opens otherwise.  Their distinct
    words go to the workers in parts of about ``room`` characters.  Texts without a word
    are like none; a row is no match of its own."""
    spark = incoming.sparkSession
    ship_package(spark)
    words = lambda df: F.array_distinct(tokens(normalize_text(F.col(text))))
    first = stored.filter(F.col(seen).between(as_of - F.make_interval(days=F.lit(days)), as_of)).orderBy(F.desc(seen), "id").limit(most)
    parts, size = [[]], 0
    for number, row in enumerate(first.select("id", words(first).alias("words")).toLocalIterator(), 1):
        length = sum(map(len, row.words))
        if parts[-1] and size + length > room:
            parts.append([])
            size = 0
        parts[-1].append((number, row.id, frozenset(row.words)))
        size += length
    numbers = [(n, key) for part in parts for n, key, _ in part]
    known = spark.createDataFrame(numbers, T.StructType([T.StructField("newness", T.IntegerType()), T.StructField("match", stored.schema["id"].dataType)]))
    rows, found = incoming.select("id", words(incoming).alias("words")).filter(F.size("words") > 0), []
    # a row costs as many comparisons as there are recent rows: few words, much work
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "id")
    for part in filter(None, parts):
        like = _like_any(spark.sparkContext.broadcast([(n, own) for n, _, own in part]), least)
        found.append(rows.select("id", F.explode(like("words")).alias("newness")))
    if not found:
        return rows.join(known.withColumnRenamed("match", "id"), "id").select("id", F.col("id").alias("match"), "newness")
    pairs = reduce(DataFrame.unionByName, found).join(F.broadcast(known), "newness")
    return pairs.filter(F.col("id") != F.col("match")).select("id", "match", "newness")


def match(incoming: DataFrame, stored: DataFrame, keys: dict[str, list[str]], *, by_title: bool = True, text: str | None = None, seen: str = "last_seen", as_of: Column | None = None) -> DataFrame:
    """``keys``: rung -> alternative key columns.  With ``text`` and ``as_of``, a rung of
    contents follows: of the recent rows (by ``seen``) with the same words the newest.
    -> id, match, rung, action."""
    left, found = incoming, []
    s = _sides(stored, "s_")
    for rung, columns in keys.items():
        # written once: what a rung found is asked for by all after it
        got = staged(same_key(left, stored, columns).select("id", "match", F.lit(rung).alias("rung"), F.lit("MERGE").alias("action")), "rung")
        found.append(got)
        left = left.join(got.select("id"), "id", "left_anti")
    if text is not None:
        left = staged(left, "unmatched")
        # written once, too: the rung runs in Python, and the next one asks what it left over
        near = staged(similar_recent(left, stored, text, seen, as_of), "content")
        pairs = _sides(left, "i_").join(near, F.col("i_id") == F.col("id")).join(s, F.col("match") == F.col("s_id")).filter(compatible("i_", "s_"))
        got = pairs.groupBy(F.col("i_id").alias("id")).agg(F.min_by("s_id", "newness").alias("match"))
        found.append(got.select("id", "match", F.lit("content").alias("rung"), F.lit("MERGE").alias("action")))
        left = left.join(got.select("id"), "id", "left_anti")
    if by_title:
        # an organizer's events, else a series', else those of one title
        block = lambda side: F.coalesce(*(F.nullif(f"{side}_{c}", F.lit("")) for c in ("organizer", "series_key") if c in stored.columns), F.col(f"{side}_title"))
        i, t = staged(_sides(left, "i_").withColumn("block", block("i")), "left"), s.withColumn("block", block("s"))
        pairs = _like_titles(i, t).filter("i_id <> s_id").withColumn("action", compare("i_", "s_", F.col("ratio"))).filter("action <> 'SEPARATE'")
        order = Window.partitionBy("i_id").orderBy(F.col("action") != "MERGE", "s_id")
        ranked = pairs.withColumn("n", F.row_number().over(order)).filter("n = 1")
        found.append(ranked.select(F.col("i_id").alias("id"), F.col("s_id").alias("match"), F.lit("title").alias("rung"), "action"))
    return reduce(DataFrame.unionByName, found)


def leaders(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each row with the first row of its key (``leader``); no key leads itself.

    A smallest value by aggregation, so that no key is gathered in one task."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, F.col("id").alias("leader"))).alias("f")).select(key, "f.leader")
    return rows.join(first, key, "left").withColumn("leader", F.coalesce("leader", "id"))


def edition_leaders(rows: DataFrame, key: str, edition: str, order: list[str]) -> DataFrame:
    """Each row with the first row of its key and edition (``leader``).  A row without an
    edition contradicts none, so it follows the first edition of its key.  Two smallest
    values by aggregation; no key is gathered in one task."""
    own = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(edition).alias("_edition")).agg(F.min(F.struct(*order, F.col("id").alias("leader"))).alias("f"))
    named = own.filter("_edition is not null").groupBy("_key").agg(F.min("f").alias("g"))
    led = own.join(named, "_key", "left").select("_key", "_edition", F.when(F.col("_edition").isNull(), F.coalesce("g.leader", "f.leader")).otherwise(F.col("f.leader")).alias("leader"))
    joined = rows.join(led, (F.col(key) == F.col("_key")) & F.col(edition).eqNullSafe(F.col("_edition")), "left")
    return joined.withColumn("leader", F.coalesce("leader", "id")).drop("_key", "_edition")
