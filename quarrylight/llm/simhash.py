"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: the perfect binary Golay code on
bits 0 to 22 and again on bits 23 to 45 (each covers its 23 bits with radius 3),
and one word for the other 18 bits.  A fingerprint is replicated to every anchor
within the covering radius plus its share of the threshold, and fingerprints are
compared per anchor.  Both sides are replicated, so half the threshold each is
enough: two fingerprints at distance ``t`` have a midpoint within ``t / 2`` of
either, and the anchor that covers the midpoint gets both.  For a threshold of two
that is 1 to 11 anchors a fingerprint, out of 2**24.

An anchor with many fingerprints is not compared pair by pair: its fingerprints go
to the finest covering code, all words with radius 0, under the same rule.  There
the members of an anchor are the at most 65 fingerprints within one bit of it, all
linked to one another, so a star of links says the same as all pairs.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; rows with a null id take part, but lend no component their id (a
component of such rows alone has a null one); repeated rows get equal results;
columns other than id and text are dropped, so clashing names cannot occur; blank
texts are near copies of one another; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import give_back, ship_package, small, written

#: Fingerprints at an anchor beyond which the finest code takes over.
CROWD = 32
#: Documents with a shingle beyond which :func:`near_copies` links them in two steps.
SHINGLE_CROWD = 8
#: Texts among which shingles are counted (one in so many), frequent shingles that are
#: told apart at most, and times in the sample from which on one is hot.  They change
#: what is compared, never what is found.
SAMPLED, FREQUENT, HOT = 16, 1 << 16, 8
#: Parts over which the texts of a crowded shingle are dealt when they are compared.
SALTS = 8
#: Parity bits of a text at most; bytes of a hash by which two sets are compared.
MOST_BITS, WIDTH = 1 << 14, 5
#: Odd factor of the shingles' hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Generator polynomial of the binary Golay code, 1 + x2 + x4 + x5 + x6 + x10 + x11.
GOLAY = 0b110001110101
LENGTH, BLOCKS = 23, 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority of the shingles' hashes for each bit; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII gaps count
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """-> id, ``fingerprint`` (long: its 64 bits)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fingerprint", T.LongType())]))


def shingles_of(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's set of shingles; a shorter text is one shingle.

    A shingle's hash is a mixed sum of its words' hashes times odd factors."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    shingle = min(shingle, len(words))
    total = np.full(len(own) - shingle + 1, shingle, np.uint64)
    for k in range(shingle):
        total *= FACTOR
        total += own[k : len(own) - shingle + 1 + k]
    for shift in (32, 29):
        total ^= total >> np.uint64(shift)
        total *= FACTOR
    return np.unique(total ^ total >> np.uint64(32))


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes fall on each of the bits, at least twice as many
    bits as hashes (up to :data:`MOST_BITS`)."""
    bits = 256
    while bits < min(2 * len(hashes), MOST_BITS):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many hashes two sets differ at least: in as many as their parities do.
    The longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def packed(hashes: np.ndarray) -> bytes:
    """The hashes by :data:`WIDTH` bytes each, for a comparison of two sets."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether the Jaccard similarity of two packed sets is at least ``similarity``."""
    x, y = (np.frombuffer(s, f"V{WIDTH}") for s in (a, b))
    wide = np.zeros((len(x) + len(y), 8), np.uint8)
    wide[:, :WIDTH] = np.concatenate([x, y]).view(np.uint8).reshape(-1, WIDTH)
    common = len(wide) - len(np.unique(wide.view("<u8")))
    return common >= similarity / (1 + similarity) * len(wide) - 1e-6


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word's polynomial by the generator."""
    words = words.copy()
    for bit in range(LENGTH - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


def covering_table() -> np.ndarray:
    """syndrome -> the error of at most three bits that leads to the covering word."""
    errors = np.array([sum(1 << b for b in bits) for weight in range(4) for bits in combinations(range(LENGTH), weight)], np.int64)
    found = np.zeros(1 << 11, np.int64)
    found[_syndrome(errors)] = errors
    return found


def anchors_of(prints: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each fingerprint the anchors that cover a point within ``reach`` bits of it."""
    cover, mask = covering_table(), (1 << LENGTH) - 1
    flips = [sum(1 << b for b in bits) for weight in range(reach + 1) for bits in combinations(range(BLOCKS * LENGTH), weight)]
    every = np.empty((len(prints), len(flips)), np.int64)
    for k, flip in enumerate(flips):
        point, anchor = prints ^ flip, np.zeros_like(prints)
        for block in range(BLOCKS):
            part = point >> (block * LENGTH) & mask
            anchor |= (part ^ cover[_syndrome(part)]) << (block * LENGTH)
        every[:, k] = anchor
    every.sort(axis=1)
    new = np.ones_like(every, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    return [row[keep] for row, keep in zip(every, new, strict=True)]


def _by_crowd(placed: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Rows at anchors with at most ``crowd`` rows, and the others.

    Chance meetings at an anchor grow with the square of the rows, so no row is made
    for them: only crowded anchors are joined with, and pairs are tested as they meet."""
    crowded = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("anchor")
    return placed.join(crowded, "anchor", "left_anti"), placed.join(crowded, "anchor", "left_semi")


def links(prints: DataFrame, *, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints (one long column) -> ``a < b``: links whose transitive
    closure is that of all pairs within the threshold (an even number of bits)."""
    if threshold % 2 or threshold < 0:
        raise ValueError("the threshold is an even number of bits")
    reach = threshold // 2
    ship_package(prints.sparkSession)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def anchors(column: pd.Series) -> pd.Series:
        return pd.Series(anchors_of(column.to_numpy(np.int64), reach))

    placed = written(prints.select("fingerprint", F.explode(anchors("fingerprint")).alias("anchor")), "simhash-anchors")
    few, many = _by_crowd(placed, crowd)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    pairs = few.withColumnRenamed("fingerprint", "a").join(few.withColumnRenamed("fingerprint", "b"), "anchor").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = many.select("fingerprint").distinct()
    flips = [sum(1 << b for b in bits) for weight in range(reach + 1) for bits in combinations(range(64), weight)]
    signed = np.array(flips, np.uint64).view(np.int64).tolist()
    points = crowded.select("fingerprint", F.explode(F.array(*map(F.lit, signed))).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("anchor"))
    # at most as many members as there are flips
    stars = points.groupBy("anchor").agg(F.sort_array(F.collect_list("fingerprint")).alias("m")).filter(F.size("m") > 1)
    spokes = stars.select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, len(flips))).alias("b"))
    return pairs.unionByName(spokes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``root``: the least node of its component, for every
    node with a link.  Alternates large-star and small-star rounds, each written to
    the shared folder, until the links no longer change."""

    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = written(df.distinct(), "components")
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return df, tuple(row)

    # a is always the greater node, b the lesser
    now, state = checked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b"))
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b")
        now, after = checked(small)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """-> id, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-prints")
    prints = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    label = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "fingerprint").alias("label")
    named = prints.select("fingerprint", label)
    linked = links(prints.select("fingerprint"), threshold=threshold, crowd=crowd)
    for side in "ab":
        linked = linked.join(named.select(F.col("fingerprint").alias(side), F.col("label").alias(f"l{side}")), side)
    # the least label of a component holds its least id: no join on the root
    roots = components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    roots = roots.select(F.col("node.fingerprint").alias("fingerprint"), F.col("root.id").alias("least"), F.lit(True).alias("linked"))
    of_print = named.join(roots, "fingerprint", "left").select("fingerprint", F.when(F.col("linked"), F.col("least")).otherwise(F.col("label.id")).alias("component_id"))
    return marked.join(of_print, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bool]]]:
    """Batches of bounded size, and which rows' texts the task hasn't met yet: of copies
    most are left out (all that differ are kept)."""
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch, new = whole.slice(at, 512), []
            for key in batch.column("key").to_pylist():
                if len(seen) >= 1 << 18:
                    seen.clear()
                new.append(key not in seen)
                seen.add(key)
            yield batch, new


def _frequent(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted frequent shingles, by a sample of texts, their ranks, and which are hot."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in _unseen(batches):
            sets = [shingles_of(t.as_py(), shingle) for t, n in zip(batch.column("text"), new, strict=True) if n]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["token"])
        give_back()

    sample = source.filter(F.pmod("key", F.lit(SAMPLED)) == 0).select("text", "key").mapInArrow(tokens, "token long")
    counts = sample.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").orderBy(F.desc("times"), "token").limit(FREQUENT)
    rows = counts.collect()
    found, times = np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.times for r in rows], np.int64)
    order = np.argsort(found)
    return found[order], len(found) - order, times[order] >= HOT


def _marked(source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """A row a document: ``doc_id``, ``key`` (hash of its text), ``node`` (hash of its set
    of shingles), ``n`` (size of the set), ``print`` (fingerprint), ``odd`` (parities);
    and unless the task has met the text before, ``prefix``: the first shingles in the
    common order, frequent ones last, of which two similar texts share one; ``cold``:
    how many of them, the first ones, aren't hot."""
    from xxhash import xxh64_intdigest

    shared = source.sparkSession.sparkContext.broadcast(_frequent(source, shingle))
    fields = [T.StructField(c, T.LongType()) for c in ("key", "node", "print")] + [T.StructField("n", T.IntegerType()), T.StructField("odd", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("cold", T.IntegerType())]
    schema = T.StructType([source.schema["doc_id"], *fields])

    def first(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
        size = len(own) and len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
        if not len(frequent):
            return own[:size].view(np.int64), size
        k = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        known = frequent[k] == own
        order = np.argsort(np.where(known, rank[k], 0), kind="stable")[:size]
        return own[order].view(np.int64), int(np.count_nonzero(~(hot[k] & known)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in _unseen(batches):
            sets = [shingles_of(t.as_py(), shingle) for t in batch.column("text")]
            nodes = np.array([xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            prints = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            starts = [first(h, *shared.value) if n else (None, None) for h, n in zip(sets, new, strict=True)]
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(nodes), pa.array(prints), pa.array([len(h) for h in sets], pa.int32()), pa.array([parities(h) for h in sets], pa.binary())]
            columns += [pa.array([p for p, _ in starts], pa.list_(pa.int64())), pa.array([c for _, c in starts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return source.mapInArrow(run, schema)


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = SHINGLE_CROWD) -> DataFrame:
    """-> id, ``group_id``: the smallest id of the near copies that a document is
    linked with, itself included.  ``docs`` is read more than once: a table, or written.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at
    least ``similarity``; groups are the transitive closure of all such links.  Every
    link is verified by the sets, whatever proposed it:

    1. Anchors, as in :func:`links`: texts whose fingerprints differ by at most two bits.
       A 64-bit fingerprint can't tell all pairs at 0.8 (they differ by ten bits on
       average), so this finds the closest copies only.
    2. Prefix filtering, which misses none: with the shingles of every text in one
       order, frequent ones last, two texts that similar share one among the first
       n - similarity * n + 1 of either.  Texts that share one are compared unless sizes,
       positions or parity bits rule the similarity out (none of these bounds can fail).
       At a shingle of more than ``crowd`` texts the least one and the one with the
       fewest rarer shingles are compared with all others first, then those pairs that
       aren't in one group yet.  Hot shingles (by the sample, at most :data:`FREQUENT`)
       aren't dealt by shingle at all: texts look their two partners up in a table of
       the hot shingles."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    marks = written(_marked(source, shingle, similarity), "near-marks")
    prefixes = marks.filter("prefix is not null").select("node", "n", "prefix", "cold")
    label = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key", "node")
    nodes = written(marks.groupBy("node").agg(F.min(label).alias("label"), *(F.min(c).alias(c) for c in ("n", "print", "odd"))), "near-nodes")

    def may(n_a, at_a, n_b, at_b):
        overlap = F.lit(similarity / (1 + similarity)) * (n_a + n_b) - 1e-6
        return (F.least(n_a, n_b) >= F.lit(similarity) * F.greatest(n_a, n_b) - 1e-6) & (F.least(n_a - at_a, n_b - at_b) >= overlap)

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs those that are similar, by their sets."""
        pairs = pairs.distinct()
        for x in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")), x)

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = (batch.column(c) for c in ("n_a", "n_b", "odd_a", "odd_b"))
                keep = [(n.as_py() + m.as_py()) * (1 - similarity) / (1 + similarity) + 1e-6 >= least_difference(x.as_py(), y.as_py()) for n, m, x, y in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        pairs = written(pairs.mapInArrow(possible, "a long, b long"), "near-pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = written(nodes.join(wanted, "node", "left_semi").select("node", F.col("label.key").alias("key")), "near-wanted")
        texts = source.join(small(wanted), "key").select("node", "key", "text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, new in _unseen(batches):
                own = batch.filter(pa.array(new, pa.bool_()))
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array([packed(shingles_of(t.as_py(), shingle)) for t in own.column("text")], pa.binary())], names=["node", "s"])
            give_back()

        # copies of a text are one set
        found = texts.mapInArrow(sets, "node long, s binary").repartition("node").groupBy("node").agg(F.first("s").alias("s"))
        one, two = (found.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [alike(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

        return written(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long"), "near-links")

    def grouped(linked: DataFrame) -> DataFrame:
        """``node``, ``root`` (labels) of linked texts; least label means least id."""
        named = nodes.select("node", "label")
        for side in "ab":
            named_side = named.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
            linked = linked.join(named_side, side)
        return written(components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "near-roots")

    # 1: fingerprints
    prints = written(nodes.groupBy("print").agg(F.min("node").alias("own")), "near-prints")
    close = links(prints.select(F.col("print").alias("fingerprint")))
    ends = [prints.select(F.col("print").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab"]
    by_anchor = close.join(ends[0], "a").join(ends[1], "b").select(*pair("own_a", "own_b"))
    by_print = nodes.join(prints, "print").filter("node <> own").select(*pair("node", "own"))

    # 2: prefixes; a shingle that isn't hot has few texts
    rare = prefixes.select("node", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("at", "token")).repartition("token")
    rare = rare.groupBy("token", "node").agg(F.min("at").alias("at"), F.min("n").alias("n"))
    of_token = Window.partitionBy("token")
    rare = rare.withColumns({"c": F.count("*").over(of_token), "least": F.min(F.struct("node", "n", "at")).over(of_token), "plainest": F.min(F.struct("at", "node", "n")).over(of_token)})
    shared = written(rare.filter("c > 1"), "near-shared")
    few, many = shared.filter(F.col("c") <= crowd).select("token", "node", "n", "at"), shared.filter(F.col("c") > crowd)
    side = lambda df, x: df.select(*(F.col(c).alias(c if c in ("token", "salt") else f"{c}_{x}") for c in df.columns))
    near = may(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))
    met = side(few, "a").join(side(few, "b"), "token").filter((F.col("node_a") < F.col("node_b")) & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    stars = [many.filter((F.col("node") != F.col(f"{end}.node")) & may(F.col("n"), F.col("at"), F.col(f"{end}.n"), F.col(f"{end}.at"))).select(*pair("node", f"{end}.node")) for end in ("least", "plainest")]
    hot = prefixes.filter(F.size("prefix") > F.col("cold"))
    spread = lambda df, *more: df.select("node", "n", *more, F.posexplode("prefix").alias("at", "token"), "cold").filter("at >= cold").drop("cold")
    hubs = spread(hot).groupBy("token").agg(F.min(F.struct("node", "n", "at")).alias("least"), F.min(F.struct("at", "node", "n")).alias("plainest"))
    flat = hubs.select("token", *(F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("least", "plainest") for c in ("node", "n", "at")))
    table = {r[0]: (tuple(r[1:4]), tuple(r[4:7])) for r in flat.collect()}  # at most FREQUENT rows
    to_hubs = hot.mapInArrow(_partners(spark, table, similarity), "a long, b long") if table else None
    proposed = [by_anchor, by_print, met, *stars] + ([to_hubs] if table else [])
    linked = verified(reduce(DataFrame.unionByName, proposed))
    roots = grouped(linked)

    # what shares a crowded or hot shingle and isn't in one group yet
    of = roots.select(F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    rooted = lambda df: df.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    crowds = rooted(many.select("token", "node", "n", "at")).select("token", "node", "n", "at", "root")
    if table:
        crowds = crowds.unionByName(spread(rooted(hot), "root"))
    mixed = crowds.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    crowds = written(crowds.join(mixed, "token", "left_semi"), "near-crowds")
    dealt = side(crowds.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")), "a")
    every = side(crowds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "b")
    apart = dealt.join(every, ["token", "salt"]).filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
    late = verified(apart.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    if not late.isEmpty():
        roots = grouped(linked.unionByName(late))
    of_node = nodes.join(roots.select(F.col("node.node").alias("node"), F.col("root.id").alias("least"), F.lit(True).alias("linked")), "node", "left")
    of_node = of_node.select("node", F.when(F.col("linked"), F.col("least")).otherwise(F.col("label.id")).alias("group_id"))
    return marks.select("doc_id", "node").join(of_node, "node").select("doc_id", "group_id")


def _partners(spark, table: dict, similarity: float):
    """Pairs of texts with the two texts that each of their hot shingles names."""
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = shared.value
        for batch in batches:
            pairs: set[tuple[int, int]] = set()
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "n", "prefix", "cold")), strict=True)
            for node, n, prefix, cold in rows:
                for at in range(cold, len(prefix)):
                    for other, m, place in hubs[prefix[at]]:
                        if other != node and min(n, m) >= similarity * max(n, m) - 1e-6 and min(n - at, m - place) >= similarity / (1 + similarity) * (n + m) - 1e-6:
                            pairs.add((min(node, other), max(node, other)))
            ends = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    return run
