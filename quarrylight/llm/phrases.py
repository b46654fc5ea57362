"""Phrase collocations by SON partitioning.

A phrase of 1 to :data:`LONGEST` words with at least ``least`` occurrences in all texts
has, in some shard of the texts, at least the shard's share of ``least``: shares add up
to one.  So the job is three passes:

1. *Mine.*  A task cuts its texts into shards of about a :data:`SHARDS`-th of all bytes
   (and of :data:`SHARD_BYTES` at most).  Each is mined completely, level by level (a
   phrase can be frequent only if it is so without its first and without its last word),
   at half of ``least`` times the shard's share of the bytes, rounded up.
2. *Unite.*  Where a phrase isn't frequent it has less than half its shard's due, so all
   such shards together hold less than half of ``least``.  A phrase is a candidate if
   the rest, summed over the shards in which it is frequent, can make up the other half.
   Sums go by a hash of 64 bits; candidates are bits of a map of fixed size (8 MB).
   Phrases that share a hash or a bit cost a count more in pass 3 and change no result.
3. *Count.*  All phrases at a set bit are counted exactly, by their words, in all texts.
   A task sums up its own texts before it sends a row a phrase.

Scores are DataFrame work on the frequent phrases: the parts of a frequent phrase are
frequent, too, so cuts are joins of that table with itself.  Products pass 64 bits and
are decimals of 38 digits.

The number of shards, and so the local support, is the same for any texts of up to
``SHARDS * SHARD_BYTES`` bytes; from there on shards grow in number.  Beyond ``least / 2``
shards the local support is one: pass 1 sends a row for every phrase of a shard, in work
and shuffled bytes that still grow in proportion to the texts.

Defined results: a null or blank text has no words; a null language is ``und``; repeated
rows count each time; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import give_back, ship_package, small, written

LONGEST = 5
#: Shards at least (uneven tasks make more), and bytes of text in one at most.
SHARDS, SHARD_BYTES = 24, 48 << 20
#: Bytes of text that are split into words at once, that are hashed at once, that the counting pass
#: holds as numbers, and distinct words that it holds.
WAIT_BYTES, SPLIT_BYTES, CHUNK_BYTES, WORDS = 1 << 20, 1 << 18, 64 << 20, 1 << 19
#: Keys that are counted at once.
PART = 1 << 19
#: The map of candidates has 2**BITS bits, in pieces as Spark's bitmap functions have them.
BITS, PIECE = 26, 1 << 15
#: Ends a piece of text; no word holds one of these signs.
STOP = b"."
_FOLD = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)
_SPREAD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(texts: list[bytes]) -> bytes:
    """Texts as one, with A-Z in lower case and :data:`STOP` for what ends a piece."""
    return (b" . ".join(texts)).lower().translate(_FOLD)


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of texts in order, with :data:`STOP` between pieces.

    ``split`` of bytes knows no white space but space, tab and the line ends that are
    stops here."""
    return folded(texts).replace(STOP, b" . ").split()


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64, and of its inverse."""
    base = 0x9FB21C651E98DF25
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))


def token_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of folded text in order, 0 for a stop, by running sums."""
    signs = np.frombuffer(data, np.uint8)
    stop = signs == STOP[0]
    word = np.concatenate([[False], ~(stop | (signs == 0x20) | (signs == 0x09)), [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    power, inverse = (p[: len(signs)] for p in _powers(max(1, len(signs)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * power)])
    at = np.zeros(len(signs), np.uint64)
    at[starts] = np.maximum((sums[ends] - sums[starts]) * inverse[starts], np.uint64(1))
    stop[starts] = True
    return at[stop]


def _split_at_blanks(data: bytes) -> Iterator[bytes]:
    """Parts of about :data:`SPLIT_BYTES`, none of which cuts a word."""
    while len(data) > 2 * SPLIT_BYTES:
        cut = max(data.find(b" ", SPLIT_BYTES), data.find(STOP, SPLIT_BYTES))
        if cut < 0:
            break
        yield data[:cut]
        data = data[cut:]
    yield data


class Vocabulary(dict):
    """Word -> number, in order of appearance; 0 is the stop."""

    def __init__(self) -> None:
        super().__init__({STOP: 0})
        self.words, self.hashes = [STOP], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        new = list(islice(self, len(self.words), None))
        self.words += new
        if new:
            self.hashes = np.concatenate([self.hashes, *map(token_hashes, _split_at_blanks(b" ".join(new)))])
        return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Bits of the map: the first of the spread hash."""
    return (hashes * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64)


def _numbered(key: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> each key's number among those with the support, or -1; their first places and
    counts.  Many keys go in parts, so that only one part's table is held."""
    import pandas as pd

    dense, firsts, counts, known = np.full(len(key), -1, np.int32), [], [], 0
    parts = -(-len(key) // PART)
    for part in range(parts):
        at = np.flatnonzero(key % parts == part).astype(np.int32) if parts > 1 else np.arange(len(key), dtype=np.int32)
        code, distinct = pd.factorize(key[at])
        count = np.bincount(code, minlength=len(distinct))
        first = np.empty(len(distinct), np.int32)
        first[code[::-1]] = at[::-1]
        good = count >= support
        dense[at] = np.where(good, np.cumsum(good) - 1 + known, -1).astype(np.int32)[code]
        known += int(good.sum())
        firsts.append(first[good])
        counts.append(count[good])
    return dense, np.concatenate(firsts), np.concatenate(counts)


def levels(tokens: np.ndarray, hashes: np.ndarray, *, support: int = 1, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """-> words, first places, counts and spread hashes of the phrases of each length that
    have the support (and, given a map, are in it), as have all their parts."""
    place = np.flatnonzero(tokens).astype(np.int32)
    chain = hashes[tokens[place]]  # of the phrase at each place
    key = tokens[place].astype(np.int64)
    group = np.full(len(tokens) + 1, -1, np.int32)
    for length in range(1, LONGEST + 1):
        if known is not None:
            slot = _slots(chain)
            there = known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
            del slot
            place, chain, key = place[there], chain[there], key[there]
        if not len(place):
            return
        dense, first, count = _numbered(key, support)
        del key
        yield length, place[first], count, (chain[first] * _SPREAD).view(np.int64)
        group.fill(-1)
        group[place] = dense
        on = (dense >= 0) & (group[place + 1] >= 0)
        place, chain, dense = place[on], chain[on], dense[on]
        last = tokens[place + length]
        key = dense.astype(np.int64) * len(hashes) + last
        chain = chain * _STEP + hashes[last]
        del dense, last, on


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))


class Held:
    """Texts of each language as arrays, made of a few texts at a time: words as objects
    take ten times the room of their text."""

    def __init__(self, number: Callable[[list[bytes]], np.ndarray]) -> None:
        self.number, self.size, self.waiting = number, 0, 0
        self.texts: dict[str, list[bytes]] = {}
        self.done: dict[str, list[np.ndarray]] = {}

    def add(self, batch: pa.RecordBatch, rows: slice) -> None:
        column = batch.column("text").slice(rows.start, rows.stop - rows.start).cast(pa.binary())
        for lang, text in zip(batch.column("lang")[rows].to_pylist(), column, strict=True):
            text = text.as_py()
            self.texts.setdefault(lang, []).append(text)
            self.waiting += len(text)
            if self.waiting >= WAIT_BYTES:
                self.split()
        self.split()

    def split(self) -> None:
        for lang, texts in self.texts.items():
            self.done.setdefault(lang, []).append(self.number([*texts, b""]))
        self.size, self.waiting = self.size + self.waiting, 0
        self.texts.clear()

    def join(self, other: Held) -> None:
        """Take over another's texts."""
        for lang, parts in other.done.items():
            self.done.setdefault(lang, []).extend(parts)
        self.size += other.size

    def taken(self) -> Iterator[tuple[str, np.ndarray]]:
        """A language at a time, each given up as it is handed out."""
        while self.done:
            lang, parts = self.done.popitem()
            yield lang, np.concatenate(parts)
        self.size = 0


def _sizes(texts: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and of a shard."""
    total = texts.agg(F.sum("size")).first()[0] or 0
    return total, max(1, min(SHARD_BYTES, -(-total // SHARDS)))


def candidates(docs: DataFrame, *, least: int, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Passes 1 and 2: the map of all phrases that may be frequent."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    total, shard = _sizes(texts)

    def hashed(own: list[bytes]) -> np.ndarray:
        return np.concatenate(list(map(token_hashes, _split_at_blanks(folded(own)))))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held, earlier = Held(hashed), None

        def mined(part: Held) -> Iterator[pa.RecordBatch]:
            support = max(1, -(-least * part.size // (2 * max(total, 1))))
            for _, words in part.taken():
                # words of one hash count as one: their phrases may be found too often,
                # and are then counted by their words; a 0 before all makes the stop 0
                tokens, hashes = pd.factorize(np.concatenate([np.zeros(1, np.uint64), words]))
                del words
                tokens = tokens.astype(np.int32)
                for _, _, count, key in levels(tokens, hashes, support=support):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count - (support - 1))], names=["key", "rest"])
                del tokens, hashes
                give_back()

        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.add(batch, slice(at, min(at + 256, batch.num_rows)))
                if held.size >= shard:
                    # a full shard waits for the next one, so that what is left at the
                    # end isn't a shard of its own, with hardly a share
                    if earlier is not None:
                        yield from mined(earlier)
                    earlier, held = held, Held(hashed)
        if earlier is not None:
            held.join(earlier)
        yield from mined(held)

    rest = texts.coalesce(max(1, -(-total // shard))).mapInArrow(mine, "key long, rest long").groupBy("key").agg(F.sum("rest").alias("rest"))
    slots = rest.filter(F.col("rest") * 2 > least).select(F.shiftrightunsigned("key", 64 - BITS).alias("slot"))
    pieces = slots.groupBy(F.expr(f"cast(slot div {PIECE} as int)").alias("piece")).agg(F.expr(f"bitmap_construct_agg(slot % {PIECE})").alias("bits"))
    known = np.zeros(1 << BITS >> 3, np.uint8)
    for row in pieces.toLocalIterator():  # at most 2**BITS / PIECE rows of PIECE / 8 bytes
        at = row.piece * (PIECE >> 3)
        known[at : at + (PIECE >> 3)] = np.frombuffer(row.bits, np.uint8)
    return known


def counted(docs: DataFrame, known: np.ndarray, *, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Pass 3: ``lang``, ``phrase`` (words joined by a space), ``f``, exactly, of all
    phrases with at least ``least`` occurrences; the empty phrase counts all words."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    texts = _texts(docs, text_col, lang_col)
    total, _ = _sizes(texts)
    # small files together, as a task sends a row a phrase
    tasks = max(SHARDS // 2, -(-total // SHARD_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = Vocabulary()
        held = Held(lambda own: words.numbers(tokens_of(own)))

        def sums() -> Iterator[pa.RecordBatch]:
            nonlocal words
            for lang, tokens in held.taken():
                phrases, numbers = [b""], [np.array([np.count_nonzero(tokens)])]
                for length, first, n, _ in levels(tokens, words.hashes, known=shared.value):
                    spelled = [map(words.words.__getitem__, tokens[first + j].tolist()) for j in range(length)]
                    phrases += map(b" ".join, zip(*spelled, strict=True))
                    numbers.append(n)
                numbers = np.concatenate(numbers)
                for at in range(0, len(phrases), 1 << 16):
                    part = pa.array(phrases[at : at + (1 << 16)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part.view(pa.string()), pa.array(numbers[at : at + (1 << 16)], pa.int64())], names=["lang", "phrase", "n"])
            if len(words) > WORDS:
                words = Vocabulary()
            give_back()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.add(batch, slice(at, min(at + 256, batch.num_rows)))
                if held.size >= CHUNK_BYTES:
                    yield from sums()
        yield from sums()
        held = words = None
        give_back()

    sums = texts.drop("size").coalesce(tasks).mapInArrow(count, "lang string, phrase string, n long")
    return sums.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, *, least: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """-> ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first
    ``most`` phrases of each language by the score of their lowest-scoring cut."""
    known = candidates(docs, least=least, text_col=text_col, lang_col=lang_col)
    found = written(counted(docs, known, least=least, text_col=text_col, lang_col=lang_col), "phrases")
    totals = small(found.filter("phrase = ''").select("lang", F.col("f").alias("n")))
    found = found.filter("phrase <> ''")
    part = lambda name: found.select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name))
    words = F.split("phrase", " ")
    phrases = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).filter("size(w) > 1")

    def some(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    size = F.size("w")
    # counts only fall as phrases grow, so a longer phrase with the same count lies over
    # a phrase that is one word longer and has the same count
    longer = phrases.select("lang", F.col("a"), F.explode(F.array(some(F.lit(1), size - 1), some(F.lit(2), size - 1))).alias("phrase")).distinct()
    kept = phrases.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"l_phrase": some(F.lit(1), F.col("k")), "r_phrase": some(F.col("k") + 1, size - F.col("k"))}).drop("w")
    cuts = cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(totals, "lang")
    big = "decimal(38,0)"
    score = F.expr(f"cast(cast(1000 as {big}) * a * n as {big}) div cast(cast(l as {big}) * r as {big})")
    lowest = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    flat = lowest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
