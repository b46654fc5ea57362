"""Language of a text by hierarchical discrimination: family first, then language.

*Features.*  Letters are lower-cased and cut into words; a word gives its 1 to 3 letter
grams, with its ends marked, hashed into :data:`BUCKETS` buckets (all grams of a text at
once, as arrays).  A text is the mean of
its grams, each scaled so that rare and frequent grams weigh alike.  No length cap: every
word of a text counts.

*Learning.*  At most :data:`LABELLED` texts, an even share of each of the at most
:data:`LANGUAGES` most frequent languages, chosen by hash.  One-versus-one linear support
vector machines (dual coordinate descent) tell families apart, and another set the
languages of each family.  :data:`FAMILIES` names closely related languages; a language
in none is a family of its own.  A scale fitted on texts set aside turns margins into
probabilities.

*Prediction.*  The winner of a stage is the class
with most duels won, then with the larger sum of margins; the score is the probability of
its closest duel, multiplied over both stages.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if there was nothing to learn from; letters that no learned text has still get
a learned language, with the score that the machines give; repeated rows get equal
results; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import ship_package, written

BITS, PIECE = 12, 1 << 20
BUCKETS = 1 << BITS
#: Texts that the machines learn from, at most, and languages that they tell apart.
LABELLED, LANGUAGES = 4000, 200
#: Closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb", "sv", "da", "no", "nb", "nn", "is", "fo"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"),
    "indic": ("hi", "mr", "ne", "bn", "as", "pa", "gu", "ur"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "semitic": ("ar", "he", "mt"),
    "malayic": ("id", "ms", "jv", "su", "tl"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    """By the code before a region or script; a language in no family is its own."""
    code = re.split("[-_]", lang.lower())[0]
    return next((name for name, members in FAMILIES.items() if code in members), f"={lang}")


@cache
def _classes() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for what else can be in a word, 0."""
    return np.array([1 if c.isalpha() else 2 if c.isalnum() or c == "_" else 0 for c in map(chr, range(0x110000))], np.uint8)


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about :data:`PIECE` characters, cut at blanks where there are."""
    while len(text) > PIECE:
        cut = text.rfind(" ", 0, PIECE) + 1 or PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def _hashed(*signs: np.ndarray) -> np.ndarray:
    """Bucket of a gram, from its code points (0: a word's end)."""
    mixed = np.full(len(signs[0]), len(signs), np.uint32)
    for sign in signs:
        mixed = (mixed ^ sign) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - BITS)


def gram_counts(text: str | None) -> tuple[np.ndarray, bool]:
    """How often each bucket occurs among a text's grams; whether it has a letter."""
    total, letters = np.zeros(BUCKETS, np.int64), False
    for piece in _pieces((text or "").lower()):
        signs = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        signs = np.concatenate([[0], signs, [0]]).astype(np.uint32)
        kind = _classes()[signs]
        letter = kind == 1
        if not letter.any():
            continue
        letters = True
        # codes and keys have no language: words that touch a digit are left out
        starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:])
        touched = (kind[starts - 1] == 2) | (kind[ends + 1] == 2)
        for a, b in zip(starts[touched].tolist(), ends[touched].tolist(), strict=True):
            letter[a : b + 1] = False
        signs = np.where(letter, signs, np.uint32(0))
        at = np.flatnonzero(letter)
        own, before, after = signs[at], signs[at - 1], signs[at + 1]
        head = before == 0
        grams = (_hashed(own), _hashed(own, after), _hashed(before[head], own[head]), _hashed(before, own, after))
        total += np.bincount(np.concatenate(grams), minlength=BUCKETS)
    return total, letters


def frequencies(text: str | None) -> np.ndarray:
    """Shares of the buckets among a text's grams."""
    counts, _ = gram_counts(text)
    return (counts / max(1, counts.sum())).astype(np.float32)


def machine(x: np.ndarray, positive: np.ndarray, *, cost: float = 0.1, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared
    hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(positive, 1.0, -1.0)
    share = positive.mean()
    slack = 1 / (2 * cost * np.where(positive, 0.5 / share, 0.5 / (1 - share)))  # classes weigh alike
    size = (x * x).sum(axis=1) + slack
    w, alpha, draw = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in draw.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]) / size[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Stage:
    """Duels between the members of a set; ``first`` is the column of their margins."""

    members: list[str]
    first: int
    heat: float = 1.0

    def duels(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.members)), 2))

    def winners(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's winner, and the probability of its closest duel."""
        rows, number = len(margins), len(self.members)
        won, total, closest = np.zeros((rows, number)), np.zeros((rows, number)), np.full((rows, number), np.inf)
        for k, (a, b) in enumerate(self.duels()):
            margin = margins[:, self.first + k] / self.heat
            for member, own in ((a, margin), (b, -margin)):
                won[:, member] += own > 0
                total[:, member] += own
                closest[:, member] = np.minimum(closest[:, member], own)
        best = np.lexsort((-total, -won))[:, 0] if number > 1 else np.zeros(rows, int)
        return best, 1 / (1 + np.exp(-np.clip(closest[np.arange(rows), best], -60, 60)))


@dataclass
class Hierarchy:
    """Weights (buckets x duels), biases, the stage of families and those of languages."""

    weights: np.ndarray
    biases: np.ndarray
    top: Stage
    below: list[Stage]

    def predict(self, sums: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """From the summed margins of a text's grams, and the number of grams."""
        margins = sums / np.maximum(counts, 1)[:, None] + self.biases
        family, score = self.top.winners(margins)
        names = np.array([""] * len(sums), object)
        for number, stage in enumerate(self.below):
            own = np.flatnonzero(family == number)
            if len(own):
                best, sure = stage.winners(margins[own])
                names[own] = np.array(stage.members, object)[best]
                score[own] *= sure
        return names.tolist(), score


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy | None:
    """The machines, from frequencies and languages; every fifth text of a language sets
    the scale of its stage's margins."""
    if not len(x):
        return None
    langs_of, scale = np.array(langs, object), 1 / np.sqrt(x.mean(axis=0) + 1e-3)
    z = x * scale
    families = np.array([family_of(lang) for lang in langs], object)
    weights, biases = [], []
    aside = np.zeros(len(x), bool)
    for lang in set(langs):
        aside[np.flatnonzero(langs_of == lang)[4::5]] = True

    def stage(labels: np.ndarray, rows: np.ndarray) -> Stage:
        own = Stage(sorted(set(labels[rows].tolist())), len(weights))
        held = []
        for a, b in own.duels():
            here = rows & np.isin(labels, (own.members[a], own.members[b]))
            learn = here & ~aside
            w = machine(z[learn], labels[learn] == own.members[a])
            test = here & aside if (here & aside).any() else learn
            held.append((z[test] @ w[:-1] + w[-1]) * np.where(labels[test] == own.members[a], 1, -1))
            weights.append(w[:-1] * scale)
            biases.append(w[-1])
        if held:
            right = np.concatenate(held)
            own.heat = float(min(np.geomspace(0.05, 4, 45), key=lambda heat: np.logaddexp(0, -right / heat).mean()))
        return own

    top = stage(families, np.ones(len(x), bool))
    below = [stage(langs_of, families == name) for name in top.members]
    table = np.array(weights).T if weights else np.zeros((BUCKETS, 0))
    return Hierarchy(np.ascontiguousarray(table), np.array(biases), top, below)


def learn(known: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = LABELLED, languages: int = LANGUAGES) -> Hierarchy | None:
    """From texts of known language.  Equal texts of a language count as one."""
    ship_package(known.sparkSession)
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    keys = keyed.select("lang", "key")
    kept = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    order = Window.partitionBy("lang").orderBy("key")
    chosen = keys.join(F.broadcast(kept.select("lang")), "lang").distinct().withColumn("n", F.row_number().over(order))
    each = max(1, most // max(1, kept.count()))
    chosen = written(chosen.filter(F.col("n") <= each).select("lang", "key"), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if (lang, key) not in seen:
                    seen.add((lang, key))  # at most as many as were chosen
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([key]), pa.array([frequencies(text.as_py()).astype("<f4").tobytes()], pa.binary())], names=["lang", "key", "x"])

    sample = keyed.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "key", "text")
    # a row a language and text, however often it occurs: at most ``most`` rows
    got = sample.mapInArrow(count, "lang string, key long, x binary").groupBy("lang", "key").agg(F.first("x").alias("x")).collect()
    got.sort(key=lambda r: (r.lang, r.key))
    return fit(np.array([np.frombuffer(r.x, "<f4") for r in got]).reshape(len(got), BUCKETS), [r.lang for r in got])


def predict(docs: DataFrame, model: Hierarchy | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, ``lang_pred``, ``score``."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    if model is None:
        return source.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([source.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sums, number, letters = np.zeros((batch.num_rows, own.weights.shape[1])), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for row, text in enumerate(batch.column("text")):
                counts, letters[row] = gram_counts(text.as_py())
                number[row] = counts.sum()
                sums[row] = counts @ own.weights
            names, score = own.predict(sums, number)
            names = [n if some else UNKNOWN for n, some in zip(names, letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=schema.names)

    return source.mapInArrow(run, schema)


def languages(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """-> id, ``lang_pred``, ``score`` of ``docs``, learned from ``known``."""
    return predict(docs, learn(known, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col)
