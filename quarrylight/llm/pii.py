"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans around digits and at signs.  Exact
rules settle the base kinds (``email``, ``ip``, ``card``, ``phone``), whose spans
always stay.  Every other proposal is scored by boosted trees on features of its
format and of the characters around it; a kind's threshold is calibrated for a
precision on generated examples that the trees haven't seen.  Of overlapping
proposals the best scored one stays, and none that overlaps a base span.

The trees are fitted on the driver, once an application, on examples that a seeded
generator writes (:data:`EXAMPLES` of them): spans of each kind and look-alikes
(versions, dates, amounts, serial numbers, failed checksums, licence lines) in
neutral and telling contexts.  The corpus has no marked spans to learn from.

Defined results: null and empty texts have no spans; repeated rows get equal
results; columns other than id and text are dropped by :func:`find_spans` and all
kept by :func:`redact`.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.boosting import BoostedTrees, calibrated_threshold
from quarrylight.llm.common import give_back, ship_package

#: In the order in which results list them; the last three are only ever added.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national_id")
BASE = KINDS[:4]
#: Generated examples, half to fit and half to calibrate; precision asked for.
EXAMPLES, PRECISION = 4000, 0.99

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and from the start of a run of digits: the same matches in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
#: Proposals: (kind, pattern), each anchored at a digit or found around one.
DIGITS = re.compile(r"[0-9]+(?:[\x20().-]{1,2}[0-9]+)*")
RUN = re.compile(r"[A-Za-z0-9+/_=-]*")
#: An account number as it is printed, in groups of four.
GROUPED = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?\b")
CONTEXT = {
    "secret": ("token", "secret", "key", "passw", "bearer", "credential"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "card": ("card", "visa", "credit", "payment"),
    "iban": ("iban", "account", "bank"),
    "national_id": ("ssn", "social security", "national id", "passport"),
    "plain": ("version", "license", "licence", "isbn", "chapter", "page", "order", "invoice", "item", "build", "commit", "sha", "year", "release"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain: a match can only
    begin where the run of local characters before its at sign begins."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _octet(part: str) -> bool:
    """At most 255, however many zeros lead."""
    own = part.lstrip("0")
    return len(own) < 3 or (len(own) == 3 and own <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds, by kind and start."""
    if not HINT.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for kind, pattern, least, most in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposals of every kind that are not base spans; they may overlap."""
    out: set[tuple[str, int, int]] = set()
    for m in DIGITS.finditer(text):
        a, b = m.span()
        n = sum(c.isdigit() for c in m.group())
        if 7 <= n <= 15:
            out.add(("phone", a - (a > 0 and text[a - 1] == "("), b))
        if 13 <= n <= 19:
            out.add(("card", a, b))
        if n == 9:
            out.add(("national_id", a, b))
    end = 0
    for m in re.finditer("[0-9]", text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and RUN.fullmatch(text[a - 1]):
            a -= 1
        end = RUN.match(text, m.start()).end()
        body = text[a:end]
        lead = len(body) - len(body.lstrip("=-_/+"))
        body = body.strip("=-_/+")
        a += lead
        if len(body) >= 16:
            out.add(("secret", a, a + len(body)))
        if 15 <= len(body) <= 34 and body[:2].isalpha():
            out.add(("iban", a, a + len(body)))
    out.update(("iban", *m.span()) for m in GROUPED.finditer(text))
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    body = text[start:end]
    digits = "".join(c for c in body if c in "0123456789")
    letters = sum(c.isalpha() for c in body)
    counts = Counter(body)
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values()) if body else 0.0
    groups = re.findall("[0-9]+", body)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False))
    before, after = text[max(0, start - 28) : start], text[end : end + 2]
    told = before.casefold()
    touches = (before[-1:].isalnum() or before[-1:] in ("$", "#", "%", "_", "/")) or after[:1].isalnum() or after[:1] in ("%", "_", "/")
    number = body.replace(" ", "")
    iban = kind == "iban" and number.isascii() and number.isalnum() and number[:2].isalpha() and number[:2].isupper() and number[2:4].isdigit() and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    return [
        float(KINDS.index(kind)), len(body), len(digits), letters, len(digits) / max(1, len(body)), entropy, float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), switches / max(1, len(body)),
        float(luhn(digits)) if digits else 0.0, float(set(body.lower()) <= set("0123456789abcdef")), float(bool(re.search("[ ().-]", body))),
        float("(" in body or before.endswith("(")), float(iban), float(touches), float(before.rstrip().endswith(("=", ":"))), float(before[-1:] in ("'", '"', "`")),
        *(float(any(w in told for w in words)) for words in CONTEXT.values()),
    ]


def examples(n: int, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Kinds, features and truth of generated spans."""
    draw = random.Random(seed)
    digit = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    words = lambda: " ".join("".join(draw.choice(("an", "er", "th", "ou", "la", "qe", "is")) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(2, 6)))

    def card(k: int, ok: bool) -> str:
        body = draw.choice(("34", "37", "36", "4", "5")) + digit(k - 3)
        body = body[: k - 1]
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if ok else str((int(check) + draw.randint(1, 9)) % 10))

    def iban() -> str:
        body = digit(draw.randint(12, 20))
        country = draw.choice(("DE", "FR", "ES", "NL", "AT"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{check:02d}{body}"

    def cue(kind: str) -> str:
        return draw.choice(CONTEXT[kind]) + draw.choice((": ", " = ", " ", ' = "', " is "))

    def made() -> tuple[str, str, str, bool]:
        """kind, text before, span, whether it is personal."""
        r = draw.randrange(16)
        if r == 0:
            return "secret", cue("secret"), hexed(draw.choice((32, 40, 64))), True
        if r == 1:
            return "secret", cue("secret"), mixed(draw.randint(20, 48)), True
        if r == 2:
            return "phone", cue("phone"), draw.choice(("{}-{}-{}", "({}) {}-{}", "{} {} {}", "{}.{}.{}")).format(digit(3), digit(3), digit(4)), True
        if r == 3:
            return "card", cue("card"), card(draw.choice((14, 15)), True), True
        if r == 4:
            number = iban()
            return "iban", draw.choice((cue("iban"), words() + " ")), draw.choice((number, " ".join(number[i : i + 4] for i in range(0, len(number), 4)))), True
        if r == 5:
            return "national_id", cue("national_id"), f"{digit(3)}-{digit(2)}-{digit(4)}", True
        if r == 6:
            return "secret", draw.choice((cue("plain"), words() + " ")), draw.choice((hexed(40), digit(draw.randint(16, 24)), mixed(draw.randint(16, 40)))), False
        if r == 7:
            return "secret", draw.choice((cue("secret"), words() + " ")), "-".join(words().split())[:30] + digit(draw.randint(1, 2)), False
        if r == 8:
            return "phone", draw.choice((cue("plain"), words() + " ")), draw.choice((digit(draw.randint(7, 15)), f"{digit(4)}-{digit(2)}-{digit(2)}", f"{digit(1)}.{digit(2)}.{digit(5)}", f"{digit(4)} {digit(4)}")), False
        if r == 9:
            return "phone", words() + " ", f"{digit(3)}.{digit(3)}.{digit(3)}", False
        if r == 10:
            return "card", draw.choice((cue("card"), words() + " ")), card(draw.randint(13, 19), False), False
        if r == 11:
            return "card", draw.choice((cue("plain"), words() + " ")), card(draw.choice((13, 14, 15)), True), False
        if r == 12:
            return "iban", draw.choice((cue("iban"), words() + " ")), draw.choice(("DE", "ab", "No")) + digit(draw.randint(14, 20)), False
        if r == 13:
            return "national_id", draw.choice((cue("plain"), words() + " ")), draw.choice((digit(9), f"{digit(4)}-{digit(5)}", f"{digit(3)}-{digit(2)}-{digit(4)}")), False
        if r == 14:
            return "phone", cue("phone"), draw.choice((digit(7)[:4] + "." + digit(3), f"{digit(1)} {digit(1)} {digit(5)}")), False
        return "secret", words() + " ", "/".join(words().split()) + "/" + digit(4), False

    kinds, rows, truth = [], [], []
    for _ in range(n):
        kind, before, body, yes = made()
        opening = words() + " " + before
        text = opening + body + draw.choice(("", '"' if before.endswith('"') else "", ".", " " + words()))
        kinds.append(kind)
        rows.append(features(text, kind, len(opening), len(opening) + len(body)))
        truth.append(yes)
    return kinds, np.array(rows), np.array(truth)


def train(n: int = EXAMPLES, precision: float = PRECISION, seed: int = 42) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold."""
    kinds, x, y = examples(n, seed)
    half = n // 2
    model = BoostedTrees(rounds=24).fit(x[:half], y[:half])
    scores, held = model.scores(x[half:]), np.array(kinds[half:])
    return model, {k: calibrated_threshold(scores[held == k], y[half:][held == k], precision) for k in sorted(set(kinds))}


_trained: dict[tuple, tuple] = {}


def trained(n: int = EXAMPLES, precision: float = PRECISION) -> tuple[BoostedTrees, dict[str, float]]:
    if (n, precision) not in _trained:
        _trained[n, precision] = train(n, precision)
    return _trained[n, precision]


def spans_of(text: str | None, model: BoostedTrees, thresholds: dict[str, float]) -> tuple[list, list]:
    """Base spans, and base and added spans; each by kind and start."""
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    free = Free((a, b) for _, a, b in base)
    proposed = [c for c in candidates(text) if free.holds(*c[1:])]
    added: list[tuple[str, int, int]] = []
    if proposed:
        scores = np.concatenate([model.scores(np.array([features(text, *c) for c in proposed[at : at + 4096]])) for at in range(0, len(proposed), 4096)])
        good = sorted((-s, c) for s, c in zip(scores.tolist(), proposed, strict=True) if s >= thresholds.get(c[0], 1.01))
        own = Free()
        for _, c in good:
            if own.holds(*c[1:]):
                own.take(*c[1:])
                added.append(c)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class Free:
    """What no span has taken yet; taken spans that touch or overlap become one."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a

    def take(self, a: int, b: int) -> None:
        """A span that the free part holds."""
        k = bisect_left(self.starts, b)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """-> id, ``base`` and ``spans``: arrays of kind, start, end (code points)."""
    ship_package(docs.sparkSession)
    model, thresholds = trained(precision=precision)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("base", SPAN), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py(), model, thresholds) for t in batch.column("text")]
            as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            columns = [pa.array([as_dicts(f[i]) for f in found], _ARROW_SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans
    of different kinds become one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """All columns of ``docs``, personal data in the text replaced; null stays null."""
    ship_package(docs.sparkSession)
    model, thresholds = trained(precision=precision)

    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()  # of what the stages before left in this worker
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield batch[at : at + 256].map(lambda t: redacted(t, spans_of(t, model, thresholds)[1]) if t else t)

    # texts that can't hold a span needn't leave the JVM
    text = F.col(text_col)
    return docs.withColumn(text_col, F.coalesce(clean(F.when(text.rlike(HINT.pattern), text)), text))


def span_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
