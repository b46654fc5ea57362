"""Quality rules: base rules and a learned decision list, as Spark expressions.

Sequential covering learns the list from labelled documents.  A rule is grown
condition by condition (statistic at most / above a threshold) by the information
gained on rejects, pruned to the prefix that does best on rows set aside, and the
rows that it covers are taken out before the next rule grows.  A rule must hold
:data:`PRECISION` of what it rejects on the rows set aside, or learning ends.  Every
count comes from a grouped aggregation over the labelled statistics; the driver sees
a few hundred counts a step.  The list becomes one ordered conditional expression.

Everything is DataFrame functions; the only broadcast is the sample of labelled ids
that the rules are learned from, at most :data:`LABELLED` rows.

Defined results: a null, empty or blank text has no words and fails the base rules;
repeated rows get equal results; without labels of both kinds the list is empty and
the base rules decide alone; rows that share a labelled id count as one when rules are
learned; other columns are kept by :func:`apply_rules`, whose statistics, ``base_failed``,
``rule`` and ``kept`` replace columns of those names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import words_of, written

#: Labelled rows that rules are learned from, at most.
LABELLED = 20_000
#: Rules in a list, conditions in a rule, thresholds tried for a statistic.
RULES, CONDITIONS, STEPS = 8, 3, 24
#: Share of rejects among the rows, set aside, that a rule covers.
PRECISION = 0.95
#: The same share, had the rule covered three more rows wrongly: rules need support.
SURE = 0.75
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: What the rules may look at: name -> expression over the statistics.
RATIOS = {
    "symbol_ratio": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "shout_ratio": lambda: F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    "mark_ratio": lambda: F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)),
    "repeat_ratio": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_ratio": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "distinct_ratio": lambda: F.col("n_distinct_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "word_length": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "line_words": lambda: F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    "words": lambda: F.col("n_words").cast("double"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair_hashes(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on."""
    return _let(hashes, lambda h: F.when(F.size(h) <= gap, F.slice(h, 1, 0)).otherwise(F.transform(F.slice(h, 1, F.size(h) - gap), lambda x, i: F.xxhash64(x, F.get(h, i + gap)))))


def _repeated(windows: Column) -> Column:
    """Words in windows (given by hash, in order) that occur twice or more."""

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        step = lambda total, k: total + F.when(k == last, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(places, k + 1) - F.get(places, k)))
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), step)

    def twice(ranked: Column) -> Column:
        h = lambda k: F.get(ranked, k)["h"]
        same = lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), same)
        return _let(F.sort_array(F.transform(places, lambda k: F.get(ranked, k)["i"])), covered)

    def whole(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ranked, twice))

    return _let(windows, whole)


def _word_statistics(words: Column) -> Column:
    def by_hash(w: Column, h: Column) -> Column:
        windows = _pair_hashes(_pair_hashes(_pair_hashes(h, 1), 2), 4)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"),
            _repeated(windows).cast("long").alias("n_repeat_words"),
        )

    return _let(words, lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: by_hash(w, h)))


def _line_statistics(text: Column) -> Column:
    wordy = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(wordy, lambda x: F.xxhash64(x))
    return _let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_lines"), (F.size(h) - F.size(F.array_distinct(h))).cast("long").alias("n_dup_lines")))


def _only(text: Column, kept: str) -> Column:
    """Number of characters of a class."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


STATISTICS = ("n_words", "word_chars", "n_distinct_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_capitals", "n_marks")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of whole texts as columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop(*(c for c in STATISTICS if c in docs.columns))
    words, lines = (next(n for n in (kind + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for kind in ("words_of_", "lines_of_"))
    docs = docs.withColumns({words: _word_statistics(words_of(F.col(text_col))), lines: _line_statistics(text)})
    columns = {c: F.col(words)[c] for c in STATISTICS[:4]} | {c: F.col(lines)[c] for c in STATISTICS[4:6]}
    columns |= {"n_symbols": _only(text, SYMBOLS), "n_capitals": _only(text, r"\p{Lu}"), "n_marks": _only(text, "!?")}
    return docs.withColumns(columns).drop(words, lines)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = RATIOS[self.name]()
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def decision(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that rejects a row; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        out = out.when(_all(rule), F.lit(number))
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most: int = LABELLED) -> DataFrame:
    """Statistics of at most ``most`` labelled documents, chosen by the hash of their
    id; written to the shared folder.  Of rows that share an id the one with the least
    statistics stands for all, so that ``most`` bounds the rows, too."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 0).cast("int").alias("_reject"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # the bound of the broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = with_statistics(rows, "_text").groupBy("_id", "_reject").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("_id", "_reject", "s.*")
    return written(rows.withColumn("_aside", F.pmod(F.xxhash64("_id", F.lit("aside")), F.lit(3)) == 0), "labelled").coalesce(4)


def learn(rows: DataFrame, *, most_rules: int = RULES, precision: float = PRECISION, sure: float = SURE) -> list[list[Condition]]:
    """Sequential covering over labelled statistics that pass the base rules."""
    names = list(RATIOS)
    rows = rows.filter(~base_failed()).select("_reject", "_aside", *(make().alias(n) for n, make in RATIOS.items()))
    rows = written(rows, "learning").coalesce(4)
    shares = [k / STEPS for k in range(STEPS)]

    def thresholds(left: DataFrame) -> dict[str, list[float]]:
        """Quantiles of all rows and of the rejects: few rejects lie in a tail."""
        of = lambda n, when: F.percentile_approx(F.when(when, F.col(n)), shares)
        edges = left.filter("not _aside").agg(*(of(n, w).alias(f"{n}{i}") for n in names for i, w in enumerate((F.lit(True), F.col("_reject") == 1)))).first()
        return {n: sorted({*(edges[f"{n}0"] or []), *(edges[f"{n}1"] or [])}) for n in names}

    def matches(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & ((F.col(c.name) > c.threshold) if c.above else (F.col(c.name) <= c.threshold))
        return out

    def grown(left: DataFrame) -> list[Condition]:
        rule: list[Condition] = []
        cuts = thresholds(left)
        # a value that equals a threshold lies below it
        bins = {n: sum(((F.col(n) > c).cast("int") for c in cuts[n]), F.lit(0)) for n in names}
        while len(rule) < CONDITIONS:
            inside = left.filter(~F.col("_aside") & matches(rule))
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), bins[n].alias("bin")) for n in names)))
            counts = inside.select("_reject", each.alias("e")).groupBy("e.name", "e.bin").agg(F.count("*").alias("n"), F.sum("_reject").alias("p")).collect()
            best = (0.0, None)
            for name in names:
                own = {r.bin: (r.p, r.n - r.p) for r in counts if r.name == name}
                total = [sum(x[i] for x in own.values()) for i in (0, 1)]
                if not total[0] or not total[1]:
                    continue
                start = math.log2(total[0] / sum(total))
                low = [0, 0]
                for k, cut in enumerate(cuts[name]):
                    low = [low[i] + own.get(k, (0, 0))[i] for i in (0, 1)]
                    for above, (p, n) in ((False, low), (True, [total[i] - low[i] for i in (0, 1)])):
                        if p and (gain := p * (math.log2(p / (p + n)) - start)) > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def centred(left: DataFrame, rule: list[Condition]) -> list[Condition]:
        """Each threshold halfway between the values nearest to it on either side."""
        near = left.agg(*(f(F.when(side, F.col(c.name))).alias(f"{e}{k}") for k, c in enumerate(rule) for e, f, side in (("low", F.max, F.col(c.name) <= c.threshold), ("high", F.min, F.col(c.name) > c.threshold)))).first()
        return [c if near[f"low{k}"] is None or near[f"high{k}"] is None else Condition(c.name, c.above, (near[f"low{k}"] + near[f"high{k}"]) / 2) for k, c in enumerate(rule)]

    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < most_rules:
        rule = grown(left)
        if not rule:
            break
        prefixes = [matches(rule[: k + 1]) for k in range(len(rule))]
        aside = left.filter("_aside").agg(*(F.sum(F.when(m, v)).alias(f"{s}{k}") for k, m in enumerate(prefixes) for s, v in (("p", F.col("_reject")), ("n", 1 - F.col("_reject"))))).first()
        worth = [((aside[f"p{k}"] or 0), (aside[f"n{k}"] or 0)) for k in range(len(rule))]
        scores = [(p - n) / (p + n) if p + n else -1.0 for p, n in worth]
        keep = scores.index(max(scores))
        p, n = worth[keep]
        # three more wrong rows could have been seen with some luck
        if not p or p < precision * (p + n) or p < sure * (p + n + 3):
            break
        rules.append(centred(left, rule[: keep + 1]))
        left = left.filter(~matches(rules[-1]))
    return rules


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (number of the rule that
    rejects, or null) and ``kept``."""
    rules = learn(labelled_statistics(docs, labels, id_col=id_col, text_col=text_col))
    judged = with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
