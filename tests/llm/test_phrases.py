"""Phrase collocations against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from quarrylight.llm import phrases
from quarrylight.llm.phrases import candidates, collocations, counted, tokens_of

SCHEMA = "doc_id long, text string, lang string, size long, phrase string, n long, slot string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(texts, least, most):
    """The contract, phrase by phrase."""
    counts, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    inside = {}
    for (lang, *words), f in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, *words[i : i + k])
                inside[key] = max(inside.get(key, 0), f)
    out = {}
    for phrase, a in often.items():
        lang, *words = phrase
        if len(words) < 2 or 100 * inside.get(phrase, 0) >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (often[(lang, *words[:k])] * often[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), often[(lang, *words[:k])], often[(lang, *words[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1))


def frame(spark, texts, parts=5):
    data = [(i % 7 or None, t, lang, 1, "x", 2, "y") for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def made(seed, documents=150):
    """Texts over few words, so that phrases of all lengths repeat; signs, line ends and
    white space of every kind, null and empty texts, one language of most rows."""
    draw = random.Random(seed)
    pool = ["a", "A", "bee", "Bee", "İ", "ß", "naïve", "x y", "\x1c", "\x85", "1"]
    gap = [" ", " ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", "\r", "!?"]
    texts = [("".join(draw.choice(pool) + draw.choice(gap) for _ in range(draw.randint(0, 60))), draw.choice(["en", "en", "en", "de", None])) for _ in range(documents)]
    return [*texts, (None, "en"), ("", None), (" \n", "de"), ("bee a bee a " * 300, "en"), ("once only here", "xx"), *texts[:3]]


@pytest.mark.parametrize("least,most", [(3, 2000), (12, 4), (1, 50)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, least, most, seed):
    texts = made(seed)
    got = collocations(frame(spark, texts), least=least, most=most)
    assert got.columns == list(COLUMNS)
    assert rows(got, *COLUMNS) == rows_of(brute(texts, least, most))


def rows_of(data):
    return sorted(data, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def test_small_chunks_and_a_full_map(spark, monkeypatch):
    """Chunks of one text, a vocabulary that starts anew, and a map in which all phrases
    meet: more is counted, the result is the same."""
    texts = made(3, 60)
    want = rows_of(brute(texts, 5, 2000))
    monkeypatch.setattr(phrases, "candidates", lambda docs, **_: phrases.np.full(1 << phrases.BITS >> 3, 255, phrases.np.uint8))
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1)
    monkeypatch.setattr(phrases, "SPLIT_BYTES", 1)
    monkeypatch.setattr(phrases, "WORDS", 1)
    assert rows(collocations(frame(spark, texts), least=5), *COLUMNS) == want


def test_shards_mine_what_is_frequent_in_one(spark):
    """A phrase whose occurrences lie in one shard alone, and one that lies in all."""
    texts = [("one two. " * 12 if i == 17 else "all over. filler words go here", "en") for i in range(40)]
    docs = frame(spark, texts, 8)
    known = candidates(docs, least=12)
    found = {r.phrase: r.f for r in counted(docs, known, least=12).collect()}
    assert found["one two"] == 12 and found["all over"] == 39
    assert rows(collocations(docs, least=12), *COLUMNS) == rows_of(brute(texts, 12, 2000))


def test_many_small_shards_in_a_task(spark, monkeypatch):
    """Shards of one text or two, vocabularies that start anew, and whole tasks as one."""
    texts = made(4)
    want = rows_of(brute(texts, 6, 2000))
    for shard, words in ((1, 1), (1, 1 << 20), (1500, 5)):
        monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
        monkeypatch.setattr(phrases, "WORDS", words)
        monkeypatch.setattr(phrases, "PART", words)
        assert rows(collocations(frame(spark, texts, 2), least=6), *COLUMNS) == want


def test_candidates_are_few(spark, monkeypatch):
    """Phrases that one shard alone holds, too rarely for all of them, are not counted."""
    docs = frame(spark, [(f"one{i} two{i} three{i}. " * 5, "en") for i in range(40)] + [("these are all over", "en")] * 40, 8)
    known = candidates(docs, least=40)
    assert sum(int(b).bit_count() for b in known if b) == 10  # the parts of four words
    assert {r.phrase for r in counted(docs, known, least=40).collect()} >= {"these are all over", "are all", ""}


def test_one_hot_pair_and_products_beyond_64_bits(spark):
    """A third of all rows repeat one pair; the parts' product passes 64 bits."""
    texts = [("hot pair", "en")] * 50 + [("cold", "en")] * 100
    docs = frame(spark, texts)
    assert rows(collocations(docs, least=50), *COLUMNS) == [("en", 1, "hot pair", 50, 50, 50, 200, 4000)]
    huge = spark.createDataFrame([("en", "", 4 * 10**15), ("en", "a", 3 * 10**12), ("en", "b", 2 * 10**12), ("en", "a b", 10**12)], "lang string, phrase string, f long")
    real = phrases.counted
    try:
        phrases.counted = lambda *_, **__: huge
        (row,) = collocations(docs, least=50).collect()
    finally:
        phrases.counted = real
    assert row.score == 1000 * 10**12 * 4 * 10**15 // (6 * 10**24)


def test_no_rows_and_no_words(spark):
    assert collocations(frame(spark, made(1)).limit(0)).count() == 0
    assert collocations(frame(spark, [(None, None), ("", "en"), ("...", "en")]), least=1).count() == 0


def test_hashes_of_tokens(monkeypatch):
    """Equal words have equal hashes wherever they stand; stops are 0; cuts change nothing."""
    texts = [b"One two\tTWO, three  . a\x1cb", b"", b"one" * 50 + b" end", " ß ".encode() * 40]
    tokens, hashes = tokens_of(texts), phrases.token_hashes(phrases.folded(texts))
    assert len(tokens) == len(hashes)
    assert {(t == b".", int(h) == 0) for t, h in zip(tokens, hashes, strict=True)} == {(True, True), (False, False)}
    assert len(set(zip(tokens, hashes.tolist(), strict=True))) == len(set(tokens)) == len(set(hashes.tolist()))
    monkeypatch.setattr(phrases, "SPLIT_BYTES", 4)
    parts = list(phrases._split_at_blanks(phrases.folded(texts)))
    assert len(parts) > 3 and b"".join(parts) == phrases.folded(texts)
    assert phrases.np.concatenate(list(map(phrases.token_hashes, parts))).tolist() == hashes.tolist()
    assert phrases.token_hashes(b"").tolist() == []
    words = phrases.Vocabulary()
    numbers = words.numbers(tokens)
    assert words.hashes[numbers].tolist() == hashes.tolist()


def test_tokens():
    text = "AÄ b.c\td\x0ce f\x1cg"
    assert b" ".join(tokens_of([text.encode(), b"h"])).decode() == "aÄ b . c d . e f\x1cg . h"


def test_words_are_hashed_in_small_parts():
    """A worker keeps the powers that its largest part needs: parts are small, cut no word,
    and hash as the whole does."""
    draw = np.random.default_rng(3)
    data = b" ".join(b"w%d" % n + b" ." * (n % 7 == 0) for n in draw.integers(0, 5000, 200_000).tolist())
    parts = list(phrases._split_at_blanks(data))
    assert b"".join(parts) == data and max(map(len, parts)) <= 1 << 19
    assert np.array_equal(np.concatenate([phrases.token_hashes(p) for p in parts]), phrases.token_hashes(data))
