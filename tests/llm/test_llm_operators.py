"""Each operator on null, empty, repeated and clashing rows, and against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "A", "word " * 3000, "Ünïcode ß İ Σ <|endoftext|> 日本 \x1c", "same text here", "same text here", "a\n\nb\r\nc", "x" * 5000]


def path():
    from quarrylight.llm.queries import tokenizer_path

    return tokenizer_path()


def documents(spark, texts=ODD, schema=DOCS + ", node long, kept string, start string, size string"):
    data = [(i, t, "en", None if i % 3 == 0 else f"src{i % 2}", None, 1, "k", "s", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(data + data[-1:], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_codec_matches_the_library():
    import random

    from tokenizers import Tokenizer

    from quarrylight.llm.bpe import ForcedBoundaryCodec

    own, library = ForcedBoundaryCodec(path()), Tokenizer.from_file(path())
    draw = random.Random(1)
    pool = "aA bB\t\n\x1c\x85\xa0 ßÄé́İΣσ日語¼!?#%'sS'llͅ​﻿😀\x00"
    cases = [*filter(None, ODD), *("".join(draw.choice(pool) for _ in range(draw.randint(0, 14))) for _ in range(2000)), "qxqz" * 50]
    for text in cases:
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert any(len(own.fragments(w)) > 1 for w in ("qxq", "jqx"))


def test_encoding_of_odd_rows(spark):
    from quarrylight.llm.queries import encode_documents

    got = encode_documents(documents(spark), path())
    assert got.columns == ["doc_id", "ids", "decoded"] and got.count() == len(ODD) + 1
    empty = {r.doc_id: (bytes(r.ids), r.decoded) for r in got.filter("doc_id < 3").collect()}
    assert set(empty.values()) == {(b"", "")}
    assert encode_documents(documents(spark).limit(0), path()).count() == 0


def packed_well(pieces, capacity, docs):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 <= capacity
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for own in by_doc.values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == own[0].doc_tokens
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    assert set(by_doc) == set(docs)
    return sum(capacity for _ in by_sequence) / max(1, sum(p.length for p in pieces))


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    from quarrylight.llm.packing import pack_documents

    library = Tokenizer.from_file(path())
    for capacity, group in ((4096, 128), (256, 8)):
        pieces = pack_documents(docs, path(), capacity=capacity, group=group).collect()
        assert packed_well(pieces, capacity, texts) < 1.15
        joined = defaultdict(bytes)
        for p in sorted(pieces, key=lambda p: p.start):
            joined[p.doc_id] += bytes(p.ids)
        for i in list(texts)[:40]:
            assert np.frombuffer(joined[i], "<u4").tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 2]


def test_packing_of_odd_rows(spark):
    from quarrylight.llm.packing import pack_documents

    odd = documents(spark).filter(f"doc_id < {len(ODD) - 1}")
    pieces = pack_documents(odd, path(), capacity=64).collect()
    packed_well(pieces, 64, range(len(ODD) - 1))
    assert {bytes(p.ids) for p in pieces if p.doc_id < 3} == {(2).to_bytes(4, "little")}
    assert pack_documents(odd.limit(0), path()).count() == 0


def test_differencing():
    from quarrylight.llm.packing import difference, pack_sizes

    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in difference(sizes, 2)) in ([14, 16], [15, 15])
    # three pieces of which no two fit together: the window count rises from two
    assert len(pack_sizes([6, 6, 6], 10)) == 3
    assert pack_sizes([], 10) == []


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return find


@pytest.mark.parametrize("crowd", [1, 32])
def test_simhash_against_brute_force(spark, docs, texts, crowd):
    from quarrylight.llm.simhash import simhash_components

    base = list(texts.values())[:60]
    near = [" ".join(w if k != j else "changed" for k, w in enumerate(t.split())) for t in base[:12] for j in (3, 7)]
    all_texts = [*ODD, *base, *near, "Alpha beta gamma", "alpha BETA gamma"]
    prints = {i: slow_fingerprint(t) for i, t in enumerate(all_texts)}
    find = brute_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    frame = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(frame, crowd=crowd).collect()}
    assert got == {i: (f"{p:016x}", least[find(p)]) for i, p in prints.items()}
    assert len(set(least.values())) < len(set(prints.values()))


@pytest.mark.parametrize("crowd", [1, 32])
def test_links_of_planted_fingerprints(spark, crowd):
    from quarrylight.llm.simhash import components, links

    draw = np.random.default_rng(5)
    centres = draw.integers(-(2**63), 2**63 - 1, 6)
    prints = set()
    for c in centres.tolist():
        for _ in range(60):
            flips = draw.choice(64, draw.integers(0, 5), replace=False)
            prints.add((c & (2**64 - 1)) ^ sum(1 << int(b) for b in flips))
    find = brute_components(prints)
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    roots = {r.node: r.root for r in components(links(frame, crowd=crowd)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[roots.get(signed(p), signed(p))].add(p)
        want[find(p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_null_ids_and_no_rows(spark):
    from quarrylight.llm.simhash import near_copies, simhash_components

    frame = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "other words altogether")], "doc_id long, text string")
    assert rows(simhash_components(frame), "doc_id", "component_id") == [(5, 5), (None, 5), (None, None)]
    assert simhash_components(frame.limit(0)).count() == 0
    assert near_copies(frame.limit(0)).count() == 0


def test_near_copies(spark, texts):
    from quarrylight.llm.simhash import near_copies

    long = [t for t in texts.values() if len(t.split()) > 200][:20]
    copies = [" ".join("edited" if k % 150 == 149 else w for k, w in enumerate(t.split())) for t in long]
    frame = spark.createDataFrame(list(enumerate([*long, *copies, *long[:3]])), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_copies(frame).collect()}
    alike = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())))
    sure = [i for i in range(20) if alike(long[i], copies[i]) >= 0.9]
    assert sum(got[20 + i] == got[i] for i in sure) >= 0.9 * len(sure)
    assert all(got[40 + i] == got[i] for i in range(3))
    firsts = [i for i in range(20) if all(alike(long[i], long[j]) < 0.3 for j in range(20) if j != i)]
    assert len({got[i] for i in firsts}) == len(firsts)


def five_word_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(texts, least=0.8):
    """The smallest number of each text's group, by all pairs."""
    sets, group = [five_word_sets(t) for t in texts], np.arange(len(texts))
    place = {s: k for k, s in enumerate(set().union(*sets))}
    has = np.zeros((len(texts), len(place)), np.float32)
    for i, own in enumerate(sets):
        has[i, [place[s] for s in own]] = 1
    common, sizes = has @ has.T, has.sum(axis=1)
    for i, j in np.argwhere(common >= least * (sizes[:, None] + sizes - common) - 1e-3):
        if group[i] != group[j]:
            group[group == max(group[i], group[j])] = min(group[i], group[j])
    return group.tolist()


def edited(words, edits, draw):
    out = list(words)
    for k in draw.choice(len(words), edits, replace=False):
        out[k] = f"edit{draw.integers(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("crowd", [1, 8])
def test_near_copies_link_at_the_threshold_and_not_below(spark, crowd):
    from quarrylight.llm.simhash import near_copies

    draw = np.random.default_rng(7)
    texts = []
    for _ in range(12):  # four and five edits of 204 words: pairs on both sides of 0.8
        words = [f"w{n}" for n in draw.integers(0, 10**6, 204)]
        texts += [" ".join(words), *(edited(words, e, draw) for e in (3, 4, 4, 5, 6))]
    # 200 shingles each, of which 22 and 23 differ: 178 / 222 and 177 / 223 in common
    words = [f"x{n}" for n in range(204)]
    texts += [" ".join(words), " ".join(words[:182] + [f"y{n}" for n in range(22)]), " ".join([f"z{n}" for n in range(23)] + words[23:])]
    got = {r.doc_id: r.group_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()}
    want = dict(enumerate(brute_groups(texts)))
    assert got == want and len(set(want.values())) > 12
    assert got[73] == got[72] and got[74] == 74


def test_near_copies_of_a_large_group(spark):
    from quarrylight.llm.simhash import near_copies

    draw = np.random.default_rng(3)
    words = [f"w{n}" for n in range(304)]
    texts = [" ".join(words)] + [edited(words, int(e), draw) for e in draw.integers(4, 8, 1200)]
    order = draw.permutation(len(texts))
    texts = [texts[k] for k in order]
    got = [r.group_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == brute_groups(texts)


def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        ranked = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def test_cover_tree_search(spark):
    from quarrylight.llm import cover_tree

    draw = np.random.default_rng(3)
    data = {i: (draw.integers(-40, 40, 8) + 200 * (i % 4 == 0)).tolist() for i in range(700)}
    data |= {1000 + i: data[8] for i in range(40)}
    frame = spark.createDataFrame([*data.items(), *list(data.items())[:5]], "vec_id long, v array<long>")
    queries = [i for i in data if i % 50 == 0 or i in (8, 1003)]
    small = {"BLOCK": 64, "GROUP": 4, "PIVOTS": 4, "SAMPLE": 32}
    with pytest.MonkeyPatch.context() as patch:
        for name, value in small.items():
            patch.setattr(cover_tree, name, value)
        got = cover_tree.top_k(frame, frame.filter(F.col("vec_id").isin(queries)), k=5)
        assert rows(got) == brute_top(data, queries, 5)


def test_cover_tree_gives_up_far_balls(spark):
    """Bounds hold for every row of a ball, and clusters that point elsewhere are given
    up before any row is copied to meet their queries; results are those of brute force."""
    from quarrylight.llm import cover_tree

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (12, 16))
    vectors = np.rint(np.repeat(centres, 60, axis=0) + rng.normal(0, 12, (720, 16))).astype(int)
    away = np.array([np.sqrt(((vectors[i * 60 : i * 60 + 60] - centres[i]) ** 2).sum(axis=1)).max() for i in range(12)])
    longest = np.array([np.sqrt((vectors[i * 60 : i * 60 + 60] ** 2).sum(axis=1)).max() for i in range(12)])
    most = cover_tree._most(vectors.astype(float), centres, away, longest)
    assert ((vectors @ vectors.T).reshape(720, 12, 60).max(axis=2) <= most).all()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<long>")
    seen, real = [], cover_tree.written

    def spied(df, name):
        out = real(df, name)
        seen.extend([out.count()] if name == "topk-meetings" else [])
        return out

    with pytest.MonkeyPatch.context() as patch:
        for name, value in {"BLOCK": 60, "GROUP": 60, "PIVOTS": 12, "written": spied}.items():
            patch.setattr(cover_tree, name, value)
        got = rows(cover_tree.top_k(frame, frame, k=5))
    scores = vectors @ vectors.T
    want = [(q, n, int(i), int(scores[q, i])) for q in range(720) for n, i in enumerate([i for i in np.lexsort((np.arange(720), -scores[q])) if i != q][:5], 1)]
    assert got == sorted(want)
    assert seen[0] < 12 * 12 / 3


def test_cover_tree_prunes_and_covers():
    from quarrylight.llm.cover_tree import DualTree, cover_tree

    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(c, 1, (300, 6)) for c in (-60, 0, 60)]) * 10
    stack = [cover_tree(points)]
    while stack:
        node = stack.pop()
        assert np.sqrt(((points[node.points] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
            stack += node.children
    whole = np.floor(points).astype(np.int64)
    search = DualTree(whole[600:650], np.arange(600, 650), np.full(50, -np.inf), whole, np.arange(900), 5)
    search.run()
    assert search.visited < 50 * 900 / 2


def test_search_of_odd_rows(spark):
    from quarrylight.llm.cover_tree import quantised, top_k

    nan, inf = float("nan"), float("inf")
    raw = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.25, -0.001]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1e17, 1e17]), (9, [1e17, -1e17])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in raw], "vec_id long, e array<double>, id string, block int").select("*", quantised(F.col("e")).alias("v"))
    a, b, c, d = [256, 128], [64, -1], [256 * 10**17] * 2, [256 * 10**17, -256 * 10**17]
    small = frame.filter("vec_id < 8")
    assert rows(top_k(small, small.filter("vec_id = 0"))) == [(0, 1, 6, 256 * 64 - 128)]
    assert top_k(small.limit(0), small).count() == 0
    # the large ones as well: exact integers, ends of the range beyond it
    held = {0: a, 6: b, 8: [2**63 - 1] * 2, 9: [2**63 - 1, -(2**63)]}
    assert {r.vec_id: r.v for r in frame.filter("vec_id in (0, 6, 8, 9)").collect()} == held and c[0] > held[8][0] and d[1] < held[9][1]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q, x in held.items():
        scored = sorted((-clip(x[0] * y[0] + x[1] * y[1]), i) for i, y in held.items() if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert rows(top_k(frame, frame, k=5)) == sorted(want)


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    again = {j for own in places.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(spark, docs):
    from quarrylight.llm.quality_rules import base_failed, with_statistics

    frame = docs.select("doc_id", "text").unionByName(documents(spark).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    extra = [(-100, "a b c d e f g h a b c d e f g h"), (-101, "a " * 9), (-102, "one two three four five six seven eight nine " * 2 + "x"), (-103, "😀 ok\nok\nok")]
    frame = frame.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in with_statistics(frame).withColumn("bad", base_failed()).collect():
        want = slow_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.bad == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_learned_rules(spark):
    from quarrylight.llm.quality_rules import apply_rules

    good = "plain words in a row that say something new each time " + " ".join(f"w{i}" for i in range(40))
    bad = " ".join(f"v{i}$$$" for i in range(50))
    frame = documents(spark, [f"{good} n{i}" if i % 3 else f"{bad} n{i}" for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    judged = apply_rules(frame, labels)
    assert all(r.kept == (r.doc_id % 3 > 0) for r in judged.collect())
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    # nothing to learn from: the base rules decide alone
    none = apply_rules(frame, labels.limit(0))
    assert none.filter("kept").count() == none.filter("not base_failed").count() > 0
    assert apply_rules(frame.limit(0), labels).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_line_dedup(spark, broadcast):
    from quarrylight.llm import line_dedup

    texts = [f"menu\nstory {i}\n\nfooter" if i % 2 else f"story {i}" for i in range(40)] + ["menu\ncopied"] * 30 + [None, "", "menu"]
    frame = documents(spark, texts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
        got = {r.doc_id: r for r in line_dedup.drop_boilerplate(frame, ratio=0.2, least_pages=3).collect()}
    pages, seen = defaultdict(set), defaultdict(set)
    for r in frame.collect():
        if r.text is not None:
            pages[r.source].add(r.text)
            for line in r.text.split("\n"):
                if line.strip(" \t\n\r\x0b\f"):
                    seen[r.source, line].add(r.text)
    drop = {k for k, v in seen.items() if len(v) >= 3 and len(v) > 0.2 * len(pages[k[0]])}
    assert drop
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert (r.text, r.n_lines, r.n_dropped) == (None, 0, 0)
            continue
        kept = [x for x in t.split("\n") if (r.source, x) not in drop]
        assert (r.text, r.n_dropped) == ("\n".join(kept), len(t.split("\n")) - len(kept))


def test_sharding(spark, docs, texts):
    from quarrylight.llm.sharding import feistel_shards, permute, place

    for n in (1, 2, 5, 64, 1000, 4097):
        assert sorted(permute(np.arange(n), n, 7).tolist()) == list(range(n))
    got = feistel_shards(docs, shards=7).collect()
    slots = defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert (r.shard, r.slot) == place(r.row_number, len(got), 7, 42)
        slots[r.shard].append(r.slot)
    assert sorted(r.row_number for r in got) == list(range(len(got)))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = feistel_shards(documents(spark), shards=3).collect()
    assert {r.size for r in odd if r.doc_id in (0, 1)} == {16} and len(odd) == len(ODD) + 1
    assert feistel_shards(docs.limit(0)).count() == 0


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    from quarrylight.llm.pii import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if fits[k](m.group())]


def test_base_spans_against_patterns(texts):
    import random

    from quarrylight.llm.pii import base_spans

    draw = random.Random(4)
    cases = [*texts.values(), *("".join(draw.choice("a.@-1 20+(é") for _ in range(draw.randint(0, 40))) for _ in range(4000)), "4111 1111 1111 1111", "1" * 30000, "a" * 30000 + "@b.c"]
    for text in cases:
        assert base_spans(text) == brute_spans(text) if len(text) < 20000 else base_spans(text) is not None


def test_added_spans(spark):
    from quarrylight.llm.pii import find_spans, redact

    texts = ['the token = "254a3ed195c502ef96b5857aa82e5fbcfb6b6856" there', "call phone: 212-555-0188 soon", "version 3.0 of 2024-05-01, page 12345", "mail a.b@c.example.com or 10.0.0.1", None, "", "plain words"]
    frame = documents(spark, texts)
    got = {r.doc_id: [s.kind for s in r.spans] for r in find_spans(frame).collect()}
    assert got == {0: ["secret"], 1: ["phone"], 2: [], 3: ["email", "ip"], 4: [], 5: [], 6: []}
    clean = {r.doc_id: r.text for r in redact(frame).collect()}
    assert clean[0] == 'the token = "[SECRET]" there' and clean[3] == "mail [EMAIL] or [IP]" and clean[4] is None and clean[6] == "plain words"
    assert set(redact(frame).columns) == set(frame.columns)


def test_span_model_on_unseen_examples():
    from quarrylight.llm.pii import examples, trained

    model, thresholds = trained()
    kinds, x, y = examples(1500, seed=99)
    said = np.array([s >= thresholds[k] for s, k in zip(model.scores(x), kinds, strict=True)])
    assert (said & y).sum() / said.sum() > 0.97 and (said & y).sum() / y.sum() > 0.6


def test_classifier(spark):
    from quarrylight.llm.classifier import quality_scores

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality_scores(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    ones, zeros = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones])
    assert auc > 0.9
    odd = quality_scores(documents(spark), labels.filter(~held)).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id < 3}) == 1


def message(conv, turn, role, text):
    return (conv, turn, role, text, 1, "x")


def test_tool_calls(spark):
    from quarrylight.llm.chat import embedded_calls, embedded_results, link_tool_calls

    call = '{"tool_calls":[{"id":"b","name":"add","arguments":{"y":2,"x":1},"after":["a"]},{"id":"a","name":"add","arguments":{"x":"1","z":0}},{"id":"c","name":"none","arguments":"?","after":["d"]},{"id":"d","name":"add","arguments":{"x":1,"y":2},"after":["c"]},{"id":"e","name":"add","arguments":{"x":1,"y":2},"after":["gone"]}]}'
    data = [message(1, 0, "assistant", call), message(1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'), message(1, 2, "tool", '{"tool_call_id":"a","content":"again"}'), message(1, 3, "tool", '{"tool_call_id":"zz","content":null}'), message(None, 0, "assistant", call), message(2, 0, "assistant", "{broken tool_calls"), message(2, 1, "tool", None)]
    messages = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, level int, json string")
    schemas = {"add": {"fields": {"x": "integer", "y": "integer"}, "required": ["x", "y"]}}
    linked = link_tool_calls(embedded_calls(messages), embedded_results(messages), schemas)
    got = {r.call_id: r for r in linked.filter("conv_id = 1").collect()}
    assert (got["a"].level, got["a"].n_results, got["a"].errors) == (0, 2, "missing y; unexpected z; x is not integer")
    assert (got["b"].level, got["b"].errors) == (1, "no result")
    assert got["b"].json == '{"arguments":{"x":1,"y":2},"call_id":"b","content":null,"errors":["no result"],"level":1,"name":"add"}'
    assert got["c"].level is None and "cycle" in got["c"].errors and "arguments are not an object" in got["c"].errors
    assert "missing dependency" in got["e"].errors and got["zz"].errors == "no call"
    assert linked.filter("conv_id is null").count() == 5
    assert rows(linked.filter("conv_id = 2"), "errors") == [("no identifier",)]
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_levels_of_long_chains_and_cycles(spark):
    from quarrylight.llm.chat import levels

    draw = np.random.default_rng(2)
    after = {i: [i - 1] if i % 50 and i < 200 else sorted({int(x) for x in draw.integers(0, i, 2)}) if i > 200 else [] for i in range(260)}
    want = {}
    for i, own in after.items():
        want[i] = 1 + max((want[j] for j in own), default=-1)
    after |= {300: [302], 301: [300], 302: [301], 303: [302, 5], 304: [5, 999]}
    frame = spark.createDataFrame([(1, str(i), list(map(str, own))) for i, own in after.items()], "conv_id long, call_id string, after array<string>")
    got = {int(r.call_id): r.level for r in levels(frame).collect()}
    assert got == want | {300: None, 301: None, 302: None, 303: None, 304: want[5] + 1}


def test_conversations_have_each_turn_once(spark):
    from quarrylight.llm.chat import format_conversations

    messages = spark.read.parquet(f"{SF}/conversations.parquet")
    got = format_conversations(messages)
    asked = messages.filter("role = 'user'").count()
    assert got.filter("n_calls = 1").count() == asked
    assert format_conversations(messages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    odd = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(ODD)], DOCS)
    for name in ("line dedup", "simhash near-dedup", "personal data"):
        got = stages[name](spark, odd, SF)
        assert got.columns == odd.columns
        assert got.count() == (len(ODD) if name != "simhash near-dedup" else len({tuple((t or "").split()) for t in ODD}))
    counts = Counter(r.doc_id for r in stages["packing"](spark, odd, SF).collect())
    assert set(counts) == set(range(len(ODD))) and math.isfinite(sum(counts.values()))


CLASHES = ("_drop", "_w", "_l", "_host", "_lines", "_kept", "_hash", "_salt", "_row", "row", "host", "hash", "key", "drop", "lines", "kept", "salt", "line", "page", "rule", "n_words", "n_lines", "n_dropped", "base_failed", "words_of_", "node", "text_col", "n", "score", "a.b")


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_stages_keep_columns_of_any_name(spark, docs, broadcast):
    """Columns named as the stages' own helpers come out as they went in."""
    import corpus_pipeline
    from quarrylight.llm import line_dedup

    own = docs.limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, own, SF)
            assert got.columns == own.columns, name
            found = got.collect()
            assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHES), name
    assert dict(corpus_pipeline.STAGES)["packing"](spark, own, SF).count() >= 60


def test_shared_labelled_ids_are_bounded(spark):
    """One labelled id holds half of all rows: one row of it is learned from."""
    from quarrylight.llm import classifier, quality_rules

    frame = documents(spark, [f"text number {i} of many words" for i in range(20)])
    many = frame.unionByName(spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.format_string("copy %d of it", F.col("id")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in frame.dtypes[2:])))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality_rules.labelled_statistics(many, labels, most=5).count() <= 5
    assert quality_rules.labelled_statistics(many, labels).count() == 20
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(classifier, "fit", lambda x, y: seen.append(len(y)))
        classifier.train(many, labels, np.ones((classifier.BUCKETS, classifier.DIMS), np.float32))
        classifier.train(many, labels, np.ones((classifier.BUCKETS, classifier.DIMS), np.float32), most=2)
    assert seen[0] == 20 and seen[1] <= 2


def test_near_dedup_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{n}" for n in range(60)) for x in "ab")
    found = [(None, a, "en", "s", 1), (None, a, "en", "t", 1), (None, b, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (7, "quite another text", "en", "s", 1), (8, b + " more", "en", "s", 1)]
    kept = rows(dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, spark.createDataFrame(found, DOCS), SF), "doc_id", "text")
    assert kept == [(7, b), (7, "quite another text"), (None, a)]


def test_oracles(spark):
    from pathlib import Path

    import duckdb

    from quarrylight.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert len(QUERIES) == 13
    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_spans_of_extreme_texts():
    """Long runs of zeros, and many numbers in linear time."""
    import time

    from quarrylight.llm.pii import Free, base_spans, spans_of, trained

    model, thresholds = trained()
    assert base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert base_spans("0" * 5000 + "256.2.3.4 1.2.3.256") == []
    took = []
    for n in (2000, 20000):
        begun = time.time()
        base, spans = spans_of(" ".join(f"{i % 200}.2.3.4 {10**7 + 7 * i}" for i in range(n)), model, thresholds)
        took.append(time.time() - begun)
        assert len(base) == n and len(spans) >= n
    assert took[1] < 40 * took[0] + 1
    free = Free([(3, 5), (4, 9), (20, 22)])
    assert [free.holds(*s) for s in ((0, 3), (0, 4), (8, 10), (9, 20), (21, 30), (22, 30))] == [True, False, False, True, False, True]
    free.take(9, 20)
    assert not free.holds(15, 16)


def test_grouped_account_numbers():
    from quarrylight.llm.pii import candidates, features

    text = "pay to DE89 3704 0044 0532 0130 00 now"
    found = [c for c in candidates(text) if c[0] == "iban"]
    assert ("iban", 7, 34) in found and features(text, "iban", 7, 34)[14] == 1.0


def test_differencing_balances_as_well_as_the_dense_form():
    from quarrylight.llm.packing import difference

    draw = np.random.default_rng(11)
    for windows in (1, 2, 5, 16):
        for n in (0, 1, 3, 40, 200):
            sizes = draw.integers(1, 513, n).tolist()
            packed = difference(sizes, windows)
            assert len(packed) == windows and sorted(i for w in packed for i in w) == list(range(n))
            if n >= 12 * windows:
                sums = [sum(sizes[i] for i in w) for w in packed]
                assert max(sums) - min(sums) <= 32


def test_checksums_equal_those_of_the_ids(spark, docs):
    import zlib

    from quarrylight.llm.packing import pack_documents
    from quarrylight.llm.queries import tokenizer_path

    few = docs.select("doc_id", "text").limit(40).coalesce(1)
    ids = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in pack_documents(few, tokenizer_path()).collect()}
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in pack_documents(few, tokenizer_path(), checksum=True).collect()}
    assert ids == sums


def test_bounds_of_near_copies_never_fail():
    from quarrylight.llm.simhash import alike, least_difference, packed, parities, shingles_of

    draw = np.random.default_rng(2)
    for n, m in ((30, 30), (300, 280), (5000, 90), (9000, 9500)):
        words = [f"w{k}" for k in draw.integers(0, 10**6, n)]
        a, b = shingles_of(" ".join(words)), shingles_of(" ".join(words[: m // 2] + [f"v{k}" for k in range(m // 2)]))
        assert least_difference(parities(a), parities(b)) <= len(np.setxor1d(a, b))
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert alike(packed(a), packed(b), jaccard) and not alike(packed(a), packed(b), jaccard + 0.01)
    assert len(shingles_of("one two")) == 1 and len(shingles_of(" ")) == 0 and len(shingles_of(None)) == 0


def test_word_vectors_against_brute_force(spark):
    """Sums of neighbours' index vectors, unit means, scores of the network."""
    from quarrylight.llm import classifier as c

    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" if k % 7 else "A!" for k in draw.integers(0, 40, n)) for n in (0, 1, 2, 3, 30, 200)] + [None, "  "]
    places, signs = c.index_vectors()
    slow = np.zeros((c.BUCKETS, c.DIMS), np.int64)
    for text in texts:
        own = c.buckets_of(text).tolist()
        for i, term in enumerate(own):
            for j in range(max(0, i - c.REACH), min(len(own), i + c.REACH + 1)):
                if j != i:
                    for at, sign in zip(places[own[j]], signs[own[j]], strict=True):
                        slow[term, at] += sign
    fast = c.Neighbours()
    for text in texts:
        fast.add(c.buckets_of(text))
    fast.flush()
    assert (fast.sums.reshape(slow.shape) == slow).all() and slow.any()
    vectors = c.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    length = np.maximum(np.linalg.norm(slow, axis=1, keepdims=True), 1)
    assert np.allclose(vectors, slow / length, atol=1e-5)
    own = c.buckets_of(texts[5])
    mean = sum(vectors[b] for b in own.tolist()) / len(own)
    assert np.allclose(c.pooled(texts[5], vectors), mean / np.linalg.norm(mean), atol=1e-4) and not c.pooled(None, vectors).any()


def test_packing_looks_for_no_cuts(monkeypatch):
    """Short words are encoded whole, to the same ids."""
    from quarrylight.llm import bpe
    from quarrylight.llm.queries import tokenizer_path

    texts = ["", "Straße naïve café 3x-ray", "zqxj" * 6 + " vkwz#~{} 漢字ΔΣ", "<|endoftext|> it's don't", "qzx" * 200]
    want = [bpe.codec(tokenizer_path()).encode(t) for t in texts]
    whole = bpe.ForcedBoundaryCodec(tokenizer_path(), cut=False)
    assert [whole.encode(t) for t in texts] == want
    monkeypatch.setattr(whole, "fragments", None)
    whole.chunks.clear()
    assert [whole.encode(t) for t in texts[:-1]] == want[:-1]


def test_redaction_leaves_plain_texts_in_the_jvm(spark):
    from quarrylight.llm.pii import redact

    plan = redact(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
    assert "RLIKE" in plan._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[-1]
    data = [(1, "mail a.b@example.com now"), (2, "plain words"), (3, None), (4, ""), *((i, f"call +49 30 1234567{i % 10}") for i in range(5, 700))]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(data, "doc_id int, text string").coalesce(1)).collect()}
    assert len(got) == len(data) and got[1] == "mail [EMAIL] now" and [got[k] for k in (2, 3, 4)] == ["plain words", None, ""]
    assert all("[PHONE]" in got[i] for i in range(5, 700))
