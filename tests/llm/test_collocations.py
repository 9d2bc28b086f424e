"""Phrases against plain counting: edge rows, tiny tries that burst and spill all the time, numbers beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm.collocations import HatTrie, PhraseCounter, collocations, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def expected(rows, min_count, max_words=5, top=2000, absorbed=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        found = []
        for g, a in candidates.items():
            if any(len(q) > len(g) and b * 100 >= absorbed * a and any(q[i:i + len(g)] == g for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, x, y, total[lang], -s) for i, (s, a, g, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("absorbed", [100, 60])
def test_phrases_of_edge_rows(docs, absorbed):
    small = docs.where(F.length("text").isNull() | (F.length("text") < 40_000))
    rows = [(r["lang"], r["text"]) for r in small.collect()]
    df = collocations(small, min_count=15, top=300, absorbed=absorbed, filter_bits=1 << 15)
    want = expected(rows, 15, top=300, absorbed=absorbed)
    assert got(df) == want
    assert len(want) > 100
    assert all(t == "bigint" for c, t in df.dtypes if c not in ("lang", "phrase"))


def test_long_texts_and_clashing_columns(edges):
    rows = [(r["lang"], r["text"]) for r in edges.collect()]
    clash = edges.withColumns({c: F.lit("clash") for c in ("phrase", "n", "a", "l", "r", "rank", "prefix", "total")})
    assert got(collocations(clash, min_count=20)) == expected(rows, 20)


def test_nothing(spark, nothing):
    assert got(collocations(nothing)) == []
    rare = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert got(collocations(rare)) == []
    assert got(collocations(rare, min_count=1, max_words=2)) == expected([("en", "a b c")], 1, 2)


@pytest.mark.parametrize("lengths, part", [(range(1, 2), 0), (range(2, 4), 1)])
def test_tries_that_burst_and_spill(lengths, part):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(40)] + ["é", "ab\xa0c", "\0en"]
    texts = [" ".join(rng.choices(words, k=50)) + rng.choice([".", "", "\n"]) for _ in range(60)]
    want = Counter()
    for t in texts:
        for w in pieces(t):
            for k in lengths:
                want.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    full = np.full(1 << 12, 255, np.uint8)  # every word may be frequent
    counter = PhraseCounter(lengths, part, full if part else None, 1 << 15, frozenset([b"w1"]), held=300 if part else 30, words=30, burst=3)
    found, runs = Counter(), []
    for at in range(0, 60, 7):
        runs += list(counter.add("en", [t.encode() for t in texts[at:at + 7]]))
    runs += list(counter.spill(0))
    part_of = {}
    for run in runs:
        for number, lang, phrases, counts in zip(*(c.to_pylist() for c in run.columns)):
            phrases = phrases.split("\t")
            assert lang == "en" and phrases == sorted(set(phrases), key=lambda p: p.encode().split(b" "))
            for phrase, n in zip(phrases, counts.split("\t"), strict=True):
                found[phrase] += int(n)
                prefix = phrase.split(" ")[:2 if phrase.startswith("w1 ") else 1]
                assert part_of.setdefault(tuple(prefix), number) == number  # a prefix is merged in one part
    assert found == want and len(runs) > 8
    if part:
        assert len({p for k, p in part_of.items() if k[0] == "w1"}) > 3  # but a hot word's phrases are split


def test_trie_keeps_counts_through_bursts():
    rng, trie, want, new = np.random.default_rng(2), HatTrie(4, burst=2), Counter(), 0
    for _ in range(20):
        ids = rng.integers(0, 4, (150, 4)).astype(np.uint32)
        new += trie.add(ids)
        want.update(map(tuple, ids.tolist()))
    assert new == len(want) == sum(trie.sizes.values())
    found = {}
    for words in (list(trie.subtrees)[:2], list(trie.subtrees)[2:]):
        ids, counts = trie.take(words)
        found |= dict(zip(map(tuple, ids.tolist()), counts.tolist()))
    assert found == want and not trie.subtrees and not trie.sizes


def test_numbers_beyond_64_bits(spark):
    n = 9_000_000_000_000_000
    known = spark.createDataFrame([("en", "a b", n // 7), ("en", "a", n // 3), ("en", "b", n // 5)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    assert got(ranked(known, totals, 10, 100)) == [("en", 1, "a b", n // 7, n // 3, n // 5, n, 1000 * (n // 7) * n // ((n // 3) * (n // 5)))]
