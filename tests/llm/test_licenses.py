"""Base phrases against plain loops; planted licence texts, whole, edited and cut."""

import re

import pytest
from pyspark.sql import functions as F

from panelscope.llm.licenses import BASE, TEMPLATES, Template, find_licenses, phrase_places, rare_index, words_of

LONG = {t.label: t for t in TEMPLATES if len(words_of(t.text)) > 25}
FILLER = "zorvel quintab meroni lapachen tiing retion shthorhe ofth eriner thanea".split()


def filler(n, seed=0):
    return " ".join(FILLER[(i * 7 + i // 3 + seed) % len(FILLER)] for i in range(n))


def base_of(text):
    words = [w for w in re.split("[\x00-/:-`{-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    at = {p: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for p in BASE}
    every = sorted(i for places in at.values() for i in places)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(BASE[p] for p in at if at[p]))


def test_base(spark, docs):
    rows = [
        (1, "Under the MIT license. under-the mit\nLICENSE; Apache License, Version 2.0"), (2, "under the mit licenses"), (3, "CC BY-NC cc by nc cc by nc"),
        (4, "é under the mit license é"), (5, "under the mité license"), (6, "cc by"), (7, "0 under THE mit\tlicense" * 3), (8, "apache license version 20"),
    ]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(planted).withColumns({c: F.lit("clash") for c in ("rid", "words", "hits", "starts", "base", "label", "share", "template", "bin")})
    got = find_licenses(every)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    rows = got.collect()
    want = [(r["doc_id"], *base_of(r["text"])) for r in every.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        base, labels = (set(filter(None, r[c].split(","))) for c in ("base_labels", "labels"))
        assert base <= labels and ",".join(sorted(labels)) == r["labels"] and 0 <= r["score"] <= 1
        assert (r["score"] == 1) == (r["n_base"] > 0) or not base
    assert all(t == "bigint" for c, t in got.dtypes if c in ("doc_id", "n_words", "n_base", "first_word", "last_word"))


def test_planted_licences(spark):
    edited = lambda text: " ".join(w for i, w in enumerate(text.split()) if i not in (14, 21))
    rows, want = [], {}
    for i, t in enumerate(TEMPLATES):
        rows += [(i, t.text), (100 + i, f"{filler(300, i)} {t.text.upper()} {filler(200)}")]
        want |= {i: {t.label}, 100 + i: {t.label}}
    for i, (label, t) in enumerate(sorted(LONG.items())):
        rows.append((200 + i, f"{filler(20)}. # " + t.text.replace(" ", "\n# ")))
        want[200 + i] = {label}
    mit, bsd, zlib = LONG["mit"], LONG["bsd"], LONG["zlib"]
    rows += [
        (300, f"{mit.text} {filler(50)} {bsd.text}"), (301, edited(bsd.text)), (302, mit.text.replace("persons to whom", "all the other persons to whom")),
        (303, zlib.text.replace("in no event will the authors be held liable", "the authors may be held liable")), (304, " ".join(reversed(mit.text.split()))),
        (305, filler(3000)), (306, "license " * 5000 + "general public version gnu"), (307, None), (308, ""), (309, f"{filler(5)} {bsd.text} " * 40),
        (310, zlib.text.replace("In no event will the authors be held liable", "The authors may be held liable")),
        (311, "gnu permission hereby granted free charge person obtaining copy sublicense merge sell"),
    ]
    want |= {300: {"mit", "bsd"}, 301: {"bsd"}, 302: {"mit"}, 303: {"zlib"}, 304: set(), 305: set(), 306: set(), 307: set(), 308: set(), 309: {"bsd"}, 310: set(), 311: set()}
    rows += [(1000 + i, filler(100, i)) for i in range(300)]  # documents in which licence words are rare
    got = {r["doc_id"]: r for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    found = {i: {x["label"] for x in r["licenses"]} for i, r in got.items()}
    assert {i: found[i] for i in want} == want
    assert not any(found[i] for i in found if i >= 1000)
    assert all(got[i]["score"] >= 0.6 for i in want if want[i]) and got[306]["score"] == 0


def test_index_holds_the_rarest():
    t = (Template("x", "alpha the beta of gamma the delta", ("beta of",)),)
    postings = rare_index({"the": 90, "of": 80, "alpha": 5, "beta": 1}, 100, t, 16)
    assert [(p.word, p.place) for p in postings] == [("beta", 2), ("gamma", 4), ("delta", 6)]
    assert phrase_places(t[0]) == [(["beta", "of"], 2)]
    with pytest.raises(ValueError):
        phrase_places(Template("x", "alpha beta", ("gamma",)))


def test_templates_are_parameters(spark, nothing):
    own = (Template("house", "for use within the house of Zorvel only and never outside", ("house of zorvel only",)),)
    df = spark.createDataFrame([(1, "Note: For use within the house of Zorvel only, and never outside!"), (2, "house of Zorvel")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in find_licenses(df, own).collect()} == {1: "house", 2: ""}
    assert find_licenses(nothing).collect() == []


def test_plan_is_native(docs):
    plan = find_licenses(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD", "CartesianProduct"))
