"""Mixing, sharding and packing against their definitions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelscope.llm import mixing, packing, sharding
from panelscope.llm.queries import tokenizer_path
from tests.llm.conftest import texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """Targets by repeated sharing of what caps cut off."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mix(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixing.mix_counts(docs).collect()
    assert Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in rows) == Counter((r["doc_id"], r["source"], r["size"]) for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 * sizes[s]
    assert Counter(map(tuple, mixing.mix_counts(docs).collect())) == Counter(map(tuple, got))


def test_mixed_documents_are_taken_as_counted(docs):
    plan = mixing.mix(docs).collect()
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in plan:
        want[(r["doc_id"], r["source"])] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +want


def test_pairing_keeps_the_mean(spark):
    """Over many seeds a document is taken about as often as its fraction says."""
    rows = [(i, "w " * (i % 7 + 1), "a") for i in range(40)] + [(100 + i, "w " * 30, "b") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = Counter()
    for seed in range(12):
        for r in mixing.mix(df, weights=(1, 4), seed=seed).where("source = 'a'").collect():
            totals[r["doc_id"]] += r["copies"]
            rate = r["target"] / r["source_size"]
    assert abs(sum(totals.values()) / (12 * 40) - rate) < 0.1
    assert len(set(totals.values())) > 1


def test_mix_of_nothing(spark, nothing, edges):
    assert mixing.mix_counts(nothing).count() == 0
    assert mixing.mix_documents(nothing).columns == nothing.columns
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [tuple(r)[1:5] for r in mixing.mix_counts(empty).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix_documents(edges).columns == edges.columns


def test_shards(docs, edges, nothing):
    rows, got = texts(docs), sharding.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(load.values()), max(r["size"] for r in got)
    assert all(abs(load[s] - total / 24) <= largest for s in range(24))
    assert sharding.shard_documents(nothing).count() == 0
    assert sharding.shard_documents(edges).count() == edges.count()


def test_shards_are_contiguous_and_split_equal_rows(spark):
    df = spark.createDataFrame([(7, "same text")] * 4800, "doc_id long, text string")
    got = Counter(r["shard"] for r in sharding.shard_documents(df).collect())
    assert max(got.values()) - min(got.values()) <= 1 and len(got) == 24


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_pack(docs):
    rows, got = texts(docs), packing.pack_documents(docs, tokenizer_path()).collect()
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        want.update((i, s, n, crc(ids[s:s + n]), len(ids)) for s, n in packing.cut(len(ids), 2048, 512))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
    assert sum(at.values()) / (2048 * len(at)) > 0.97


@pytest.mark.parametrize("tokens", [1, 511, 512, 513, 2047, 2048, 2049, 5000])
def test_pieces_cover_a_document(tokens):
    at = 0
    for start, length in packing.cut(tokens, 2048, 512):
        assert start == at and 0 < length
        at += length
    assert at == tokens


def test_differencing_keeps_every_item_and_balances():
    draw = np.random.default_rng(2)
    for items, windows in ((1, 3), (7, 3), (400, 50), (1000, 9)):
        sizes = draw.integers(1, 500, items)
        window, loads = packing.differencing(sizes, windows)
        sums = np.bincount(window, weights=sizes, minlength=len(loads))
        assert sorted(sums.tolist()) == sorted(loads.tolist())
        if items > 10 * windows:
            assert loads.max() - loads.min() <= 25
    assert packing.pack(np.asarray([2048, 2048, 1]), 2048).tolist() in ([0, 1, 2], [1, 0, 2], [0, 2, 1], [2, 0, 1], [1, 2, 0], [2, 1, 0])


def test_pack_of_nothing(nothing, edges):
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0
    assert packing.pack_documents(edges, tokenizer_path()).columns[:2] == ["doc_id", "start"]
