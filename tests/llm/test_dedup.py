"""SimHash groups and repeated passages against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from panelscope.llm import simhash, suffix_dedup
from tests.llm.conftest import texts


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points, near):
    """Smallest name reachable over pairs that are near."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


def test_near_duplicates(docs):
    rows = texts(docs)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {t: plain_fingerprint(t) for t in {t for _, t in rows}}
    distinct = sorted(set(fps.values()))
    root = dict(zip(distinct, groups(distinct, lambda a, b: (a ^ b).bit_count() <= 3), strict=True))
    least = {}
    for i, t in rows:
        r = root[fps[t]]
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    expected = sorted(((i, f"{fps[t]:016x}", least[root[fps[t]]]) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == expected


@pytest.mark.parametrize("segment", [8, 64, 4096])
def test_links_join_all_near_pairs(spark, segment):
    draw = np.random.default_rng(3)
    codes = [int(x) for x in draw.integers(0, 1 << 63, 150, dtype=np.int64)]
    for i in range(250):  # chains and clouds around the first
        code = codes[draw.integers(0, 20)] if i % 2 else codes[-1]
        for bit in draw.integers(0, 63, draw.integers(1, 4)):
            code ^= 1 << int(bit)
        codes.append(code)
    codes = sorted(set(codes))
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), 3, segment)).collect()}
    expected = groups(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {(roots.get(c, c), e) for c, e in zip(codes, expected, strict=True)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_gray_index_finds_what_a_scan_finds():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(0, 1 << 12, 900, dtype=np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = {(q, n) for query, node in simhash.GrayIndex(codes).search(codes[:60], 2, np.uint64(0)) for q, n in zip(query.tolist(), node.tolist(), strict=True)}
    assert found == {(q, n) for q in range(60) for n in range(len(codes)) if int(codes[q] ^ codes[n]).bit_count() <= 2}


def test_first_of_groups_keeps_one_row_each(docs, nothing):
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in kept.collect()]
    for i, (_, a) in enumerate(rows):
        assert all((a ^ b).bit_count() > 3 for _, b in rows[:i])
    assert simhash.first_of_groups(nothing).count() == 0


def plain_removal(rows, span=50):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for i, text in order:
        data = (text or "").encode()
        name = (i is None, i or 0)
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            if first.setdefault(data[p:p + span], name) < name:
                gone[p:p + span] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "merged"), [(64, 1 << 20), (1 << 17, 1 << 20), (300, 2000), (1 << 14, 150_000)])
def test_remove_repeats(docs, shard, merged, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "MERGED", merged)
    rows = [r for r in texts(docs) if len(r[1] or "") < 40_000]
    some = docs.where("text is null or length(text) < 40000")
    got = suffix_dedup.remove_repeats(some).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


def test_long_runs_of_one_byte(spark):
    rows = [(1, "x" * 3000), (2, "y" + "x" * 2000), (3, "ab" * 500), (4, "ba" * 300), (5, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


@pytest.mark.parametrize("shard", [16, 100, 10_000])
def test_merged_order_is_the_sorted_order(shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    draw = np.random.default_rng(5)
    lines = sorted({bytes(draw.integers(97, 99, draw.integers(1, 40)).astype(np.uint8)) for _ in range(60)})
    line, owner, order = suffix_dedup.merged_order(lines, 50)
    ends = np.flatnonzero(line == 0)
    suffix = lambda p: bytes((line[p:ends[owner[p]] + 1]).astype(np.uint8))
    found = [suffix(p) for p in order.tolist()]
    assert found == sorted(found) and sorted(order.tolist()) == list(range(len(line)))


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_clashing_columns(edges):
    assert simhash.near_duplicates(edges).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.first_of_groups(edges).columns == edges.columns
    assert suffix_dedup.remove_repeats(edges).count() == edges.count()
