"""Alignment against whole-text encoding, cuts by intersection and links by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelscope.llm import alignment
from panelscope.llm.alignment import Aligned, Encoder, align_documents, link_counts, links, shared_cuts
from panelscope.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "x▁y", "\r\nfoo \r bar", "a\xa0b 　 c", "trailing  ", "   ", "\n\n\t x", "\t", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "a\n  b \n c\n\n   d",
    "\U0001f600\U0001f468‍\U0001f469 ok", "é é ﬁ", "don't we'LL 3.14 x=y;{}", "中文字" * 200, " lead", "=" * 5000, "ab" * 3000, "\0 nul", "\x0b\x0c v f", "​zero width",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(tokenizers, text):
    """Groups of a text: lists of ids of both sides."""
    a, b = tokenizers
    if not text:
        return []
    want = (" " + text).encode()
    byte_of = {c: k for k, c in ((k, chr(v)) for k, v in alignment.printable_bytes().items())}
    xs = a.encode(" " + text, add_special_tokens=False)
    ys = b.encode(text)
    xb = [bytes(byte_of.get(c, ord(c) & 255) for c in t) for t in xs.tokens]
    yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ys)]
    if b"".join(xb) != want or b"".join(yb) != want:
        return []
    xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(xe) & set(ye)):
        p, q = xe.index(end) + 1, ye.index(end) + 1
        out.append((xs.ids[i:p], ys[j:q], end))
        i, j = p, q
    return out


@pytest.fixture(scope="module")
def rows(docs, spark):
    small = docs.where(F.length("text").isNull() | (F.length("text") < 4_000)).select("doc_id", "text")
    return small.unionByName(spark.createDataFrame([(7_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_groups(rows, tokenizers):
    got = align_documents(rows.repartition(3), A, B).collect()
    out = []
    for r in got:
        groups, i, j = [], 0, 0
        for g in r["groups"]:
            groups.append((r["a_ids"][i:g["a_end"]], r["b_ids"][j:g["b_end"]], g["byte_end"]))
            i, j = g["a_end"], g["b_end"]
        assert (i, j) == (len(r["a_ids"]), len(r["b_ids"]))
        out.append((r["doc_id"], groups))
    key = lambda r: (r[0] is None, r[0], str(r[1]))
    assert sorted(out, key=key) == sorted(((r["doc_id"], plain(tokenizers, r["text"])) for r in rows.collect()), key=key)
    assert not next(g for d, g in out if d == 7_000)  # U+2581 does not come back


def test_links(rows, tokenizers, monkeypatch):
    texts = [(r["doc_id"], plain(tokenizers, r["text"])) for r in rows.collect()]
    met = [Counter((a, b) for x, y, _ in groups for a in x for b in y) for _, groups in texts]
    count = Counter(p for m in met for p in m)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = []
    for (doc, groups), m in zip(texts, met):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in groups)
        want.append((
            doc, sum(len(x) for x, _, _ in groups), sum(len(y) for _, y, _ in groups), len(groups), sum(m.values()),
            sum(n for p, n in m.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in m.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    key = lambda r: (r[0] is None, *r)
    clash = rows.withColumns({c: F.lit("clash") for c in ("block", "codes", "code", "docs", "n", "best", "known", "a")})
    got = link_counts(clash.repartition(5), A, B)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_nothing(nothing):
    assert align_documents(nothing, A, B).collect() == [] and link_counts(nothing, A, B).collect() == []


def test_long_texts(edges, tokenizers):
    """Whole texts, also of 120,000 characters."""
    got = {r["doc_id"]: r for r in link_counts(edges, A, B).where("doc_id in (9008, 9009, 9010, 9013)").collect()}
    for r in edges.where("doc_id in (9008, 9009, 9010, 9013)").collect():
        a, b = tokenizers
        x = got[r["doc_id"]]
        assert (x["n_a"], x["n_b"]) == (len(a.encode(" " + r["text"], add_special_tokens=False).ids), len(b.encode(r["text"])))
        assert x["n_groups"] > 1 and x["n_links"] >= max(x["n_a"], x["n_b"])


def test_cuts_of_random_ends():
    rng = random.Random(3)
    for _ in range(200):
        a_ends, b_ends, a_bounds, b_bounds, base = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 5)):
            size = rng.choice([1, 2, 7, 60, 400])
            for ends, bounds in ((a_ends, a_bounds), (b_ends, b_bounds)):
                inner = rng.sample(range(1, size), rng.randint(0, size - 1)) if size > 1 else []
                ends += [base + e for e in sorted(inner)] + [base + size]
                bounds.append(len(ends))
            base += size
        a_cut, b_cut = shared_cuts(*(np.asarray(v, np.int64) for v in (a_ends, b_ends, a_bounds, b_bounds)))
        both = sorted(set(a_ends) & set(b_ends))
        assert [a_ends[i] for i in a_cut] == both == [b_ends[j] for j in b_cut]


def test_a_group_without_cuts(monkeypatch):
    """A large group is linked by distinct ids, in parts, with nothing lost."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50, 900), rng.integers(0, 40, 700)
    one = np.asarray([0, 900]), np.asarray([0, 700])
    x = Aligned(pa.array([1]), a, b, *one, one[0][1:], one[1][1:], np.asarray([1]))
    want = Counter((int(p) << 32 | int(q)) for p in a for q in b)
    for limit in (100, 10_000, 10_000_000):
        monkeypatch.setattr(alignment, "LINKS", limit)
        found = Counter()
        for _, code, times in links(x):
            found.update(dict(zip(code.tolist(), times.tolist())))
        assert found == want


def test_units_are_bounded_and_exact(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 50)
    encoder, rng = Encoder(A, B), random.Random(5)
    words = ["the", "Zaun", "naïve", "x1", "...", "don't", "\n", "\t", "", "12%"]
    for _ in range(20):
        texts = [" ".join(rng.choices(words, k=30)) + rng.choice(["", " ", "\n"]) for _ in range(5)]
        for text, (x, y) in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(x, np.uint32).tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
            assert np.frombuffer(y, np.uint32).tolist() == tokenizers[1].encode(text)
        assert len(encoder.units) <= 400
