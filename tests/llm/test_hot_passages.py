"""Passages that very many documents share: no task gets their contexts all by itself, and nothing is lost."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelscope.llm import suffix_dedup
from panelscope.llm.suffix_dedup import GRAM, SPAN, hot_keys, packed, parts_of, remove_repeats, runs, send_contexts, settled_rows

LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def around(n, seed=0, passage=300, total=700):
    """Texts of their own around one shared passage, as a notice in a page."""
    r = random.Random(seed)
    shared = "".join(r.choices(LETTERS, k=passage))
    own = total - passage
    out = []
    for _ in range(n):
        text = "".join(r.choices(LETTERS, k=own))
        at = r.randrange(own)
        out.append(text[:at] + shared + text[at:])
    return out


def by_hand(rows, span=SPAN):
    first = {}
    for doc, text in rows:
        for i in range(len(text) - span + 1):
            s = text[i:i + span]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - span + 1):
            if first[text[i:i + span]] < doc:
                gone[i:i + span] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def loads(texts, hot, buckets):
    """Contexts each task gets if every text is a batch's."""
    out = np.zeros(buckets, int)
    for at in range(0, len(texts), 500):
        some = [t.encode() for t in texts[at:at + 500]]
        doc, _, _, key = runs(some, SPAN, GRAM, hot)
        met = Counter(key.tolist())
        wanted = [np.unique(key[doc == i][[met[k] > 1 for k in key[doc == i].tolist()]]) for i in range(len(some))]
        edges = np.concatenate([[0], np.cumsum([len(w) for w in wanted])])
        blobs = packed(np.concatenate(wanted), edges)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(at, at + len(some))), pa.array(range(at, at + len(some))), pa.array(some, pa.binary()), pa.array([[b] for b in blobs.to_pylist()])],
            names=["uid", "id", "text", "keys"])
        for block in send_contexts(buckets, SPAN, GRAM, hot)(iter([batch])):
            for bucket, done, sizes in zip(*(block.column(i).to_pylist() for i in (0, 1, 9))):
                if done is None:
                    out[bucket] += len(sizes) // 4
    return out


def test_contexts_of_a_hot_passage_are_spread(spark):
    texts = around(4000)
    rows = spark.createDataFrame([(i, i, t.encode()) for i, t in enumerate(texts)], "uid long, id long, text binary")
    hot = hot_keys(rows, 8, SPAN, GRAM)
    assert 0 < len(hot) < 400
    before, after = loads(texts, None, 8), loads(texts, hot, 8)
    assert before.max() > 2 * before.mean()  # the edges of the passage are in a few tasks
    assert after.max() < 2 * after.mean() and after.sum() < before.sum()


@pytest.mark.parametrize("looked_at", [1, 16])
def test_nothing_is_lost(spark, looked_at):
    texts = around(300, 1) + around(120, 2, passage=70, total=200) + ["x" * 400, "y" * 49, ""] + around(30, 1)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, remove_repeats(df, looked_at=looked_at).drop("kept").collect()))
    assert got == by_hand([(i, t.encode()) for i, t in rows])


def test_hot_windows_go_by_their_own_bytes():
    texts = [t.encode() for t in around(50, 3)]
    doc, start, count, key = runs(texts, SPAN, GRAM)
    hot = np.sort(np.asarray([k for k, n in Counter(key.tolist()).items() if n > 20], np.uint64))
    of = {}
    for d, s, c, k in zip(*(x.tolist() for x in runs(texts, SPAN, GRAM, hot))):
        for i in range(s, s + c):
            assert of.setdefault(texts[d][i:i + SPAN], k) == k  # equal windows have equal keys
    assert len(of) == len({t[i:i + SPAN] for t in texts for i in range(len(t) - SPAN + 1)})


def test_large_batches(spark, monkeypatch):
    """Batches of more rows than a short number holds are taken in parts."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(130_000)), pa.array([b"x"] * 130_000, pa.binary())], names=["uid", "text"])
    sizes = [p.num_rows for p in parts_of(iter([batch]), 1)]
    assert sum(sizes) == 130_000 and max(sizes) <= suffix_dedup.ROWS < 1 << 16


def test_settled_ranges_are_joined():
    uid, blobs = settled_rows(np.asarray([7, 3, 7, 7, 3, 9]), np.asarray([10, 0, 0, 40, 60, 5]), np.asarray([60, 50, 12, 90, 110, 55]))
    found = {u: np.frombuffer(b, np.int64).reshape(-1, 2).tolist() for u, b in zip(uid.tolist(), blobs.to_pylist())}
    assert found == {3: [[0, 50], [60, 110]], 7: [[0, 90]], 9: [[5, 55]]}


def test_texts_of_one_name_are_told_apart(spark, monkeypatch):
    plain = suffix_dedup.text_name
    monkeypatch.setattr(suffix_dedup, "text_name", lambda text, turn: plain(text, turn) % 3 if turn < 2 else plain(text, turn))
    texts = around(40, 5, passage=90, total=200) + ["x" * 80, "x" * 80, "", "z"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("kept").collect()))
    assert got == by_hand([(i, t.encode()) for i, t in rows])


def test_findings_come_back_in_few_rows():
    """One row per task that gathers, however many documents a task has found something for."""
    owner = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000).repeat(3)
    values = np.arange(15_000).astype(np.uint64)
    bucket, owners, counts, found = (a.to_pylist() for a in suffix_dedup.to_owners(owner, suffix_dedup.six(values), 7))
    assert bucket == list(range(7))
    who, what = suffix_dedup.from_blocks(owners, counts, found, "V6")
    assert sorted(zip(who.tolist(), suffix_dedup.wide(what).tolist())) == sorted(zip(owner.tolist(), values.tolist()))
    assert all((np.frombuffer(o, np.int64) % 7 == b).all() for b, o in zip(bucket, owners))
