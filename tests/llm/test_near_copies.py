"""Near copies of the pipeline's stage against brute force."""

import numpy as np

import corpus_pipeline
from panelscope.llm import nearcopies
from tests.llm.conftest import SCHEMA, SF, texts
from tests.llm.test_dedup import groups


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_first(rows):
    """Smallest id of each component of texts."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [plain_set(t) for _, t in rows]
    root, first = groups(sets, plain_near), {}
    for r, (i, _) in zip(root, rows, strict=True):
        first.setdefault(r, i)
    return sorted(first.values(), key=str)


def edited(draw, words, edits):
    out = list(words)
    for i in draw.choice(len(out), edits, replace=False).tolist():
        out[i] = f"edit{draw.integers(1 << 30)}"
    return out


def test_edited_copies_go(spark):
    draw = np.random.default_rng(11)
    rows = []
    for base in range(60):  # of 200 words, with up to 6 edits: similarities from about 0.74 to 1
        words = [f"w{draw.integers(3000)}" for _ in range(200)]
        rows.append((10 * base, " ".join(words)))
        rows += [(10 * base + 1 + k, " ".join(edited(draw, words, int(draw.integers(0, 7))))) for k in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == plain_first(rows)


def test_near_copies_of_documents(docs, nothing):
    kept = nearcopies.first_of_near_copies(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == plain_first([(i, t or "") for i, t in texts(docs)])
    assert nearcopies.first_of_near_copies(nothing).count() == 0


def test_chains_are_followed_in_every_round(spark, monkeypatch):
    draw = np.random.default_rng(12)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each a near copy of the one before, the last far from the first
        rows.append((i, " ".join(words)))
        words = edited(draw, words, 1)
    for rounds in (0, 2):
        monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
        kept = nearcopies.first_of_near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA))
        assert [r["doc_id"] for r in kept.collect()] == plain_first(rows)


def test_unlike_members_of_a_large_group_make_no_pairs(spark, monkeypatch):
    draw, sizes, stored = np.random.default_rng(13), {}, nearcopies.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        return out

    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(draw, words, int(draw.integers(2, 8))))) for i in range(500)]  # most are nearer to the text they come from than to each other
    monkeypatch.setattr(nearcopies, "stored", counted)
    for block in (nearcopies.BLOCK, 1 << 14):  # in one block, and in several
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        kept = nearcopies.first_of_near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA))
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == plain_first(rows)
        assert sizes["near_pairs"] <= nearcopies.BANDS * len(rows) and sizes["near_links"] <= nearcopies.BANDS * len(rows)


def test_fingerprints_give_candidates(spark):
    """The SimHash index pairs most texts that differ in one of 800 words, and verified pairs are near copies only."""
    draw = np.random.default_rng(14)
    rows = []
    for base in range(20):
        words = [f"w{draw.integers(3000)}" for _ in range(800)]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(edited(draw, words, 1)))]
    found = nearcopies.described(spark.createDataFrame(rows, "_key long, _text string"), 5)
    of = {bytes(r["node"]): r["_key"] for r in found.collect()}
    pairs = {frozenset((of[bytes(r["a"])], of[bytes(r["b"])])) for r in nearcopies.fingerprint_pairs(found.select("node", "fp")).collect()}
    assert len(pairs & {frozenset((2 * b, 2 * b + 1)) for b in range(20)}) >= 15
