"""Units are divided once, and texts put together from remembered units have the groups of whole texts."""

import random

import pyarrow as pa

from panelscope.llm import alignment
from panelscope.llm.alignment import Encoder, links
from tests.llm.test_alignment import ODD, A, B, plain, tokenizers  # noqa: F401


def groups_of(x, k):
    out, i, j = [], int(x.a_bounds[k]), int(x.b_bounds[k])
    first, last = x.group_bounds()[k:k + 2].tolist()
    before = 0 if first == 0 else int(x.bytes_end[first - 1])
    for p, q, end in zip(x.a_ends[first:last].tolist(), x.b_ends[first:last].tolist(), x.bytes_end[first:last].tolist()):
        out.append((x.a[i:p].tolist(), x.b[j:q].tolist(), end - before))
        i, j = p, q
    assert (i, j) == (x.a_bounds[k + 1], x.b_bounds[k + 1])
    return out


def test_tokens_divided_do_not_grow_with_repeats(monkeypatch):
    seen = []
    cuts = alignment.shared_cuts
    monkeypatch.setattr(alignment, "shared_cuts", lambda a, *more: seen.append(len(a)) or cuts(a, *more))
    for copies in (1, 300):
        seen.append(0)
        x = Encoder(A, B).align(pa.array(range(copies)), ["Onthe hethion, the on thonwh.\nEr antion"] * copies)
        assert len(x.a) > 10 * copies and len({*x.hashes}) == 1
    assert seen[1] and seen[1::2] == [seen[1]] * 2


def test_groups_from_remembered_units(tokenizers, monkeypatch):  # noqa: F811
    monkeypatch.setattr(alignment, "UNITS", 60)
    encoder, rng = Encoder(A, B), random.Random(8)
    words = ["the", "Zaun", "naïve", "x1", "...", "don't", "\n", "\t", "", "12%", "a.b,", "ä" * 70, "ab" * 80, "end!", "?", *(f"w{i}on" for i in range(80))]
    for _ in range(15):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", " ", "\n"]) for _ in range(6)] + rng.sample(ODD, 4)
        rng.shuffle(texts)
        x = encoder.align(pa.array(range(10)), texts)
        for k, text in enumerate(texts):
            assert groups_of(x, k) == plain(tokenizers, text)
        assert sum(int(n.sum()) for *_, n in links(x)) >= len(x.a_ends)
        assert len(encoder.units) <= 60 and all(len(u) <= alignment.LONG_UNIT for u in encoder.units)
        rows = len(encoder.units)
        assert {len(encoder.shown), len(encoder.bad), len(encoder.met), *(len(r.counts) for r in (*encoder.ids, encoder.groups))} == {rows}
