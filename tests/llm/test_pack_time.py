"""What packing does once, not at each place: looking pieces up, and merging single items into a partition."""

import random
import re

import numpy as np
import pytest

from panelscope.llm import packing
from panelscope.llm.queries import tokenizer_path

#: The tokenizer's split of plain lower-case text, as an expression.
SPLIT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ɏ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ɏ]+")


def odd_texts(count):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abs tdmlrev''''  .,-_19\n\r\téɏßzl\"") for _ in range(draw.randrange(60))) for _ in range(count)]
    return ["", "'", "''s", "'l", "'l'l", "'ll", "'rex", "a'", "1'2's", "'é", "x" * 5000, " \n", *texts]


def test_pieces_are_those_of_the_split():
    texts = odd_texts(3000)
    pieces, upto = packing.plain_pieces(texts)
    want = [SPLIT.findall(t) for t in texts]
    assert pieces.to_pylist() == [p for w in want for p in w]
    assert upto.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert packing.plain_pieces([])[0].to_pylist() == []


@pytest.mark.parametrize("block", [1, 500, 10**9])
def test_ids_are_those_of_the_tokenizer(monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", block)
    texts = [*odd_texts(400), "中 a's", "<|endoftext|> it's", "İK ÉTÉ'S", "a\x00b", "a\x0bb"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = [np.frombuffer(ids, "<u4").tolist() for ids in packing.WordEncoder(tokenizer_path(), added_tokens=True).ids(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_looked_up_once_for_many_texts():
    looked = []

    class Counted(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    texts = ["many words, the same ones in every text; it's 12 of them."] * 1000
    words = packing.WordEncoder(tokenizer_path())
    want = [*words.ids(texts)]
    words.of_piece = Counted(words.of_piece)
    assert [*words.ids(texts)] == want
    assert len(looked) <= 20


def test_single_items_are_merged_at_once(monkeypatch):
    sizes = np.random.default_rng(6).integers(1, 513, 2700)
    sort, sorts = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(len(a[0])) or sort(*a, **k))
    window, loads = packing.differencing(sizes, 400)
    assert np.array_equal(np.bincount(window, weights=sizes, minlength=400), loads)
    assert len(sorts) <= 200
