"""Words are told apart column-wise, and looked up once per batch, however often they stand there."""

import random
import re

from panelscope.llm.collocations import PhraseCounter, tokens_of

ODD = [b"", b" ", b"\n", b"\t \t", b".", b"A", b"Ab\tcD.eF\x0b\x0c\r;:!?gh  ", b"..a..", "ÄÖ É\xa0x y\U0001f600.Z".encode(), b"\0 \x1c\x85", b"x" * 5000 + b",Y"]


def plain(text):
    return [b"\n" if re.fullmatch(rb"[.,;:!?\x0a-\x0d]", w) else w for w in re.findall(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+", text.lower())]


def test_tokens_of_odd_texts():
    rng = random.Random(6)
    texts = ODD + [b"".join(rng.choices([b"A", b"b", b"\xc3\xa4", b" ", b"\t", b"\n", b"\r", b".", b"?", b"'", b"\x00"], k=rng.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert tokens_of(text).to_pylist() == plain(text)


class Looked(dict):
    times = 0

    def __getitem__(self, key):
        Looked.times += 1
        return super().__getitem__(key)


def test_a_word_is_looked_up_once_per_batch():
    for copies in (1, 200):
        counter = PhraseCounter(range(1, 2), 0, None, 1 << 15)
        counter.ids = Looked(counter.ids)
        Looked.times = 0
        assert list(counter.add("en", [b"one two, Two three.\nthree"] * copies)) == []
        assert Looked.times == 4  # three words and the end of a piece
        (run,) = counter.spill(0)
        found = {p: int(n) for ps, ns in zip(run.column(2).to_pylist(), run.column(3).to_pylist()) for p, n in zip(ps.split("\t"), ns.split("\t"))}
        assert found == {"one": copies, "two": 2 * copies, "three": 2 * copies}
