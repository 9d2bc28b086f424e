"""Languages of many letters, many scripts, long texts and many labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm import langid
from tests.llm.conftest import SCHEMA
from tests.llm.test_text_models import plain_phrases


@pytest.mark.parametrize("width", [2, 8, 64])
def test_phrases_over_many_symbols(width, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    draw = np.random.default_rng(8)
    line = lambda n, top: draw.integers(2, top, n)
    samples = [line(400, 30), line(3000, 900)]
    docs = [np.concatenate([s[a:a + 40], line(n, 1000)]) for s in samples for a, n in ((0, 0), (50, 9), (200, 300), (7, 77))]
    got = langid.phrases(np.concatenate(docs), np.asarray([len(d) for d in docs]), [langid.move_table(s, width) for s in samples])
    name = lambda x: "".join(map(chr, x.tolist()))
    assert got.tolist() == [[plain_phrases(name(d), name(s)) for d in docs] for s in samples]


def test_every_letter_of_the_samples_is_known():
    draw = np.random.default_rng(9)
    latin = "the quick brown fox jumps over the lazy dog " * 200
    words = {lang: ["".join(chr(first + int(c)) for c in draw.integers(0, 1500, 3)) for _ in range(400)] for lang, first in (("ja", 0x4E00), ("ko", 0xAC00), ("zh", 0x4E00))}
    say = lambda lang, n: " ".join(words[lang][i] for i in draw.integers(0, 400, n))
    model = langid.LanguageModel(("en", *words), (latin, *(say(lang, 2000) for lang in words)))
    texts = [say(lang, 60) for lang in words for _ in range(20)]
    langs, _, known = langid.judged(texts, model)
    assert langs == [lang for lang in words for _ in range(20)]
    assert known.min() > 0.9


def test_labels_of_long_texts_are_learned(spark):
    draw = np.random.default_rng(10)
    say = lambda lang, n: " ".join(f"{lang}{'abcdefgh'[int(i)]}{lang}" for i in draw.integers(0, 8, n))
    rows = [(i, say("un", 200), "un", "s", 1) for i in range(120)] + [(1000 + i, "1" * 9000 + say("vo", 4000), "vo", "s", 1) for i in range(120)]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert model.languages == ("un", "vo") and min(map(len, model.samples)) >= 40_000
    # rows without letters take no place of the sample
    rows += [(5000 + i, "123", "wu", "s", 1) for i in range(300)] + [(9000, say("wu", 50), "wu", "s", 1)]
    assert langid.learn(spark.createDataFrame(rows, SCHEMA), F.lit(True)).languages == ("un", "vo", "wu")


def test_every_label_is_learned(spark):
    draw = np.random.default_rng(11)
    names = [f"{a}{b}" for a in "abcdefghi" for b in "klmnopqrs"]
    word = lambda n: "".join(n[int(i)] for i in draw.integers(0, 2, 6))
    rows = [(100 * k + i, " ".join(word(n) for _ in range(40)), n, "s", 1) for k, n in enumerate(names) for i in range(4 if k else 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs, F.lit(True))
    assert model.languages == tuple(names)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert all(out[i] == n for i, _, n, _, _ in rows)
    with pytest.raises(ValueError, match="labels"):
        langid.learn(docs, F.lit(True), max_languages=len(names) - 1)
