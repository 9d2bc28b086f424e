"""What a worker of the pipeline's packing stage remembers."""

import tracemalloc
import zlib

import corpus_pipeline
from panelscope.llm import packing
from panelscope.llm.queries import tokenizer_path
from tests.llm.conftest import SCHEMA

SYLLABLES = ["an", "er", "th", "ou", "ti", "ea", "sh", "re", "on", "ble"]


def word(i):
    return "".join(SYLLABLES[int(d)] for d in str(i))


def test_memory_is_bounded_over_many_words():
    words = packing.encoder(tokenizer_path(), True, corpus_pipeline.REMEMBERED)
    texts = [" ".join(map(word, range(i, i + 5000))) for i in range(0, 250_000, 5000)]
    tracemalloc.start()
    try:
        got = [zlib.crc32(ids) for ids in words.ids(texts)]
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(words.of_piece) + len(words.of_piece.before) <= 2 * corpus_pipeline.REMEMBERED
    assert held < 25e6
    assert got == [zlib.crc32(ids) for ids in packing.WordEncoder(tokenizer_path(), True).ids(texts)]


def test_stage_remembers_less_and_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{word(i)} {word(i // 3)}, {word(7 * i)}!" * 40, "en", "s", 1) for i in range(300)], SCHEMA)
    asked, pieces_of = [], packing.pieces_of
    monkeypatch.setattr(packing, "pieces_of", lambda *a: asked.append(a[6]) or pieces_of(*a))
    rows = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    few = rows(packing.pack_documents(docs, tokenizer_path(), added_tokens=True, remembered=3))
    assert rows(corpus_pipeline.windows(spark, docs, "")) == rows(packing.pack_documents(docs, tokenizer_path(), added_tokens=True)) == few
    assert asked == [3, corpus_pipeline.REMEMBERED, packing.PIECE_CACHE] and corpus_pipeline.REMEMBERED < packing.PIECE_CACHE
