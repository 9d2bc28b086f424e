"""Ids of texts that hold the tokenizer's added tokens."""

import zlib

import numpy as np

import corpus_pipeline
from panelscope.llm import packing, queries
from panelscope.llm.queries import tokenizer_path
from tests.llm.conftest import SCHEMA, SF

TEXTS = ["one <|endoftext|> two", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> is text", "中 <|endoftext|>\n ½", "<|endoftext", "plain", "", "<|endoftext|>" * 3000]


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(spark, monkeypatch):
    words = packing.WordEncoder(tokenizer_path(), added_tokens=True)
    assert [np.frombuffer(b, "<u4").tolist() for b in words.ids(TEXTS)] == [ids_of(t) for t in TEXTS]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*ids_of(t), 1]
        want += [(i, s, n, crc(ids[s:s + n]), len(ids)) for s, n in packing.cut(len(ids), 2048, 512)]
    for got in (queries.op10_packing(spark, SF), corpus_pipeline.windows(spark, docs, SF)):
        assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()) == sorted(want)
