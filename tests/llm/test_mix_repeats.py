"""Repeated rows of the mixture that differ in other columns."""

from collections import Counter

from panelscope.llm import mixing
from tests.llm.conftest import SCHEMA


def test_copies_are_spread_over_repeated_rows(spark):
    rows = [(1, "one two three", lang, "a", n) for lang, n in (("en", 1), ("en", 1), ("de", 2), (None, 3))]
    rows += [(i, f"word{i} more words", "en", "ab"[i % 2], i) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = [r for r in mixing.mix(docs).collect() if r["doc_id"] == 1]
    assert len(plan) == 1 and plan[0]["rows"] == 4 and plan[0]["copies"] >= 4
    outs = [Counter(tuple(r) for r in mixing.mix_documents(d).collect()) for d in (docs, docs.repartition(7))]
    assert outs[0] == outs[1]
    taken = {r: c for r, c in outs[0].items() if r[0] == 1}
    assert set(taken) == set(rows[:4]) and sum(taken.values()) == plan[0]["copies"]
    low = plan[0]["copies"] // 4
    assert all(low * n <= taken[r] <= (low + 1) * n for r, n in Counter(rows[:4]).items())
