"""Quality rules, personal data, language and line quality against brute force and held-out labels."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm import langid, linecrf, pii, quality_rules
from panelscope.llm.queries import QUERIES
from tests.llm.conftest import SF, texts

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELLED = "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words, at, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(p + j for p in places for j in range(8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels).collect()
    want = []
    for i, t in texts(docs):
        s = plain_statistics(t)
        want.append((i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in got)


def test_rules_agree_with_labels(spark):
    out = QUERIES["op2_quality_rules"](spark, LABELLED)
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    judged = out.where("not base_failed").join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.2


def test_rules_are_found_again(spark):
    """A planted conjunction is learned, and pruning keeps noise out."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        stats = draw.random(len(quality_rules.STATS)).tolist()
        rows.append((*stats, bool(stats[2] > 0.7 and stats[5] > 0.6), i % 3 == 0))
    names = ", ".join(f"{s} double" for s in quality_rules.STATS)
    rules = quality_rules.learn(spark.createDataFrame(rows, f"{names}, _bad boolean, _prune boolean")).rules
    first = {(c.stat, c.above) for c in rules[0]}
    assert first <= {("symbol_share", True), ("upper_share", True)} and len(first) == 2


def test_no_labels_no_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels)
    assert got.where("rule <> 0").count() == 0
    assert quality_rules.quality_rules(nothing, labels).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) if 12 <= len(digits) <= 19 else 1
                if total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x@y z@-.- é@b.com a..@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (212) 555-0100 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49 30 123456)", "\U0001f600\U0001f600 a@b.co \U0001f600 1.1.1.1", "@a.b a@.b +a 1-2-3", "",
]


def test_personal_data(spark, docs):
    short = docs.where("text is null or length(text) < 40000")
    more = spark.createDataFrame([(9500 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    df = short.select("doc_id", "text").unionByName(more)
    got = pii.find_spans(df).collect()
    want = [(i, plain_base(t)) for i, t in texts(df)]
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(((i, hashlib.sha256(b.encode()).hexdigest()) for i, b in want), key=str)
    count = {}
    for i, b in want:
        count.setdefault(i, []).append(b)
    for r in got:
        if len(count[r["doc_id"]]) == 1:
            base = count[r["doc_id"]][0]
            assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
            assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]


def test_long_runs_are_found_in_linear_time(edges):
    got = {r["doc_id"]: r for r in pii.find_spans(edges).collect()}
    assert (got[9009]["n_email"], got[9009]["n_ip"], got[9009]["n_phone"]) == (1, 1, 1)
    assert got[9013]["n_email"] == 1


def test_masking(spark, edges, nothing):
    df = spark.createDataFrame([(1, "mail a@b.com, host 1.2.3.4."), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r["text"] for r in pii.mask_documents(df).orderBy("doc_id").collect()] == ["mail [EMAIL], host [IP].", None, "clean"]
    assert pii.mask_documents(edges).columns == edges.columns and pii.mask_documents(nothing).count() == 0
    assert pii.find_spans(nothing).count() == 0


def test_expectation_maximisation_finds_the_reliable_labeler():
    draw = np.random.default_rng(6)
    counts = {}
    for _ in range(4000):
        truth = draw.random() < 0.4
        votes = tuple(int(truth if draw.random() < p else not truth) for p in (0.95, 0.9, 0.55, 0.85, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    rates, prior, _ = pii.expectation_maximisation(sorted(counts.items()))
    assert prior == pytest.approx(0.4, abs=0.05)
    assert [round(t, 1) for t, _ in rates] == pytest.approx([0.9, 0.9, 0.6, 0.8, 0.6], abs=0.11)


def plain_phrases(text, sample):
    at, count = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    draw = np.random.default_rng(7)
    line = lambda n, top: draw.integers(2, top, n).astype(np.uint8)
    samples = [line(400, 5), line(300, 7)]
    docs = [line(n, 8) for n in (0, 1, 5, 200, 77)]
    got = langid.phrases(np.concatenate(docs), np.asarray([len(d) for d in docs]), [langid.move_table(s) for s in samples])
    want = [[plain_phrases(bytes(d), bytes(s)) for d in docs] for s in samples]
    assert got.tolist() == want


def test_languages(spark, docs, edges, nothing):
    out = QUERIES["op4_language_id"](spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    got = langid.language_query(docs).collect()
    by = {r["doc_id"]: r for r in got}
    learned = {r["lang"] for r in docs.select("lang").distinct().collect()}
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in learned or r["lang_pred"] == "und")
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (9001, 9002, 9003))
    model = langid.learn(docs, F.lit(True))
    kept = langid.accepted(edges, model)
    assert kept.columns == edges.columns and {9001, 9002, 9003}.isdisjoint(r["doc_id"] for r in kept.select("doc_id").collect())
    empty = langid.learn(nothing, F.lit(True))
    assert langid.identify(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edges, empty).collect()} == {"und"}


def test_marginals_are_those_of_all_labelings():
    draw = np.random.default_rng(8)
    lines, trans = np.asarray([3, 1, 5]), draw.normal(size=(2, 2))
    score = draw.normal(size=9)
    got, expected = linecrf.marginals(score, lines, trans)
    at = 0
    for d, n in enumerate(lines.tolist()):
        total, good, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(score[at + i] * y for i, y in enumerate(labels)) + sum(trans[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.asarray(labels)
            for a, b in itertools.pairwise(labels):
                moves[a, b] += weight
        assert got[at:at + n] == pytest.approx(good / total) and expected[d] == pytest.approx(moves / total)
        at += n


def test_line_quality(spark, docs, edges, nothing):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    out = QUERIES["op6_quality_classifier"](spark, LABELLED).join(labels, "doc_id").where("held_out").collect()
    good = np.asarray([r["score"] for r in out if r["quality"] == 1])
    bad = np.asarray([r["score"] for r in out if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    scores = linecrf.quality_query(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scores)
    none = linecrf.learn(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in linecrf.quality(edges, none).collect()} == {0.5}
    assert linecrf.quality(nothing, none).count() == 0


def test_labels_without_a_document_take_no_place(spark):
    rows = [(i, f"good line number {i}\nand one more of them" if i % 2 else "$$ ## buy now\n$$ ##") for i in range(40)] + [(100 + i, "x " * 200) for i in range(20)]
    docs = spark.createDataFrame([*rows, (7, "aaa of one id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1000 + i, 1) for i in range(5000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    seen = {}
    plain = linecrf.fit

    def fit(texts, marks, **more):
        seen["texts"], seen["marks"] = texts, marks
        return plain(texts, marks, **more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(linecrf, "fit", fit)
        linecrf.learn(docs, labels, F.lit(True), sample=30, longest=100)
    assert len(seen["texts"]) == 30 and np.bincount(seen["marks"]).tolist() == [15, 15]
    assert all(len(t) <= 100 for t in seen["texts"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(linecrf, "fit", fit)
        linecrf.learn(docs, labels.where("quality = 1 or doc_id < 4"), F.lit(True), sample=30, longest=100)
    assert np.bincount(seen["marks"]).tolist() == [2, 20] and b"aaa of one id" in seen["texts"]


def luhn_number(draw, right):
    digits = [4, *draw.integers(0, 10, 14).tolist()]
    double = sum(sum(divmod(d * 2, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
    last = (-double) % 10
    text = "".join(map(str, [*digits, last if right else (last + 1) % 10]))
    return ".".join(text[i:i + 4] for i in range(0, 16, 4))


def planted_spans():
    """(text, value or None, kind): loose forms that are personal data, and forms that only look so."""
    draw = np.random.default_rng(11)
    some = lambda a, b: int(draw.integers(a, b))
    names, hosts = ["jane.doe", "bob", "k_miller", "sales7"], ["example", "mail-host", "acme"]
    out = []
    for i in range(40):
        name, host, end = names[i % 4], hosts[i % 3], ["com", "org", "net", "de"][i % 4]
        number = [f"{some(200, 999)}-{some(200, 999)}-{some(1000, 9999)}", f"({some(200, 999)}) {some(200, 999)}-{some(1000, 9999)}"][i % 2]
        six = ":".join(f"{some(4096, 65535):x}" for _ in range(8))
        out += [
            (f"please write an email to {name} at {host} dot {end} today", f"{name} at {host} dot {end}", "email"),
            (f"contact {name} [at] {host} [dot] {end} or wait", f"{name} [at] {host} [dot] {end}", "email"),
            (f"you can call {number} before noon", number, "phone"),
            (f"her phone {number}, mornings only", number, "phone"),
            (f"the server {six} answered late", six, "ip"),
            *[(f"paid with card {n} last week", n, "card") for n in [luhn_number(draw, True)]],
            (f"we look at the dot plot number {i}", None, "email"),
            (f"they meet at noon dot then they go home {i}", None, "email"),
            (f"it was on 20{some(10, 24)}-0{some(1, 9)}-1{some(0, 9)} that we left", None, "phone"),
            (f"order {some(100, 999)}-{some(100, 999)}-{some(100, 999)} was sent", None, "phone"),
            (f"a box of {some(10, 99)} {some(10, 99)} {some(10, 99)} cm in size", None, "phone"),
            (f"the key {':'.join(f'{some(16, 255):02x}' for _ in range(8))} is old", None, "ip"),
            (f"part no {luhn_number(draw, False)} in stock", None, "card"),
            (f"card {luhn_number(draw, False)} was wrong", None, "card"),
            (f"email {name}{i}@{host}.{end} from {some(1, 223)}.{some(0, 255)}.7.{i} call +1 {some(200, 999)} 555 0{some(100, 199)}", None, "strict"),
            (f"version {some(1, 9)}.{some(300, 999)}.{i}.7 of the card 4{some(10**14, 10**15 - 1)}", None, "strict"),
        ]
    return out


def test_added_spans_of_planted_forms(spark):
    """Precision and recall of what the classifier adds to the valid strict matches."""
    planted = planted_spans()
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.find_spans(df).collect():
        text, value, kind = planted[r["doc_id"]]
        base = set(filter(None, plain_base(text).split(",")))
        added = set(filter(None, r["spans"].split(","))) - base
        want = {f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"} if value else set()
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
        assert base <= set(r["spans"].split(",")) | {""}
    assert right + missed == 240
    assert right / (right + missed) >= 0.95 and right / max(1, right + wrong) >= 0.95, (right, wrong, missed)


def test_what_cannot_be_true_is_never_added(spark):
    """Also not where everything speaks for it and the table holds nothing else."""
    df = spark.createDataFrame([(i, f"pay by visa card 4111 1111 1111 111{i % 9 + 2} or from ip 1.2.3.{256 + i}") for i in range(9)], "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        assert r["n_card"] == r["n_ip"] == 0 and "card" not in r["spans"] and "ip" not in r["spans"]


def test_known_candidates_hold_the_estimates_off_their_ends():
    counts = [((1, 1), 500), ((0, 0), 40), ((1, None), 30), ((0, 1), 20)]
    rates, prior, post = pii.expectation_maximisation(counts, [1.0, 0.0, None, None], [(0.8, 0.3), (0.7, 0.4)])
    assert post[:2] == [1.0, 0.0] and post[2] > 0.9 > post[3]  # one for and one against stays undecided
    assert 0.85 < prior < 0.98 and rates[0][0] > 0.9 and rates[0][1] < 0.2 and rates[1][1] < 0.4
