"""Personal data by weak supervision, in Spark expressions only.

Candidates are the matches of strict patterns, valid or not, and of looser ones, which also match dates, serial numbers, fingerprints and
plain sentences. Labelers vote on each: a check (Luhn, where a looser form has one), a gazetteer, the words around it, its borders, the
shape of its digits, and the form that found it; each says yes, no or nothing. Valid strict matches are known to be true, addresses with
parts over 255 and cards that fail Luhn are known to be false and are never added; all others are hidden.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each pattern's probability, first over all
kinds together, then per kind, drawn to what was found for all. These soft labels train the final classifier, naive Bayes over a
candidate's own features, which is emitted as a Spark expression. Valid strict matches always count; the classifier adds to them.

Matches and their places come from one regular expression each: ``regexp_extract_all`` gives the matches,
``split`` the text between them, and a running sum of their lengths gives code point offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import stored, whole_text

# -- fixed values: kinds and strict patterns of the contract ----------------------------------------
KINDS = ("email", "ip", "card", "phone")
# Possessive and with a look-behind that lets a run be tried at its start (or where the last match ended) only:
# the matches are those of the plain patterns, but long runs cost linear time and no stack.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# ----------------------------------------------------------------------------------------------------
#: Cheap tests that a text must pass to hold a match at all.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){5}", "phone": r"\+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:\.| ?[\[(]dot[\])] ?| dot )| at [A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?| dot ))"
             r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}){0,7}+",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?![0-9]|[.-][0-9])",
}
LOOSE_NEEDS = {
    "email": r"[\[(]at[\])]| at [A-Za-z0-9-]{1,63}(?: ?[\[(]dot| dot )", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]", "card": r"[0-9]{4}[./_][0-9]{4}[./_]",
    "phone": r"[0-9)][ .-][0-9]{2,4}[ .-][0-9]{2,4}(?![0-9])",
}
#: Gazetteer: what a kind's value ends or begins with.
KNOWN = {
    "email": r"(?i)(?:\.|\bdot[\])]? ?)(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|uk|us|ca|ch|at|be|nl|pl|pt|mx|ar|br|in|jp|cn|ru|example|test)$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|:",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Words that announce a kind, and words that announce some other number.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|courriel|adresse|write to|schreib)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|from|client)\b",
    "card": r"(?i)(?:card|visa|master|amex|carte|karte|tarjeta|payment|iban)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|handy|cell|whatsapp|ruf|appel|llam)",
}
OTHER = r"(?i)(?:isbn|issn|order|invoice|serial|version|part no|item|sku|doi|build|rev\.?|commit|sha|key)[^\n]{0,12}$"
#: Units after a number, and shapes that belong to something else: a date, a fingerprint in pairs.
UNITS = r"^ ?(?:px|kg|km|cm|mm|ms|[KMGT]i?B|%|\u20ac|\$|EUR|USD)(?![A-Za-z])"
NOT_A = {
    "email": r"(?i)^(?:look|meet|arrive|stay|is|was|be|are|were|stop|start|end)\b",
    "ip": r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+$",
    "card": r"^0",
    "phone": r"^(?:(?:19|20)[0-9]{2}[ .-](?:0[1-9]|1[0-2])[ .-][0-3][0-9]|[0-3]?[0-9][ .-][0-3]?[0-9][ .-](?:19|20)[0-9]{2})$",
}
VOTES = ("check", "gazetteer", "context", "border", "shape", "form")
FEATURES = ("f_digits", "f_marks", "f_cue", "f_border", "f_known", "f_shape", "f_form")
CONTEXT = 40
AFTER = 8


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array of (start, end, value, before, after): leftmost matches that don't overlap; offsets in code points."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def placed(found: Column) -> Column:
        rows = F.transform(found["m"], lambda m, i: F.struct(m.alias("m"), found["p"].getItem(i).alias("p"), found["p"].getItem(i + 1).alias("q")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(s: Column, r: Column) -> Column:
            begin = s["at"] + F.length(r["p"])
            end = begin + F.length(r["m"])
            item = F.struct(begin.alias("start"), end.alias("end"), r["m"].alias("value"), F.right(r["p"], F.lit(CONTEXT)).alias("before"), F.left(r["q"], F.lit(AFTER)).alias("after"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

        return F.aggregate(rows, start, step, lambda s: s["out"])

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(needs), _let(found, placed)).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(places, F.lit(0), lambda s, i: s + _let(
        F.substring(F.reverse(number), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The strict check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    count = F.length(digits(value))
    if kind == "phone":
        return count.between(9, 15)
    return F.when(count.between(12, 19), luhn(digits(value))).otherwise(False)


def described(kind: str, strict: bool, m: Column) -> Column:
    """A candidate: kind, place, whether it is a valid strict match (``base``) or cannot be true (``never``), votes (1 yes, 0 no, null nothing) and features."""
    count = F.length(digits(m["value"]))
    marks = F.length(F.regexp_replace(m["value"], "[A-Za-z0-9]", ""))
    letter_before, letter_after = m["before"].rlike(r"[\p{L}0-9_/=#]$"), m["after"].rlike(r"^[\p{L}0-9_/=]")
    border = ~(letter_before | letter_after)
    cue = F.when(m["before"].rlike(OTHER) | m["after"].rlike(UNITS), 0).when(m["before"].rlike(CUES[kind]), 1)
    known = m["value"].rlike(KNOWN[kind]).cast("int")
    typical = {"email": count <= 12, "ip": count.between(4, 32), "card": count.between(13, 16), "phone": count.between(10, 12)}[kind]
    flat = m["value"].rlike(r"^[^0-9]*+([0-9])(?:[^0-9]*+\1)++[^0-9]*+$")
    right = valid(kind, m["value"]) if strict or kind == "card" else F.lit(None).cast("boolean")
    never = ~right if kind in ("ip", "card") and (strict or kind == "card") else F.lit(False)
    shape = F.when(flat | m["value"].rlike(NOT_A[kind]), 0).when(typical, 1).when(F.lit(kind == "phone"), 0).cast("int")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (right if strict else F.lit(False)).alias("base"), never.alias("never"),
        right.cast("int").alias("check"), known.alias("gazetteer"), cue.cast("int").alias("context"),
        border.cast("int").alias("border"), shape.alias("shape"), F.lit(int(strict)).alias("form"),
        F.least(count / 3, F.lit(7)).cast("int").alias("f_digits"), F.least(marks, F.lit(5)).cast("int").alias("f_marks"),
        F.coalesce(cue.cast("int"), F.lit(2)).alias("f_cue"), border.cast("int").alias("f_border"), known.alias("f_known"),
        F.coalesce(shape, F.lit(2)).alias("f_shape"), F.lit(int(strict)).alias("f_form"),
    )


def candidates(text: Column) -> Column:
    """All candidates of a text, as an array."""
    describe = lambda kind, strict: lambda m: described(kind, strict, m)
    found = [F.transform(matches(text, STRICT[k], NEEDS[k]), describe(k, True)) for k in KINDS]
    found += [F.transform(matches(text, LOOSE[k], LOOSE_NEEDS[k]), describe(k, False)) for k in LOOSE]
    return F.concat(*found)


# -- learning ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SpanModel:
    """``reliability[kind][labeler]``: P(yes | true), P(yes | false) among votes given; naive Bayes log odds per kind and feature value."""

    reliability: tuple
    prior: tuple[float, ...]
    odds: tuple

    def probability(self, c: Column) -> Column:
        """The classifier's probability for a candidate, as an expression over its features."""
        total = None
        for k in range(len(KINDS)):
            score = F.lit(self.prior[k])
            for name, table in zip(FEATURES, self.odds[k], strict=True):
                case = F.lit(0.0)
                for value, weight in reversed(table):
                    case = F.when(c[name] == value, weight).otherwise(case)
                score = score + case
            total = F.when(c["kind"] == k, score) if total is None else total.when(c["kind"] == k, score)
        return 1 / (1 + F.exp(-total))


def expectation_maximisation(
    counts: list[tuple[tuple, int]], known: list[float | None] | None = None, drawn_to: list[tuple[float, float]] | None = None, rounds: int = 60,
) -> tuple[list[tuple[float, float]], float, list[float]]:
    """(P(yes | true), P(yes | false)) per labeler, P(true), and P(true) of each vote pattern.

    ``counts``: vote patterns with their number; a vote is 1, 0 or None. ``known``: P(true) of patterns where it is no question.
    Estimates start where yes is more likely for true ones, and are held by two imaginary votes per labeler and class, or by
    twenty that vote as ``drawn_to`` says. P(true) is held by one imaginary candidate of each class.
    """
    labelers = len(counts[0][0]) if counts else len(VOTES)
    known = known or [None] * len(counts)
    weight, held = (20, drawn_to) if drawn_to else (2, [(0.8, 0.3)] * labelers)
    rates, prior, post = held, 0.5, [0.5] * len(counts)
    for _ in range(rounds):
        for i, (votes, _n) in enumerate(counts):
            odds = math.log(prior / (1 - prior))
            for v, (t, f) in zip(votes, rates, strict=True):
                if v is not None:
                    odds += math.log(t / f) if v else math.log((1 - t) / (1 - f))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if known[i] is None else known[i]
        new = []
        for j, (t, f) in enumerate(held):
            given = [(p, n, votes[j]) for (votes, n), p in zip(counts, post, strict=True) if votes[j] is not None]
            true, false = sum(p * n for p, n, _ in given), sum((1 - p) * n for p, n, _ in given)
            new.append(((sum(p * n for p, n, v in given if v) + weight * t) / (true + weight), (sum((1 - p) * n for p, n, v in given if v) + weight * f) / (false + weight)))
        total = sum(n for _, n in counts)
        rates, prior = new, (sum(p * n for (_, n), p in zip(counts, post, strict=True)) + 1) / (total + 2)
    return rates, prior, post


def learn(found: DataFrame) -> SpanModel:
    """Reliabilities and classifier from a table with an array ``candidates``.

    One aggregation counts votes and features; the driver sees its groups: their number is bounded by the values that votes and features take, whatever the input.
    """
    fields = ["kind", "base", "never", *VOTES, *FEATURES]
    rows = found.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in fields]).count().collect()
    key = lambda r: (r["base"], r["never"], tuple(r[v] for v in VOTES))

    def estimate(mine: list, drawn_to: list | None) -> tuple:
        patterns: dict[tuple, int] = {}
        for r in mine:
            patterns[key(r)] = patterns.get(key(r), 0) + r["count"]
        ordered = sorted(patterns, key=lambda x: (*x[:2], *(-1 if v is None else v for v in x[2])))
        # whether a strict match is true is known by its check, so the check tells nothing of other labelers: it votes on looser forms only
        votes = lambda x: (None if x[0] or x[1] else x[2][0], *x[2][1:])
        known = [1.0 if base else 0.0 if never else None for base, never, _ in ordered]
        rates, share, post = expectation_maximisation([(votes(x), patterns[x]) for x in ordered], known, drawn_to)
        return rates, share, dict(zip(ordered, post, strict=True))

    pooled = estimate(rows, None)[0]
    reliability, prior, odds = [], [], []
    for k in range(len(KINDS)):
        mine = [r for r in rows if r["kind"] == k]
        rates, share, soft = estimate(mine, pooled)
        tables = []
        for name in FEATURES:
            true: dict[int, float] = {}
            false: dict[int, float] = {}
            for r in mine:
                p = soft[key(r)]
                true[r[name]] = true.get(r[name], 0.0) + p * r["count"]
                false[r[name]] = false.get(r[name], 0.0) + (1 - p) * r["count"]
            width, all_true, all_false = len(true), sum(true.values()), sum(false.values())
            tables.append(tuple((v, math.log((true[v] + 1) / (all_true + width)) - math.log((false[v] + 1) / (all_false + width))) for v in sorted(true)))
        reliability.append(tuple(rates))
        prior.append(math.log(share / (1 - share)))
        odds.append(tuple(tables))
    return SpanModel(tuple(reliability), tuple(prior), tuple(odds))


# -- results ------------------------------------------------------------------------------------------------------


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))


def base_spans(found: Column) -> Column:
    """Valid strict matches as (start, kind, end), by start, then kind."""
    return _ordered(F.filter(found, lambda c: c["base"]))


def all_spans(found: Column, model: SpanModel, least: float = 0.9) -> Column:
    """Base spans, and candidates of probability ``least`` or more that overlap none of them, nor an added one before."""
    base = F.filter(found, lambda c: c["base"])
    more = F.filter(found, lambda c: ~c["base"] & ~c["never"] & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & (model.probability(c) >= least))
    kind = "array<struct<start:int,kind:int,end:int>>"
    kept = F.aggregate(_ordered(more), F.array().cast(kind), lambda s, c: F.when(F.exists(s, lambda x: c["start"] < x["end"]), s).otherwise(F.concat(s, F.array(c))))
    return F.array_sort(F.concat(base_spans(found), kept))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        more = F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), names[x["kind"]])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["parts"], more)).otherwise(s["parts"]).alias("parts"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``candidates`` of every row, written once. A null text is empty."""
    return stored(docs.select(F.col(id_col), candidates(whole_text(text_col)).alias("candidates")), "pii_candidates")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row: id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as text), spans (all, as text).

    Null and empty texts have none. Rows with the same id keep a row each. Very long runs of digits or
    name characters cost linear time. An empty table gives an empty result; with no candidates nothing is learned.
    """
    found = find_candidates(docs, id_col, text_col)
    model = learn(found)
    of_kind = lambda k: lambda c: c["base"] & (c["kind"] == k)
    counts = [F.size(F.filter("candidates", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = written(base_spans(F.col("candidates")))
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), written(all_spans(F.col("candidates"), model)).alias("spans"))


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the personal data in the text masked; a null text stays null."""
    model = learn(docs.select(candidates(whole_text(text_col)).alias("candidates")))
    text = F.col(text_col)
    # candidates are found once, and so are spans
    new = _let(candidates(whole_text(text_col)), lambda c: _let(all_spans(c, model), lambda s: masked(text, s)))
    return docs.withColumn(text_col, F.when(text.isNotNull(), new))
