"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Sequential covering learns rules for bad documents one at a time. A rule grows on two thirds of
the labelled rows, condition by condition, by information gain; it is pruned on the last third, back to the
prefix that is most precise there; rows it covers are taken out and the next rule is grown. Each step is one
aggregation of the labelled statistics into histograms over (statistic, bin), so the driver sees bins only. The
list is emitted as ordered ``CASE WHEN`` conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import SPACE_CHARS, stored, whole_text

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Statistics the rules may use: the base ones as shares, and some of characters.
STATS = ("words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "stop_share", "words_per_line")
BINS = 24


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    plain = F.btrim(F.translate(text, SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1)))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only where some repeat are they sorted: equal neighbours
    are repeats, and the words they cover are counted from the sorted starts, each start up to the next.
    """
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def covered(sorted_: Column) -> Column:
        size = F.size(sorted_)

        def repeats(x: Column, i: Column) -> Column:
            before = F.when(i > 0, sorted_.getItem(F.greatest(i - 1, F.lit(0)))["h"] == x["h"]).otherwise(False)
            after = F.when(i < size - 1, sorted_.getItem(F.least(i + 1, size - 1))["h"] == x["h"]).otherwise(False)
            return before | after

        starts = F.array_sort(F.transform(F.filter(sorted_, repeats), lambda x: x["at"]))
        return _let(starts, lambda s: F.aggregate(
            s, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]))

    def count(h: Column) -> Column:
        lined = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(lined, covered)).otherwise(0)

    return F.coalesce(_let(hashes, lambda h: F.when(h.isNull(), 0).otherwise(count(h))), F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics and character counts of every row. A null text has none."""
    text = whole_text(text_col)
    counted = docs.select(F.col(id_col), _let(F.struct(words_of(text).alias("words"), text.alias("text")), lambda v: _let(
        F.filter(F.split(v["text"], "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0),
        lambda lines: F.struct(
            F.size(v["words"]).cast("long").alias("n_words"),
            F.length(F.translate(v["text"], SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(v["text"]) - F.length(F.translate(v["text"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(v["words"]).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            *[F.regexp_count(v["text"], F.lit(p)).cast("long").alias(n) for n, p in (("upper", r"\p{Lu}++"), ("digits", "[0-9]++"), ("bangs", "!"), ("stops", r"[.?!](?=\s|$)"))],
        ))).alias("s"))
    return counted.select(id_col, "s.*")


def features() -> dict[str, Column]:
    """The rules' statistics, from a row of ``statistics``."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("upper") / words,
        "digit_share": F.col("digits") / words, "bang_share": F.col("bangs") / words, "stop_share": F.col("stops") / words, "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def holds(self, of) -> Column:
        return of(self.stat) > self.threshold if self.above else of(self.stat) <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction that says bad; what none covers is good."""

    rules: tuple[tuple[Condition, ...], ...]

    def number(self, of) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        case = None
        for i, rule in enumerate(self.rules, 1):
            holds = reduce(lambda a, b: a & b, [c.holds(of) for c in rule])
            case = F.when(holds, i) if case is None else case.when(holds, i)
        return F.lit(0) if case is None else case.otherwise(0)

    def __str__(self) -> str:
        return "\n".join([f"if {' and '.join(map(str, rule))} then bad" for rule in self.rules] + ["else good"])


def _holds(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.holds(F.col) for c in rule], F.lit(True))


def _best(rows: list, cuts: dict[str, list[float]], rule: list[Condition], least: int) -> Condition | None:
    """The condition of most information gain (FOIL), from bins (stat, bin, bad, good); ties go to the first statistic and threshold."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(STATS[r["stat"]], {})[r["bin"]] = (r["bad"], r["good"])
    best, most = None, 1e-9
    for stat in STATS:
        bins = by.get(stat, {})
        bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
        if not bad:
            continue
        now = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for i, cut in enumerate(cuts[stat]):
            b, g = bins.get(i, (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for above, (p, n) in ((True, (bad - low_bad, good - low_good)), (False, (low_bad, low_good))):
                if p >= least and (gain := p * (math.log2(p / (p + n)) - now)) > most:
                    # rows above lie beyond the gap to the next threshold, so its middle parts them more safely
                    ahead = cuts[stat][i + 1] if above and i + 1 < len(cuts[stat]) else cut
                    best, most = Condition(stat, above, (cut + ahead) / 2), gain
    return best


def tightest(rule: list[Condition]) -> list[Condition]:
    """The rule without conditions that another on the same side of the same statistic implies."""
    edge = {(c.stat, c.above): (max if c.above else min)(o.threshold for o in rule if (o.stat, o.above) == (c.stat, c.above)) for c in rule}
    return [Condition(stat, above, threshold) for (stat, above), threshold in edge.items()]


def learn(labelled: DataFrame, rules: int = 8, conditions: int = 3, precision: float = 0.9, least: int = 5) -> DecisionList:
    """A decision list from all rows of ``labelled`` (the columns STATS, ``_bad`` boolean, ``_prune`` boolean).

    Thresholds are the quantiles of the bad rows and of all rows. A rule needs ``least`` bad rows to grow and
    ``precision`` on the pruning rows to stay; learning stops with the first that has not, or after ``rules``.
    """
    points = [i / BINS for i in range(1, BINS)]
    quantiles = labelled.agg(*[F.percentile_approx(F.when(F.col("_bad") == side, F.col(s)), points, 5000).alias(f"{s}_{side}") for s in STATS for side in (True, False)]).first()
    cuts = {s: sorted({float(q) for side in (True, False) for q in (quantiles[f"{s}_{side}"] or [])}) for s in STATS}
    bins = F.array(*[F.struct(F.lit(i).alias("stat"), sum((F.when(F.col(s) > c, 1).otherwise(0) for c in cuts[s]), F.lit(0)).alias("bin")) for i, s in enumerate(STATS)])
    # a row per labelled row and statistic, written once: each step filters and counts it
    binned = stored(labelled.select(*STATS, "_bad", "_prune", F.explode(bins).alias("b")), "rule_bins")
    done: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(done) < rules:
        rule: list[Condition] = []
        while len(rule) < conditions:
            open_ = binned.where(left & ~F.col("_prune") & _holds(rule))
            rows = open_.groupBy("b.stat", "b.bin").agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good")).collect()
            if not any(r["good"] for r in rows) or (found := _best(rows, cuts, rule, least)) is None:
                break
            rule.append(found)
        if not rule:
            break
        held = [_holds(rule[:i]) for i in range(1, len(rule) + 1)]
        counts = binned.where(left & F.col("_prune") & (F.col("b.stat") == 0)).agg(*[F.count_if(h & F.col("_bad")).alias(f"bad{i}") for i, h in enumerate(held)], *[F.count_if(h & ~F.col("_bad")).alias(f"good{i}") for i, h in enumerate(held)]).first()
        worth = [((counts[f"bad{i}"] - counts[f"good{i}"]) / max(1, counts[f"bad{i}"] + counts[f"good{i}"]), -i) for i in range(len(held))]
        value, length = max(worth)
        length = 1 - length
        if (value + 1) / 2 < precision or not counts[f"bad{length - 1}"]:
            break
        done.append(tuple(tightest(rule[:length])))
        left = left & ~_holds(rule[:length])
    return DecisionList(tuple(done))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    ``base_failed``: under 20 words, or over 30 % of them repeated. ``rule``: the first learned rule that holds, 0 if none. All
    labelled rows that pass the base are learned from; rows without a label, or with a null id, are judged only. A null or empty text fails the base. Rows
    with the same id keep a row each. Without labels the list is empty and base decides. An empty table gives an empty result.
    """
    stats = stored(statistics(docs, id_col, text_col), "text_statistics")
    named = features()
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad")).distinct()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    known = stats.where(~failed).join(marks, F.col(id_col) == F.col("_id")).select(*[c.alias(n) for n, c in named.items()], "_bad", (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("_prune"))
    rules = learn(known)
    judged = stats.withColumns({"base_failed": failed, "rule": rules.number(named.__getitem__)})
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
