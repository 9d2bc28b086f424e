"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and, shifted, the lines before and after it; the
chain's transitions tie neighbours together. Forward-backward gives each line's probability of being good;
their mean, weighted by length, is the document's quality. Weights are fitted by gradient ascent on the
conditional likelihood of labelled documents, whose label all their lines carry.

Features come from counts of character classes per line, computed for a whole batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import map_batches, stored, whole_text

#: Character classes that are counted: letters a-z, capitals, digits, blanks, stops, exclamation, symbols, pipes, other marks, non-ASCII.
CLASSES = 10
SYMBOLS = b"#*$%&<>"
#: Thresholds that turn shares and lengths into indicators; a line model stays linear in them.
SHARES = (0.01, 0.03, 0.1, 0.3)
LENGTHS = (1, 4, 12, 40, 150)
OWN = 1 + CLASSES * len(SHARES) + len(LENGTHS) * 2 + 4 + 2
#: Bytes of text handled at a time, which bounds a worker's memory.
AT_ONCE = 2_000_000


def class_table() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[ord("a"):ord("z") + 1] = 0
    table[ord("A"):ord("Z") + 1] = 1
    table[ord("0"):ord("9") + 1] = 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[list(b".,;:")] = 4
    table[ord("!")] = 5
    table[list(SYMBOLS)] = 6
    table[ord("|")] = 7
    table[128:] = 9
    return table


TABLE = class_table()


def repeated_words(data: np.ndarray, begins: np.ndarray, blank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words per line that equal the word before them in the line, by a rolling checksum modulo 2**64."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.full(len(data), base, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * power)])
    word = np.flatnonzero(begins)
    stop = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))  # each line ends in a blank
    back = np.cumprod(np.full(len(data), inverse, np.uint64))
    code = (total[stop] - total[word]) * back[word]
    line = np.searchsorted(ends, word, side="left")
    echo = np.zeros(len(word), bool)
    echo[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    return np.bincount(line[echo], minlength=len(ends))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line with a word, its length in bytes, and the number of such lines per text.

    A text without any has one empty line of weight 1, so that it gets a score too.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = TABLE[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    per_text = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), per_text)
    length = ends - starts
    counts = np.zeros((len(ends), CLASSES), np.int64)
    for c in range(CLASSES):
        total = np.concatenate([[0], np.cumsum(kind == c)])
        counts[:, c] = total[ends] - total[starts]
    blank = kind == 3
    begins = ~blank
    begins[1:] &= blank[:-1]
    total = np.concatenate([[0], np.cumsum(begins)])
    words = total[ends] - total[starts]
    echoes = repeated_words(data, begins, blank, starts, ends)
    has = words > 0
    none = np.bincount(doc[has], minlength=len(texts)) == 0
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    keep = has | (none[doc] & first)
    same = np.zeros(len(ends), bool)
    if len(ends) > 1:
        alike = (length[1:] == length[:-1]) & (doc[1:] == doc[:-1]) & (counts[1:] == counts[:-1]).all(axis=1) & has[1:]
        for i in np.flatnonzero(alike):
            same[i + 1] = bytes(data[starts[i]:ends[i]]) == bytes(data[starts[i + 1]:ends[i + 1]])
    doc, length, counts, words, same, echoes = doc[keep], length[keep], counts[keep], words[keep], same[keep], echoes[keep]
    size = np.maximum(length, 1)
    share = counts / size[:, None]
    mean = (length - counts[:, 3]) / np.maximum(words, 1)
    columns = [np.ones(len(doc)), *((share > s).astype(float)[:, c] for c in range(CLASSES) for s in SHARES)]
    columns += [(words > w).astype(float) for w in LENGTHS]
    columns += [(mean > m).astype(float) for m in (3, 4.5, 6, 8, 12)]
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    columns += [(echoes > e * words).astype(float) for e in (0.05, 0.4)]
    columns += [same.astype(float), (upper > 0.5).astype(float), (counts[:, 4] == 0).astype(float), share[:, 0]]
    return np.column_stack(columns) if len(doc) else np.zeros((0, OWN)), size, np.bincount(doc, minlength=len(texts))


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), and which lines are ends."""
    n = len(own)
    doc = np.repeat(np.arange(len(lines)), lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        inside = (doc[1:] == doc[:-1])[:, None]
        before[1:] = own[:-1] * inside
        after[:-1] = own[1:] * inside
    return np.hstack([own, before, after])


def marginals(score: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and per text the expected transitions (texts, 2, 2).

    ``score`` is a line's log odds for good; ``trans`` scores (from, to). All texts go in step, the longest first.
    """
    order = np.argsort(-lines, kind="stable")
    size, start = lines[order], (np.cumsum(lines) - lines)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    up, move = 1 / (1 + np.exp(-np.clip(score, -50, 50))), np.exp(trans)
    emit = np.column_stack([1 - up, up])
    forward, norm = np.zeros((len(score), 2)), np.ones(len(score))
    for t in range(longest):
        at = start[: active[t]] + t
        a = emit[at] * (forward[at - 1] @ move if t else 0.5)
        norm[at] = a.sum(axis=1)
        forward[at] = a / norm[at][:, None]
    backward, expected = np.ones((len(score), 2)), np.zeros((len(lines), 2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1] / norm[at + 1][:, None]
        expected[order[: active[t + 1]]] += forward[at][:, :, None] * move[None] * ahead[:, None, :]
        backward[at] = ahead @ move.T
    good = forward * backward
    return good[:, 1] / good.sum(axis=1), expected


@dataclass(frozen=True)
class LineModel:
    """Weights of the features for good, and transition scores (from, to)."""

    weights: np.ndarray
    trans: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        own, size, lines = line_features(texts)
        good, _ = marginals(with_neighbours(own, lines) @ self.weights, lines, self.trans)
        doc = np.repeat(np.arange(len(lines)), lines)
        mean = np.bincount(doc, weights=good * size, minlength=len(lines)) / np.bincount(doc, weights=size, minlength=len(lines))
        return np.clip(mean, 0.0, 1.0)


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> LineModel:
    """Gradient ascent (Adam) on the mean conditional log likelihood per document; labels 1 good, 0 bad."""
    own, _, lines = line_features(texts)
    x = with_neighbours(own, lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    y = labels[doc].astype(float)
    weights, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (lines[labels == label] - 1).sum()
    each = 1 / np.maximum(lines, 1)[doc]
    theta, m, v = np.zeros(len(weights) + 4), 0.0, 0.0
    for i in range(1, rounds + 1):
        weights, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected = marginals(x @ weights, lines, trans)
        slope = np.concatenate([x.T @ ((y - good) * each), ((seen - expected.sum(axis=0)) / max(1, lines.mean())).ravel()]) / max(1, len(lines)) - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    theta[-4:] = np.clip(theta[-4:], -6, 6)
    return LineModel(theta[:-4], theta[-4:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 3_000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, those with the least hash of the id, of up to ``longest`` characters.

    Labels without such a document, and rows with a null id or label, are left out before the sample is drawn, so they take nobody's
    place. Half of the sample is kept for each label (0 and 1), as far as
    there are rows. Of several texts under one id the least counts. Without any usable row the model says 0.5 to everything.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).where(F.length("_text") <= longest)
    marks = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    there = stored(marks.distinct().join(rows.select("_id"), "_id", "left_semi"), "line_labels")
    first = [F.xxhash64("_id"), F.col("_id"), F.col("_label")]
    sizes = {r["_label"]: r["count"] for r in there.groupBy("_label").count().collect()}
    chosen = None
    for label, n in sorted(sizes.items()):
        others = sum(min(m, sample // 2) for k, m in sizes.items() if k != label)
        some = there.where(F.col("_label") == label).orderBy(*first).limit(min(n, max(sample // 2, sample - others)))
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return LineModel(np.zeros(3 * OWN), np.zeros((2, 2)))
    one = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    got = sorted((r["_id"], r["_label"], bytes(r["_text"])) for r in one.select("_id", "_label", F.col("_text").cast("binary").alias("_text")).collect())
    return fit([g[2] for g in got], np.asarray([g[1] for g in got]))


def quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1, higher is better) of every row.

    Whole texts count, however long. A null or empty text, or one of blanks, is one empty line. Rows with the same id
    keep a row each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, part, held = [np.zeros(0)], [], 0
            for i, text in enumerate(batch.column(1)):
                part.append(text.as_py())
                held += len(part[-1])
                if held >= AT_ONCE or i + 1 == batch.num_rows:
                    found.append(model.scores(part))
                    part, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("_id"), whole_text(text_col).cast("binary")), run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned outside fold 1 of 3; a null id is neither learned from nor held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = quality(docs, learn(docs, labels, ~fold))
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
