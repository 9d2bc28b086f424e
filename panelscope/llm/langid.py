"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton of labelled text knows every string that occurs in it. A document is
parsed into phrases, each the longest match in the language's text from where the last one ended. The
number of phrases, times the bits that name one (the logarithm of the language's text length), per
symbol, estimates the cross entropy; the language that needs least wins.

Only letters count: a run of anything else is one blank, case is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import KEPT, map_batches, whole_text

UNKNOWN = "und"
#: Symbols are 0 blank, 1 unknown letter, then the letters of the samples, most frequent first. A table is dense in so many of them at
#: most; moves by others are found by search.
SYMBOLS = 64
#: Entries of all dense tables of a model, which bounds a worker's memory: with many languages they are narrower.
DENSE = 200_000_000
#: A document is parsed in blocks of so many symbols, side by side; a phrase ends with its block.
BLOCK = 1024
#: Symbols handled at a time, which bounds a worker's memory.
AT_ONCE = 4_000_000

_LETTERS: list[np.ndarray] = []
_TABLES: dict["LanguageModel", tuple[np.ndarray, list["MoveTable"], np.ndarray]] = {}


@dataclass(frozen=True)
class LanguageModel:
    """Bounded samples of text per language; their tables are built where they are used."""

    languages: tuple[str, ...]
    samples: tuple[str, ...]

    def tables(self) -> tuple[np.ndarray, list[MoveTable], np.ndarray]:
        """Symbol of each code point, move tables, bits per phrase; built once per worker."""
        KEPT[__name__] = _TABLES.clear
        if self not in _TABLES:
            _TABLES.clear()
            symbol = symbols_of(self.samples)
            coded = [normalised([s], symbol)[0] for s in self.samples]
            states = sum(2 * len(c) + 2 for c in coded)
            width = next(w for w in (SYMBOLS, 32, 16, 8, 4, 2) if w == 2 or states * w <= DENSE)
            _TABLES[self] = symbol, [move_table(c, width) for c in coded], np.asarray([np.log2(max(2, len(c))) for c in coded])
        return _TABLES[self]


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in a row, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def symbols_of(samples: tuple[str, ...]) -> np.ndarray:
    code, _ = code_points([s.lower() for s in samples])
    found, count = np.unique(code[letters()[code]], return_counts=True)
    best = found[np.lexsort((found, -count))]
    symbol = letters().astype(np.uint8 if len(best) < 254 else np.int32)
    symbol[best] = np.arange(2, 2 + len(best))
    return symbol


def normalised(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts in a row, and how many each has."""
    code, size = code_points([t.lower() for t in texts])
    line = symbol[code]
    keep = line > 0
    keep[1:] |= line[:-1] > 0  # the first of a run of other characters
    doc = np.repeat(np.arange(len(texts)), size)
    return line[keep], np.bincount(doc[keep], minlength=len(texts))


def suffix_automaton(line: np.ndarray) -> list[dict[int, int]]:
    """Moves of the smallest automaton that reads every substring of ``line``."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in line.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = state
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
    return moves


@dataclass(frozen=True)
class MoveTable:
    """Next state (times ``width``) for state and symbol. Bit 0: no such string, a new phrase starts with the symbol.

    ``dense`` has the symbols below ``width``. Of the others ``keys`` has the moves (state and symbol as one number, sorted) and
    ``to`` where they lead; ``start`` has the symbols that start a phrase, ``first`` where they lead, ``lost`` is for those no string has.
    """

    width: int
    dense: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    start: np.ndarray
    first: np.ndarray
    lost: int

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        rare = np.flatnonzero(symbol >= self.width)
        if not len(rare):
            return self.dense[state + symbol]
        move = self.dense[state + np.where(symbol < self.width, symbol, 0)]
        symbol = symbol[rare].astype(np.int64)
        move[rare] = searched(self.start, self.first, symbol, np.full(len(rare), self.lost, np.int32))
        move[rare] = searched(self.keys, self.to, (state[rare].astype(np.int64) // self.width << 32) | symbol, move[rare])
        return move


def searched(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, ``other`` where there is no such key."""
    if not len(keys):
        return other
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def move_table(line: np.ndarray, width: int = SYMBOLS) -> MoveTable:
    moves = suffix_automaton(line)
    moves.append({})  # after a symbol that no string has: whatever comes next starts a phrase
    lost = (len(moves) - 1) * width + 1
    start = np.full(width, lost, np.int32)
    for c, to in moves[0].items():
        if c < width:
            start[c] = to * width + 1
    dense = np.tile(start, (len(moves), 1))
    state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    symbol = np.fromiter((c for m in moves for c in m), np.int64, len(state))
    to = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state)) * width
    low = symbol < width
    dense[state[low], symbol[low]] = to[low]
    keys, to = ((state << 32) | symbol)[~low], to[~low].astype(np.int32)
    order = np.argsort(keys)
    keys, to = keys[order], to[order]
    from_start = keys < 1 << 32
    return MoveTable(width, dense.ravel(), keys, to, keys[from_start], to[from_start] + np.int32(1), lost)


def phrases(line: np.ndarray, size: np.ndarray, tables: list[MoveTable]) -> np.ndarray:
    """Number of phrases of each document in each language."""
    blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(size) - size, blocks) + nth * BLOCK
    length = np.minimum(np.repeat(size, blocks) - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    doc, start, length = doc[order], start[order], length[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # lanes longer than t
    padded, top = np.concatenate([line, np.zeros(BLOCK, line.dtype)]), int(line.max(initial=0))
    state = np.zeros((len(tables), len(doc)), np.int32)
    count = np.ones((len(tables), len(doc)), np.int32)  # the phrase that is open at the end
    for t in range(longest):
        n = active[t]
        symbol = padded[start[:n] + t].astype(np.int32)
        for i, table in enumerate(tables):
            move = table.dense[state[i, :n] + symbol] if top < table.width else table.next(state[i, :n], symbol)
            new = move & 1
            if t:
                count[i, :n] += new
            state[i, :n] = move ^ new
    out = np.zeros((len(tables), len(size)), np.int64)
    for i in range(len(tables)):
        out[i] = np.bincount(doc, weights=count[i], minlength=len(size)).astype(np.int64)
    return out


def judged(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and share of known letters of each text."""
    symbol, tables, bits = model.tables()
    line, size = normalised(texts, symbol)
    doc = np.repeat(np.arange(len(size)), size)
    total = np.bincount(doc, weights=line > 0, minlength=len(size))
    known = np.bincount(doc, weights=line > 1, minlength=len(size)) / np.maximum(total, 1)
    if not tables:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    cost = phrases(line, size, tables) * bits[:, None] / np.maximum(size, 1)
    best = np.argmin(cost, axis=0)  # ties: the first language in order
    if len(tables) > 1:
        two = np.partition(cost, 1, axis=0)[:2]
        score = 1 - two[0] / np.maximum(two[1], 1e-12)
    else:
        score = np.ones(len(texts))
    none = total == 0
    return [UNKNOWN if n else model.languages[b] for n, b in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(score, 0, 1)), known


def judged_batch(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``judged``, for a bounded number of symbols at a time."""
    langs, scores, shares = [], [np.zeros(0)], [np.zeros(0)]
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= AT_ONCE or i + 1 == len(texts):
            found = judged(texts[first:i + 1], model)
            langs += found[0]
            scores.append(found[1])
            shares.append(found[2])
            first, held = i + 1, 0
    return langs, np.concatenate(scores), np.concatenate(shares)


def accepted(docs: DataFrame, model: LanguageModel, least_known: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Rejected are texts without a letter (null and empty ones too), and texts of which less than ``least_known`` of the letters occur in
    the samples, such as other scripts. A model without languages rejects all.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, known = judged_batch([t or "" for t in batch.column(at).to_pylist()], model)
            yield batch.filter(pa.array([lang != UNKNOWN and share >= least_known for lang, share in zip(langs, known, strict=True)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def learn(
    docs: DataFrame, usable: Column, sample_symbols: int = 40_000, sample_docs: int = 96, longest: int = 8_000,
    max_languages: int = 2048, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
) -> LanguageModel:
    """Samples of the labelled rows that are ``usable``.

    Per language the ``sample_docs`` rows with a letter and the least hash of the id, of these whole texts, of texts over ``longest``
    characters so many from the first letter on, each text once, until ``sample_symbols`` characters are reached. Every label of a text with a letter is
    learned; more than ``max_languages`` are refused. So at most languages * sample_docs rows reach the driver, whatever the input.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(usable & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.col(id_col)).alias("_h"), F.xxhash64(text).alias("_x"))
    names = sorted(r["_lang"] for r in rows.select("_lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} labels in {lang_col}")
    first = Window.partitionBy("_lang").orderBy("_h", "_id", "_x")
    ids = rows.select("_lang", "_id", "_h", "_x").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_docs)
    ids = ids.select(F.col("_lang").alias("_l"), F.col("_id").alias("_i"), F.col("_x").alias("_y")).distinct()
    window = F.when(F.length("_text") <= longest, F.col("_text")).otherwise(F.substring(F.regexp_replace("_text", r"^\P{L}++", ""), 1, longest))
    same = (F.col("_lang") == F.col("_l")) & (F.col("_x") == F.col("_y")) & F.col("_id").eqNullSafe(F.col("_i"))
    texts = rows.join(F.broadcast(ids), same).select("_lang", "_h", window.alias("_text")).distinct()
    got: dict[str, list[str]] = {n: [] for n in names}
    room = dict.fromkeys(names, sample_symbols)
    for r in sorted(texts.collect(), key=lambda r: (r["_lang"], r["_h"], r["_text"])):
        if room[r["_lang"]] > 0:
            got[r["_lang"]].append(r["_text"])
            room[r["_lang"]] -= len(r["_text"])
    names = [n for n in names if any(c.isalpha() for t in got[n] for c in t)]
    return LanguageModel(tuple(names), tuple("\n".join(got[n]) for n in names))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1: how much less the best needs than the second) and ``known`` (share of letters the samples have).

    Whole texts count, however long. A null text, or one without a letter, is ``und`` with score 0; so is every text
    if nothing was learned. Ties go to the first language by code point. Rows with the same id keep a row each. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, known = judged_batch(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(known)], names=["_id", "lang_pred", "score", "known"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), whole_text(text_col)), run, f"_id {kind}, lang_pred string, score double, known double")
    return out.withColumnRenamed("_id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id's checksum falls in the fold that nothing may be learned from; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def language_query(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those outside fold 2 of 4; a null id is neither learned from nor held out."""
    out = identify(docs, learn(docs, ~held_out("doc_id", 4, 2)))
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score", "known")
