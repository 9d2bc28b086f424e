"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Both tokenizers' tokens cover the same bytes. An interval of tokens is divided at a byte where tokens of both end: the
end of the middle token of A is looked up among the ends of B by bisection, then those of its neighbours, nearest first.
Both halves are divided in turn; an interval without a shared end inside is a group. All intervals are divided side by
side, level by level. Tokens of both sides end where units of a text meet, so a unit is encoded, divided and written out
once, and a text is put together from its units' tokens and groups.

Links of a group are all pairs of its tokens. Their document frequencies are needed of every block of texts, so distinct
pairs travel once per block: to be summed over the corpus, and back to the block, whose documents add them up.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import KEPT, map_batches, stored, tasks, whole_text
from panelscope.llm.packing import printable_bytes

#: Bytes of text aligned at a time, and in a block.
AT_ONCE = 2_000_000
BLOCK = 16_000_000
#: Units a task remembers, and the longest of them.
UNITS = 200_000
LONG_UNIT = 60
#: New units encoded at a time.
BULK = 200
#: Links made at a time.
LINKS = 2_000_000
#: White space and joiners beyond blank, tab and line feed, which tokenizers may treat in their own ways: such texts are
#: encoded as a whole, all others unit by unit.
BEYOND = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠▁　﻿]")
#: A word with the white space before it, a mark at its end apart; no piece of either side goes from a letter on to such a mark.
MARKS = "[.,;:!?]{1,3}(?=[ \t\n]|\\Z)"
UNIT = re.compile(f"{MARKS}|[ \t\n]*+(?:[A-Za-z]++(?:(?={MARKS})|[^ \t\n]*+)|[^ \t\n]++)|[ \t\n]++")

_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


class ByteTokens:
    """A byte-level BPE of the ``tokenizers`` library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {chr(c): b for b, c in printable_bytes().items()} | {chr(b): b for b in range(256) if b not in printable_bytes()}
        self.token_bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class PieceTokens:
    """A SentencePiece model that puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")
        #: Whether no piece goes on past a character that white space follows, so that units are encoded apart.
        self.by_units = not any(re.search("[^ \t\n][ \t\n]|[\t\n](?s:.)|[A-Za-z][.,;:!?]", t.decode(errors="replace"))
                                for i, t in enumerate(self.token_bytes) if not self.model.is_byte(i))

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Ids of texts that start with the blank, of units that start with it, and of units that do not: theirs is taken off again."""
        found = self.model.encode([t.removeprefix(" ") for t in spaced], num_threads=1)
        return [ids if t[0] == " " and len(t) > 1 else [self.blank] if t == " " else ids[1:] for t, ids in zip(spaced, found, strict=True)]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A, and of B, that end where a token of the other ends, by divide and conquer from the given intervals.

    Bounds are token numbers between texts (0 first, the number of tokens last); texts end together on both sides.
    """
    cut = [np.asarray(a_bounds[1:]) - 1], [np.asarray(b_bounds[1:]) - 1]
    lo, hi, blo, bhi = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    while True:
        inner = (hi - lo > 1) & (bhi - blo > 1)  # others are leaf groups
        lo, hi, blo, bhi = lo[inner], hi[inner], blo[inner], bhi[inner]
        if not len(lo):
            break
        at, there = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        middle, open_, away = (lo + hi) // 2 - 1, np.arange(len(lo)), 0
        while len(open_):
            for probe in ((middle + away, middle - away) if away else (middle,)):
                p = probe[open_]
                inside = (p >= lo[open_]) & (p < hi[open_] - 1)
                which, p = open_[inside], p[inside]
                j = np.searchsorted(b_ends, a_ends[p])
                hit = b_ends[j] == a_ends[p]
                at[which[hit]], there[which[hit]] = p[hit], j[hit]
                open_ = open_[at[open_] < 0]
            away += 1
            open_ = open_[(middle[open_] + away < hi[open_] - 1) | (middle[open_] - away >= lo[open_])]
        found = at >= 0
        lo, hi, blo, bhi, at, there = (x[found] for x in (lo, hi, blo, bhi, at, there))
        cut[0].append(at)
        cut[1].append(there)
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at + 1, hi])
        blo, bhi = np.concatenate([blo, there + 1]), np.concatenate([there + 1, bhi])
    return np.sort(np.concatenate(cut[0])), np.sort(np.concatenate(cut[1]))


@dataclass
class Aligned:
    """Some texts: ids of both sides, bounds of texts in them, and where groups end (token numbers past the last)."""

    doc_ids: pa.Array
    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    #: Byte, among all the texts' bytes in a row, where each group ends.
    bytes_end: np.ndarray
    #: Hash of each text's groups, written ``a1,a2|b1;a3|b2``; nothing for texts without tokens.
    hashes: list[str] = field(default_factory=list)

    def group_bounds(self) -> np.ndarray:
        """Number of groups before each text."""
        return np.searchsorted(self.a_ends, self.a_bounds, side="right")


class Digits:
    """``a1,a2|b1;a3|b2;`` of each unit; the text of every id with every separator is made once."""

    def __init__(self, size: int):
        self.size = size
        self.texts = [f"{i}{mark}".encode() for mark in (",", "|", ";") for i in range(size)]

    def of(self, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> list[bytes]:
        """From ids, bounds of units in them, and where groups end (token numbers past the last)."""
        n = len(a) + len(b)
        group_a, group_b = (np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) for ends in (a_ends, b_ends))
        # a group's tokens of A, then those of B: a token moves on by the other side's tokens before it
        b_before = np.concatenate([[0], b_ends])
        keys = np.empty(n, np.int64)
        at_a, at_b = np.arange(len(a)) + b_before[group_a], np.arange(len(b)) + a_ends[group_b]
        keys[at_a], keys[at_b] = a, b
        keys[at_a[a_ends - 1]] += self.size
        keys[at_b[b_ends - 1]] += 2 * self.size
        shown = [*map(self.texts.__getitem__, keys.tolist())]
        bounds = (a_bounds + b_bounds).tolist()
        return [b"".join(shown[i:j]) for i, j in zip(bounds, bounds[1:])]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as it counts, in a row."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Rows:
    """Rows of numbers of different lengths, in columns that are as long as each other."""

    def __init__(self, columns: int):
        self.counts = np.zeros(0, np.int64)
        self.columns = [np.zeros(0, np.int32)] * columns

    def extend(self, counts: np.ndarray, *columns: np.ndarray) -> None:
        self.counts = np.concatenate([self.counts, counts])
        self.columns = [np.concatenate([c, more.astype(np.int32)]) for c, more in zip(self.columns, columns, strict=True)]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many numbers these rows have, and the numbers."""
        counts = self.counts[rows]
        at = spread((np.cumsum(self.counts) - self.counts)[rows], counts)
        return counts, [c[at] for c in self.columns]

    def keep(self, rows: np.ndarray) -> None:
        self.counts, self.columns = self.of(rows)


class Encoder:
    """Units of texts as ids of both tokenizers, with their groups."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.sizes = [np.fromiter(map(len, t.token_bytes), np.int64, len(t.token_bytes)) for t in (self.a, self.b)]
        self.by_units = self.b.by_units and all(len(side.encode([" a"])[0]) == 1 for side in (self.a, self.b))
        self.digits = Digits(max(map(len, self.sizes)))
        #: Rows of the units: their ids, groups (tokens of A, of B and bytes up to their ends) and these written out; which do not
        #: come back byte by byte; how often each was met.
        self.units: dict[str, int] = {}
        self.ids = Rows(1), Rows(1)
        self.groups = Rows(3)
        self.shown: list[bytes] = []
        self.bad = np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)

    def _pairs(self, spaced: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of each, or nothing where one side's bytes are not those of the text."""
        found = self.a.encode(spaced), self.b.encode(spaced)
        raw = [t.encode() for t in spaced]
        good = [True] * len(raw)
        for side, ids in zip((self.a, self.b), found, strict=True):
            back = [b"".join(map(side.token_bytes.__getitem__, x)) for x in ids]
            if back != raw:
                good = [g and x == y for g, x, y in zip(good, back, raw, strict=True)]
        for ok, x, y in zip(good, *found, strict=True):
            yield (array("I", x).tobytes(), array("I", y).tobytes()) if ok else None

    def _bulk(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Of both sides, how many ids units have that start with white space and end without, and the ids: encoded as one text
        and cut where units meet; nothing if that is not exact."""
        text = " a" + "".join(units)
        raw = text.encode()
        ends = np.cumsum([2, *(map(len, units) if len(raw) == len(text) else map(len, map(str.encode, units)))])
        sides = []
        for side, sizes in zip((self.a, self.b), self.sizes, strict=True):
            found = side.encode([text])[0]
            ids = np.asarray(found, np.uint32)
            upto = np.cumsum(sizes[ids])
            at = np.searchsorted(upto, ends)
            if len(ids) == 0 or at[-1] != len(ids) - 1 or not np.array_equal(upto[at], ends) or b"".join(map(side.token_bytes.__getitem__, found)) != raw:
                return None
            sides.append((np.diff(at), ids[at[0] + 1:]))
        return sides

    def _learn(self, fresh: set[str], whole: set[str] = frozenset()) -> None:
        """Add rows of units, and of whole texts, not met before."""
        marks = [u for u in fresh if u[0] in ".,;:!?"]
        after = [x for u in marks for x in self._bulk([f" a{u}"]) or ()]  # as they stand: after a letter
        order, sides = marks, ([], [])
        for i, (_, ids) in enumerate(after):
            sides[i % 2].append((np.asarray([len(ids) - 1]), ids[1:]))
        rest = [u for u in fresh if u.isspace()]
        inner = [u for u in fresh if u[0] not in ".,;:!?" and not u.isspace()]
        for some in (inner[i:i + BULK] for i in range(0, len(inner), BULK)):
            if (pairs := self._bulk(some)) is None:
                rest += some
            else:
                order += some
                for side, pair in zip(sides, pairs, strict=True):
                    side.append(pair)
        rest += whole
        found = [*self._pairs(rest)] if rest else []
        for side, ids in zip(sides, zip(*(p or (b"", b"") for p in found), strict=True)):
            side.append((np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32)))
        order += rest
        if not order:
            return
        self.units.update(zip(order, range(len(self.units), len(self.units) + len(order)), strict=True))
        self.bad = np.concatenate([self.bad, np.zeros(len(order) - len(found), bool), np.fromiter((p is None for p in found), bool, len(found))])
        self.met = np.concatenate([self.met, np.zeros(len(order), np.int64)])
        counts, ids = zip(*((np.concatenate([x[0] for x in side]), np.concatenate([x[1] for x in side]).astype(np.int64)) for side in sides), strict=True)
        for rows, n, own in zip(self.ids, counts, ids, strict=True):
            rows.extend(n, own)
        some = np.flatnonzero(counts[0])  # units with tokens
        bounds = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
        ends = [np.cumsum(sizes[own]) for sizes, own in zip(self.sizes, ids, strict=True)]
        keep = np.concatenate([[0], some + 1])
        cuts = shared_cuts(*ends, *(x[keep] for x in bounds)) if len(some) else (np.zeros(0, np.int64),) * 2
        until = [cut + 1 for cut in cuts]
        unit = np.searchsorted(bounds[0], cuts[0], side="right") - 1
        before = np.concatenate([[0], ends[0]])[bounds[0][unit]]
        self.groups.extend(np.bincount(unit, minlength=len(order)), until[0] - bounds[0][unit], until[1] - bounds[1][unit], ends[0][cuts[0]] - before)
        self.shown += self.digits.of(*ids, *bounds, *until)

    def _forget(self, last: int) -> None:
        """The rows from the given one on go, and if there are too many, those met least."""
        rows = np.arange(last)
        if last > UNITS:
            rows = np.sort(np.argsort(-self.met[:last], kind="stable")[:UNITS // 2])
            self.met //= 2
        elif last == len(self.units):
            return
        names = [*self.units]
        self.units = {names[i]: k for k, i in enumerate(rows.tolist())}
        for x in (*self.ids, self.groups):
            x.keep(rows)
        self.shown = [self.shown[i] for i in rows.tolist()]
        self.bad, self.met = self.bad[rows], self.met[rows]

    def align(self, doc_ids: pa.Array, texts: list[str]) -> Aligned:
        split, whole, units = [], [], set()
        for text in texts:
            if not text:
                split.append([])
            elif self.by_units and not BEYOND.search(text):
                split.append(UNIT.findall(" " + text))
                units.update(split[-1])
            else:
                split.append([" " + text])
                whole += split[-1]
        fresh = units.difference(self.units)
        long = {u for u in fresh if len(u) > LONG_UNIT}
        self._learn(fresh - long if long else fresh)
        stay = len(self.units)  # the others are dropped again
        if long or whole:
            self._learn(long, {*whole}.difference(self.units, long))
        rows = np.fromiter(map(self.units.__getitem__, chain.from_iterable(split)), np.int64)
        bounds = np.concatenate([[0], np.cumsum([*map(len, split)], dtype=np.int64)])
        self.met += np.bincount(rows, minlength=len(self.met))
        if self.bad[rows].any():  # texts with such a unit have no tokens
            lost = np.diff(np.concatenate([[0], np.cumsum(self.bad[rows])])[bounds]) > 0
            rows = rows[~np.repeat(lost, np.diff(bounds))]
            bounds = np.concatenate([[0], np.cumsum(np.where(lost, 0, np.diff(bounds)))])
        at = rows.tolist()
        hashes = [hashlib.sha256(b"".join(map(self.shown.__getitem__, at[i:j]))[:-1]).hexdigest() if i < j else "" for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
        (n_a, (a,)), (n_b, (b,)) = (side.of(rows) for side in self.ids)
        n, ends = self.groups.of(rows)
        last = np.cumsum(n) - 1
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b, ends[2][last].astype(np.int64))]
        a_ends, b_ends, bytes_end = (end + np.repeat(x[:-1], n) for end, x in zip(ends, upto, strict=True))
        out = Aligned(doc_ids, a.astype(np.int64), b.astype(np.int64), upto[0][bounds], upto[1][bounds], a_ends, b_ends, bytes_end, hashes)
        self._forget(stay)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of each text; nothing where it has no tokens."""
        x = self.align(pa.nulls(len(texts), pa.int64()), texts)
        a, b = x.a.astype(np.uint32), x.b.astype(np.uint32)
        return [(a[i:j].tobytes(), b[k:m].tobytes()) if j > i else None for i, j, k, m in zip(x.a_bounds, x.a_bounds[1:], x.b_bounds, x.b_bounds[1:])]


def encoder(path_a: str, path_b: str) -> Encoder:
    """The worker's encoder, with the units it has met in earlier tasks."""
    KEPT[__name__] = _ENCODERS.clear
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = Encoder(path_a, path_b)
    return _ENCODERS[path_a, path_b]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows in parts of about ``AT_ONCE`` bytes of text."""
    for batch in batches:
        start, size = 0, 0
        texts: list[str] = []
        for i, text in enumerate(batch.column(1)):
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= AT_ONCE:
                yield batch.column(0).slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []
        if texts:
            yield batch.column(0).slice(start, len(texts)), texts


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids and groups (a_end, b_end, byte_end) of every text: group k holds the tokens after group k - 1's ends.

    ``path_a`` is a byte-level BPE, ``path_b`` a SentencePiece model; bytes are those of a blank and the text. Texts that are
    null or empty, or that one side does not give back byte by byte (such as those with U+2581), have empty lists. Repeated rows
    are aligned each; an empty table gives an empty result.
    """
    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int, byte_end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(path_a, path_b)
        for doc_ids, texts in parts(batches):
            x = both.align(doc_ids, texts)
            groups = x.group_bounds()
            per_doc = np.diff(groups)
            before = np.concatenate([[0], x.bytes_end])[groups[:-1]]
            inner = pa.StructArray.from_arrays([
                pa.array(x.a_ends - np.repeat(x.a_bounds[:-1], per_doc), pa.int32()), pa.array(x.b_ends - np.repeat(x.b_bounds[:-1], per_doc), pa.int32()),
                pa.array(x.bytes_end - np.repeat(before, per_doc), pa.int64())], names=["a_end", "b_end", "byte_end"])
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values) for bounds, values in (
                (x.a_bounds, pa.array(x.a, pa.int32())), (x.b_bounds, pa.array(x.b, pa.int32())), (groups, inner))]
            yield pa.RecordBatch.from_arrays([doc_ids, *lists], names=["doc_id", "a_ids", "b_ids", "groups"])

    return map_batches(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), run, schema)


def links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (text, pair of ids) and how often they are linked, in parts; the same text and pair may come in several."""
    doc_of = np.repeat(np.arange(len(x.doc_ids)), np.diff(x.group_bounds()))
    a_start, b_start = np.concatenate([[0], x.a_ends[:-1]]), np.concatenate([[0], x.b_ends[:-1]])
    if not len(x.a_ends):
        return
    na, nb = x.a_ends - a_start, x.b_ends - b_start
    large = na * nb > LINKS // 8
    for g in np.flatnonzero(large).tolist():  # by distinct ids, some of A's at a time
        a, a_times = np.unique(x.a[a_start[g]:x.a_ends[g]], return_counts=True)
        b, b_times = np.unique(x.b[b_start[g]:x.b_ends[g]], return_counts=True)
        step = max(1, LINKS // len(b))
        for i in range(0, len(a), step):
            code = (a[i:i + step, None] << 32 | b).reshape(-1)
            yield np.full(len(code), doc_of[g]), code, (a_times[i:i + step, None] * b_times).reshape(-1)
    groups = np.flatnonzero(~large)
    many = np.cumsum(na[groups] * nb[groups])
    b_bits = int(x.b.max()).bit_length()
    bits = int(x.a.max()).bit_length() + b_bits
    for some in np.split(groups, np.searchsorted(many, np.arange(LINKS, many[-1], LINKS))) if len(groups) else ():
        count = na[some] * nb[some]
        nth = spread(np.zeros(len(count), np.int64), count)
        wide = np.repeat(nb[some], count)
        of_a = nth // wide
        of_b = nth - of_a * wide
        of_a += np.repeat(a_start[some], count)
        of_b += np.repeat(b_start[some], count)
        key = np.sort(np.repeat(doc_of[some] << bits, count) | x.a[of_a] << b_bits | x.b[of_b])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        key = key[first]
        pair = key & (1 << bits) - 1
        yield key >> bits, pair >> b_bits << 32 | pair & (1 << b_bits) - 1, times


BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "codes array<long>, docs array<int>, triples binary")


class BlockBuilder:
    """Documents of a block with their links: (document, place of the pair among the block's pairs, times)."""

    def __init__(self):
        self.columns: list[list] = [[], [], [], [], [], []]
        self.doc, self.code, self.times = [], [], []
        self.size = self.rows = 0

    def add(self, x: Aligned, size: int) -> None:
        n = len(x.doc_ids)
        total = np.zeros(n, np.int64)
        codes = [np.zeros(0, np.int64)]
        for doc, code, times in links(x):
            np.add.at(total, doc, times)
            self.doc.append((doc + self.rows).astype(np.int32))
            self.times.append(times)
            codes.append(code)
        self.code.extend(codes[1:])
        values = (x.doc_ids.to_pylist(), np.diff(x.a_bounds), np.diff(x.b_bounds), np.diff(x.group_bounds()), total, x.hashes)
        for column, value in zip(self.columns, values, strict=True):
            column.extend(value if isinstance(value, list) else value.tolist())
        self.size += size
        self.rows += n

    def finish(self, block: int) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        codes, place = np.unique(np.concatenate([empty, *self.code]), return_inverse=True)
        key = np.concatenate([empty, *self.doc]).astype(np.int64) << 32 | place
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, np.concatenate([empty, *self.times]), len(key)).astype(np.int64) if len(key) else empty
        docs = np.bincount(key & 0xFFFFFFFF, minlength=len(codes))
        gaps = np.diff(key >> 32, prepend=0)
        payload = b"".join(x.tobytes() for x in (gaps.astype(np.uint32), (key & 0xFFFFFFFF).astype(np.uint32), times))
        values = [block, *self.columns, codes, docs, zlib.compress(payload, 1)]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def triples(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    n = len(raw) // 16
    docs, places = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint32, n, 4 * n)
    return np.cumsum(docs, dtype=np.int64), places.astype(np.int64), np.frombuffer(raw, np.int64, n, 8 * n)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(path_a, path_b)
        block, number = BlockBuilder(), TaskContext.get().partitionId() << 32
        for doc_ids, texts in parts(batches):
            block.add(both.align(doc_ids, texts), sum(map(len, texts)) + 100 * len(texts))
            if block.size >= BLOCK:
                yield block.finish(number)
                block, number = BlockBuilder(), number + 1
        if block.rows:
            yield block.finish(number)

    return map_batches(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), run, BLOCKS)


def link_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Groups are those of ``align_documents``. A pair of ids counts the documents (rows) that hold it linked; n_best are the links whose pair
    has the highest count of its id of A (ties included), count_sum the counts of all links. Texts without tokens have zeros and an empty hash.
    """
    blocks = stored(aligned_blocks(docs, path_a, path_b, id_col, text_col), "aligned_blocks")
    met = blocks.select("block", F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("block", F.col("x.codes").alias("code"), F.col("x.docs").alias("docs"))
    counts = stored(met.groupBy("code").agg(F.sum("docs").alias("n")), "pair_counts")
    best = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("most"))
    known = counts.withColumn("a", F.shiftright("code", 32)).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    looked_up = (
        met.select("block", "code").join(known, "code")
        .groupBy("block").agg(F.collect_list(F.struct("code", "n", "best")).alias("known"))
        .select("block", *[F.col(f"known.{c}").alias(c) for c in ("code", "n", "best")])
    )
    rows = blocks.drop("codes", "docs").join(looked_up, "block", "left")
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "triples", "code", "n", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(k)[i].values for k, c in enumerate(columns) if c != "triples"}
                doc, place, times = triples(batch.column(6)[i].as_py())
                n_best = count_sum = np.zeros(len(x["doc_ids"]), np.int64)
                if len(doc):
                    order = np.argsort(x["code"].to_numpy())
                    n, is_best = x["n"].to_numpy()[order], x["best"].to_numpy(zero_copy_only=False)[order]
                    ends = np.flatnonzero(np.diff(doc, append=-1) != 0)
                    n_best, count_sum = np.zeros((2, len(x["doc_ids"])), np.int64)
                    for out, value in ((n_best, times * is_best[place]), (count_sum, times * n[place])):
                        out[doc[ends]] = np.diff(np.cumsum(value)[ends], prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [x["doc_ids"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], pa.array(n_best), pa.array(count_sum), x["groups_sha256"]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_batches(rows.select(*columns), run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
