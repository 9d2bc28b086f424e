"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie; full windows are cut off at once, and the rest is cut into
short pieces. Pieces are dealt evenly to groups of bounded size, and each group is packed by
largest differencing: partial partitions are merged two at a time, the fullest windows of one with
the emptiest of the other, until one partition with near-equal windows is left. If its fullest window
exceeds the capacity, the group starts again with more windows.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import KEPT, map_batches, stored, whole_text

#: Pieces whose ids a worker remembers, twice: those met lately and those met before.
PIECE_CACHE = 500_000
#: Characters of the texts that are split into pieces together.
BLOCK = 1_000_000
#: Characters beyond lower-case text of ASCII and Latin letters, whose texts take the tokenizer's own way.
BEYOND = re.compile("[^\t\n\r -~\u00df-\u00f6\u00f8-\u024f]")
#: What a byte of other texts is: all that are not ASCII are of letters; blanks and the end of a text are in no piece.
BLANK, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[list(b"\0\t\n\r ")] = BLANK
KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
KIND[list(b"0123456789")] = DIGIT
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"

_ENCODERS: dict[tuple[str, bool, int], "WordEncoder"] = {}


def printable_bytes() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


class Recent(dict):
    """Values made on demand; the ones met lately are kept, in two generations of bounded size."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def plain_pieces(texts: Iterable[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in turn, and how many there are up to the end of each text.

    The tokenizer's own split, written out for texts without characters ``BEYOND``: runs of letters, single digits, runs of other
    marks; an apostrophe that begins such a run takes a following s, t, re, ve, m, ll or d as its piece.
    """
    data = np.frombuffer("".join(f"{t}\0" for t in texts).encode(), np.uint8)
    kind = KIND[data]
    starts = kind == DIGIT
    starts[:1] = True
    starts[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero((data == ord("'")) & starts)
    quote = quote[kind[quote + 1] == LETTER]
    one, two = data[quote + 1], data[quote + 2]
    short = quote[np.isin(one, list(b"stmd"))]
    double = quote[(np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
    starts[short + 1] = starts[double + 1] = False
    starts[short + 2] = starts[double + 3] = True
    used = kind != BLANK
    inside = starts[used]
    offsets = np.append(np.flatnonzero(inside), len(inside))
    pieces = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[used])])
    return pieces, np.searchsorted(np.flatnonzero(starts & used), np.flatnonzero(data == 0))


class WordEncoder:
    """Ids of a text, piece by piece.

    The tokenizer normalises a text, splits it into pieces without white space and merges inside pieces only, so the ids of a
    text are those of its pieces in turn; equal pieces are encoded once. With ``added_tokens`` a text that holds one of the
    tokenizer's added tokens takes the tokenizer's own way, which gives it the token's id; without, such a token is text like any other.
    """

    def __init__(self, path: str, added_tokens: bool = False, remembered: int = PIECE_CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.normalizer, self.splitter = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        self.shown = printable_bytes()
        self.of_piece = Recent(self.piece, remembered)

    def piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return self.merged(mapped)

    def merged(self, mapped: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str, added: bool) -> bytes:
        """Ids of a text by the tokenizer's own way."""
        if added:
            ids = self.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join(self.merged(mapped) for mapped, _ in found)

    def plain(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of lower-case texts without characters ``BEYOND``: different pieces are looked up once for all texts."""
        pieces, upto = plain_pieces(texts)
        named = pieces.dictionary_encode()
        found = [self.of_piece[p] for p in named.dictionary.to_numpy(zero_copy_only=False)]
        held = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        of = named.indices.to_numpy()
        each = lengths[of]
        ends = np.append(0, np.cumsum(each))
        at = np.repeat((np.cumsum(lengths) - lengths)[of] - ends[:-1], each)
        at += np.arange(len(at))
        ids, start = held[at], 0
        for end in ends[upto].tolist():
            yield ids[start:end].tobytes()
            start = end

    def block(self, texts: list[str]) -> Iterator[bytes]:
        low = [text.lower() for text in texts]
        added = [bool(self.added and self.added.search(x)) for x in low]
        own = [a or bool(BEYOND.search(x)) for a, x in zip(added, low, strict=True)]
        plain = self.plain([x for x, o in zip(low, own, strict=True) if not o])
        for text, a, o in zip(texts, added, own, strict=True):
            yield self.whole(text, a) if o else next(plain)

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self.block(held)
                held, size = [], 0
        yield from self.block(held)


def encoder(path: str, added_tokens: bool, remembered: int = PIECE_CACHE) -> WordEncoder:
    KEPT[__name__] = _ENCODERS.clear
    key = path, added_tokens, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def cut(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then even parts of at most ``piece`` ids."""
    full = tokens // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    at, rest = full * capacity, tokens - full * capacity
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((at, length))
        at += length
    return out


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, piece: int, added_tokens: bool, remembered: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of every document, with the checksum of its ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, added_tokens, remembered)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start, length in cut(total, capacity, piece):
                    row = (doc, start, length, zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)]), total)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return map_batches(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), run, PIECES)


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for ``windows`` parts: the window of every item, and the loads.

    A partial partition is its non-empty windows, heaviest first; the others are empty. A merge joins
    the heaviest windows of one with the lightest of the other, so that imbalances cancel.
    """
    n = len(sizes)
    # while windows are empty, the heaviest partition takes the next heaviest item into one of them: those merges at once, here and below
    order = np.argsort(-sizes, kind="stable")
    first, rest = order[:windows], order[windows:].tolist()
    loads, nodes = {n: sizes[first].astype(np.int64)}, {n: first}  # of partitions; an item alone is in the heap only
    parent = list(range(n))  # of a window that was joined with another: the joint one
    spread = lambda x: int(x[0]) - (int(x[-1]) if len(x) == windows else 0)
    taken = lambda i: (loads.pop(i), nodes.pop(i)) if i in loads else (sizes[i:i + 1].astype(np.int64), np.asarray([i], np.int64))
    heap = [(-spread(loads[n]), n), *((-spread(sizes[i:i + 1]), i) for i in rest)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        la, na = taken(a)
        items = []  # until its windows are full, the partition's spread is its heaviest window: it stays the heaviest
        while heap and len(la) + len(items) < windows and heap[0][1] not in loads:
            items.append(heapq.heappop(heap)[1])
        if items:
            la, na = np.concatenate([la, sizes[items]]), np.concatenate([na, items])
            order = np.argsort(-la, kind="stable")
            loads[a], nodes[a] = la[order], na[order]
            heapq.heappush(heap, (-spread(loads[a]), a))
            continue
        _, b = heapq.heappop(heap)
        lb, nb = taken(b)
        shared = max(0, len(la) + len(lb) - windows)
        if shared:  # b's heaviest fall to a's empty windows, the lightest of both meet in between
            la, lb, na, nb = la.copy(), lb.copy(), na.copy(), nb.copy()
            top = len(la) - shared
            joint = np.arange(len(parent), len(parent) + shared)
            parent.extend(joint.tolist())
            meet = np.arange(len(lb) - 1, len(lb) - 1 - shared, -1)
            for x, y, j in zip(na[top:].tolist(), nb[meet].tolist(), joint.tolist(), strict=True):
                parent[x] = parent[y] = j
            la[top:] += lb[meet]
            na[top:] = joint
            alone = np.ones(len(lb), bool)
            alone[meet] = False
            la, na = np.concatenate([la, lb[alone]]), np.concatenate([na, nb[alone]])
        else:
            la, na = np.concatenate([la, lb]), np.concatenate([na, nb])
        order = np.argsort(-la, kind="stable")
        loads[a], nodes[a] = la[order], na[order]
        heapq.heappush(heap, (-spread(loads[a]), a))
    last = heap[0][1]
    slot = {node: i for i, node in enumerate(nodes[last].tolist())}
    root = np.asarray(parent)
    while not np.array_equal(root, root[root]):
        root = root[root]
    return np.asarray([slot[r] for r in root[:n].tolist()], np.int64), loads[last]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every item; no window exceeds the capacity, if no item does."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    windows = -(-int(sizes.sum()) * 501 // (capacity * 500))  # a little room saves most second attempts
    while True:
        window, loads = differencing(sizes, windows)
        if loads.max() <= capacity:
            return window
        windows += 1 + windows // 500


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, piece: int = 512,
    group_tokens: int = 1_000_000, group_pieces: int = 8_192, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False,
    remembered: int = PIECE_CACHE,
) -> DataFrame:
    """Pieces of all documents with their window and place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Repeated rows are packed as often as they
    occur. Very long texts give full windows of their own. A group of pieces has about ``group_tokens`` ids and at most
    about ``group_pieces`` pieces, so its packing time and memory are bounded whatever the input; pieces are dealt
    by count, not by key. With ``added_tokens`` ids are those of the tokenizer with its defaults, also of texts that hold its added tokens;
    without, these are text like any other. A worker remembers the ids of up to twice ``remembered`` pieces: fewer take less memory
    and more time, the result is the same. An empty table gives an empty result.
    """
    if piece > capacity:
        raise ValueError("a piece must fit into a window")
    pieces = stored(pieces_of(docs, tokenizer_path, end_id, capacity, piece, added_tokens, remembered, id_col, text_col), "pieces")
    short = F.col("length") < capacity
    ids, rows = pieces.where(short).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-ids // group_tokens), -(-rows // group_pieces))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        length = table.column("length").to_numpy()
        window = pack(length, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], np.diff(window[order]) != 0])
        begin = (ends - length[order])[first]
        offset = ends - length[order] - np.repeat(begin, np.diff(np.concatenate([np.flatnonzero(first), [len(order)]])))
        table = table.take(order).append_column("sequence_id", pa.array(window[order] + (task << 32), pa.int64()))
        yield from table.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    mixed = map_batches(pieces.where(short).repartition(groups), group, PACKED)
    # full windows need no partner: numbered apart, above all groups
    alone = pieces.where(~short).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return mixed.unionByName(alone)
