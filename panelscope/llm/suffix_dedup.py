"""Removal of repeated passages: bytes covered by a string that also starts in a document with a smaller id.

Suffix order finds them: where all suffixes stand in order, equal strings of ``span`` bytes are neighbours. Three steps keep
that order small and spread out.

1. Every window of ``span`` bytes has a key, the least hash of the grams inside it, so equal windows have equal keys. Keys
   that only one document has cannot repeat; all others go back to their documents.
   A key that very many documents share (windows at the edges of a frequent passage) stands for many different windows; windows
   of such hot keys go by a hash of their own bytes instead, which no longer repeats unless the window does.
2. A document (of copies one) cuts out its contexts: stretches of windows that share a repeated key. Equal contexts that meet are
   settled at once by the smallest id; the rest are dealt out by key.
3. The contexts of a task are cut into shards. Each shard is sorted by itself into a Burrows-Wheeler
   transform. The transforms are merged by refining their interleave: starting from one shard after the other, each pass
   reads every shard's symbols in the current order and deals them stably by symbol, after which the
   order is right for one more symbol; no suffix is sorted again. Common prefixes of neighbours give the intervals of equal windows, and
   each interval's smallest id tells which of its windows go.

Keys and contexts travel in blocks of many, and a frequent key or context travels at most twice per batch of documents. What a
task has found for documents goes back in blocks, too, one per task that gathers it, so rows do not grow with documents times tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import map_batches, stored, tasks, whole_text

SPAN = 50
GRAM = 20
#: Bytes of text whose windows are handled at a time, and bytes whose contexts are held at a time.
AT_ONCE = 2_000_000
HELD = 12_000_000
#: Symbols whose order is merged at a time.
MERGED = 150_000
#: Symbols of a shard.
SHARD = 1 << 14
#: Documents whose keys are looked at to find the hot ones, one in so many; it decides how windows are dealt out, not what is found.
LOOKED_AT = 16
#: Rows handled at a time.
ROWS = 50_000
BASE = 0x9E3779B97F4A7C15
NO_ID = np.iinfo(np.int64).max


# -- window keys ------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """48-bit hash of the ``size`` bytes from every position, by doubling."""
    power, span, rest = data.astype(np.uint64) + np.uint64(1), 1, size
    out, done = None, 0
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, span
            else:
                n = len(data) - done - span + 1
                out, done = out[:n] * np.uint64(pow(BASE, span, 1 << 64)) + power[done:done + n], done + span
        rest >>= 1
        if rest:
            n = len(data) - 2 * span + 1
            power, span = power[:n] * np.uint64(pow(BASE, span, 1 << 64)) + power[span:span + n], 2 * span
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))) >> np.uint64(16)


def window_keys(data: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Least gram hash of every window of ``span`` bytes."""
    least, width, want = gram_hashes(data, gram), 1, span - gram + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    more = want - width
    return np.minimum(least[: len(least) - more], least[more:]) if more else least


def runs(texts: list[bytes], span: int, gram: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one key: text, first byte in the text, number of windows, key. Windows of a hot key have their own hash as key."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    keys = window_keys(data, span, gram)
    if hot is not None and len(hot):
        split = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
        keys = np.where(split, gram_hashes(data, span), keys)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(keys)]
    inside = np.arange(len(keys)) + span <= (begin + sizes)[doc]
    new = inside.copy()
    new[1:] &= (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return doc[at], at - begin[doc[at]], stop - at + 1, keys[at]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about AT_ONCE bytes, with the number of the first."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= AT_ONCE or i + 1 == len(texts):
            yield first, texts[first:i + 1]
            first, held = i + 1, 0


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary array whose items are ``values`` between consecutive ``edges``."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def group_edges(sorted_: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def by_value(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct owners, and each one's values as binary."""
    order = np.argsort(owner, kind="stable")
    edges = group_edges(owner[order])
    return owner[order][edges[:-1]], packed(values[order], edges)


# -- the way back to documents --------------------------------------------------------------------------


def to_owners(owner: np.ndarray, values: np.ndarray, buckets: int) -> list[pa.Array]:
    """Values by the bucket of their owner: bucket, owners, number of values of each, values; one row per bucket."""
    order = np.lexsort((owner, owner % buckets))
    owner, values = owner[order], values[order]
    target = owner % buckets
    of_bucket = group_edges(target)
    edges = group_edges(owner)  # an owner has one bucket, so its values stand together
    cuts = np.searchsorted(edges[:-1], of_bucket)
    return [
        pa.array(target[of_bucket[:-1]].astype(np.int32)), packed(owner[edges[:-1]], cuts), packed(np.diff(edges).astype(np.uint32), cuts), packed(values, of_bucket),
    ]


def from_blocks(owners: list[bytes], counts: list[bytes], values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Owner of every value, and the values."""
    each = [np.frombuffer(o, np.int64).repeat(np.frombuffer(c, np.uint32)) for o, c in zip(owners, counts, strict=True)]
    return np.concatenate(each), np.frombuffer(b"".join(values), kind)


def gathered(kind: str, merge):
    """Blocks of a task to (uid, values), one row per document; ``merge`` makes owners and their values of those of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [c for batch in batches for c in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True)]
        if not blocks:
            return
        owner, values = from_blocks(*zip(*blocks, strict=True), kind)
        order = np.argsort(owner, kind="stable")
        owner, values = owner[order], values[order]
        cuts = group_edges(owner)
        first = 0
        while first < len(cuts) - 1:  # about HELD values at a time, whole documents
            stop = max(first + 1, int(np.searchsorted(cuts, cuts[first] + HELD // 8, side="right")) - 1)
            who, blobs = merge(owner[cuts[first]:cuts[stop]], values[cuts[first]:cuts[stop]])
            yield pa.RecordBatch.from_arrays([pa.array(who), blobs], names=["uid", "found"])
            first = stop

    return run


def six(keys: np.ndarray) -> np.ndarray:
    """Keys in six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def wide(keys: np.ndarray) -> np.ndarray:
    """Keys of six bytes as numbers."""
    out = np.zeros((len(keys), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# -- hot keys -----------------------------------------------------------------------------------------


def keys_of(span: int, gram: int):
    """Batches of (text) to the keys of each chunk of texts with the number of texts that have it, if that is more than a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in chunks([t.as_py() for t in batch.column(0)]):
                doc, _, _, key = runs(part, span, gram)
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                found, count = np.unique(key[fresh], return_counts=True)
                some = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(found[some].astype(np.int64)), pa.array(count[some])], names=["key", "n"])

    return run


def hot_keys(rows: DataFrame, buckets: int, span: int, gram: int, looked_at: int = LOOKED_AT) -> np.ndarray:
    """Keys that more than a ``buckets``-th of the different texts looked at have: at most ``buckets`` times the keys of a mean text."""
    # copies of a text are one: they have one context
    some = rows.where(F.pmod("uid", F.lit(looked_at)) == 0).dropDuplicates(["uid"]).select("text")
    texts = rows.where(F.pmod("uid", F.lit(looked_at)) == 0).select("uid").distinct().count()
    counts = map_batches(some, keys_of(span, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(8, -(-texts // buckets))
    return np.sort(np.asarray([r["key"] for r in counts.where(F.col("n") > least).select("key").collect()], np.uint64))


# -- step 1: keys that several documents have ----------------------------------------------------------


KEY_BLOCK = ["bucket", "counts", "keys", "docs", "uids"]
BACK = ["bucket", "owners", "counts", "found"]
BACK_KIND = "bucket int, owners binary, counts binary, found binary"


def send_keys(buckets: int, span: int, gram: int, hot: np.ndarray | None = None):
    """Batches of (uid, id, text) to key blocks per bucket; keys that repeat inside the batch also go straight to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            texts = [t.as_py() for t in batch.column(2)]
            found = [(doc + first, key) for first, part in chunks(texts) for doc, _, _, key in [runs(part, span, gram, hot)]]
            if not found:
                continue
            names, number = np.unique(uid, return_inverse=True)
            doc, key = number[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key = doc[fresh], key[fresh]
            edges = group_edges(key)
            size = np.diff(edges)
            nth = np.arange(len(key)) - np.repeat(edges[:-1], size)
            repeated = np.repeat(size > 1, size)
            if repeated.any():
                target, owners, counts, blobs = to_owners(names[doc[repeated]], six(key[repeated]), buckets)
                yield pa.RecordBatch.from_arrays([target, counts, blobs, pa.nulls(len(target), pa.binary()), owners], names=KEY_BLOCK)
            few = nth < 2
            doc, key = doc[few], key[few]
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            doc, key, bucket = doc[order], key[order], bucket[order]
            edges = group_edges(bucket)
            rows = [[], [], []]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine, short = np.unique(doc[a:b], return_inverse=True)
                rows[0].append(six(key[a:b]).tobytes())
                rows[1].append(short.astype(np.uint16 if len(mine) < 1 << 16 else np.uint32).tobytes())
                rows[2].append(names[mine].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]]), pa.nulls(len(rows[0]), pa.binary()), *[pa.array(r, pa.binary()) for r in rows]], names=KEY_BLOCK)

    return run


def repeated_keys(buckets: int):
    """Key blocks of a task to blocks of documents with their keys that two documents have; what is settled already passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, uids = [], []
        for batch in batches:
            done = pa.compute.is_valid(batch.column(1))
            passing = batch.filter(done)
            if passing.num_rows:
                yield pa.RecordBatch.from_arrays([passing.column(i) for i in (0, 4, 1, 2)], names=BACK)
            for key, doc, names in zip(*(c.to_pylist() for c in batch.filter(pa.compute.invert(done)).columns[2:]), strict=True):
                keys.append(wide(np.frombuffer(key, "V6")))
                uids.append(np.frombuffer(names, np.int64)[np.frombuffer(doc, np.uint16 if len(doc) == 2 * len(keys[-1]) else np.uint32)])
        if keys:
            key, uid = np.concatenate(keys), np.concatenate(uids)
            order = np.lexsort((uid, key))
            key, uid = key[order], uid[order]
            edges = group_edges(key)
            several = np.repeat(uid[edges[:-1]] != uid[edges[1:] - 1], np.diff(edges))
            if several.any():
                yield pa.RecordBatch.from_arrays(to_owners(uid[several], six(key[several]), buckets), names=BACK)

    return run


# -- step 2: contexts -----------------------------------------------------------------------------------


BLOCK = ["bucket", "counts", "ranges", "uids", "ids", "of_text", "of_doc", "starts", "keys", "sizes", "texts"]
BLOCK_KIND = "bucket int, counts binary, ranges binary, uids binary, ids binary, of_text binary, of_doc binary, starts binary, keys binary, sizes binary, texts binary"


def parts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about HELD bytes of text, at most ROWS."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, min(first + ROWS, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD, side="right"))))
            yield batch.slice(first, stop - first)
            first = stop


def merged_ranges(uid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges by document; those that overlap or touch are one."""
    order = np.lexsort((low, uid))
    uid, low, high = uid[order], low[order], high[order]
    _, number = np.unique(uid, return_inverse=True)
    far = int(high.max(initial=0)) + 1
    reach = np.maximum.accumulate(high + number * far)  # texts one behind the other, so that none reaches into the next
    new = np.ones(len(uid), bool)
    new[1:] = (low + number * far)[1:] > reach[:-1]
    new[1:] |= uid[1:] != uid[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid)) - 1
    return uid[first], np.column_stack([low[first], reach[last] - number[last] * far]).astype(np.int64).view("V16").ravel()


def settled_rows(uid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents, and the merged ranges of each as binary."""
    return by_value(*merged_ranges(uid, low, high))


def send_contexts(buckets: int, span: int, gram: int, hot: np.ndarray | None = None):
    """Batches of (uid, id, text, keys) to blocks of contexts per bucket, and ranges that are settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 2):
            uid, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.as_py() for t in batch.column(2)]
            own = [np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])) for blobs in batch.column(3).to_pylist()]
            owner = np.repeat(np.arange(len(own)), [len(o) for o in own]).astype(np.uint64)
            known = (owner << np.uint64(48)) | np.concatenate(own)  # sorted: batches have fewer than 2**16 rows
            number: dict[bytes, int] = {}
            which, found = [], []
            for first, part in chunks(texts):
                doc, start, count, key = runs(part, span, gram, hot)
                doc = doc + first
                mark = (doc.astype(np.uint64) << np.uint64(48)) | key
                at = np.searchsorted(known, mark)
                hit = known[np.minimum(at, len(known) - 1)] == mark
                doc, start, count, key = doc[hit], start[hit], count[hit], key[hit]
                which += [number.setdefault(texts[d][a:b], len(number)) for d, a, b in zip(doc.tolist(), start.tolist(), (start + count + (span - 1)).tolist(), strict=True)]
                found.append((doc, start, key))
            if not which:
                continue
            which = np.asarray(which, np.int64)
            doc, start, key = (np.concatenate([f[i] for f in found]) for i in range(3))
            contexts = list(number)
            size = np.fromiter(map(len, contexts), np.int64, len(contexts))
            key_of = np.zeros(len(contexts), np.uint64)
            key_of[which] = key
            least = np.full(len(contexts), NO_ID)
            np.minimum.at(least, which, ids[doc])
            later = ids[doc] > least[which]
            if later.any():
                target, owners, counts, blobs = to_owners(*merged_ranges(uid[doc[later]], start[later], start[later] + size[which[later]]), buckets)
                yield pa.RecordBatch.from_arrays([target, counts, blobs, owners, *[pa.nulls(len(target), pa.binary())] * 7], names=BLOCK)
            doc, start, which = doc[~later], start[~later], which[~later]
            # contexts by bucket, then the places that ask for them
            bucket = (key_of % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            edges = group_edges(bucket[order])
            places = np.argsort(rank[which], kind="stable")
            which, doc, start = rank[which][places], doc[places], start[places]
            cuts = np.searchsorted(which, edges)
            rows: list[list] = [[] for _ in range(8)]
            for (a, b), (c, d) in zip(itertools.pairwise(edges.tolist()), itertools.pairwise(cuts.tolist()), strict=True):
                mine, short = np.unique(doc[c:d], return_inverse=True)
                inside = order[a:b]
                for row, value in zip(rows, (
                    uid[mine], ids[mine], (which[c:d] - a).astype(np.uint32), short.astype(np.uint16), start[c:d].astype(np.uint32),
                    six(key_of[inside]), size[inside].astype(np.uint32)), strict=False):
                    row.append(value.tobytes())
                rows[7].append(b"".join([contexts[i] for i in inside.tolist()]))
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), *[pa.nulls(n, pa.binary())] * 2, *[pa.array(r, pa.binary()) for r in rows]], names=BLOCK)

    return run


# -- step 3: merged Burrows-Wheeler transforms -------------------------------------------------------------


def shard_order(line: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of a shard in order, by doubling: ``line`` holds symbols (0 ends a text), ``ends`` the places of the zeros, texts in order."""
    n = len(line)
    rank = line.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))  # ends differ, in the order of the texts
    width, top = 1, int(line.max(initial=0)) + len(ends) + 2
    while True:
        other = np.zeros(n, np.int64)
        other[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (top + 1) + other
        width *= 2
        if width == 2 and top**4 < 1 << 62:  # four symbols fit as they are
            rank, top = pair, top * (top + 1) + top + 1
            continue
        order = np.argsort(pair)
        new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        if new[-1] == n - 1 or width >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        top = int(new[-1]) + 1


def merged_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, text of every place, places in the order of their first ``depth`` symbols) of sorted distinct texts.

    The interleave is kept as the rows of all shards' transforms in merged order. A pass reads the symbols before them in that
    order and deals the rows stably by symbol; a row's place among its own symbol is where its transform leads
    (last-to-first), so each shard's rows keep the order of their shard. Two symbols are dealt at once where a pair fits 16 bits.
    """
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    line = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(size) - 1
    line[ends] = 0
    used, line = np.unique(line, return_inverse=True)  # few symbols occur
    line = line.astype(np.uint16)
    owner = np.repeat(np.arange(len(texts)), size)
    cut = np.searchsorted(ends, np.arange(0, len(line), SHARD)[1:])
    cuts = np.unique(np.concatenate([[0], cut, [len(texts)]]))
    orders = []
    for a, b in itertools.pairwise(cuts.tolist()):
        lo, hi = (int(ends[a - 1]) + 1 if a else 0), int(ends[b - 1]) + 1
        orders.append(shard_order(line[lo:hi], ends[a:b] - lo) + lo)
    places = np.concatenate(orders)
    if len(orders) == 1:
        return line, owner, places
    row = np.empty(len(places), np.int32)
    row[places] = np.arange(len(places), dtype=np.int32)
    before = np.arange(-1, len(line) - 1)
    before[ends - size + 1] = ends  # before a text's first symbol stands its end
    step = 1
    symbols, lead = line[before], before
    if len(used) < 256:
        step, symbols, lead = 2, line[before[before]] * np.uint16(len(used)) + line[before], before[before]
    symbols, lead = symbols[places], row[lead[places]]
    current = np.arange(len(places), dtype=np.int32)
    for _ in range(0, depth, step):
        moved = lead[current[np.argsort(symbols[current], kind="stable")]]
        if np.array_equal(moved, current):
            break
        current = moved
    return line, owner, places[current]


def least_ids(texts: list[bytes], ids: np.ndarray, span: int) -> list[np.ndarray]:
    """For every window of every text the smallest id among texts that hold it. Texts are sorted and distinct."""
    line, owner, order = merged_order(texts, span)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    nth = order - begin[owner[order]]
    order = order[nth + span <= size[owner[order]]]
    # common prefix of neighbours, up to ``span``: eight bytes at a time (windows hold no ends)
    wide = np.concatenate([line.astype(np.uint64), np.ones(8, np.uint64)]) - np.uint64(1)
    for width in (1, 2, 4):
        wide = (wide[: len(wide) - width] << np.uint64(8 * width)) + wide[width:]
    same = np.ones(max(0, len(order) - 1), bool)
    for j in [*range(0, span - 7, 8), span - 8]:
        value = wide[order + j]
        same &= value[1:] == value[:-1]
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    least = np.minimum.reduceat(ids[owner[order]], starts)
    flat = np.empty(len(line), np.int64)
    flat[order] = np.repeat(least, np.diff(np.concatenate([starts, [len(order)]])))
    return [flat[b:b + s - span + 1] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def settle_contexts(buckets: int, span: int):
    """Context blocks of a task to blocks of documents with the ranges of windows that a smaller id holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            done = pa.compute.is_valid(batch.column(1))
            passing = batch.filter(done)
            if passing.num_rows:
                yield pa.RecordBatch.from_arrays([passing.column(i) for i in (0, 3, 1, 2)], names=BACK)
            for uids, ids, of_text, of_doc, starts, key, sizes, texts in zip(*(c.to_pylist() for c in batch.filter(pa.compute.invert(done)).columns[3:]), strict=True):
                cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))]).tolist()
                local = np.asarray([number.setdefault(texts[a:b], len(number)) for a, b in itertools.pairwise(cuts)], np.int64)
                keys.append(np.column_stack([local.astype(np.uint64), wide(np.frombuffer(key, "V6"))]))
                doc = np.frombuffer(of_doc, np.uint16)
                parts.append((np.frombuffer(uids, np.int64)[doc], np.frombuffer(ids, np.int64)[doc], np.frombuffer(starts, np.uint32).astype(np.int64), local[np.frombuffer(of_text, np.uint32)]))
        if not parts:
            return
        uid, ids, start, which = (np.concatenate([p[i] for p in parts]) for i in range(4))
        pairs = np.concatenate(keys)
        texts = list(number)
        least = np.full(len(texts), NO_ID)
        np.minimum.at(least, which, ids)
        of = np.zeros(len(texts), np.uint64)
        of[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
        _, group, members = np.unique(of, return_inverse=True, return_counts=True)
        lone = members[group] == 1
        windows = np.fromiter((len(t) - span + 1 for t in texts), np.int64, len(texts))
        flat, begin = np.repeat(least, windows), np.cumsum(windows) - windows
        shared = np.flatnonzero(~lone)  # texts with a key that another text has: their windows may be equal in part
        # equal windows have equal keys, so keys can be taken a portion at a time
        portions = max(1, -(-int(windows[shared].sum() + (span + 1) * len(shared)) // MERGED))
        portion = (of[shared] // np.uint64(1 << 24)) % np.uint64(portions)
        for k in range(portions):
            some = sorted(shared[portion == k].tolist(), key=texts.__getitem__)
            if some:
                for i, found in zip(some, least_ids([texts[i] for i in some], least[some], span), strict=True):
                    flat[begin[i]:begin[i] + windows[i]] = found
        gone_from: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(which), 50_000):
            w, n = which[a:a + 50_000], windows[which[a:a + 50_000]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(np.arange(len(w)), n)
            gone = flat[begin[w][place] + nth] < ids[a:a + 50_000][place]
            place, nth = place[gone], nth[gone]
            if not len(place):
                continue
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (nth[1:] != nth[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(place)]]) - 1
            low = start[a:a + 50_000][place[first]] + nth[first]
            high = start[a:a + 50_000][place[last]] + nth[last] + span
            gone_from.append(merged_ranges(uid[a:a + 50_000][place[first]], low, high))
        if gone_from:
            who, found = (np.concatenate(g) for g in zip(*gone_from, strict=True))
            yield pa.RecordBatch.from_arrays(to_owners(who, found, buckets), names=BACK)

    return run


def cut_out(span: int):
    """Batches of (id, text, least, ranges) to what is left of each text; ``least`` is the smallest id that has this very text."""
    return lambda batches: (pa.RecordBatch.from_arrays(left_over(batch, span), names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]) for batch in batches)


def left_over(batch: pa.RecordBatch, span: int) -> list[pa.Array]:
    rows: list[list] = [[], [], [], []]
    for own, text, least, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        text = text.as_py()
        if least < own and len(text) >= span:  # a copy
            blobs = [np.asarray([0, len(text)], np.int64).tobytes()]
        spans, left = [], [text]
        if blobs:
            ranges = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs])
            ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
            reach = np.maximum.accumulate(ranges[:, 1])
            new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
            low = ranges[new, 0]
            high = reach[np.concatenate([np.flatnonzero(new)[1:], [len(ranges)]]) - 1]
            spans = list(zip(low.tolist(), high.tolist(), strict=True))
            left, at = [], 0
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
        kept = b"".join(left)
        for column, value in zip(rows, (len(text), len(text) - len(kept), len(spans), kept), strict=True):
            column.append(value)
    digest = [hashlib.sha256(k).hexdigest() for k in rows[3]]
    return [batch.column(0), *[pa.array(r, pa.int64()) for r in rows[:3]], pa.array(digest, pa.string()), pa.array(rows[3], pa.binary())]


def merge_found(owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    low, high = np.ascontiguousarray(found).view(np.int64).reshape(-1, 2).T
    return settled_rows(owner, low, high)


def text_name(text: Column, turn: int) -> Column:
    """A 64-bit name of a text; another one each turn."""
    return F.xxhash64(text, F.octet_length(text), F.lit(turn)) if turn else F.xxhash64(text, F.octet_length(text))


def named_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a 64-bit name ``uid`` of their text, and a written table of names with the smallest id of each.

    Different texts with one name (about forty pairs in 4e10 texts) are told by 60 bits of a second hash, and named anew until no two share a name.
    """
    second = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    named, turn = rows.select(text_name(F.col("text"), 0).alias("uid"), "id", "text"), 0
    while True:
        each = named.select("uid", "id", second.alias("second")).groupBy("uid")
        names = stored(each.agg(F.min("id").alias("least"), F.min("second").alias("low"), F.max("second").alias("high")), f"names_{turn}")
        clash = names.where("low <> high").select("uid", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return named, names.select("uid", "least")
        turn += 1
        own = F.when(F.col("clash"), text_name(F.col("text"), turn)).otherwise(F.col("uid"))
        named = named.join(stored(clash, f"clashes_{turn}"), "uid", "left").select(own.alias("uid"), "id", "text")


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, looked_at: int = LOOKED_AT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the remaining bytes) of every row.

    A byte goes if a ``span``-byte string that covers it also starts in a document with a smaller id. Texts are whole, as UTF-8 bytes; a null
    text is empty. Repetition inside one document, or under one id, is no reason. A null id is greater than all
    others. Repeated rows have the same result each. Texts are told apart by 124 bits of two hashes (see ``named_texts``). An empty table gives an empty result.
    """
    if span < gram or span < 8:
        raise ValueError("the span must hold a gram, and 8 bytes")
    text = whole_text(text_col).cast("binary")
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID)))
    rows, least = named_texts(docs.select(number.alias("id"), text.alias("text")))
    buckets = tasks(docs)
    hot = hot_keys(rows, buckets, span, gram, looked_at)
    sent = map_batches(rows, send_keys(buckets, span, gram, hot), "bucket int, counts binary, keys binary, docs binary, uids binary")
    again = map_batches(sent.repartition(buckets, "bucket"), repeated_keys(buckets), BACK_KIND)
    keys = map_batches(again.repartition(buckets, "bucket"), gathered("V6", lambda owner, found: by_value(owner, wide(found))), "uid long, found binary")
    wanted = keys.join(least, "uid").select("uid", F.array("found").alias("keys"), "least")
    # copies of one text have one uid: the smallest id stands for all of them. "<=" is "=" here, but leaves uid the only
    # join key, so both joins with the texts share one exchange
    contexts = map_batches(rows.join(wanted, "uid").where("id <= least").select("uid", "id", "text", "keys"), send_contexts(buckets, span, gram, hot), BLOCK_KIND)
    back = map_batches(contexts.repartition(buckets, "bucket"), settle_contexts(buckets, span), BACK_KIND)
    ranges = map_batches(back.repartition(buckets, "bucket"), gathered("V16", merge_found), "uid long, found binary")
    gone = least.join(ranges.select("uid", F.array("found").alias("ranges")), "uid", "left")
    left = rows.join(gone, "uid").select("id", "text", "least", "ranges")
    out = map_batches(left, cut_out(span), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(int(NO_ID))).cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
