"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's word shingles. Fingerprints that
differ in at most ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits. For each block
the fingerprints are rotated so that it leads, and sorted by Gray rank; the sorted line is
cut into segments of bounded size. A segment is indexed as a tree: a node keeps the bits that all
fingerprints below it share and that no node above it has, and a search adds up the differences on the
way down and drops whole groups once they exceed the radius. Segments that hold parts of
the same block value are searched against each other, pair by pair, so no group has to fit into one task.
Links become components by repeated random contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import map_batches, stored, whole_text

BITS = 64
FANOUT = 16
SEGMENT = 4096


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """Majority bits of a text; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)  # of one shingle
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
    stops = (ends - 1)[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp`` (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("_id"), whole_text(text_col).cast("binary")), run, f"_id {kind}, fp long")


# -- the index ---------------------------------------------------------------


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over codes in Gray order.

    ``levels[0]`` are the codes, each higher level joins ``FANOUT`` neighbours. ``bits`` and ``mask`` of a node hold what
    everything below shares, less what the nodes above hold already.
    """

    def __init__(self, codes: np.ndarray):
        full = [(codes, np.full(len(codes), np.iinfo(np.uint64).max, np.uint64))]
        while len(full[-1][0]) > FANOUT:
            bits, mask = full[-1]
            starts = np.arange(0, len(bits), FANOUT)
            all_and, all_or = np.bitwise_and.reduceat(bits, starts), np.bitwise_or.reduceat(bits, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(all_and ^ all_or)
            full.append((all_and & shared, shared))
        self.levels = []
        for i, (bits, mask) in enumerate(full):
            own = mask
            if i + 1 < len(full):
                own = mask & ~np.repeat(full[i + 1][1], FANOUT)[: len(mask)]
            self.levels.append((bits & own, own))

    def search(self, queries: np.ndarray, radius: int, lead: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, code) positions that differ in at most ``radius`` bits and in none of ``lead``."""
        for at in range(0, len(queries), 256):
            part = queries[at:at + 256]
            who = np.repeat(np.arange(len(part)), len(self.levels[-1][0]))
            node = np.tile(np.arange(len(self.levels[-1][0])), len(part))
            sofar = np.zeros(len(who), np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                bits, mask = self.levels[level]
                off = (part[who] ^ bits[node]) & mask[node]
                sofar = sofar + np.bitwise_count(off)
                keep = (sofar <= radius) & ((off & lead) == 0)
                who, node, sofar = who[keep], node[keep], sofar[keep]
                if level:
                    width = len(self.levels[level - 1][0])
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    who, sofar = np.repeat(who, FANOUT), np.repeat(sofar, FANOUT)
                    inside = node < width
                    who, node, sofar = who[inside], node[inside], sofar[inside]
            yield who + at, node


def spanning(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of linked positions; a root is the smallest position of its tree."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


def linked(codes: np.ndarray, others: np.ndarray | None, radius: int, lead: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within a segment, or between two: (code, code of its root)."""
    line = codes if others is None else np.concatenate([codes, others])
    index, shift = GrayIndex(codes), 0 if others is None else len(codes)
    parent = np.arange(len(line))
    for query, node in index.search(codes if others is None else others, radius, lead):
        keep = query != node if others is None else slice(None)
        parent = spanning(parent, (query + shift)[keep], node[keep])
    at = np.flatnonzero(parent != np.arange(len(line)))
    return line[at], line[parent[at]]


def rotations(radius: int) -> list[int]:
    """Left turns that bring each of ``radius + 1`` blocks to the front."""
    return [BITS * i // (radius + 1) for i in range(radius + 1)]


def turned(code: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    by = np.asarray(by, np.uint64)
    return np.where(by == 0, code, (code << by) | (code >> (np.uint64(BITS) - np.maximum(by, np.uint64(1)))))


def segments_of(fps: DataFrame, radius: int, segment: int) -> DataFrame:
    """One row per segment of the Gray-sorted lines: turn, seg, first and last block, codes."""
    turns = rotations(radius)
    width = BITS // (radius + 1)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for by in turns:
                rank = gray_rank(turned(code, by)) ^ np.uint64(1 << 63)  # signed order is the unsigned order
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), by, np.int32)), pa.array(rank.view(np.int64))], names=["turn", "rank"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(by: int, rank: np.ndarray) -> pa.RecordBatch:
            rank = rank.view(np.uint64) ^ np.uint64(1 << 63)
            code = rank ^ (rank >> np.uint64(1))
            top = code >> np.uint64(BITS - width)
            return pa.RecordBatch.from_arrays(
                [pa.array([by], pa.int32()), pa.array([int(top[0])], pa.int64()), pa.array([int(top[-1])], pa.int64()), pa.array([code.tobytes()], pa.binary())],
                names=["turn", "low", "high", "codes"])

        held, of = [], None
        for batch in batches:
            turn_, rank_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(turn_)) + 1, [len(turn_)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and of != turn_[a]:
                    yield row(of, np.concatenate(held))
                    held = []
                of = int(turn_[a])
                held.append(rank_[a:b])
                while sum(map(len, held)) >= segment:
                    line = np.concatenate(held)
                    yield row(of, line[:segment])
                    held = [line[segment:]] if len(line) > segment else []
        if held:
            yield row(of, np.concatenate(held))

    lines = map_batches(fps, turn, "turn int, rank long").repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    cuts = map_batches(lines, cut, "turn int, low long, high long, codes binary")
    return stored(cuts.withColumn("seg", F.monotonically_increasing_id()), "gray_segments")


def links(fps: DataFrame, radius: int = 3, segment: int = SEGMENT) -> DataFrame:
    """Links (a, b) between fingerprints; their components are those of all pairs within ``radius`` bits.

    Within a segment, or a pair of segments, a found component is given as links to one of its members, so
    the output is linear in what was read even where all fingerprints are near each other.
    """
    width = BITS // (radius + 1)
    lead = np.uint64(((1 << width) - 1) << (BITS - width))
    segments = segments_of(fps, radius, segment)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, codes, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = linked(np.frombuffer(codes, np.uint64), None if others is None else np.frombuffer(others, np.uint64), radius, lead)
                back = (BITS - by) % BITS
                yield pa.RecordBatch.from_arrays([pa.array(turned(x, back).view(np.int64)) for x in (a, b)], names=["a", "b"])

    # segments that share a block value: only their first or last block can run on into others
    ends = segments.select("turn", "seg", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    left, right = ends.withColumnRenamed("seg", "one"), ends.withColumnRenamed("seg", "two")
    pairs = left.join(right, ["turn", "block"]).where("one < two").select("one", "two").distinct()
    one = segments.select(F.col("seg").alias("one"), "turn", "codes")
    two = segments.select(F.col("seg").alias("two"), F.col("codes").alias("others"))
    across = pairs.join(one, "one").join(two, "two").select("turn", "codes", "others")
    inside = segments.select("turn", "codes", F.lit(None).cast("binary").alias("others"))
    jobs = inside.unionByName(across)
    return map_batches(jobs.repartition(F.xxhash64("codes", "others")), search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): nodes have the same root if and only if they are connected.

    Each round every node moves to the neighbour (or itself) with the least random rank, and the graph is drawn
    on the places moved to; a constant share of nodes goes each round. Rounds are written, so lost
    executors repeat one round at most. The driver sees only whether links are left.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, turn = None, 0
    while not edges.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("r"), F.col(c).alias("n"))
        move = both(edges).groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = stored(move.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("root")), "moves")
        to = lambda c: move.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        drawn = edges.join(to("a"), "a").join(to("b"), "b").where("_a <> _b")
        drawn = drawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        if roots is None:
            roots = move
        else:
            roots = roots.join(move.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left")
            roots = roots.select("node", F.coalesce("_next", "root").alias("root"))
        edges, roots, turn = stored(drawn, "links"), stored(roots, "roots"), turn + 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row.

    A null or empty text has no words: fingerprint 0, linked like any other. Texts shorter than a shingle are one
    shingle. Rows with the same id or text keep a row each. Ids that are null are never a component's name unless all
    its ids are. Equal fingerprints are one node of the graph, so groups of copies are never expanded.
    An empty table gives an empty result.
    """
    found = stored(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("_id").alias("_least"))
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    placed = stored(placed, "placed")
    names = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = placed.join(names, "_root").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each component the row with the smallest id stays.

    A null id is greater than all others. Rows that share an id are told apart by their text, and identical rows are one.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text"))
    keyed = docs.select(key.alias("_key"), *[F.col(c) for c in docs.columns])
    names = near_duplicates(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **options)
    first = names.where("_key = component_id").select("_key").distinct()
    return keyed.join(first, "_key").dropDuplicates(["_key"]).select(*docs.columns)
