"""Near copies by SimHash and minwise candidates, and exact similarity of five-word shingles.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of at least ``least``. First candidates
are texts whose SimHash fingerprints (of their sets) the Gray-order index of ``simhash`` links. Fingerprints within few bits miss most pairs
near 0.8, so texts that agree in all minima of one of ``BANDS`` bands of ``ROWS`` minwise hashes are candidates too: at a similarity of
0.8 a pair is missed with a probability of (1 - 0.8**6)**26, about 0.0004, and with less above. Every candidate is verified by its sets.
Texts with equal sets are one node. In a group of candidates a leader is compared with all members of other components and leaves it, a few
rounds long; what remains is compared block by block inside tasks, which give links that connect and no list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm import simhash
from panelscope.llm.common import map_batches, stored, whole_text
from panelscope.llm.simhash import components

ROWS = 6
BANDS = 26
#: Rounds in which the leaders of groups are compared with the other members.
ROUNDS = 2
#: Shingles hashed at a time.
AT_ONCE = 4096
#: Bits in which linked SimHash fingerprints differ at most.
RADIUS = 3
#: Hashes of a block of a group, where a member counts as ``MEMBER`` more, and hashes of two blocks that are laid out at a time.
BLOCK = 1 << 18
MEMBER = 128
LAID_OUT = 4096

_DRAW = np.random.default_rng(42)
FACTORS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    words = min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
    stops = (ends - 1)[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b]) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value per band of minwise hashes; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, ((hashes[at:at + AT_ONCE, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def described(docs: DataFrame, words: int) -> DataFrame:
    """_key, ``node`` (a digest of the set of shingles), its fingerprint ``fp`` and ``bands`` of rows (_key, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(1)]
            nodes = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
            fps = np.fromiter((simhash.majority(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), nodes, pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["_key", "node", "fp", "bands"])

    kind = docs.schema["_key"].dataType.simpleString()
    return map_batches(docs.select("_key", whole_text("_text").cast("binary")), run, f"_key {kind}, node binary, fp long, bands array<long>")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``shingles`` (sorted hashes) and their number ``size`` for rows (node, bands, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                names=["node", "bands", "shingles", "size"])

    return map_batches(texts.select("node", "bands", "text"), run, "node binary, bands array<long>, shingles binary, size long")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are at least ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2), batch.column(3), strict=True)
            near = [similarity(*(np.frombuffer(x.as_buffer(), np.uint64) for x in two)) >= least for two in found]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"_{n}")) for n in "ab")
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), run, "a binary, b binary")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect what the fingerprints' index links; nodes of one fingerprint are paired with the first."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near_fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (firsts.select(F.col("fp").alias(f"_{n}"), F.col("first").alias(n)) for n in "ab")
    links = simhash.links(firsts.select("fp"), RADIUS).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    across = links.join(one, "_a").join(two, "_b").select("a", "b")
    return same.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Size of the intersection of every set of ``left`` with every one of ``right`` (of ``left`` itself, if not given)."""
    line = left if right is None else [*left, *right]
    owner = np.repeat(np.arange(len(line)), [len(s) for s in line])
    _, name, often = np.unique(np.concatenate(line), return_inverse=True, return_counts=True)
    shared = often > 1  # in two sets at least
    owner, name = owner[shared[name]], (np.cumsum(shared) - 1)[name[shared[name]]]
    order = np.argsort(name, kind="stable")
    owner, name, names = owner[order], name[order], int(shared.sum())
    both = np.zeros((len(left), len(line) - (0 if right is None else len(left))), np.int64)
    for at in range(0, names, LAID_OUT):
        lo, hi = np.searchsorted(name, [at, at + LAID_OUT])
        laid = np.zeros((len(line), min(LAID_OUT, names - at)), np.float32)
        laid[owner[lo:hi], name[lo:hi] - at] = 1
        both += (laid[:len(left)] @ laid[0 if right is None else len(left):].T).astype(np.int64)
    return both


def connected(group: int, sides: list[list[tuple]], least: float) -> tuple[list[bytes], list[bytes]]:
    """Links that connect what is near between two blocks of a group, or within one: members (node, root, bands, set).

    Members of one component are not compared, nor are those that share an earlier band: they meet in that band's group.
    """
    one, two = sides if sides[1] else (sides[0], sides[0])
    inside = not sides[1]
    if not one:
        return [], []
    band_a, band_b = (np.stack([m[2] for m in side]) for side in (one, two))
    root_a, root_b = (np.array([m[1] for m in side], object) for side in (one, two))
    wanted = (root_a[:, None] != root_b[None, :]).astype(bool)
    for k in range(int(np.argmax(band_a[0] == group))):
        wanted &= band_a[:, k][:, None] != band_b[:, k][None, :]
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return [], []
    left = [one[i][3] for i in rows]
    right = None if inside else [two[i][3] for i in columns]
    both = overlaps(left, right)
    size = [np.array([len(s) for s in x], np.int64) for x in (left, left if right is None else right)]
    near = both / np.maximum(1, size[0][:, None] + size[1][None, :] - both) >= least
    a, b = np.nonzero(near & wanted[np.ix_(rows, columns)])
    nodes = [one[i][0] for i in rows] + ([] if inside else [two[i][0] for i in columns])
    parent = simhash.spanning(np.arange(len(nodes)), a, b + (0 if inside else len(rows)))
    at = np.flatnonzero(parent != np.arange(len(nodes)))
    return [nodes[i] for i in at], [nodes[i] for i in parent[at]]


def block_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all near members of different components in the groups (node, g, root).

    A group is cut into blocks of bounded size by hash of the node; every block meets every other one of its group.
    """
    sized = members.join(sets.select("node", "size"), "node")
    groups = sized.groupBy("g").agg(F.ceil(F.sum(F.col("size") + MEMBER) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), "blocks")
    meets = members.join(groups, "g").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    jobs = meets.select(
        "node", "g", "root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).alias("second"))
    key = ["g", "one", "two"]
    lines = jobs.join(sets, "node").select(*key, "second", "node", "root", "bands", "shingles").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(of: tuple, sides: list[list[tuple]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in connected(of[0], sides, least)], names=["a", "b"])

        of, sides = None, [[], []]
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for i, (at, second, node, root) in enumerate(zip(keys, *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)):
                if at != of:
                    if of is not None:
                        yield found(of, sides)
                    of, sides = at, [[], []]
                shingled = np.frombuffer(batch.column(7)[i].as_py(), np.uint64)
                sides[second].append((node, root, batch.column(6)[i].values.to_numpy(), shingled))
        if of is not None:
            yield found(of, sides)

    return map_batches(lines, run, "a binary, b binary")


def near_copies(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(_key) of the rows (_key, _text) that are the first of their component by key."""
    rows = stored(described(docs, words), "near_described")
    nodes = stored(rows.groupBy("node").agg(F.min("_key").alias("_least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near_nodes")
    close = stored(fingerprint_pairs(nodes.select("node", "fp")), "near_pairs")
    each = nodes.select("node", F.explode("bands").alias("g"))
    groups = stored(each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "near_groups")
    members = stored(each.join(groups, "g").select("node", "g"), "near_members")
    met = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = nodes.join(met, "node").select(F.col("_least").alias("_key"), "node", "bands")
    texts = docs.join(wanted, "_key").dropDuplicates(["_key"]).select("node", "bands", whole_text("_text").cast("binary").alias("text"))
    sets = stored(sets_of(texts, words), "near_sets")

    linked = stored(verified(close, sets, least), "near_links")
    for turn in range(ROUNDS + 1):
        roots = components(linked)
        to = roots.select("node", F.col("root").alias("_root"))
        placed = members.join(to, "node", "left").select("node", "g", F.coalesce("_root", "node").alias("root"))
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node").alias("n"), F.col("root").alias("c"))).alias("lead")
        # groups of one component are done
        leaders = placed.groupBy("g").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        leaders = stored(leaders.select("g", F.col("lead.n").alias("leader"), F.col("lead.c").alias("own")), "near_leaders")
        open_ = stored(placed.join(leaders, "g"), "near_open")
        if open_.isEmpty():
            break
        if turn < ROUNDS:
            pairs = open_.where("root <> own").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
            more = verified(stored(pairs.distinct(), "near_pairs"), sets, least)
        else:
            more = block_links(open_.select("node", "g", "root"), sets, least)
        linked = linked.unionByName(stored(more, "near_links"))
        members = open_.where("node <> leader").select("node", "g")
        if turn == ROUNDS:
            roots = components(linked)
    nodes = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("node"), "_least")
    return nodes.groupBy("node").agg(F.min("_least").alias("_key")).select("_key")


def first_of_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less near copies: of each component of similar texts the row with the smallest id stays.

    Texts count as lower-case words parted by ASCII blanks. A component is what pairs of similarity ``least`` or more connect, so a
    row may go whose likeness to the one that stays is by way of others. Texts without words are copies of each other. A null id is greater
    than all others. Rows that share an id are told apart by their text, and identical rows are one. An empty table gives an empty result.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text"))
    keyed = docs.select(key.alias("_key"), *[F.col(c) for c in docs.columns])
    first = near_copies(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), words, least)
    return keyed.join(first, "_key").dropDuplicates(["_key"]).select(*docs.columns)
