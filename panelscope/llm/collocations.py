"""Phrase collocations from exact counts, taken with burstable hash containers under a shallow trie of word ids.

Texts are read three times, each time for longer phrases: words, pairs of frequent words, and phrases of three words and
more in which every pair is frequent. No phrase is more frequent than its parts, so nothing is lost. Which words and pairs are
frequent travels to the tasks as a bitmap of their hashes, of a size that does not depend on the input; a phrase that a clash of
hashes lets through is counted in vain, and dropped by its count.

A task counts in HAT-tries, one per language and length. Below a first word stands a hash container of the remaining word ids; a
container that grows too large bursts into a branch with a container per next word. When the tries are full, their largest
subtrees leave as sorted runs, one row per part. A part is what a hash of the first word names (of the first two, if the first is
one of the at most a thousand words that make a thousandth of the corpus each); runs are dealt out by part and merged there.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import map_batches, stored, tasks, whole_text

#: A-Z as a-z, a character that ends a piece as line feed, tab as blank.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + BREAKS + b"\t", string.ascii_lowercase.encode() + b"\n" * len(BREAKS) + b" ")
#: Bytes of text counted at a time, sequences all tries of a task hold, words it numbers, sequences of a container.
AT_ONCE = 2_000_000
HELD = 700_000
WORDS = 300_000
BURST = 16_384
#: Bits that tell frequent words or pairs.
FILTER_BITS = 1 << 26
RUNS = "part int, lang string, phrases string, counts string"
#: Parts of runs (more, if the session has more than half as many shuffle partitions), and the share of all words from which on
#: a first word's phrases are split.
PARTS = 4096
HOT = 1000


class Branch(dict):
    """A burst container: containers (or branches) by the next word's id."""


class HatTrie:
    """Counts of sequences of ``length`` word ids. A first word names a subtree, which leaves as a whole."""

    def __init__(self, length: int, burst: int = BURST):
        self.length, self.burst = length, burst
        self.subtrees: dict[int, Counter | Branch] = {}
        self.sizes: Counter = Counter()

    def add(self, sequences: np.ndarray) -> int:
        """Count the rows of a matrix of ids; returns how many sequences are new."""
        sequences = sequences[np.argsort(sequences[:, 0].astype(np.uint64) << np.uint64(32) | sequences[:, 1], kind="stable")]
        first = sequences[:, 0]
        rest = np.ascontiguousarray(sequences[:, 1:])
        keys = rest.view(f"V{4 * (self.length - 1)}").ravel().tolist()
        starts = np.flatnonzero(np.diff(first, prepend=-1)).tolist()
        new = 0
        for word, i, j in zip(first[starts].tolist(), starts, [*starts[1:], len(keys)], strict=True):
            node = self.subtrees.get(word)
            if node is None:
                node = self.subtrees[word] = Counter()
            more = self._fill(self.subtrees, word, node, keys[i:j], self.length - 1)
            self.sizes[word] += more
            new += more
        return new

    def _fill(self, parent: dict, step: int | bytes, node: Counter | Branch, keys: list[bytes], words: int) -> int:
        """Add keys, sorted by their first word, below a node; the node bursts if it gets too large."""
        if type(node) is not Branch:
            before = len(node)
            if len(keys) > 8:
                node.update(keys)
            else:
                for key in keys:
                    node[key] = node.get(key, 0) + 1
            if len(node) > self.burst and words > 1:
                parent[step] = self.burst_open(node)
            return len(node) - before
        new = i = 0
        while i < len(keys):
            step, j = keys[i][:4], i + 1
            while j < len(keys) and keys[j][:4] == step:
                j += 1
            child = node.get(step)
            if child is None:
                child = node[step] = Counter()
            new += self._fill(node, step, child, sorted([k[4:] for k in keys[i:j]]), words - 1)
            i = j
        return new

    @staticmethod
    def burst_open(container: Counter) -> Branch:
        branch = Branch()
        for key, count in container.items():
            if key[:4] not in branch:
                branch[key[:4]] = Counter()
            branch[key[:4]][key[4:]] = count
        return branch

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Take subtrees out: their sequences and counts."""
        first, sizes, keys, counts = [], [], [], []
        for word in words:
            todo = [(self.subtrees.pop(word), b"")]
            while todo:
                node, path = todo.pop()
                if type(node) is Branch:
                    todo.extend((child, path + step) for step, child in node.items())
                else:
                    keys.extend([path + k for k in node] if path else node)
                    counts.extend(node.values())
                    first.append(word)
                    sizes.append(len(node))
            del self.sizes[word]
        rest = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, self.length - 1)
        return np.column_stack([np.repeat(np.asarray(first, np.uint32), sizes), rest]), np.asarray(counts, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def places(lang: np.uint64, *words: np.ndarray, bits: int) -> np.ndarray:
    """Where the bitmap holds a word or pair of a language."""
    x = mix(words[0] ^ lang)
    for more in words[1:]:
        x = mix(x ^ more)
    return (x & np.uint64(bits - 1)).astype(np.int64)


def held_at(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def tokens_of(text: bytes) -> pa.LargeBinaryArray:
    """The words of a text, and a line feed where a piece ends."""
    letters = np.frombuffer(text.translate(PLAIN), np.uint8)
    kept, breaks = letters != ord(" "), letters == ord("\n")
    starts = kept.copy()
    starts[1:] &= ~kept[:-1] | breaks[:-1] | breaks[1:]
    letters, starts = letters[kept], np.flatnonzero(starts[kept])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(letters)).astype(np.int64)), pa.py_buffer(letters)])


class PhraseCounter:
    """What one task counts: phrases of ``lengths`` words whose parts of ``part`` words the bitmap holds; with part 0, words."""

    def __init__(self, lengths: range, part: int, bitmap: np.ndarray | None, bits: int, hot: frozenset[bytes] = frozenset(), runs: int = 64,
                 held: int = HELD, words: int = WORDS, burst: int = BURST):
        self.lengths, self.part, self.bitmap, self.bits, self.hot, self.runs = lengths, part, bitmap, bits, hot, runs
        self.held, self.most_words, self.burst = held, words, burst
        self.forget()

    def forget(self) -> None:
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.word_counts: dict[str, np.ndarray] = {}
        self.size = 0
        self.names: list[bytes] = [b""]
        self.ids: dict[bytes, int] = {b"\n": 0}
        self.hash = np.zeros(1, np.uint64)

    def numbered(self, text: bytes) -> np.ndarray:
        """Ids of a text's words; 0 where a piece ends."""
        tokens = tokens_of(text).dictionary_encode()
        ids, names = self.ids, self.names
        met = tokens.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in met if w not in ids]
        ids.update(zip(fresh, range(len(names), len(names) + len(fresh)), strict=True))
        names += fresh
        if len(names) > len(self.hash):
            self.hash = np.concatenate([self.hash, hashes(names[len(self.hash):])])
        return np.fromiter(map(ids.__getitem__, met), np.int64, len(met))[tokens.indices.to_numpy()]

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count some texts of one language; yields runs as the tries fill."""
        ids = self.numbered(b"\n".join(texts))
        if self.part:
            self.add_phrases(lang, ids)
        elif len(ids):
            counts = np.bincount(ids, minlength=len(self.names))
            before = self.word_counts.get(lang, counts[:0])
            counts[:len(before)] += before
            counts[0] = 0
            self.size += np.count_nonzero(counts) - np.count_nonzero(before)
            self.word_counts[lang] = counts
        if self.size > self.held:
            yield from self.spill(self.held // 2)
        if len(self.names) > self.most_words:
            yield from self.spill(0)
            self.forget()

    def add_phrases(self, lang: str, ids: np.ndarray) -> None:
        windows = [ids[k:len(ids) - self.part + 1 + k] for k in range(self.part)]
        ok = np.logical_and.reduce([w > 0 for w in windows])
        ok &= held_at(self.bitmap, places(hashes([lang.encode()])[0], *(self.hash[w] for w in windows), bits=self.bits))
        narrow = ids.astype(np.uint32)
        for n in self.lengths:
            parts = n - self.part + 1
            starts = np.flatnonzero(np.logical_and.reduce([ok[k:len(ok) - parts + 1 + k] for k in range(parts)])) if len(ok) >= parts else ()
            if len(starts):
                if (lang, n) not in self.tries:
                    self.tries[lang, n] = HatTrie(n, self.burst)
                self.size += self.tries[lang, n].add(narrow[starts[:, None] + np.arange(n)])

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of whole subtrees, largest first, until at most ``keep`` sequences are left; words leave all at once."""
        names = pa.array(self.names, pa.binary())
        rank = np.empty(len(self.names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(rank))
        for lang, counts in self.word_counts.items():
            if len(own := np.flatnonzero(counts)):
                yield self.run(lang, own[:, None], counts[own], names, rank)
                self.size -= len(own)
        self.word_counts = {}
        leaving: dict[tuple[str, int], list[int]] = {}
        for size, key, word in sorted(((n, key, word) for key, trie in self.tries.items() for word, n in trie.sizes.items()), reverse=True):
            if self.size <= keep:
                break
            leaving.setdefault(key, []).append(word)
            self.size -= size
        for key, words in sorted(leaving.items()):
            yield self.run(key[0], *self.tries[key].take(words), names, rank)

    def run(self, lang: str, ids: np.ndarray, counts: np.ndarray, names: pa.Array, rank: np.ndarray) -> pa.RecordBatch:
        """Sequences as one row per part, in the order of their words; tabs are between words, so never in them."""
        part = mix(self.hash[ids[:, 0]])
        if ids.shape[1] > 1 and self.hot:
            hot = np.zeros(len(self.names), bool)
            hot[[self.ids[w] for w in self.hot if w in self.ids]] = True
            part = np.where(hot[ids[:, 0]], mix(part ^ self.hash[ids[:, 1]]), part)
        part = (part % np.uint64(self.runs)).astype(np.int64)
        first, *more = rank[ids].T
        if more and len(self.names) < 1 << 24 and self.runs <= 1 << 15:  # part and two words fit a number
            first, more = first << 24 | more[0], more[1:]
            order = np.argsort(part << 48 | first, kind="stable") if not more else np.lexsort((*more[::-1], part << 48 | first))
        else:
            order = np.lexsort((*more[::-1], first, part))
        words = [names.take(pa.array(column)) for column in ids[order].T]
        phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
        ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
        bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(bounds, x.cast(pa.string())), "\t") for x in (phrase, pa.array(counts[order]))]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[order][ends - 1], pa.int32()), pa.array([lang] * len(ends), pa.string()), *joined], names=["part", "lang", "phrases", "counts"])


def count_phrases(texts: DataFrame, lengths: range, part: int, bitmap: bytes | None, hot: frozenset[bytes], bits: int) -> DataFrame:
    """part, lang, phrase and exact count ``n`` of all phrases whose parts may be frequent."""
    parts = max(PARTS, 2 * tasks(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else np.frombuffer(zlib.decompress(bitmap), np.uint8)
        counter = PhraseCounter(lengths, part, held, bits, hot, parts)
        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            size = 0
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                waiting.setdefault(lang.as_py(), []).append(text.as_buffer().to_pybytes())
                size += len(text.as_buffer())
                if size >= AT_ONCE:
                    for name, some in waiting.items():
                        yield from counter.add(name, some)
                    waiting, size = {}, 0
            for name, some in waiting.items():
                yield from counter.add(name, some)
        yield from counter.spill(0)

    runs = map_batches(texts, run, RUNS).repartition(tasks(texts), "part")
    entries = F.explode(F.arrays_zip(F.split("phrases", "\t").alias("phrase"), F.split("counts", "\t").alias("n")))
    return (
        runs.select("part", "lang", entries.alias("e")).select("part", "lang", "e.phrase", F.col("e.n").cast("long").alias("n"))
        .groupBy("part", "lang", "phrase").agg(F.sum("n").alias("n"))
    )


def frequent_bitmap(counts: DataFrame, bits: int) -> bytes:
    """The hashes of frequent words or pairs as a bitmap of ``bits`` bits, packed: the only thing that passes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = hashes([x.encode() for x in batch.column(0).to_pylist()])
            words = [x.encode().split(b" ") for x in batch.column(1).to_pylist()]
            at = np.zeros(len(words), np.int64)
            for size in {len(w) for w in words}:
                own = np.flatnonzero(np.fromiter((len(w) == size for w in words), bool, len(words)))
                at[own] = places(lang[own], *(hashes([words[i][k] for i in own.tolist()]) for k in range(size)), bits=bits)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    at = map_batches(counts.select("lang", "phrase"), run, "at long")
    parts = at.groupBy(F.expr("at div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    out = bytearray(max(bits // 8, 4096))
    for row in parts.collect():
        out[row["bucket"] * 4096:(row["bucket"] + 1) * 4096] = row["bits"]
    return zlib.compress(bytes(out), 1)


def joined(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def collocations(
    docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, absorbed: int = 100, filter_bits: int = FILTER_BITS,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` and into words ``[^\\x20\\x09]+``. Candidates are phrases of 2 to
    ``max_words`` words found ``a >= min_count`` times. Of the cuts into two parts (found l and r times) the one of least score
    floor(1000 a n / (l r)) counts, n being all words of the language. Candidates inside a longer one that has at least
    ``absorbed`` percent of their count are left out. Null texts have no words, null languages are ``und``, repeated rows count
    each time; an empty table, or one without frequent phrases, gives no rows. Sizes that a task holds are bounded:
    ``HELD`` sequences, ``WORDS`` words, and the bitmap of ``filter_bits`` bits (which only saves work: a smaller one gives the same result).
    """
    if filter_bits < 32768 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two, at least 32768")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    every = stored(count_phrases(texts, range(1, 2), 0, None, frozenset(), filter_bits), "all_words")
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("total")), "phrase_totals")
    frequent = F.col("n") >= min_count
    words = counts = stored(every.where(frequent).select("lang", "phrase", "n"), "phrase_words")
    if max_words > 1:
        corpus = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        hot = words.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") * HOT >= corpus)
        hot_words = frozenset(r["phrase"].encode() for r in hot.collect())
        pairs = count_phrases(texts, range(2, 3), 1, frequent_bitmap(words, filter_bits), hot_words, filter_bits)
        pairs = stored(pairs.where(frequent).select("lang", "phrase", "n"), "phrase_pairs")
        counts = counts.unionByName(pairs)
    if max_words > 2:
        more = count_phrases(texts, range(3, max_words + 1), 2, frequent_bitmap(pairs, filter_bits), hot_words, filter_bits)
        counts = counts.unionByName(stored(more.where(frequent).select("lang", "phrase", "n"), "phrase_longer"))
    return ranked(counts, totals, top, absorbed)


def ranked(known: DataFrame, totals: DataFrame, top: int, absorbed: int) -> DataFrame:
    """Scores, absorption and ranks from the counts of all frequent phrases and words, and the words of each language."""
    candidates = known.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1).withColumnRenamed("n", "a")
    # cuts: the halves are frequent too, so they are among the counts
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)"))).select(
        "lang", "phrase", "a", "k", F.expr(joined("w", "1", "k")).alias("left"), F.expr(joined("w", "k + 1", "size(w) - k")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = "decimal(38, 0)"
    score = F.expr(f"cast(a as {wide}) * cast(total as decimal(20, 0)) * 1000 div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = (
        scored.withColumn("score", score.cast("long"))
        .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = F.expr(
        f"flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> {joined('w', 's', 'm')})))")
    inside = (
        candidates.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
