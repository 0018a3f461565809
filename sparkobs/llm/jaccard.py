"""N-gram Jaccard join: ordered shingle sets in a trie, traversed with shared partial overlaps and pruned by length.

1. One pass hashes each text's words into its set of distinct shingles, and counts all shingles in a sketch whose size
   follows the corpus up to a fixed bound. The sketch gives every shingle a global rank, rare ones first; any collision
   only moves a rank.
2. Two sets that reach the similarity share one of their first n - ceil(t n) + 1 ranked shingles. Documents that meet
   on such a shingle are chained by size, not paired; the chains' components say which sets may meet at all. Each task
   chains its own documents first, so a shingle of very many documents is shuffled as a few runs of sizes. Where the
   corpus crowds the sketch, passages of few copies are lost in chance and tie strangers together. Components of several
   blocks are then parted: by a sketch that counts their sets alone, prefixes are made so much longer that similar sets
   share several shingles of them, and these are counted by pair, but not within what neighbours tie together already.
3. Within a component, sets first meet as profiles: counts of their shingles by hash range. The sum of the smaller
   counts bounds the overlap, so most sets that only share a passage part here, at a byte for every few shingles.
4. What is left meets as sets. A block's sets, frequent shingles first, form a path-compressed trie; each set walks it,
   sharing the overlap of common prefixes, and leaves a subtree when the remaining lengths cannot reach the overlap
   needed or when all of it is linked to the set already.
5. Components of several blocks share pivots. What the pivots do not tie to the component's largest class is held
   against every block, so no link is lost and a group of near copies costs in proportion to its size.

Equal texts (after lower-casing A-Z and cutting at blanks) are one class and never paired.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a
shingle are one shingle; a row without an id gets the smallest id of its component, null if there is none; rows that
repeat an id are each judged by their text; ties in size or rank fall either way and change no link; texts of any length
are shingled whole; empty tables give empty tables; other columns are never read. Words, shingles and classes are 64-bit hashes: equal sets need no collision, unequal ones could only meet by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkobs.llm.common import discard, slices, small, stored

WORDS, SIMILAR = 5, 80  # shingle length; least similarity in percent
BITS, CHUNK = (18, 23), 14  # of the sketch, least and most (a byte each when broadcast), and of a part of it
CROWDED, MEMBERS = 24, 100  # shingles a counter from which on large components are parted; sets of a shingle that are counted by pair
FILTER_BITS = (12, 27)  # of the filter that picks texts for the full sets, least and most
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, SALTS = 400, 1_000_000, 25, 8
PROFILE_DOCS = 400  # of a block of profiles, which are a small part of the sets
REMEMBERED = 300_000
FINISH = 500_000  # edges of 16 bytes that one task ties together
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingle hashes of texts, and one hash of all words of each."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def __call__(self, texts: list[str | None], wanted=None, rank=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of all texts (each text's sorted), their number by text, and the texts' classes.

        ``wanted`` takes classes and says which texts get shingles; ``rank`` turns shingles into what is sorted and returned."""
        if len(self.at) > REMEMBERED:
            self.__init__()
        words = [(t or "").encode().lower().split() for t in texts]
        classes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
        if wanted is not None:
            live = wanted(classes)
            words = [w if x else [] for w, x in zip(words, live, strict=True)]
        new = sorted(set().union(*words) - self.at.keys())
        start = len(self.at)
        self.at.update(zip(new, range(start, start + len(new)), strict=True))
        while len(self.at) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[start : len(self.at)] = [xxhash.xxh3_64_intdigest(w) for w in new]
        counts = np.array([len(w) for w in words], np.int64)
        h = self.hashes[np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))]
        starts = np.cumsum(counts) - counts
        whose = np.repeat(np.arange(len(words)), counts)
        left = np.minimum(np.repeat(starts + counts, counts) - np.arange(len(h)), WORDS)  # words from here on, at most a shingle
        key = np.zeros(len(h), np.uint64)
        for k in range(WORDS):
            on = left > k
            key[on] = (key[on] ^ key[on] >> np.uint64(29)) * MIX + h[np.flatnonzero(on) + k]
        first = np.zeros(len(h), bool)
        first[starts[counts > 0]] = True
        whole = (left == WORDS) | first & (np.repeat(counts, counts) < WORDS)
        key, whose = mixed(key[whole] + left[whole].astype(np.uint64)), whose[whole]
        if rank is not None:
            key = rank(key)
        ends = np.cumsum(np.bincount(whose, minlength=len(words))).tolist()
        for i, j in zip([0, *ends], ends, strict=False):
            key[i:j].sort()
        distinct = np.ones(len(key), bool)
        distinct[1:] = (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])
        return key[distinct], np.bincount(whose[distinct], minlength=len(words)), classes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def needed(a: np.ndarray | int, b: np.ndarray | int):
    """Least overlap of sets of sizes a and b that are similar."""
    return -(-SIMILAR * (a + b) // (100 + SIMILAR))


def profile(tokens: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by range, up to 255; ranges are a power of two, about a third of the set's size."""
    bits = max(3, int(len(tokens) // 3).bit_length())
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def coarser(x: np.ndarray, ranges: int) -> np.ndarray:
    return x if len(x) == ranges else np.minimum(x.reshape(ranges, -1).sum(1), 255).astype(np.uint8)


class Links:
    """Union-find over ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


class Trie:
    """Sets of small ints as a path-compressed trie. A node is a run of tokens that a range of the sorted sets shares."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        shared = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            n = min(self.sizes[i - 1], self.sizes[i])
            differ = self.sets[i - 1][:n] != self.sets[i][:n]
            shared[i] = differ.argmax() if differ.any() else n
        #: low, high, from depth, to depth, number of sets that end here, least size, most size, children
        self.nodes: list[tuple[int, int, int, int, int, int, int, list[int]]] = []
        self.top: list[int] = []
        todo = [(0, len(sets), 0, self.top)]
        while todo:
            low, high, start, siblings = todo.pop()
            cuts = [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] <= start)).tolist(), high]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                end = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(self.sizes[lo])
                over = int(np.count_nonzero(self.sizes[lo:hi] == end))
                siblings.append(len(self.nodes))
                self.nodes.append((lo, hi, start, end, over, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), own := []))
                if lo + over < hi:
                    todo.append((lo + over, hi, end, own))

    def search(self, query: np.ndarray, marked: np.ndarray, known, found) -> None:
        """Calls ``found`` with each set similar to ``query``; ``marked``: flags of its tokens; ``known``: whether all sets of a range are linked to it."""
        n, stack = len(query), [(k, 0) for k in self.top]
        while stack:
            k, overlap = stack.pop()
            low, high, start, end, over, least, most, below = self.nodes[k]
            if 100 * most < SIMILAR * n or 100 * n < SIMILAR * least or known(low, high):
                continue
            part = self.sets[low][start:end]
            overlap += int(np.count_nonzero(marked[part]))
            rest = n - int(np.searchsorted(query, self.sets[low][end - 1], "right")) if end else n
            if overlap + min(rest, most - end) < needed(n, least):
                continue
            if over and 100 * overlap >= SIMILAR * (n + end - overlap):
                for i in range(low, low + over):
                    found(i)
            stack += [(x, overlap) for x in below]


def joined(ids: list[int], sets: list[np.ndarray], links: Links, asks: list[bool]) -> None:
    """Adds to ``links`` what ties all similar sets of a block together; ``asks`` says which sets search."""
    flat = np.concatenate(sets)
    values, local, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))  # frequent first
    ends = np.cumsum([len(s) for s in sets])
    own = [np.sort(r) for r in np.split(rank[local], ends[:-1])]
    trie = Trie(own)
    names = [ids[i] for i in trie.order]
    marked = np.zeros(len(values), bool)
    for at, i in enumerate(trie.order):
        if not asks[i]:
            continue
        marked[own[i]] = True
        me = names[at]

        def known(low: int, high: int, me: int = me) -> bool:
            root = links.root(me)
            return all(links.root(x) == root for x in names[low:high])

        def found(k: int, me: int = me) -> None:
            links.join(me, names[k])

        trie.search(own[i], marked, known, found)
        marked[own[i]] = False


def bounded(ids: list[int], rows: list[bytes], links: Links, asks: list[bool]) -> None:
    """Like ``tried``, over profiles behind their set's size: ties together all sets whose overlap may be enough."""
    sizes = np.array([int.from_bytes(r[:4], "little") for r in rows], np.int64)
    profiles = [np.frombuffer(r, np.uint8, offset=4) for r in rows]
    own = np.array([len(p) for p in profiles])
    for ranges in np.unique(own).tolist():
        # sizes within the similarity have ranges that are equal or one step apart; the finer is folded
        group = np.flatnonzero((own == ranges) | (own == 2 * ranges))
        table = np.array([coarser(profiles[i], ranges) for i in group])
        for k, i in enumerate(group.tolist()):
            if not asks[i]:
                continue
            near = np.flatnonzero((100 * sizes[group] >= SIMILAR * sizes[i]) & (100 * sizes[i] >= SIMILAR * sizes[group]) & ((own[i] == ranges) | (own[group] == ranges)))
            root = links.root(ids[i])
            near = near[[links.root(ids[j]) != root for j in group[near].tolist()]]
            if len(near):
                a, b = table[k], table[near]
                gap = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)  # as many hashes are in one set alone, at least
                both = sizes[i] + sizes[group[near]]
                for j in group[near[(both - gap) // 2 >= needed(sizes[i], sizes[group[near]])]].tolist():
                    links.join(ids[i], ids[j])


def tried(ids: list[int], rows: list[bytes], links: Links, asks: list[bool]) -> None:
    joined(ids, [np.frombuffer(r, np.uint64) for r in rows], links, asks)


def lookup(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to a ``table`` with one row for each ``on``; the rows of a hot key are dealt by ``by`` to SALTS tasks."""
    salts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salts, [on, "salt"], how).drop("salt")


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all nodes of edges a, b."""
    links = Links()
    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            links.join(x, y)
    nodes = {*links.up, *links.up.values()}
    yield pa.RecordBatch.from_arrays([pa.array(list(nodes), pa.int64()), pa.array([links.root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the least node that edges reach) of all nodes of ``edges`` (a, b).

    Each round, edges jump to their lower end's least neighbour, and lower ends of one node tie together at the least
    of them; rounds end when every node has one edge, to its root. Up to FINISH edges, a size that is checked first and
    fits any task, are tied together in one step instead, with the same result."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        seen = Observation()
        e = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), name)
        if (seen.get["n"] or 0) <= FINISH:
            return e.coalesce(1).mapInArrow(rooted, "node long, root long")
        if (state := (seen.get["n"], seen.get["s"])) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct())
        before = state
        parent = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up"))
        jumped = lookup(e, parent, "b", "a", "left").select("a", F.coalesce("up", "b").alias("b"))
        met = jumped.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        e = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()


def packed(counts: np.ndarray) -> bytes:
    """Counters in bytes where all fit."""
    return zstandard.ZstdCompressor(level=1).compress((counts.astype(np.uint8) if counts.max() < 256 else counts.astype(np.uint32)).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, np.uint8 if len(raw) == 1 << CHUNK else np.uint32)


def survey(docs: DataFrame, bits: int, turns: int) -> DataFrame:
    """A row for each document (id, mark, class, n, its profile as data) and rows with parts of the sketch of all shingles (part, turn, counts as data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, names = Shingler(), np.zeros(1 << bits, np.uint32), ["id", "mark", "class", "n", "part", "turn", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in slices(batches, "text"):
            shingles, counts, classes = shingler(b.column("text").to_pylist())
            np.add.at(sketch, (shingles >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            ends = np.cumsum(counts).tolist()
            profiles = [n.to_bytes(4, "little") + profile(shingles[e - n : e]).tobytes() if n else None for e, n in zip(ends, counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(classes), pa.array(counts), *(pa.nulls(len(counts), t) for t in types[4:6]), pa.array(profiles, pa.binary())], names=names)
        parts = parts_of(sketch, turns)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts[0]), t) for t in types[:4]), *parts], names=names)

    return docs.mapInArrow(run, "id long, mark long, class long, n long, part int, turn int, data binary")


def parts_of(sketch: np.ndarray, turns: int) -> list[pa.Array]:
    """part, turn and data of a task's sketch."""
    parts = [(k, p) for k, p in enumerate(sketch.reshape(-1, 1 << CHUNK)) if p.any()]
    turn = int(xxhash.xxh32_intdigest(sketch.tobytes()) % turns)
    return [pa.array([k for k, _ in parts], pa.int32()), pa.array([turn] * len(parts), pa.int32()), pa.array([packed(p) for _, p in parts], pa.binary())]


def recount(sets: DataFrame, bits: int, turns: int) -> DataFrame:
    """Parts of the sketch of all shingles of ``sets`` (node, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for b in slices(batches, "data"):
            np.add.at(sketch, (np.frombuffer(b"".join(b.column("data").to_pylist()), np.uint64) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays(parts_of(sketch, turns), names=["part", "turn", "data"])

    return sets.select("data").mapInArrow(run, "part int, turn int, data binary")


def sketch_of(rows: DataFrame, bits: int, turns: int) -> np.ndarray:
    """The whole sketch: parts are summed by turn, then over all turns; 2**bits counters reach the driver.

    A byte holds a count's root in units of a quarter of the mean's, where chance spreads all counts alike."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK, np.uint32)
        for c in pdf.data:
            total += unpacked(c)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "turn": [pdf.turn.iloc[0]], "data": [packed(total)]})

    kind = "part int, turn int, data binary"
    parts = rows.where("part is not null").select("part", "turn", "data")
    for by in (["part", "turn"], ["part"])[turns == 1 :]:
        parts = parts.groupBy(*by).applyInPandas(add, kind)
    sketch = np.zeros((1 << bits - CHUNK, 1 << CHUNK), np.uint32)
    for r in parts.toLocalIterator():
        sketch[r.part] = unpacked(bytes(r.data))
    return np.minimum(np.sqrt(sketch.ravel()) * (64 / max(1.0, float(sketch.mean())) ** 0.5), 255).astype(np.uint8)


def sketch_size(texts: DataFrame) -> tuple[int, int]:
    """Bits and turns for the sketch of texts (a word has about 6 bytes)."""
    return sized((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)


def sized(shingles: int) -> tuple[int, int]:
    """Bits that give a counter to every 8 shingles or so, within BITS; and the groups of tasks whose sketches are summed first."""
    return min(BITS[1], max(BITS[0], int(shingles // 8).bit_length())), min(4096, 1 + 6 * shingles // (1 << 31))


def ranked(shingles: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Rank: the sketch's count, then the low bits of the hash."""
    return sketch[(shingles >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(44) | shingles & np.uint64((1 << 44) - 1)


def chains(docs: DataFrame, sketch: np.ndarray, bits: int) -> DataFrame:
    """Edges (a, b) of a forest whose trees hold all classes that may be similar: those with a common prefix shingle and close sizes."""
    known = docs.sparkSession.sparkContext.broadcast(sketch)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, seen = Shingler(), known.value, set()
        for b in slices(batches, "text"):
            def first(classes: np.ndarray) -> np.ndarray:
                out = np.zeros(len(classes), bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in seen:
                        seen.add(c)
                        out[i] = True
                return out

            if len(seen) > REMEMBERED:
                seen.clear()
            shingles, counts, classes = shingler(b.column("text").to_pylist(), first, lambda x: ranked(x, sketch, bits))
            whose = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(shingles)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = at < np.repeat(counts - -(-SIMILAR * counts // 100) + 1, counts)
            s, c, n = shingles[keep].view(np.int64), classes[whose[keep]], counts[whose[keep]]
            order = np.lexsort((n, s))
            s, c, n = s[order], c[order], n[order]
            near = chained(s, n, n)
            first = np.flatnonzero(~near)
            last = np.append(first[1:], len(s)) - 1 if len(s) else first
            pairs = np.unique(np.stack([c[1:][near[1:]], c[:-1][near[1:]]]), axis=1) if near.any() else np.zeros((2, 0), np.int64)
            # a pair travels as a row whose sizes are below 0, anywhere
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[first], pairs[0]])), pa.array(np.concatenate([c[first], pairs[1]])), pa.array(np.concatenate([n[first] << 32 | n[last] - n[first], np.full(pairs.shape[1], -1)]))], names=["shingle", "class", "sizes"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, last = Links(), None
        for b in batches:
            s, c, z = (b.column(k).to_numpy() for k in ("shingle", "class", "sizes"))
            for x, y in zip(s[z < 0].tolist(), c[z < 0].tolist(), strict=True):
                links.join(x, y)
            s, c, low, high = s[z >= 0], c[z >= 0], z[z >= 0] >> 32, (z[z >= 0] >> 32) + (z[z >= 0] & (1 << 32) - 1)
            if last is not None:
                s, c, low, high = (np.concatenate([[x], y]) for x, y in zip(last, (s, c, low, high), strict=True))
            if not len(s):
                continue
            near = np.flatnonzero(chained(s, low, high)[1:])
            near = near[c[near] != c[near + 1]]
            for x, y in zip(c[near].tolist(), c[near + 1].tolist(), strict=True):
                links.join(x, y)
            last = (s[-1], c[-1], low[-1], high[s == s[-1]].max())
            if len(links.up) > REMEMBERED:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(links.edges(), columns=["a", "b"], dtype="int64"), preserve_index=False)
                links = Links()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(links.edges(), columns=["a", "b"], dtype="int64"), preserve_index=False)

    return docs.mapInArrow(prefixes, "shingle long, class long, sizes long").repartition("shingle").sortWithinPartitions("shingle", "sizes", "class").mapInArrow(linked, "a long, b long")


def chained(shingles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each run of sizes (``low`` to ``high``, in order of shingle and low) may hold a set similar to one of the runs before it."""
    same = np.zeros(len(shingles), bool)
    same[1:] = shingles[1:] == shingles[:-1]
    group = np.cumsum(~same) << 32
    reach = np.maximum.accumulate(group | high) - group  # the largest size so far under one shingle
    same[1:] &= 100 * reach[:-1] >= SIMILAR * low[1:]
    return same


def required(n):
    """Shingles that similar sets of n or more share at least in their first m - ceil(t m) + required(m), m being each one's size."""
    return 1 + n // 16


def counted(sets: DataFrame, sketch: np.ndarray, bits: int, labels: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of ``sets`` (node, data) that share so many prefix shingles that they may be similar.

    Without ``labels`` (node, label), of neighbours by size under a shingle only; those under a shingle of more than
    MEMBERS sets are tied whatever they share. With labels, of all pairs whose labels differ under the other shingles.
    Similar sets are tied by a chain of either or have one label: all that they share is counted, or lies in a chain."""
    known, beside = sets.sparkSession.sparkContext.broadcast(sketch), labels is None

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            own = [np.sort(ranked(np.frombuffer(x, np.uint64), known.value, bits)) for x in b.column("data").to_pylist()]
            counts = np.array([len(x) for x in own], np.int64)
            keep = counts - -(-SIMILAR * counts // 100) + required(counts)
            shingles = np.concatenate([x[:k] for x, k in zip(own, keep.tolist(), strict=True)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.repeat(b.column("node").to_numpy(), keep)), pa.array(np.repeat(counts, keep))], names=["shingle", "node", "n"])

    def found(s: np.ndarray, c: np.ndarray, n: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        once = np.ones(len(s), bool)
        once[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, n, label = s[once], c[once], n[once], label[once]
        group = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) - 1
        wide = np.bincount(group)[group] > MEMBERS if len(s) else np.zeros(0, bool)
        i, out = np.arange(len(s)) if beside else np.flatnonzero(~wide), []
        for d in range(1, 2 if beside else MEMBERS):
            i = i[i + d < len(s)]
            i = i[(group[i] == group[i + d]) & (100 * n[i] >= SIMILAR * n[i + d])]  # sizes rise: what is beyond is larger still
            if not len(i):
                break
            k = i if beside else i[label[i] != label[i + d]]
            out.append((np.maximum(c[k], c[k + d]), np.minimum(c[k], c[k + d]), np.where(wide[k], 0, required(n[k]))))
        columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 3
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(x))) for x in columns], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            held = [np.concatenate([x, b.column(k).to_numpy()]) for x, k in zip(held, ("shingle", "node", "n", "label"), strict=True)]
            if len(held[0]):
                last = int(np.searchsorted(held[0], held[0][-1]))  # the last shingle may go on
                yield found(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        yield found(*held)

    rows = sets.mapInArrow(prefixes, "shingle long, node long, n long")
    rows = rows.withColumn("label", F.lit(0).cast("long")) if beside else rows.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    met = rows.select("shingle", "node", "n", "label").repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, "a long, b long, need long")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need")).where("k >= need").select("a", "b")


def filter_of(nodes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits over nodes with their least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(spots(b.column("node").to_numpy(), b.column("least").fill_null(0).to_numpy(), bits))))], names=["at"])

    flags = np.zeros(1 << bits, bool)
    packed = nodes.select("node", "least").mapInArrow(run, "at long").groupBy(F.shiftright("at", 12).alias("part")).agg(F.collect_set(F.col("at").bitwiseAND(4095).cast("int")).alias("own"))
    for r in packed.toLocalIterator():  # 2**bits flags at most
        flags[(r.part << 12) + np.array(r.own, np.int64)] = True
    return np.packbits(flags, bitorder="little")


def spots(classes: np.ndarray, ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mixed(classes.view(np.uint64) ^ ids.astype(np.int64).view(np.uint64) * MIX)
    return [(x >> np.uint64(64 - bits)).astype(np.int64), ((x * MIX) >> np.uint64(64 - bits)).astype(np.int64)]


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, data: the shingle sets (bytes) of the classes ``nodes`` (node, least), each from the document with the least id."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], int(nodes.count() * 16).bit_length()))
    known = docs.sparkSession.sparkContext.broadcast(filter_of(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, flags = Shingler(), known.value
        for b in slices(batches, "text"):
            ids = b.column("id").fill_null(0).to_numpy()

            def wanted(classes: np.ndarray, ids: np.ndarray = ids) -> np.ndarray:
                out = np.ones(len(classes), bool)
                for at in spots(classes, ids, bits):
                    out &= (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                return out

            shingles, counts, classes = shingler(b.column("text").to_pylist(), wanted)
            ends, raw = (np.cumsum(counts) * 8).tolist(), shingles.tobytes()
            rows = [(c, raw[e - 8 * n : e]) for c, e, n in zip(classes.tolist(), ends, counts.tolist(), strict=True) if n]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["node", "data"])

    return docs.mapInArrow(run, "node long, data binary")


def meet(placed: DataFrame, data: DataFrame, kernel) -> DataFrame:
    """Links (a, b) that ``kernel`` finds between what ``placed`` (node, slot, label, asks) brings together in a slot; equal labels count as linked."""
    rows = data.join(small(placed), "node").select("slot", "node", "label", "asks", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int | None, bool, bytes]] = {}
        slot = None

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            links = Links()
            for node, (label, *_) in held.items():
                if label is not None:
                    links.join(node, label)
            kernel(list(held), [x[2] for x in held.values()], links, [x[1] for x in held.values()])
            return links.edges()

        out: list[tuple[int, int]] = []
        for b in batches:
            for s, node, *row in zip(*(b.column(k).to_pylist() for k in ("slot", "node", "label", "asks", "data")), strict=True):
                if s != slot:
                    out += done()
                    held, slot = {}, s
                held[node] = tuple(row)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "b"], dtype="int64"), preserve_index=False)
            out = []
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done(), columns=["a", "b"], dtype="int64"), preserve_index=False)

    return rows.repartitionByRange("slot").sortWithinPartitions("slot").mapInArrow(run, "a long, b long")


def blocks_of(own: DataFrame, most: int) -> DataFrame:
    """root and blocks of the components of ``own`` (root, n)."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") * BLOCK_DOCS / (BLOCK_SHINGLES * most)))
    return own.groupBy("root").agg(size.cast("int").alias("blocks"))


def tie(own: DataFrame, data: DataFrame, kernel, most: int, name: str) -> DataFrame:
    """Links (a, b) that tie together whatever ``kernel`` finds similar within the components of ``own`` (node, root, n).

    A block has ``most`` classes and BLOCK_SHINGLES times most / BLOCK_DOCS shingles or so; ``data`` (node, data) is what the kernel reads."""
    large = stored(blocks_of(own, most).where("blocks > 1"), name)
    own = lookup(own, large, "root", "node", "left").select("node", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = stored(own.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")), name)
    slot = lambda *by: F.xxhash64(*by).alias("slot")
    # pivots: some classes of a large component's first block go to all of its blocks
    first = own.where("blocks > 1 and block = 0").where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(1, most // PIVOTS))) == 0)
    everywhere = first.select("node", "root", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"))
    placed = own.select("node", "root", "block").unionAll(everywhere)
    links = stored(meet(placed.select("node", slot("root", "block"), F.lit(None).cast("long").alias("label"), F.lit(True).alias("asks")), data, kernel), name)
    if not large.limit(1).count():
        return links
    # In components of several blocks, all classes outside the largest one so far are held against every block.
    tied = components(links, name).withColumnRenamed("root", "label")
    wide = stored(own.where("blocks > 1").join(tied, "node", "left").withColumn("label", F.coalesce("label", "node")), name)
    counts = wide.groupBy("root", "label").agg(F.count(F.lit(1)).alias("members"))
    leading = counts.groupBy("root").agg(F.max(F.struct("members", F.col("label").alias("top"))).alias("x")).select("root", "x.top")
    loose = stored(lookup(wide, leading, "root", "node").where("label != top").select("node", "root", "label", "blocks"), name)
    turns = loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("turns"))
    turned = lookup(loose, turns, "root", "node").select("node", "root", "label", "turns", F.pmod(F.xxhash64("node", F.lit(4)), F.col("turns")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = turned.select("node", slot("root", "block", "turn"), "label", F.lit(True).alias("asks"))
    held = lookup(wide, turns, "root", "node").select("node", "root", "label", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    both = asked.unionAll(held.select("node", slot("root", "block", "turn"), "label", F.lit(False).alias("asks"))).groupBy("node", "slot").agg(F.first("label").alias("label"), F.max("asks").alias("asks"))
    return links.unionAll(stored(meet(stored(both, name), data, kernel), name))


def parted(texts: DataFrame, own: DataFrame, shingles: int, name: str) -> DataFrame:
    """``own`` (node, root, least, n) with its components of several blocks parted, where the ``shingles`` of all texts crowd their sketch."""
    large = blocks_of(own, PROFILE_DOCS).where("blocks > 1").select("root")
    if shingles <= CROWDED << BITS[1] or not large.limit(1).count():
        return own
    folder = f"{name}-parted"
    large = small(stored(large, f"{folder}/large"))
    among = stored(own.join(large, "root", "left_semi"), f"{folder}/among")
    sets = stored(sets_of(texts, among), f"{folder}/sets")
    bits, turns = sized(among.agg(F.sum("n")).first()[0])
    sketch = sketch_of(recount(sets, bits, turns), bits, turns)
    beside = stored(counted(sets, sketch, bits), f"{folder}/beside")
    labels = stored(components(beside, f"{folder}/labels"), f"{folder}/labels").withColumnRenamed("root", "label")
    again = components(beside.unionAll(counted(sets, sketch, bits, labels)), f"{folder}/again")
    out = stored(own.join(large, "root", "left_anti").unionByName(again.join(among.drop("root"), "node")), name)
    discard(texts.sparkSession, folder)
    return out


def grouped(docs: DataFrame, key: str, text: str, mark: Column, folder: str) -> DataFrame:
    """id, mark, class, n, group (null for a text that is like no other) and component (the group's least id, else the own id) of every document.

    What the result reads lies in ``folder``; all other tables are deleted."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    (bits, turns), run = sketch_size(texts), f"jaccard-{uuid.uuid4().hex}"  # a folder for all that only this function reads
    seen = stored(survey(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), mark.cast("long").alias("mark")), bits, turns), f"{folder}/shingles")
    rows = seen.where("part is null").select("id", "mark", "class", "n")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    of_class = classes.select(F.col("class").alias("node"), "least", "n")
    near = components(chains(texts, sketch_of(seen, bits, turns), bits), f"{run}/near")
    shingles = seen.agg(F.sum("n")).first()[0] or 0
    own = parted(texts, stored(near.join(of_class, "node"), f"{run}/candidates"), shingles, f"{run}/candidates")
    # a class's profile comes from the document with its least id
    profiles = seen.where("n > 0").select(F.col("class").alias("node"), F.col("id").alias("least"), "data").join(small(own.select("node", "least")), ["node", "least"]).select("node", "data")
    profiles = profiles.unionAll(seen.where("n > 0 and id is null").select(F.col("class").alias("node"), "data").join(small(own.where("least is null").select("node")), "node"))
    may = components(tie(own, stored(profiles, f"{run}/profiles"), bounded, PROFILE_DOCS, f"{run}/bound"), f"{run}/may")
    own = stored(may.join(of_class, "node"), f"{run}/similar")
    links = tie(own, stored(sets_of(texts, own), f"{run}/sets"), tried, BLOCK_DOCS, f"{run}/links")
    tied = components(links, f"{run}/final").select(F.col("node").alias("class"), "root")
    named = classes.join(tied, "class", "left").where("copies > 1 or root is not null")  # all others are alone
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    named = lookup(named, least, "root", "class", "left").select("class", F.coalesce("root", "class").alias("group"), F.coalesce("component", "least").alias("component"))
    named = stored(named, f"{folder}/named")
    discard(docs.sparkSession, run)
    out = lookup(rows.withColumnRenamed("id", "doc"), named, "class", "doc", "left").withColumnRenamed("doc", "id")
    return out.select("id", "mark", "class", "n", "group", F.coalesce("component", "id").alias("component"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every document."""
    return grouped(docs, key, text, F.lit(None), f"groups-{uuid.uuid4().hex}").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of a group the one with the least key, null last; ties go by the text's class, then by the row's hash. All other rows once.

    Only keys and hashes of rows decide; texts are shuffled where rows repeat, and nowhere else."""
    mark, name = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)), "mark"  # alone, the hash passes over nulls
    while name in docs.columns:
        name += "_"
    folder = f"groups-{uuid.uuid4().hex}"
    rows = stored(grouped(docs, key, text, mark, folder).groupBy("id", "mark", "class", "group").agg((F.count(F.lit(1)) > 1).alias("again")), f"{folder}-alike/rows")
    discard(docs.sparkSession, folder)
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "class", "mark")).alias("x")).select("group", F.col("x.id").alias("first_id"), F.col("x.mark").alias("first_mark"))
    gone = lookup(rows.where("group is not null"), first, "group", "mark").where("not (id <=> first_id and mark = first_mark)").select("id", "mark", F.lit(True).alias("gone"))
    again = rows.where("again").select("id", "mark", F.lit(False).alias("gone"))
    told = stored(gone.unionAll(again).groupBy(F.col("id").alias("told_id"), F.col("mark").alias("told_mark")).agg(F.max("gone").alias("told_gone")), "gone")
    discard(docs.sparkSession, f"{folder}-alike")
    marked, told = docs.withColumn(name, mark), small(told)
    on = (F.col(name) == told.told_mark) & F.col(key).cast("long").eqNullSafe(told.told_id)
    left = marked.join(told, on, "left_anti").drop(name)
    once = small(told.where("not told_gone"))
    return left.unionAll(marked.join(once, on, "left_semi").drop(name).distinct()) if once.limit(1).count() else left
