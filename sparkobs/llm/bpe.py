"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Distinct pieces of a batch go into matrices of similar length. Each round, every row merges its leftmost pair of
minimum rank; pairs are looked up in a hashed table, and compaction takes the merged cell out of every row and finished
rows out of the matrix. A piece beyond the longest bucket is a matrix of one row; a round merges all places of its
minimum pair from the left on, or the first alone where that would bring up a pair of lower rank: the same merges.

Texts are cut where a piece always starts, and what the cuts leave (chunks) is remembered with its ids, so that a batch
splits and merges only what is new to its worker.

Defined results: a null text encodes as the empty text; the empty text has no ids and decodes to no bytes; texts of any
length are encoded whole; equal texts get equal ids; an empty table gives an empty table; other columns are passed
through by ``encode`` and ``decode``, which replace a column only if it has the name of their output.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkobs.llm.common import slices

NONE = np.int32(2**31 - 1)
#: Lengths up to which pieces share a matrix; a longer piece has its own.
BUCKETS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
#: Cells of one matrix; chunks, pieces and characters of either that one Python worker remembers; bytes of text at once. All only bound memory.
CELLS, REMEMBERED, CHARACTERS, SLICE = 300_000, 120_000, 10_000_000, 700_000
#: In texts under this pattern, a blank or line end between two other characters always starts a piece.
CUTTABLE, CUT = public_tokenizers.PATTERN, re.compile(r"(?<=\S)(?=[ \n]\S)")


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of the joined bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(len(rank) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several, the last stays; the others try on
            won = free[self.keys[slot[free]] == key[free]]
            self.ranks[slot[won]] = rank[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where an id is padding (negative) or the pair is unknown."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1) & (key != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n

    def since(self, n: int) -> list[str]:
        """The keys from number ``n`` on."""
        return list(islice(reversed(self), len(self) - n))[::-1]


class Runs:
    """Numbered runs of ids."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1024, np.int32), 0
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids`` holds the runs of ``numbers`` one after another."""
        while len(numbers) and numbers.max() >= len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``numbers`` one after another, and their sizes."""
        sizes = self.size[numbers].astype(np.int64)
        return ragged(self.ids, self.at[numbers], sizes), sizes


class Codec:
    """Encodes texts to ids by a file of ranks, and ids back to bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.pattern, self.cuttable = regex.compile(pattern), pattern == CUTTABLE
        top = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = np.array([(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks], np.int64).reshape(-1, 3)
        self.pairs = PairTable(*pairs.T)
        self.size = np.zeros(top, np.int64)
        for t, r in self.ranks.items():
            self.size[r] = len(t)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.zeros(int(self.size.sum()), np.uint8)
        for t, r in self.ranks.items():
            self.bytes[self.at[r] : self.at[r] + len(t)] = np.frombuffer(t, np.uint8)
        said = [f"{i} ".encode() for i in range(top)]
        self.digits = np.array(said, f"S{len(said[-1])}").view(np.uint8).reshape(top, -1)  # padded with 0
        self.forget()

    def forget(self) -> None:
        """What a task has learnt; workers outlive their tasks."""
        self.pieces, self.piece_runs = Numbered(), Runs()
        self.chunks, self.chunk_runs, self.unfit, self.characters = Numbered(), Runs(), np.zeros(0, bool), 0

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and their number by piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        done = [(known, whole[known].astype(np.int32), np.ones(len(known), np.int64))]
        low = 0
        for high in BUCKETS:
            rows = np.flatnonzero((sizes > low) & (sizes <= high) & (whole < 0))
            for part in np.array_split(rows, max(1, -(-len(rows) * high // CELLS))):
                self._merge_rows(data, starts[part], sizes[part], part, high, done)
            low = high
        for i in np.flatnonzero((sizes > low) & (whole < 0)):
            ids = self._merge_long(data[starts[i] : starts[i] + sizes[i]])
            done.append((np.array([i]), ids, np.array([len(ids)])))
        which, ids, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        out = np.zeros(len(pieces), np.int64)
        out[which] = counts
        begins = np.zeros(len(pieces), np.int64)
        begins[which] = np.cumsum(counts) - counts
        return ragged(ids, begins, out), out

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, width: int, done: list) -> None:
        if not len(rows):
            return
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.byte_id[data[(starts[:, None] + columns)[inside]]]
        rank = np.full((len(rows), width), NONE, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            each = np.arange(len(rows))
            at = rank.argmin(1)
            best = rank[each, at]
            over = best == NONE
            if over.any():
                own = ids[over]
                done.append((rows[over], own[own >= 0], (own >= 0).sum(1)))
                live = ~over
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = best
            kept = np.ones(ids.shape, bool)
            kept[each, at + 1] = False  # its cell joins the one before
            ids, rank = ids[kept].reshape(len(rows), -1), rank[kept].reshape(len(rows), -1)
            last = ids.shape[1] - 1
            after, before = np.flatnonzero(at < last), np.flatnonzero(at > 0)
            rank[each, at] = NONE
            a, b = at[after], at[before]
            found = self.pairs.find(np.concatenate([ids[after, a], ids[before, b - 1]]), np.concatenate([ids[after, a + 1], ids[before, b]]))
            rank[after, a], rank[before, b - 1] = found[: len(after)], found[len(after) :]

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """One row: all places of the minimum pair at once, unless a merge would bring up a pair of lower rank."""
        ids = self.byte_id[data]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # of places that overlap, every second from the left
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged = joined_at(ids, rank, at, best, self.pairs)
            if len(at) > 1 and merged[2] < best:
                merged = joined_at(ids, rank, at[:1], best, self.pairs)
            ids, rank, _ = merged
        return ids

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces; new ones are merged."""
        known = len(self.pieces)
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        if new := self.pieces.since(known):
            self.piece_runs.put(np.arange(known, known + len(new)), *self.merge([p.encode() for p in new]))
        return numbers

    def _learn(self, known: int) -> None:
        """Ids of the chunks from number ``known`` on.

        A chunk's first character says what it is: two blanks, any part of a text; one blank, a text's first chunk;
        a line end, a chunk after one; all others follow a blank."""
        new = self.chunks.since(known)
        if not new:
            return
        self.characters += sum(map(len, new))
        find, joined, order, alone, unfit = self.pattern.findall, [], [], [], np.zeros(len(new), bool)
        for i, k in enumerate(new):
            if k[:1] == " ":
                if k[:2] != "  " and (k == " " or k[1].isspace() or k[-1].isspace()):
                    unfit[i] = True
                else:
                    alone.append((i, find(k[2:] if k[:2] == "  " else k[1:])))
            else:
                body = k[1:] if k[:1] == "\n" else k
                if not body or body[0].isspace() or body[-1].isspace():
                    unfit[i] = True
                elif body.isalnum() or body.split() == [body]:
                    order.append(i)
                    joined.append(k if k[0] == "\n" else " " + k)
                else:
                    alone.append((i, find(k if k[0] == "\n" else " " + k)))
        self.unfit = np.concatenate([self.unfit, unfit])
        pieces = find("".join(joined))
        starts = np.array([j for j, p in enumerate(pieces) if p[0] in " \n"], np.int64)
        counts = np.concatenate([np.diff(np.append(starts, len(pieces))), np.array([len(p) for _, p in alone], np.int64)])
        numbers = self._pieces(pieces + list(chain.from_iterable(p for _, p in alone)))
        ids, sizes = self.piece_runs.take(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        self.chunk_runs.put(known + np.array(order + [i for i, _ in alone], np.int64), ids, np.diff(ends))
        none = np.flatnonzero(unfit)
        self.chunk_runs.put(known + none, np.zeros(0, np.int32), np.zeros(len(none), np.int64))

    def _looked_up(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, and how many each text has."""
        known, counts = len(self.chunks), np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self._learn(known)
        return numbers, counts

    def _rough(self, text: str) -> list[str]:
        """Chunks of a text with blanks or line ends side by side, or at its ends."""
        first, *rest = CUT.split(text) if self.cuttable else [text]
        return ["  " + first, *((p[1:] if p[0] == " " else p) if p[1:].split() == [p[1:]] else "  " + p for p in rest)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of each text."""
        if len(self.chunks) > REMEMBERED or self.characters > CHARACTERS:
            self.chunks, self.chunk_runs, self.unfit, self.characters = Numbered(), Runs(), np.zeros(0, bool), 0
        if len(self.pieces) > REMEMBERED or self.piece_runs.used > CHARACTERS:
            self.pieces, self.piece_runs = Numbered(), Runs()
        if self.cuttable:
            cut = [t.replace("\n", " \n").split(" ") for t in texts]
            for c in cut:
                c[0] = " " + c[0]
            numbers, counts = self._looked_up(cut)
            del cut
            whose = np.repeat(np.arange(len(texts)), counts)
            rough = np.unique(whose[self.unfit[numbers]])
        else:
            numbers, whose, rough = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(texts))
        if len(rough):
            others, more = self._looked_up([self._rough(texts[i]) for i in rough])
            fit = ~np.isin(whose, rough)
            numbers, whose = np.concatenate([numbers[fit], others]), np.concatenate([whose[fit], np.repeat(rough, more)])
            order = np.argsort(whose, kind="stable")
            numbers, whose = numbers[order], whose[order]
        ids, sizes = self.chunk_runs.take(numbers)
        return ids, np.bincount(whose, sizes, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ``counts`` ids."""
        sizes = self.size[ids]
        out = ragged(self.bytes, self.at[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each run of ``counts`` ids in decimal, joined by spaces."""
        table = self.digits[ids]
        full = table != 0
        out = table[full].tobytes()
        ends = np.concatenate([[0], np.cumsum(full.sum(1))])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


def joined_at(ids: np.ndarray, rank: np.ndarray, at: np.ndarray, best: int, pairs: PairTable) -> tuple[np.ndarray, np.ndarray, int]:
    """``ids`` and the ranks of their pairs after the pairs at ``at`` have become ``best``, and the least new rank."""
    own = ids.copy()
    own[at] = best
    own, rank = np.delete(own, at + 1), np.delete(rank, at)
    at = at - np.arange(len(at))
    near = np.unique(np.concatenate([at, at - 1]))
    near = near[(near >= 0) & (near < len(own) - 1)]
    rank[near] = found = pairs.find(own[near], own[near + 1])
    return own, rank, int(found.min(initial=NONE))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``values`` that begin at ``starts`` and hold ``sizes`` entries, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_codecs: dict[tuple[int, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker."""
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def read_ranks(df: DataFrame, path: str):
    """The rank file (a megabyte or so, whatever the corpus) as a broadcast variable."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds ``to``, the ids of ``text``."""
    ranks, schema = read_ranks(df, path), T.StructType([*(f for f in df.schema if f.name != to), T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for b in slices(batches, text, SLICE):
            ids, counts = own.encode([t or "" for t in b.column(text).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists if f.name == to else b.column(f.name) for f in schema], names=[f.name for f in schema])
        own.forget()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``, the bytes that ``ids`` stand for."""
    ranks, schema = read_ranks(df, path), T.StructType([*(f for f in df.schema if f.name != to), T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for b in batches:
            lists = b.column(ids)
            counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out = own.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if f.name == to else b.column(f.name) for f in schema], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to; ids and bytes stay inside the task."""
    ranks = read_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for b in slices(batches, "text", SLICE):
            ids, counts = own.encode([t or "" for t in b.column("text").to_pylist()])
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in part(ids, counts)]) for part in (own.decimal, own.decode)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
