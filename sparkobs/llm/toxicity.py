"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams, their stems and skip-grams.

A text's features are the distinct hashes of its words, of their first letters (4, 5 and 6: inflected forms share
them), of neighbouring words and of words one or two apart. Per-coordinate rates and L1 leave few weights, which are
broadcast (2**BITS of them at most, whatever the corpus) to score whole texts.

Defined results: a null text scores as the empty one, which has the bias alone; texts of any length are scored whole;
repeated rows get equal scores; a null id is in no fold (``held_out`` is null) and its label teaches nothing; a
document labelled more than once is toxic if any label says so; null labels and null ids teach nothing; with labels of
one kind or none every score is that kind's smoothed share (0.5 without any) and nothing is learned; other columns of
either table are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkobs.llm.common import slices

BITS = 20
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
GAPS = (1, 2, 3)
#: Documented bound of the sample that fits the weights: so many documents of each label at most, by hash of doc_id.
SAMPLE = 3000
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.5, 1.0, 4.0, 0.1, 6, 17
#: Words remembered by one Python worker; bounds memory only.
REMEMBERED = 250_000


class Features:
    """Hashed features of texts; words are remembered with their hashes."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.hashes = np.zeros((1024, 1 + len(STEMS)), np.uint64)

    def _learn(self, words: list[str]) -> None:
        start = len(self.at)
        self.at.update(zip(words, range(start, start + len(words)), strict=True))
        while len(self.at) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        of = xxhash.xxh64_intdigest
        self.hashes[start : len(self.at), 0] = [of(w) for w in words]
        for j, n in enumerate(STEMS):
            self.hashes[start : len(self.at), j + 1] = [of(w[:n], n) if len(w) >= n else 0 for w in words]

    def __call__(self, texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and features, each pair once; only features that ``kept`` (a mask over all hashes) admits."""
        if len(self.at) > REMEMBERED:
            self._forget()
        words = [WORD.findall(t.lower()) for t in texts]
        self._learn(sorted(set().union(*words) - self.at.keys()))
        counts = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(texts)), counts)
        found = []

        def take(hashes: np.ndarray, whose: np.ndarray) -> None:
            f = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            if kept is not None:
                live = kept[f]
                f, whose = f[live], whose[live]
            found.append(whose << BITS | f)

        for j in range(1 + len(STEMS)):
            h = self.hashes[ids, j]
            take(h[h != 0] if j else h, of[h != 0] if j else of)
        h = self.hashes[ids, 0]
        for gap in GAPS:
            same = of[gap:] == of[:-gap] if gap < len(of) else np.zeros(0, bool)
            a, b = (h[:-gap][same], h[gap:][same]) if gap < len(of) else (h[:0], h[:0])
            take((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(2 * gap + 1) * np.uint64(0x165667B19E3779F9), of[gap:][same] if gap < len(of) else of[:0])
        pairs = np.unique(np.concatenate(found))
        return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all hashes, and the bias."""
    size = 1 << BITS
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return np.zeros(size), float(np.log(share / (1 - share)))
    features, own = Features(), []
    for i in range(0, len(texts), 200):
        of, f = features(texts[i : i + 200])
        own += np.split(f, np.searchsorted(of, np.arange(1, len(texts[i : i + 200]))))
    order = np.random.default_rng(SEED)
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    bias = lambda: -bias_z / ((BETA + bias_n**0.5) / ALPHA + L2)
    for _ in range(EPOCHS):
        for i in order.permutation(len(own)):
            f = own[i]
            zf, nf = z[f], n[f]
            w, b = weight(zf, nf), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - labels[i]
            root = np.sqrt(nf + g * g)
            z[f], n[f] = zf + g - (root - np.sqrt(nf)) / ALPHA * w, nf + g * g
            bias_z, bias_n = bias_z + g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * b, bias_n + g * g
    return weight(z, n), float(bias())


def score(texts: list[str], weights: np.ndarray, bias: float, features: Features) -> np.ndarray:
    of, f = features(texts, weights != 0)
    total = np.bincount(of, weights[f], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns feature, weight: the weights that are not 0, and the bias as feature -1."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    picked = own.where("label = 1").orderBy("h", "doc_id").limit(sample).unionAll(own.where("label = 0").orderBy("h", "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # at most 2 * sample rows, one for each document
    rows = rows.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"), F.first("h").alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        weights, bias = fit(pdf.text.tolist(), pdf.label.to_numpy())
        live = np.flatnonzero(weights)
        return pd.DataFrame({"feature": np.concatenate([[-1], live]), "weight": np.concatenate([[bias], weights[live]])})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "feature long, weight double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: list[str] = ["doc_id"], sample: int = SAMPLE) -> DataFrame:  # noqa: B006
    """The columns ``keep`` of ``docs`` with score and predicted (1 from ``threshold`` on)."""
    learned = train(docs, labels, sample).toPandas()
    sparse = docs.sparkSession.sparkContext.broadcast((learned.feature.to_numpy(), learned.weight.to_numpy()))
    out = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(o) for c, o in zip(keep, out, strict=True)), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = sparse.value
        weights, features = np.zeros(1 << BITS), Features()
        weights[f[f >= 0]] = w[f >= 0]
        bias = float(w[f < 0].sum())  # 0 without any label
        for b in slices(batches, "text"):
            s = score(b.column("text").to_pylist(), weights, bias, features)
            yield pa.RecordBatch.from_arrays([*(b.column(o) for o in out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*out, "score", "predicted"])

    kinds = ", ".join(f"{o} {rows.schema[o].dataType.simpleString()}" for o in out)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int").select(*(F.col(o).alias(c) for c, o in zip(keep, out, strict=True)), "score", "predicted")
