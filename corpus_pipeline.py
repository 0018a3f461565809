"""A corpus pipeline over ``documents``: each stage applies one operator to all that the stage before it kept.

All stages but the last return the columns of documents, and any others that documents has. Of rows that are alike one
stays at the join: the one with the least id, null last, ties by hash of text and row; repeated rows stay once there.
Null and empty texts pass all stages but mixing, which takes no document without words; very long texts go through all
stages whole; an empty table gives an empty table, and without labels no document counts as toxic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkobs.llm import jaccard, mixing, pii, toxicity
from sparkobs.llm import queries as q
from sparkobs.llm.common import discard, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.classify(docs, q.table(spark, sf_dir, "labels"), keep=docs.columns).where("predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of similar shingle sets tie together, the one with the smallest id."""
    return jaccard.first_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the new text."""
    both = pii.redact(docs.select(F.struct(*docs.columns).alias("old"), "text"))
    kept = [F.col("old").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    n = F.when(F.length("text") != F.length("old.text"), size).otherwise(F.col("old.n_chars")).alias("n_chars")
    return both.select(*kept, "text", n).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.select(docs, F.array("source"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return q.tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", clean), ("jaccard_join", distinct), ("pii", private), ("mixing", mix), ("byte_bpe", tokenize)]
#: Learned scores and hashed merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, run_id = q.table(spark, sf_dir, "documents"), None, uuid.uuid4().hex
    for name, stage in STAGES[:-1]:
        folder = f"pipeline-{run_id}-{name}"
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/docs")  # the next stage reads it more than once
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
