"""Bounded, reproducible samples of labelled texts for the classifiers, and sigmoids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fold

#: Labelled rows a model is fitted on, at most.
SAMPLE_ROWS = 8_000


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold, in an order set by the id.

    Null ids and labels are left out; an id with both labels counts as 1. The ids are taken by hash, whatever their text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
