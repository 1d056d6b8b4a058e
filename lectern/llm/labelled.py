"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: dict[int, int], max_chars: int) -> DataFrame:
    """(text, label): at most ``per_class`` labelled ids of each class, outside the held-out fold.

    Ids are taken in the order of their hash. Null ids and labels are left out,
    an id with two labels counts with the larger, of an id with several texts the
    one with the smallest hash counts, and texts longer than ``max_chars`` serve
    only for scoring. The ids are few by construction, so they are broadcast to
    the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", folds) != fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = None
    for value, most in per_class.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    found = texts.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "label")
