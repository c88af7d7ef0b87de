"""Spans of words in documents: joining pairs with their texts and merging what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import id_text


def texts_of(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """doc_id and text of the documents in ``pairs`` (a, b), written once."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return stage(id_text(docs, id_col, text_col).join(ids, "doc_id", "left_semi").distinct(), name)


def with_texts(pairs: DataFrame, texts: DataFrame, *more: str, firsts: DataFrame | None = None) -> DataFrame:
    """Pairs with both texts; ``firsts`` has those of the documents a, if not all documents may be one."""
    left = (texts if firsts is None else firsts).select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", *more, "ta", "tb")


def merge_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, end (words, end exclusive), n_words, other_id and later.

    spans: doc_id, start, end, other_id. Overlapping spans of a document become one; other_id is
    the smallest id it was found with, and ``later`` tells whether that comes before the
    document itself, so that removing all later spans leaves each passage's first home.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = spans.groupBy("doc_id", "start", "end").agg(F.min("other_id").alias("other_id"))
    new = F.when(F.col("start") <= before, 0).otherwise(1)
    runs = flat.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    out = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_id").alias("other_id"))
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other_id",
                      (F.col("other_id") < F.col("doc_id")).alias("later"))
