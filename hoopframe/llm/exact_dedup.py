"""Exact dedup by content sort, with built-in expressions only.

Sampled splitters range-partition the rows on the leading characters of the normalised text
and its digest; an external sort inside each partition puts equal texts next to each other,
and the window compares neighbouring rows in full. A salt from the id cuts a large group of
copies into runs that sort in different partitions; the runs' first rows are then merged by
digest, with map-side partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import WHITE

SALTS = 64
LEAD = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_sorted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One struct column ``row`` (all input columns) plus doc_id, chars, digest, salt and rank.

    ``rank`` numbers the rows of a run (equal text, equal salt) from the longest original text,
    then the smallest id. Partitions are cut on (lead, digest, salt), so the window needs no
    further exchange; ``norm`` is part of its key, so neighbours are compared in full.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    norm = normalised(docs[text_col])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"),
                       F.length(text).cast("long").alias("chars"), norm.alias("norm"))
    rows = rows.select("*", F.sha2("norm", 256).alias("digest"), F.substring("norm", 1, LEAD).alias("lead"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    run = (Window.partitionBy("lead", "digest", "salt", "norm")
           .orderBy(F.desc("chars"), F.asc_nulls_last("doc_id")))
    return (rows.repartitionByRange("lead", "digest", "salt")
            .withColumn("rank", F.row_number().over(run)).drop("norm", "lead"))


def best_of_groups(ranked: DataFrame) -> DataFrame:
    """digest, keep_id, keep_salt, group_size: one row per distinct text."""
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    head = F.min(F.when(F.col("rank") == 1, F.struct(order.alias("o"), F.col("salt").alias("s")))).alias("b")
    return (ranked.groupBy("digest").agg(F.count("*").alias("group_size"), head)
            .select("digest", "group_size", F.col("b.o.d").alias("keep_id"), F.col("b.s").alias("keep_salt")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical without ASCII white space. The row with the longest original
    text, then the smallest id stays (a null id sorts last). Null and empty texts, and texts of
    white space only, form one group. Rows that repeat an id and text are members like any
    other, and one of them stays. An empty table gives an empty result.
    """
    ids = docs.select(docs[id_col], docs[text_col])
    ranked = stage(content_sorted(ids, id_col, text_col).drop("row"), "exact-runs")
    groups = best_of_groups(ranked)
    runs = ranked.where("rank = 1").select("digest", "salt").join(groups, "digest").drop("keep_salt")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rank") == 1)
    return (ranked.join(runs, ["digest", "salt"])
            .select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with the columns of ``docs``."""
    ranked = stage(content_sorted(docs, id_col, text_col).where("rank = 1"), "exact-heads")
    best = best_of_groups(ranked.drop("row")).select("digest", F.col("keep_salt").alias("salt"))
    return ranked.join(best, ["digest", "salt"], "left_semi").select("row.*")
