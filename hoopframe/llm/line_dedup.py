"""Line dedup over overlapping windows of three lines, with built-in expressions only.

Every window of three consecutive lines is hashed; one grouping finds each window's first
occurrence in the order (doc_id, position). Later occurrences cover three lines each, the
covered positions of a document are merged, and those lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

WIDTH = 3


def line_windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (hash of the text), pos and hash of every window with a visible character."""
    cut = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("lines"))
    cut = cut.where(F.size("lines") >= width)
    joined = F.transform(F.sequence(F.lit(1), F.size("lines") - (width - 1)),
                         lambda i: F.concat_ws("\n", F.slice("lines", i, width)))
    return (cut.select("doc_id", "mark", F.posexplode(joined).alias("pos", "part"))
            .where(F.col("part").rlike(r"[^\x20\x09-\x0D]"))
            .select("doc_id", "mark", "pos", F.unhex(F.md5("part")).alias("hash")))


def later_windows(windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Occurrences after the first, as doc_id, mark, from, to (the lines they cover).

    An occurrence that overlaps the window's own first one covers only lines beyond it.
    """
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "pos", "mark")
    repeated = (windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .where("first <> last").select("hash", "first"))
    later = windows.join(repeated, "hash").where(place != F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    begin = F.when(same, F.greatest("pos", F.col("first.pos") + width)).otherwise(F.col("pos"))
    return later.select("doc_id", "mark", begin.alias("from"), (F.col("pos") + width - 1).alias("to")).where("from <= to")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines, removed (sorted line numbers from 0) and the text that stays.

    Lines are split at line feeds. A null text counts as empty (one empty line). Documents with
    fewer lines than a window, and windows of white space only, are left alone. Documents are
    ordered by id, null last; rows that repeat both id and text are one document and get the
    same result. An empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    covered = (later_windows(line_windows(rows, width), width)
               .groupBy("doc_id", "mark")
               .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("from", "to"))))).alias("removed"))
               .select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "removed"))
    marked = rows.withColumn("mark", F.xxhash64("text"))
    both = marked.join(covered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains(removed, i))
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), removed.alias("removed"), text.alias("text"))
