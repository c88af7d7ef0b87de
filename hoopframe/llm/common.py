"""What several operators share: column access, word hashing in numpy, batch sizes, components."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

#: The white space of every contract, as characters and as a class for regular expressions.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; a null text counts as empty. Other columns never clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python workers, so that long texts don't fill a worker.

    Workers also look for this library where the driver has it, besides their installed packages.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    paths = spark.sparkContext.environment
    held = [p for p in paths.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in held:
        paths["PYTHONPATH"] = os.pathsep.join([*held, ROOT])


def slices(texts: list, most: int = 8_000_000):
    """Index ranges of ``texts`` with about ``most`` characters each; one longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


# --- hashing words of many texts at once -------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Lower-cased words of several texts as 64-bit hashes, in order.

    ``hashes`` holds all words of all texts, text i owning ``hashes[first[i]:first[i + 1]]``.
    Only A-Z are lower-cased; words are maximal runs without ASCII white space. A word's hash
    is a polynomial over its bytes modulo 2^64, mixed.
    """

    BASE = 0x2545F4914F6CDD1D

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        blob = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        white = (blob == 32) | ((blob >= 9) & (blob <= 13))
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        size = len(blob)
        with np.errstate(over="ignore"):
            powers, inverse = self._powers(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
            poly = (sums[ends] - sums[starts]) * inverse[starts]
            self.hashes = mix(poly + (ends - starts).astype(np.uint64) * _ODD)
        lengths = np.array([len(r) + 1 for r in raw], np.int64)
        self.first = np.searchsorted(starts, np.concatenate([[1], 1 + np.cumsum(lengths)]))
        self.counts = np.diff(self.first)

    _held: tuple | None = None

    @classmethod
    def _powers(cls, size: int):
        if cls._held is None or len(cls._held[0]) < size:
            room = 1 << max(16, (size - 1).bit_length())
            base = np.full(room, cls.BASE, np.uint64)
            base[0] = 1
            back = np.full(room, pow(cls.BASE, -1, 2**64), np.uint64)
            back[0] = 1
            with np.errstate(over="ignore"):
                cls._held = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return cls._held

    def shingles(self, k: int):
        """Hashes of all runs of k words, the row each belongs to, and its word position in the row.

        A row with fewer than k words (but at least one) has its whole sequence as one shingle.
        """
        h, first, counts = self.hashes, self.first, self.counts
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - np.repeat(first[:-1], counts)
        with np.errstate(over="ignore"):
            if len(h) >= k:
                n = len(h) - k + 1
                acc = np.zeros(n, np.uint64)
                for j in range(k):
                    acc = (acc + h[j:j + n]) * _ODD
                    acc ^= acc >> np.uint64(29)
                full = owner[:n] == owner[k - 1:]
                values, rows, pos = mix(acc[full]), owner[:n][full], place[:n][full]
            else:
                values, rows, pos = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            short = np.flatnonzero((counts > 0) & (counts < k))
            if len(short):
                extra = []
                for r in short:
                    acc = np.uint64(counts[r])
                    for x in h[first[r]:first[r + 1]]:
                        acc = (acc + x) * _ODD
                        acc ^= acc >> np.uint64(29)
                    extra.append(acc)
                values = np.concatenate([values, mix(np.array(extra, np.uint64))])
                rows = np.concatenate([rows, short])
                pos = np.concatenate([pos, np.zeros(len(short), np.int64)])
                order = np.argsort(rows, kind="stable")
                values, rows, pos = values[order], rows[order], pos[order]
        return values, rows, pos


# --- connected components ----------------------------------------------------------------------

def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, component) for every end of an edge (a, b); component is the smallest reachable id.

    Alternates large-star and small-star steps until only stars are left. Every step is a grouping
    with a map-side minimum and a join on one end, written to the shared folder.
    """
    now = stage(edges.where("a <> b")
                .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), name)
    while True:
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = (both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        near = large.join(low, "v")
        small = (near.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        now = stage(small, name)
        # stars: every v has one u, and no u is a v
        many = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        chained = now.join(now.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("v")
        if many.unionByName(chained).isEmpty():
            break
    roots = now.select(F.col("u").alias("v")).distinct().select("v", F.col("v").alias("component"))
    return now.select("v", F.col("u").alias("component")).unionByName(roots)
