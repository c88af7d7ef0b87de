"""Resampling towards a target distribution by hashed word features, with a head-tail vocabulary.

A feature is a run of 1 to ``runs`` consecutive words, its bucket the CRC-32 of its bytes. The
words are counted once over the corpus; the head (the ``HEAD`` most frequent words and pairs, a
bounded table) is broadcast: for a word its CRC state, from which the CRC of a pair goes on
without reading the first word again, and for a frequent pair its bucket. All other features, the
tail, take their CRC directly. Both feed the same exact bucket totals; the head only saves work,
the result is the same for any size of it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopframe.operators.ordering import number_rows
from hoopframe.sources.staging import stage

from .common import id_text, small_batches

#: Words are runs of these bytes after lower-casing A-Z; every byte of a non-ASCII character is one.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words, and pairs, in the broadcast head: some megabytes at most.
HEAD = 20_000
#: Words handled at a time, so that a huge text needs no list of all its words.
CHUNK = 50_000
#: Distinct features counted in a task before they are passed on.
HELD = 200_000


def chunks(text: str):
    """Lists of consecutive words of a text."""
    found = WORD.finditer(text.encode("utf-8", "surrogatepass").lower())
    while part := [m[0] for m in islice(found, CHUNK)]:
        yield part


def pairs(words: list[bytes], last: bytes | None) -> list[bytes]:
    """Two-word features, with the word before the list if there is one."""
    left = words if last is None else [last, *words]
    return [a + b" " + b for a, b in zip(left, left[1:])]


def common_features(texts: DataFrame, runs: int, head: int) -> tuple[dict, dict]:
    """CRC states of the most frequent words and buckets-to-be (CRCs) of the most frequent pairs.

    Counts are exact over all texts. Features of one count are in together or not at all, so at most
    ``head`` rows come to the driver.
    """
    def count(batches):
        seen = Counter()

        def rows():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([f for _, f in keys], pa.binary()),
                                               pa.array([seen[k] for k in keys], pa.int64())], names=["n", "feature", "times"])

        for batch in batches:
            for text in batch.column("text"):
                last = None
                for words in chunks(text.as_py()):
                    for w, times in Counter(words).items():
                        seen[1, w] += times
                    if runs > 1:
                        for p, times in Counter(pairs(words, last)).items():
                            seen[2, p] += times
                    last = words[-1]
                    if len(seen) > HELD:
                        yield rows()
                        seen.clear()
        yield rows()

    times = (texts.select("text").mapInArrow(count, "n int, feature binary, times long")
             .groupBy("n", "feature").agg(F.sum("times").alias("times")))
    held = stage(times, "features")
    out = []
    for n in (1, 2)[:min(runs, 2)]:
        mine = held.where(F.col("n") == n)
        # how many features have each count, from the highest: the counts whose features all fit make the head
        steps = mine.groupBy("times").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("times")).limit(head).collect()
        least, room = None, head
        for step in steps:
            room -= step.many
            if room < 0:
                break
            least = step.times
        top = [] if least is None else mine.where(F.col("times") >= least).select("feature").collect()  # at most ``head`` rows
        out.append({bytes(r.feature): crc32(r.feature) for r in top})
    return out[0], out[1] if runs > 1 else {}


def features(texts: DataFrame, buckets: int, runs: int, head: tuple[dict, dict]) -> DataFrame:
    """id, n_words, n_features and the bucket of every feature (packed unsigned numbers)."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def of(words, before, states, known, out):
        """Appends the buckets of all runs that end in ``words``; ``before`` holds the words before them."""
        get = states.get
        state = [s if (s := get(w)) is not None else crc32(w) for w in words]
        out.append(np.array(state, np.uint32) % buckets)
        if runs < 2:
            return
        line = [*before, *words]
        first = [s if (s := get(w)) is not None else crc32(w) for w in before] + state
        skip = len(before)
        got = known.get
        for n in range(2, runs + 1):
            now = []
            for i in range(max(skip, n - 1), len(line)):
                begin = i - n + 1
                if n == 2 and (b := got(line[begin] + b" " + line[i])) is not None:
                    now.append(b)
                else:
                    now.append(crc32(b" " + b" ".join(line[begin + 1:i + 1]), first[begin]))
            out.append(np.array(now, np.uint32) % buckets)

    def work(batches):
        states, known = sent.value
        for batch in batches:
            counts, sizes, packed = [], [], []
            for text in batch.column("text"):
                parts, before, n = [], [], 0
                for words in chunks(text.as_py()):
                    of(words, before, states, known, parts)
                    before = [*before, *words][-(runs - 1):] if runs > 1 else []
                    n += len(words)
                every = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
                counts.append(n)
                sizes.append(len(every))
                packed.append(every.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(packed, pa.binary())], names=["doc_id", "n_words", "n_features", "packed"])

    return texts.mapInArrow(work, "doc_id long, n_words long, n_features long, packed binary")


def totals(held: DataFrame, buckets: int) -> DataFrame:
    """bucket and how many features it holds: one row a bucket and task, then summed."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                sums += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "times"])

    return held.select("packed").mapInArrow(count, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Every bucket's gain: its share in the target over that in the corpus, in thousandths of a logarithm."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).withColumnRenamed("id", "bucket")
            .join(corpus.withColumnRenamed("times", "s"), "bucket", "left")
            .join(target.withColumnRenamed("times", "t"), "bucket", "left")
            .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]))
    both = stage(both, "bucket-totals")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    n = float(buckets)
    share = (F.col("t") + 1.0) * F.lit(sums.s + n) / ((F.col("s") + 1.0) * F.lit(sums.t + n))
    gains = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect():  # one row a bucket
        gains[r.bucket] = r.gain
    return gains


def weights(held: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and the sum of the gains of a text's features."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    sent = held.sparkSession.sparkContext.broadcast(gains)

    def work(batches):
        gain = sent.value
        for batch in batches:
            sums = [int(gain[np.frombuffer(p.as_buffer(), kind)].sum()) for p in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return held.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = 10_000, runs: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024",
             head: int = HEAD) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred (rounded down)
    with the highest scores are drawn, ties to the smaller id, null ids last. A null text counts as
    empty: no features, weight 0, never drawn while ``least_words`` is above 0. A null id draws its
    noise from the seed alone. Rows that repeat an id are scored each on its own; rows equal in id
    and score take neighbouring ranks. Empty tables give an empty result, an empty target one in
    which every gain compares with nothing. Of other columns none is read. Long texts are read in
    chunks of words; their buckets take two bytes a feature (four beyond 65,536 buckets).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, aim = id_text(docs, id_col, text_col), target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(target_col, F.lit("")).alias("text"))
    common = common_features(rows.unionByName(aim), runs, head)
    held = stage(features(rows, buckets, runs, common), "buckets")
    goal = features(aim, buckets, runs, common)
    gains = bucket_gains(totals(held, buckets), totals(goal, buckets), buckets)
    scored = weights(held, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = number_rows(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents drawn, all columns, one row for every drawn id (ids should not repeat)."""
    chosen = resample(docs, target, id_col=id_col, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
