"""MinHash near-dedup: one-permutation hashing with optimal densification, banded, linked by stars.

A document's shingle hashes fall into bins by their leading bits; the least of each bin is its
signature, and an empty bin borrows from a filled one chosen by a fixed hash of (bin, attempt).
Documents with one shingle set are one class. Class representatives meet in banded buckets. In
a round every bucket links its members to a center only, the links are confirmed on full sets,
and components are formed. Members of one component need no further comparison; buckets that
still hold several components go into the next round without the centers, which have met
everyone. Documents that share too few shingles with all others to have any link leave. Rounds
end when no bucket is left, so no pair that could be linked is skipped.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import Words, components, id_text, mix, slices, small_batches

#: Bands and bins per band. A pair of similarity 0.8 misses all bands once in 10 million times.
BANDS, ROWS = 32, 4
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: 64-bit words of the marks of lacking shingles. Fewer only rule out fewer pairs before they are measured.
MARKS = 8


def sets_of(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and each text's offsets."""
    values, rows, _ = Words(texts).shingles(k)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, first: np.ndarray, bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    """(texts, bands) hashes of densified one-permutation signatures; rows without shingles are zero."""
    n, bins = len(first) - 1, bands * per_band
    shift = np.uint64(64 - (bins - 1).bit_length())
    if 1 << (bins - 1).bit_length() != bins:
        raise ValueError("bands * per_band must be a power of two")
    rows = np.repeat(np.arange(n), np.diff(first))
    at = rows * bins + (values >> shift).astype(np.int64)
    head = np.ones(len(at), bool)
    head[1:] = at[1:] != at[:-1]
    sig, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    sig[at[head]], full[at[head]] = values[head], True
    sig, full = sig.reshape(n, bins), full.reshape(n, bins)
    row, gap = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        source = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt + 1)) >> shift).astype(np.int64)
        ok = full[row, source[gap]]
        sig[row[ok], gap[ok]] = sig[row[ok], source[gap[ok]]]
        row, gap, attempt = row[~ok], gap[~ok], attempt + 1
    out = np.zeros((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(per_band):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::per_band][:, :bands] + np.arange(1, bands + 1, dtype=np.uint64))
    return out


def sign(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit mark of the shingle set, and the band hashes."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 2_000_000):
                values, first = sets_of(texts[i:j], k)
                n = np.diff(first)
                sums = []
                with np.errstate(over="ignore"):
                    for seed in _SEEDS:
                        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ seed), dtype=np.uint64)])
                        sums.append(total[first[1:]] - total[first[:-1]])
                bands = signatures(values, first).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel()))],
                    ["doc_id", "n_shingles", "m1", "m2", "bands"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_shingles long, m1 long, m2 long, bands array<long>")


def marks(values: np.ndarray) -> np.ndarray:
    """One bit for each group of shingle hashes that any of ``values`` falls into."""
    group = (values % np.uint64(64 * MARKS)).astype(np.int64)
    out = np.zeros(64 * MARKS, np.uint8)
    out[group] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def measure(pairs: DataFrame, texts: DataFrame, k: int, percent: int, lacking: bool = False) -> DataFrame:
    """a, b, same and linked of every pair: the intersection of the full shingle sets, and whether
    100 * intersection >= percent * union. ``lacking``: also the marks of the shingles of b that a lacks
    (a_lacks) and of those of a that b lacks (b_lacks)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            ta, tb = b.column(2).to_pylist(), b.column(3).to_pylist()
            same, linked = np.zeros(len(ta), np.int64), np.zeros(len(ta), bool)
            lacks = np.zeros((2, len(ta), MARKS), np.int64)
            for i, j in slices([x if len(x) > len(y) else y for x, y in zip(ta, tb)], 1_000_000):
                values, first = sets_of(ta[i:j] + tb[i:j], k)
                m = j - i
                for r in range(m):
                    x, y = values[first[r]:first[r + 1]], values[first[m + r]:first[m + r + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    n = int((both[1:] == both[:-1]).sum())
                    same[i + r], linked[i + r] = n, n > 0 and 100 * n >= percent * (len(both) - n)
                    if lacking:
                        lacks[0, i + r] = marks(np.setdiff1d(y, x, assume_unique=True))
                        lacks[1, i + r] = marks(np.setdiff1d(x, y, assume_unique=True))
            out = [b.column(0), b.column(1), pa.array(same), pa.array(linked)]
            if lacking:
                ends = np.arange(0, len(ta) * MARKS + 1, MARKS, dtype=np.int32)
                out += [pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel())) for m in lacks]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["a", "b", "same", "linked", *(["a_lacks", "b_lacks"] if lacking else [])]
    return both.mapInArrow(run, "a long, b long, same long, linked boolean" + (", a_lacks array<long>, b_lacks array<long>" if lacking else ""))


def most_shared() -> Column:
    """Upper bound of the shingles that a row and its center (c_) share.

    z is the member that all of the bucket have met, i the shingles shared with it and s those shared with anyone.
    Of the shingles of z that one has, those are not common that the other lacks: at least one for each marked group
    that holds none that the one lacks itself. Outside of z both have at most s - i.
    """
    def beyond(one: str, other: str) -> Column:
        return reduce(add, [F.bit_count(F.col(one)[g].bitwiseAND(F.bitwise_not(F.col(other)[g]))) for g in range(MARKS)])

    inside = F.least(F.col("i") - beyond("c_lacks", "lacks"), F.col("c_i") - beyond("lacks", "c_lacks"))
    return inside + F.least(F.col("s") - F.col("i"), F.col("c_s") - F.col("c_i"))


def unshared(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id and n_alone: how many of its shingles no other of these documents has."""
    rows = texts.join(ids, "doc_id", "left_semi").select("doc_id", "text")

    def run(batches):
        for b in batches:
            texts_ = b.column(1).to_pylist()
            for i, j in slices(texts_, 1_000_000):
                values, first = sets_of(texts_[i:j], k)
                owner = np.repeat(b.column(0).slice(i, j - i).to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(values.view(np.int64))], ["doc_id", "shingle"])

    seen = (rows.mapInArrow(run, "doc_id long, shingle long").groupBy("shingle")
            .agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")))
    return seen.where("doc_id = other").groupBy("doc_id").agg(F.count("*").alias("n_alone"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, component) after the components that new links (a, b) connect have become one."""
    ends = links.select("a", "b").join(labels.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a")
    ends = ends.join(labels.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-components")
    joined = joined.select(F.col("v").alias("component"), F.col("component").alias("to"))
    return labels.join(joined, "component", "left").select("v", F.coalesce("to", "component").alias("component"))


def near_links(signed: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text"):
    """(classes, labels): m1, m2, n_shingles -> rep, and rep (v) -> component for linked representatives.

    In each round the centers of a bucket meet its other members that are in other components,
    unless set sizes (n) and shared shingles rule a link out. The first center is the smallest
    id. Then s, the shingles shared with anyone, is counted, and the member that shares most
    meets all others: each shares i shingles with it and s - i others, which with marks of what each
    lacks of it bounds the intersection of two members (``most_shared``). From then on each round
    has 16 times as many centers, drawn by a hash.
    """
    spark = signed.sparkSession
    key = ["m1", "m2", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(key).agg(F.min("doc_id").alias("rep"))
    heads = (signed.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"])
             .select("doc_id", F.col("n_shingles").alias("n"), "bands"))
    members = heads.select("doc_id", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("bucket")
    live = stage(members.join(shared, "bucket").distinct()
                 .withColumns({"s": F.col("n"), "i": F.lit(0).cast("long"), "lacks": F.array_repeat(F.lit(0).cast("long"), MARKS)}), "near-buckets")
    texts = stage(id_text(docs, id_col, text_col).join(live.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "near-texts")
    labels = live.select(F.col("doc_id").alias("v"), F.col("doc_id").alias("component")).distinct()
    done = spark.createDataFrame([], "a long, b long")
    turn, centers = 0, 1
    while True:
        state = live.join(labels, live["doc_id"] == labels["v"]).select("bucket", "doc_id", "n", "s", "i", "lacks", F.col("component").alias("comp"))
        best = F.struct((-F.col("s") / F.col("n")).alias("order") if turn else F.lit(0.0).alias("order"), "doc_id")
        open_ = (state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"),
                                             F.min(best).alias("best")).where("lo < hi")
                 .select("bucket", "size", F.col("best.doc_id").alias("best")))
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("size")) < (centers if centers > 1 else 0)
        state = state.join(open_, "bucket").withColumn("center", (F.col("doc_id") == F.col("best")) | drawn)
        # a document's open buckets, and those it is a center of
        own = state.groupBy("doc_id").agg(F.collect_set("bucket").alias("mine"), F.collect_set(F.when(F.col("center"), F.col("bucket"))).alias("led"))
        state = stage(state.drop("size").join(own, "doc_id"), "near-open")
        if state.isEmpty():
            break
        heads_ = state.where("center").select("bucket", *[F.col(c).alias(f"c_{c}") for c in ("doc_id", "n", "s", "i", "lacks", "comp", "led")])
        most = most_shared()
        # of the buckets that a document shares with a center, one emits the pair
        both = state.join(heads_, "bucket").where("doc_id <> c_doc_id AND bucket = array_min(array_intersect(mine, c_led))")
        if turn != 1:
            both = both.where("comp <> c_comp").where(100 * most >= percent * (F.col("n") + F.col("c_n") - most))
        pairs = both.select(F.least("doc_id", "c_doc_id").alias("a"), F.greatest("doc_id", "c_doc_id").alias("b")).distinct()
        met = stage(measure(pairs if turn == 1 else pairs.join(done, ["a", "b"], "left_anti"), texts, k, percent, lacking=turn == 1), "near-links")
        done = done.unionByName(met.select("a", "b"))
        if not met.where("linked").isEmpty():
            labels = stage(relabel(labels, met.where("linked")), "near-labels")
        live = state.where("NOT center").select("bucket", "doc_id", "n", "s", "i", "lacks", "best")
        if turn == 0:
            alone = unshared(texts, state.select("doc_id").distinct(), k)
            live = live.join(alone, "doc_id", "left").withColumn("s", F.col("n") - F.coalesce("n_alone", F.lit(0)))
            live = live.where(100 * F.col("s") >= percent * F.col("n")).select("bucket", "doc_id", "n", "s", "i", "lacks")
        elif turn == 1:
            live = live.drop("i", "lacks").join(met.select("a", "b", F.col("same").alias("i"), "a_lacks", "b_lacks"),
                                                (F.least("doc_id", "best") == F.col("a")) & (F.greatest("doc_id", "best") == F.col("b")))
            live = live.select("bucket", "doc_id", "n", "s", "i", F.when(F.col("doc_id") == F.col("a"), F.col("a_lacks")).otherwise(F.col("b_lacks")).alias("lacks"))
        turn, centers = turn + 1, centers if turn < 1 else centers * 16
    return classes, labels


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are runs without ASCII white space, A-Z lower-cased; a document with fewer than k
    words has its whole sequence as its one shingle. Two documents are linked when their sets
    have a similarity of ``percent`` or more; component_id is the smallest id reachable. Null and
    empty texts have no shingle and are linked with nothing. A row without id belongs to the
    documents of the same shingle set, if any. Rows that repeat an id get the same component and
    are all kept or all dropped. An empty table gives an empty result.
    """
    signed = stage(sign(docs, k, id_col, text_col), "near-signatures")
    classes, labels = near_links(signed, docs, k, percent, id_col, text_col)
    rows = signed.select("doc_id", "n_shingles", "m1", "m2")
    out = rows.join(classes, ["m1", "m2", "n_shingles"], "left")
    out = out.join(labels, out["rep"] == labels["v"], "left")
    group = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with the columns of ``docs``."""
    gone = near_groups(docs, k, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone"]), "left_anti")
