"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are kept: positions whose k-gram hash is the least of some
window of k-grams. Any passage of ``least`` words holds such a position, the same one in every
document. Suffixes whose k-gram occurs once leave. The others are sorted twice, by what follows
and by what precedes (in blocks of words, then by id), in range partitions; neighbours of
different documents are pairs, and each pair is extended word by word to the left and right.
Neighbours in two orders do not show every passage. So each window of ``least`` words around a
kept suffix that does not lie in a passage found so far is hashed, and its documents are linked
to the smallest one that holds it and extended as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import Words, id_text, mix, slices, small_batches
from .spans import merge_spans, texts_of, with_texts

#: Words of a k-gram, and of one block of a suffix's sort key; blocks on either side.
KGRAM, BLOCK, BLOCKS = 16, 8, 4
SORTED = [f"r{i}" for i in range(BLOCKS)], [f"l{i}" for i in range(BLOCKS)]


def sliding(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of ``width`` values, by doubling."""
    size, out = 1, v
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:-rest], out[rest:]) if rest else out


def minimisers(values: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Indices that are the least of some window of ``width`` values of one row (the last of equals).

    A row with fewer values has its one least value.
    """
    if not len(values):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.concatenate([first, [len(rows)]]))
    # one zero between rows, so that windows across rows have a least value that is nobody's
    at = np.arange(len(rows)) + np.repeat(np.arange(len(first)), counts) + width
    v = np.zeros(len(rows) + len(first) + 2 * width, np.uint64)
    v[at] = np.maximum(values, np.uint64(1))
    low = sliding(v, width, np.minimum)
    high = sliding(low, width, np.maximum)  # high[i]: the largest least value of windows that hold v[i + width - 1]
    chosen = high[at - width + 1] == v[at]
    short = np.flatnonzero(counts < width)
    picks = np.array([first[s] + int(values[first[s]:first[s] + counts[s]].argmin()) for s in short], np.int64)
    return np.union1d(np.flatnonzero(chosen), picks)


def block_hashes(h: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
    """Hash of BLOCK words from each start in direction step, counting words outside [low, high) as none."""
    acc = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BLOCK):
            i = start + j * step
            inside = (i >= low) & (i < high)
            word = np.where(inside, h[np.clip(i, 0, max(0, len(h) - 1))], np.uint64(0))
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + word)
    return (acc >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos (word), gram and the sort blocks of every kept suffix of documents with ``least`` words."""
    small_batches(docs.sparkSession)
    width = least - KGRAM + 1
    names = ["doc_id", "pos", "gram", *SORTED[0], *SORTED[1]]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(texts, 2_000_000):
                words = Words(texts[i:j])
                values, rows, pos = words.shingles(KGRAM)
                long = words.counts[rows] >= least
                values, rows, pos = values[long], rows[long], pos[long]
                at = minimisers(values, rows, width)
                values, rows, pos = values[at], rows[at], pos[at]
                first, last = words.first[rows], words.first[rows + 1]
                start = first + pos
                right = [block_hashes(words.hashes, start + KGRAM + BLOCK * k, first, last, 1) for k in range(BLOCKS)]
                left = [block_hashes(words.hashes, start - 1 - BLOCK * k, first, last, -1) for k in range(BLOCKS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][rows]), pa.array(pos.astype(np.int32)), pa.array(values.view(np.int64)),
                     *[pa.array(x) for x in right], *[pa.array(x) for x in left]], names)

    kinds = "doc_id long, pos int, gram long, " + ", ".join(f"{x} int" for x in names[3:])
    return id_text(docs, id_col, text_col).where("doc_id IS NOT NULL").mapInArrow(run, kinds)


def neighbours(suffixes: DataFrame, blocks: list[str], name: str) -> DataFrame:
    """a, p, b, q: suffixes of different documents next to each other in the order (gram, blocks, id).

    A run of suffixes of one document counts as one neighbour. Range partitions may cut a k-gram
    anywhere; the last suffix of each partition meets the first one of the next on the
    driver, which sees two rows a partition.
    """
    order = ["gram", *blocks, "doc_id", "pos"]
    ranged = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        held: list[tuple] = []  # the current run: (gram, doc, pos), one document and k-gram
        earlier: list[tuple] = []  # the run before it, of the same k-gram
        head, part = None, 0
        for b in batches:
            out = []
            gram, doc, pos = (b.column(order.index(c)).to_pylist() for c in ("gram", "doc_id", "pos"))
            for g, d, p in zip(gram, doc, pos):
                row = (g, d, p)
                if head is None:
                    head, part = row, b.column(len(order))[0].as_py()
                if held and (held[0][0] != g or held[0][1] != d):
                    earlier = held if held[0][0] == g else []
                    held = []
                held.append(row)
                if earlier:
                    # the first of a run meets all of the run before, later ones its last
                    out += [(e[1], e[2], d, p) for e in (earlier if len(held) == 1 else earlier[-1:])]
            yield batch(out, 0, 0)
        if head is not None:
            yield batch([(head[0], 0, head[1], head[2])], 1, part)
            yield batch([(h[0], 0, h[1], h[2]) for h in held[-1:]], 2, part)

    def batch(rows, kind, part):
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                           pa.array(columns[3], pa.int64()), pa.array([kind] * len(rows), pa.int32()),
                                           pa.array([part] * len(rows), pa.int32())], ["a", "p", "b", "q", "kind", "part"])

    found = stage(ranged.mapInArrow(run, "a long, p long, b long, q long, kind int, part int"), name)
    heads, tails = {}, {}
    for r in found.where("kind > 0").collect():
        (heads if r["kind"] == 1 else tails).setdefault(r["part"], []).append((r["a"], r["b"], r["q"]))
    seams, parts = [], sorted(heads)
    for one, two in zip(parts, parts[1:]):
        for g, d, p in tails[one]:
            seams += [(d, p, e, q) for h, e, q in heads[two] if h == g and e != d]
    extra = found.sparkSession.createDataFrame(seams, "a long, p long, b long, q long")
    return found.where("kind = 0").select("a", "p", "b", "q").unionByName(extra)


def extend(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, least: int, width: int) -> list[tuple[int, int, int]]:
    """(start in x, start in y, length) of the maximal equal runs of at least ``least`` words around the places (p in x, q in y).

    A place whose ``width`` words lie in runs found before, in x and in y, is not looked at again: a text that
    repeats itself has places on very many shifts, which all cover the same words.
    """
    out = []
    apart = q - p
    order = np.lexsort((p, apart))
    p, apart = p[order], apart[order]
    cuts = [0, *(np.flatnonzero(apart[1:] != apart[:-1]) + 1).tolist(), len(p)]
    by_shift = sorted(zip(cuts, cuts[1:]), key=lambda c: c[0] - c[1])
    open_x = open_y = left_x = left_y = None  # uncovered words, and how many of them lie before each one; none while all are
    for i, j in by_shift:
        shift, at = int(apart[i]), p[i:j]
        if open_x is not None and j - i == 1:
            k = int(at[0])
            if not open_x[k:k + width].any() and not open_y[k + shift:k + shift + width].any():
                continue
        elif open_x is not None:
            if left_x is None:
                left_x, left_y = (np.concatenate([[0], np.cumsum(o)]) for o in (open_x, open_y))
            there = at + shift
            at = at[(left_x[np.minimum(at + width, len(x))] > left_x[at]) | (left_y[np.minimum(there + width, len(y))] > left_y[there])]
            if not len(at):
                continue
        low, high = max(0, -shift), min(len(x), len(y) - shift)
        unlike = np.flatnonzero(x[low:high] != y[low + shift:high + shift])
        # a place's run lies between the last unlike word before it and the first one from it on
        if len(at) == 1:
            runs = [int(unlike.searchsorted(int(at[0]) - low))]
        else:
            runs = unlike.searchsorted(at - low)
            runs = runs[np.concatenate([[True], runs[1:] != runs[:-1]])].tolist()
        for k in runs:
            start = low + (int(unlike[k - 1]) + 1 if k else 0)
            end = low + int(unlike[k]) if k < len(unlike) else high
            if end - start >= least:
                out.append((start, start + shift, end - start))
                if len(by_shift) > 1:
                    if open_x is None:
                        open_x, open_y = np.ones(len(x), bool), np.ones(len(y), bool)
                    mine, theirs = open_x[start:end], open_y[start + shift:end + shift]
                    if mine.any() or theirs.any():
                        mine[:], theirs[:], left_x = False, False, None
    return out


def extended(pairs: DataFrame, docs: DataFrame, least: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, start, end and other_id of the passages around the places ``at`` (p in a, q in b) of each pair, for both sides."""
    pairs = stage(pairs.groupBy("a", "b").agg(F.collect_set("at").alias("at")), "suffix-pairs")
    both = with_texts(pairs, texts_of(docs, pairs, id_col, text_col, "suffix-texts"), "at")

    def run(batches):
        for b in batches:
            one, two = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cut, p, q = b.column(2).offsets.to_numpy(), *(b.column(2).values.field(n).to_numpy(zero_copy_only=False) for n in ("p", "q"))
            ta, tb = b.column(3).to_pylist(), b.column(4).to_pylist()
            out = []
            for i, j in slices([x if len(x) > len(y) else y for x, y in zip(ta, tb)], 1_000_000):
                # a text that many pairs share is hashed once
                spot = {t: k for k, t in enumerate(dict.fromkeys(ta[i:j] + tb[i:j]))}
                words = Words(list(spot))
                first, hashes = words.first.tolist(), words.hashes
                for r in range(i, j):
                    k, m, c = spot[ta[r]], spot[tb[r]], slice(cut[r], cut[r + 1])
                    x, y = hashes[first[k]:first[k + 1]], hashes[first[m]:first[m + 1]]
                    out += [(r, *found) for found in extend(x, y, p[c], q[c], least, width)]
            r, s, t, n = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((one[r], two[r]), (s, t), (s + n, t + n), (two[r], one[r]))],
                                             ["doc_id", "start", "end", "other_id"])

    return both.mapInArrow(run, "doc_id long, start long, end long, other_id long")


def open_windows(n: int, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Starts of the windows of ``least`` of n words that hold the k-gram of a kept suffix (at) and lie in none of the merged spans."""
    near = np.zeros(max(0, n - least + 1) + 1, np.int64)
    np.add.at(near, np.clip(at - (least - KGRAM), 0, len(near) - 1), 1)
    np.add.at(near, np.clip(at + 1, 0, len(near) - 1), -1)
    p = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    k = np.searchsorted(starts, p, "right") - 1
    return p[(k < 0) | (np.append(ends, 0)[k] < p + least)]


def window_pairs(docs: DataFrame, shared: DataFrame, spans: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """a, b and at of windows of ``least`` words that no span holds: the smallest document that holds it with each other one,
    and other places of the smallest one with the largest."""
    places = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    cover = merge_spans(spans).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cover"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = (id_text(docs, id_col, text_col).join(places, "doc_id").join(cover, "doc_id", "left")
            .select("doc_id", "text", "at", F.coalesce("cover", none).alias("cover")))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cut, at = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            ends_, held = b.column(3).offsets.to_numpy(), b.column(3).values
            start, end = (held.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
            for i, j in slices(texts, 2_000_000):
                words = Words(texts[i:j])
                values, rows_, pos = words.shingles(least)
                first = np.searchsorted(rows_, np.arange(j - i + 1))
                for r in range(j - i):
                    c = slice(ends_[i + r], ends_[i + r + 1])
                    p = open_windows(int(words.counts[r]), at[cut[i + r]:cut[i + r + 1]], start[c], end[c], least)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(values[first[r] + p].view(np.int64)), pa.array(np.full(len(p), ids[i + r], np.int64)),
                                                          pa.array(p.astype(np.int64))], ["window", "doc_id", "pos"])

    seen = stage(rows.mapInArrow(run, "window long, doc_id long, pos long"), "suffix-windows")
    place = F.struct("doc_id", "pos")
    ends = seen.groupBy("window").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.doc_id < hi.doc_id")
    met = seen.join(ends, "window").withColumn("to", F.when(F.col("doc_id") == F.col("lo.doc_id"), F.col("hi")).otherwise(F.col("lo")))
    flip = F.col("doc_id") > F.col("to.doc_id")
    return met.select(F.least("doc_id", "to.doc_id").alias("a"), F.greatest("doc_id", "to.doc_id").alias("b"),
                      F.struct(F.when(flip, F.col("to.pos")).otherwise(F.col("pos")).alias("p"),
                               F.when(flip, F.col("pos")).otherwise(F.col("to.pos")).alias("q")).alias("at"))


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, other_id and later of every passage of ``least`` words or more
    that another document holds word for word (A-Z lower-cased, white space apart).

    Documents without such a passage give no row; null and empty texts, shorter ones and rows
    without id never do. Rows that repeat an id are one document. An empty table gives an
    empty result. Long texts are read whole; a text that repeats itself costs about as many
    comparisons as its words, times the shifts that still cover new ones. Ties of equal k-grams
    are all kept. Of other columns none is read.
    """
    kept = stage(anchors(docs, least, id_col, text_col), "suffix-anchors")
    # written first, so that the join's sides are plain exchanges and adaptive execution splits a frequent k-gram
    twice = stage(kept.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"), "suffix-grams")
    shared = stage(kept.join(twice, "gram"), "suffix-shared")
    pairs = neighbours(shared, SORTED[0], "suffix-right").unionByName(neighbours(shared, SORTED[1], "suffix-left"))
    flip = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                         F.struct(F.when(flip, F.col("q")).otherwise(F.col("p")).alias("p"),
                                  F.when(flip, F.col("p")).otherwise(F.col("q")).alias("q")).alias("at"))
    spans = stage(extended(pairs, docs, least, id_col, text_col, KGRAM), "suffix-spans")
    rest = window_pairs(docs, shared, spans, least, id_col, text_col)
    return merge_spans(spans.unionByName(extended(rest, docs, least, id_col, text_col, least)))
