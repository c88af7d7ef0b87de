"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

Every training document counts its words; the counts of all of them are grouped by word over
the cluster. Every segment of every training document becomes a training sequence of subword
ids. Ids fall into
classes by the ids next to them (k-means); the attention model reads the classes of the last
ids in one-hot form and predicts the class of the next id. It is trained in rounds of local
gradient steps per partition, and the partitions' weights are averaged by Spark. Texts are
scored in overlapping windows, in which only the second half is scored, so every id counts
once with the first half as context. Given a class, an id has its corpus-wide share, and a
word's first class may also yield the whole word at once with its own share (a mixture).
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import id_text, small_batches

#: Characters of text that one group of documents holds at most on average (groups are drawn by a hash; a longer document makes its group longer).
GROUP_CHARS = 4_500_000
#: Words of a training segment.
SEGMENT = 64
#: Context of a window, and how much of it is scored.
WIDE, HALF = 16, 8
#: Classes of word-first and of other ids; one more is the end's own.
FIRSTS, OTHERS = 28, 19
CLASSES = FIRSTS + OTHERS + 1
START, PAD = CLASSES, CLASSES + 1
LN10 = float(np.log(10))
#: Classes a word (or the end) can begin with.
OPENING = np.array([*range(FIRSTS), CLASSES - 1])
BUCKETS = 32
ROUNDS, BATCH, RATE = 2, 512, 0.03
#: What is added to every id's count, and the weight of an id's share when little is known of what follows a class.
ADD, BACK = 0.1, 20.0


class Subwords:
    """Ids of single words by the ranks file; a word is encoded with a space before it."""

    _held: dict = {}

    def __init__(self, path: str):
        if path not in self._held:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            coder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            opening = np.zeros(len(ranks) + 1, bool)
            for t, r in ranks.items():
                opening[r] = t[:1] == b" "
            self._held[path] = coder, opening
        self.coder, self.opening = self._held[path]
        self.end = len(self.opening) - 1

    def encode(self, words: list[bytes]) -> list[list[int]]:
        piece = self.coder._encode_single_piece
        return [piece(b" " + w) for w in words]


@dataclass
class Model:
    """Class of each id, log10 share of an id within its class after each class inside a word, uses of words by first class and how often those
    are new (as often as words used once, among all uses), and the attention tables."""

    classes: np.ndarray
    inner_share: np.ndarray
    first_share: np.ndarray
    word_total: np.ndarray
    fresh: np.ndarray
    tables: dict = field(default_factory=dict)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, held_out and chunk; chunks hold about GROUP_CHARS characters."""
    rows = id_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-total // GROUP_CHARS))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    return rows.select("doc_id", "text", (F.crc32(name) % 10 == 0).alias("held_out"),
                       F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).alias("chunk"))


def code_of(end: int) -> str:
    """The smallest unsigned kind that holds all ids plus one."""
    return "<u2" if end + 1 < 65536 else "<u4"


def joined(column, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: before a text's first) of all segments of a column in one array, and each segment's length."""
    kind = np.dtype(code_of(end))
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).astype(np.int64) - 1, np.array([len(x) for x in raw], np.int64) // kind.itemsize


def gather(rows: DataFrame, path: str) -> DataFrame:
    """chunk, word, n (uses in training texts) for every word of a chunk, and all training segments in ``ids``.

    The end of a text is the empty word. A word of held-out texts only has n = 0. A segment holds its
    ids plus one, and zero before a text's first.
    """
    def run(table: pa.Table) -> pa.Table:
        coder = Subwords(path)
        counts: Counter[bytes] = Counter()
        lists: list[list[bytes]] = []
        for text, out in zip(*(table.column(c).to_pylist() for c in ("text", "held_out"))):
            words = split_words(text)
            words.append(b"")
            if out:
                for w in words:
                    counts.setdefault(w, 0)
                continue
            counts.update(words)
            lists.append(words)
        used = [w for w, k in counts.items() if k and w]
        kind = np.dtype(code_of(coder.end))
        # each distinct word is encoded once
        spelled = {w: (np.array(x) + 1).astype(kind).tobytes() for w, x in zip(used, coder.encode(used))}
        spelled[b""] = np.array([coder.end + 1], kind).tobytes()
        opening = np.zeros(1, kind).tobytes()
        segments = [(b"" if i else opening) + b"".join(map(spelled.__getitem__, words[i:i + SEGMENT])) for words in lists for i in range(0, len(words), SEGMENT)]
        n, m = len(counts), len(segments)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * (n + m), pa.int64()), "word": pa.array([*counts, *[None] * m], pa.binary()),
                         "n": pa.array([*counts.values(), *[None] * m], pa.int64()), "ids": pa.array([*[None] * n, *segments], pa.binary())})

    return rows.groupBy("chunk").applyInArrow(run, "chunk long, word binary, n long, ids binary")


def id_counts(counts: DataFrame, path: str) -> DataFrame:
    """id, n (uses), opens (uses as a word's first id) and singles (words used once that begin with it).

    At most one row an id."""
    def run(batches):
        coder = Subwords(path)
        used, opens, singles = np.zeros((3, coder.end + 1))
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for ids, k, w in zip(coder.encode(words), n, words):
                if w:
                    for x in ids:
                        used[x] += k
                    singles[ids[0]] += k == 1
                    opens[ids[0]] += k
                else:
                    used[coder.end] += k
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(used[at]), pa.array(opens[at]), pa.array(singles[at])],
                                         ["id", "n", "opens", "singles"])

    return (counts.select("word", "n").where("n > 0").mapInArrow(run, "id int, n double, opens double, singles double")
            .groupBy("id").agg(F.sum("n").alias("n"), F.sum("opens").alias("opens"), F.sum("singles").alias("singles")))


def inner_counts(counts: DataFrame, path: str, classes: np.ndarray) -> DataFrame:
    """before (class of an id), id and n: how often the id follows inside a word, each distinct word counted
    by the square root of its uses. At most CLASSES rows an id."""
    def run(batches):
        coder = Subwords(path)
        seen = np.zeros((CLASSES, coder.end + 1))
        for b in batches:
            n = np.sqrt(b.column(1).to_numpy(zero_copy_only=False))
            for ids, k in zip(coder.encode(b.column(0).to_pylist()), n):
                for x, y in zip(ids, ids[1:]):
                    seen[classes[x], y] += k
        c, i = np.nonzero(seen)
        for a in range(0, len(c), 100_000):
            p, q = c[a:a + 100_000], i[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(seen[p, q])], ["before", "id", "n"])

    return (counts.select("word", "n").where("n > 0 AND word <> X''").mapInArrow(run, "before int, id int, n double")
            .groupBy("before", "id").agg(F.sum("n").alias("n")))


def profiles(segments: DataFrame, end: int) -> DataFrame:
    """id and how often each bucket of ids stands left and right of it; at most one row an id."""
    def run(batches):
        seen = np.zeros((end + 1, 2 * BUCKETS), np.float32)
        for b in batches:
            ids, lengths = joined(b.column(0), end)
            same = np.repeat(np.arange(len(lengths)), lengths)
            same, ids = same[ids >= 0], ids[ids >= 0]
            one, two = ids[:-1][same[1:] == same[:-1]], ids[1:][same[1:] == same[:-1]]
            for at, near in ((two, one * 40503 % 65521 % BUCKETS), (one, BUCKETS + two * 40503 % 65521 % BUCKETS)):
                cell, n = np.unique(at * (2 * BUCKETS) + near, return_counts=True)
                seen.ravel()[cell] += n
        at = np.flatnonzero(seen.any(1))
        for i in range(0, len(at), 5000):
            part = at[i:i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(list(seen[part]), pa.list_(pa.float32()))], ["id", "near"])

    rows = segments.mapInArrow(run, "id int, near array<float>")
    sums = [F.sum(F.element_at("near", i + 1)).alias(f"s{i}") for i in range(2 * BUCKETS)]
    return rows.groupBy("id").agg(*sums)


def cluster(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Weighted k-means; starts from the heaviest row and then those farthest from all centers."""
    if len(x) <= k:
        return np.arange(len(x))
    centers = [x[weight.argmax()]]
    far = ((x - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centers.append(x[(far * weight).argmax()])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        mass = np.bincount(own, weight, k)
        for j in np.flatnonzero(mass):
            mine = own == j
            c[j] = (x[mine] * weight[mine, None]).sum(0) / mass[j]
    return own


def classes_of(near: list, opening: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Class of every id: word-first ids, others, and the end apart. Ids without neighbours join the largest class of their kind."""
    ids = np.array([r[0] for r in near], np.int64)
    x = np.array([r[1:] for r in near], np.float64).reshape(len(near), 2 * BUCKETS)
    for side in (slice(0, BUCKETS), slice(BUCKETS, None)):
        x[:, side] = np.sqrt((x[:, side] + 0.2) / (x[:, side] + 0.2).sum(1, keepdims=True))
    out = np.where(opening, 0, FIRSTS)
    for kind, base, k in ((True, 0, FIRSTS), (False, FIRSTS, OTHERS)):
        mine = (opening[ids] == kind) & (ids != len(opening) - 1)
        if mine.any():
            own = cluster(x[mine], used[ids[mine]] + 1e-6, k)
            heavy = np.bincount(own, used[ids[mine]], k).argmax()
            out[opening == kind] = base + heavy
            out[ids[mine]] = base + own
    out[-1] = CLASSES - 1
    return out


# --- the attention model -----------------------------------------------------------------------

def blank() -> dict:
    """Tables: score of (query class, key class), of distance, outputs of the own class and of attended ones."""
    return {"match": np.zeros((CLASSES + 2, CLASSES + 2), np.float32), "distance": np.zeros(WIDE, np.float32),
            "own": np.zeros((CLASSES + 2, CLASSES), np.float32), "seen": np.zeros((CLASSES + 2, CLASSES), np.float32)}


def blocks(inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray):
    """Sequences cut into windows: (windows, HALF) query classes, (windows, WIDE) key classes, targets (-1: none), places."""
    rounded = -(-lengths // HALF) * HALF
    starts = np.cumsum(rounded + HALF) - rounded - HALF
    room = int((rounded + HALF).sum())
    offset = np.cumsum(lengths) - lengths
    place = np.arange(len(inputs)) + np.repeat(starts + HALF - offset, lengths)
    row = np.full(room, PAD, np.int64)
    row[place] = inputs
    want = np.full(room, -1, np.int64)
    want[place] = targets
    row, want = row.reshape(-1, HALF), want.reshape(-1, HALF)
    lead = np.zeros(len(row), bool)
    lead[starts // HALF] = True
    body = np.flatnonzero(~lead)
    return row[body], np.concatenate([row[body - 1], row[body]], 1), want[body], place


_GAP = np.arange(HALF)[:, None] + HALF - np.arange(WIDE)[None, :]
_NEAR = np.clip(_GAP, 0, WIDE - 1)
_MASK = np.where(_GAP < 0, np.float32(-1e9), np.float32(0))


def attend(t: dict, query: np.ndarray, key: np.ndarray):
    """Masked attention of each window: weights (n, HALF, WIDE) and log probabilities (n, HALF, CLASSES)."""
    score = t["match"][query[:, :, None], key[:, None, :]] + (t["distance"][_NEAR] + _MASK)
    score += np.where(key == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
    score -= score.max(2, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(2, keepdims=True)
    out = t["own"][query] + score @ t["seen"][key]
    out -= out.max(2, keepdims=True)
    out -= np.log(np.exp(out).sum(2, keepdims=True))
    return score, out


def laid_out(t: dict) -> dict:
    """The trained tables, laid out for scoring."""
    begins = np.zeros((CLASSES, 2), np.float32)
    begins[:, 0], begins[OPENING, 1] = 1, 1
    match = t["match"].astype(np.float32)
    match[:, PAD] = -1e9
    return {"match": match, "distance": t["distance"].astype(np.float32)[_NEAR] + _MASK, "own": t["own"], "begins": begins,
            "seen": t["seen"].astype(np.float32)}


def predict(t: dict, query: np.ndarray, key: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each wanted class and of a word's begin, (windows, HALF) each, from the tables of ``laid_out``.

    Scores and outputs stay far from the limits of single precision, so nothing is subtracted first.
    """
    score = t["match"].ravel().take(query[:, :, None] * (CLASSES + 2) + key[:, None, :])
    score += t["distance"]
    np.exp(score, out=score)
    with np.errstate(invalid="ignore"):  # places after a text's end see nothing and are not read
        score /= score.sum(2, keepdims=True)
    out = (score @ t["seen"].take(key, 0)).reshape(-1, CLASSES)
    out += t["own"].take(query.ravel(), 0)
    picked = out[np.arange(len(out)), np.maximum(want.ravel(), 0)]
    np.exp(out, out=out)
    sums = np.log(out @ t["begins"])
    return (picked - sums[:, 0]).reshape(want.shape), (sums[:, 1] - sums[:, 0]).reshape(want.shape)


def gradients(t: dict, query: np.ndarray, key: np.ndarray, want: np.ndarray) -> dict:
    """Gradients of the mean log loss of the wanted classes.

    A place's attention is summed by class first, so that what the places have seen and their own
    classes are one matrix, and outputs and gradients are products with it.
    """
    flat, rows = CLASSES + 2, query.size
    match, near = np.exp(t["match"]), np.where(_GAP < 0, np.float32(0), np.exp(t["distance"])[_NEAR])
    match[:, PAD] = 0
    cell = query[:, :, None] * flat + key[:, None, :]
    spot = np.arange(0, rows * flat, flat).reshape(query.shape)[:, :, None] + key[:, None, :]
    a = match.ravel().take(cell)
    a *= near
    # places after a text's end see nothing
    a /= np.maximum(np.einsum("nij->ni", a), np.float32(1e-30))[:, :, None]
    x = np.zeros((rows, 2 * flat), a.dtype)
    x[:, :flat] = np.bincount(spot.ravel(), a.ravel(), rows * flat).reshape(rows, flat)
    x[np.arange(rows), flat + query.ravel()] = 1
    g = x @ np.concatenate([t["seen"], t["own"]])
    np.exp(g, out=g)
    real = want.ravel() >= 0
    n = max(1, int(real.sum()))
    g *= (real / (g.sum(1) * n)).astype(a.dtype)[:, None]
    at = np.flatnonzero(real)
    g[at, want.ravel()[at]] -= 1 / n
    both = x.T @ g
    ds = (g @ t["seen"].T).ravel().take(spot)
    ds -= np.einsum("nij,nij->ni", a, ds)[:, :, None]
    ds *= a
    match = np.bincount(cell.ravel(), ds.ravel(), flat * flat).reshape(flat, flat)
    distance = np.bincount(_NEAR.ravel(), ds.sum(0).ravel(), WIDE)
    return {"match": match, "distance": distance, "own": both[flat:], "seen": both[:flat]}


def sequences(batches, classes: np.ndarray):
    """Windows of many training segments at a time."""
    end = len(classes) - 1
    for b in batches:
        ids, lengths = joined(b.column(0), end)
        c = np.where(ids < 0, START, classes[ids])
        owner = np.repeat(lengths > 1, lengths)
        c, lengths = c[owner], lengths[lengths > 1]
        if len(lengths):
            ends = np.cumsum(lengths)
            first, last = np.ones(len(c), bool), np.ones(len(c), bool)
            last[ends - 1], first[ends - lengths] = False, False
            yield blocks(c[last], c[first], lengths - 1)[:3]


def following(segments: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each; a table of fixed size."""
    def run(batches):
        n = np.zeros((CLASSES + 2, CLASSES))
        for query, _, want in sequences(batches, classes):
            real = want >= 0
            n += np.bincount(query[real] * CLASSES + want[real], minlength=n.size).reshape(n.shape)
        a, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[a, b])], ["a", "b", "n"])

    out = np.zeros((CLASSES + 2, CLASSES))
    for r in segments.mapInArrow(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def one_round(segments: DataFrame, classes: np.ndarray, tables: dict, rate: float) -> dict:
    """Local gradient steps (Adam) in every partition, averaged by the number of windows each has seen."""
    names = list(tables)
    start = np.concatenate([tables[k].ravel() for k in names])
    cuts = np.cumsum([tables[k].size for k in names])[:-1]

    def shaped(flat):
        return {k: x.reshape(tables[k].shape).astype(np.float32) for k, x in zip(names, np.split(flat, cuts))}

    def run(batches):
        w, m, v, step, seen = start.astype(np.float64), 0.0, 0.0, 0, 0
        for query, key, want in sequences(batches, classes):
            order = np.random.default_rng(len(query)).permutation(len(query))
            for i in range(0, len(order), BATCH):
                at = order[i:i + BATCH]
                g = gradients(shaped(w), query[at], key[at], want[at])
                g = np.concatenate([g[k].ravel() for k in names])
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                seen += len(at)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w * seen), pa.array(np.full(len(w), float(seen)))], ["i", "w", "n"])

    sums = segments.mapInArrow(run, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
    flat = start.astype(np.float64)
    for r in sums.collect():
        flat[r["i"]] = r["w"]
    return shaped(flat)


def fit(gathered: DataFrame, counts: DataFrame, path: str) -> Model:
    """The model; all the driver sees is bounded by the vocabulary and the tables."""
    coder = Subwords(path)
    segments = gathered.where("ids IS NOT NULL").select("ids")
    used, opens, singles = np.zeros((3, coder.end + 1))
    for r in id_counts(counts, path).collect():
        used[r["id"]], opens[r["id"]], singles[r["id"]] = r["n"], r["opens"], r["singles"]
    near = sorted(tuple(r) for r in profiles(segments, coder.end).collect())
    classes = classes_of(near, coder.opening, used)
    mass = np.bincount(classes, used + ADD, CLASSES)
    share = np.log10((used + ADD) / mass[classes])
    inner = np.zeros((CLASSES, coder.end + 1), np.float32)
    for r in inner_counts(counts, path, classes).toLocalIterator():
        inner[r["before"], r["id"]] = r["n"]
    for row in inner:
        total = np.bincount(classes, row, CLASSES)
        row[:] = np.log10((row + BACK * 10.0**share) / (total[classes] + BACK))
    words = np.bincount(classes, opens, CLASSES)
    fresh = np.clip((np.bincount(classes, singles, CLASSES) + 1) / (words + 2), 0.001, 0.999)
    t = blank()
    pairs = following(segments, classes)
    prior = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    t["own"][:] = np.log((pairs + 20 * prior) / (pairs.sum(1, keepdims=True) + 20))
    for i in range(ROUNDS):
        t = one_round(segments, classes, t, RATE / (1 + 2 * i))
    return Model(classes, inner, share, words, fresh, laid_out(t))


def score_group(texts: list[str], uses_of: dict, model: Model, coder: Subwords) -> tuple[list[float], list[int], list[int], list[float]]:
    """(score, tokens, known tokens, base sum) of each text; uses_of: word -> uses in training texts."""
    words = list(uses_of)
    index = {w: i for i, w in enumerate(words)}
    ids = [[coder.end] if not w else x for w, x in zip(words, coder.encode(words))]
    flat = np.array([x for i in ids for x in i], np.int64)
    size = np.array([len(i) for i in ids])
    start = np.cumsum(size) - size
    uses = np.array([uses_of[w] for w in words], np.float64)
    base = np.log10(uses + 0.1)
    spelled = model.inner_share[model.classes[np.roll(flat, 1)], flat].astype(np.float64)
    spelled[start] = model.first_share[flat[start]]
    with np.errstate(divide="ignore"):
        whole = np.log10(uses) - np.log10(model.word_total[model.classes[flat[start]]])
    whole[np.array(words) == b""] = -np.inf if len(words) else 0
    lists = [[*split_words(t), b""] for t in texts]
    counts = np.array([len(x) for x in lists])
    which = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
    lengths = size[which]
    ends = np.cumsum(lengths)
    take = np.arange(ends[-1]) + np.repeat(start[which] - (ends - lengths), lengths)
    classes = model.classes[flat[take]]
    per_text = np.add.reduceat(lengths, np.cumsum(counts) - counts)
    inputs = np.empty_like(classes)
    inputs[1:] = classes[:-1]
    inputs[np.cumsum(per_text) - per_text] = START
    query, key, want, place = blocks(inputs, classes, per_text)
    logp, begin = np.zeros(want.shape, np.float32), np.zeros(want.shape, np.float32)
    for i in range(0, len(query), 2048):
        logp[i:i + 2048], begin[i:i + 2048] = predict(model.tables, query[i:i + 2048], key[i:i + 2048], want[i:i + 2048])
    steps = logp[want >= 0].astype(np.float64) / np.log(10)  # windows keep the order of ids
    begin = np.append(begin[want >= 0].astype(np.float64) / np.log(10), 0.0)  # a word begins here
    first = ends - lengths
    opening = steps[first] - begin[first]
    last = np.zeros(len(which), bool)
    last[np.cumsum(counts) - 1] = True
    rest = np.add.reduceat(steps + spelled[take], first) - steps[first] + np.where(last, 0.0, begin[ends])
    new = model.fresh[model.classes[flat[start]]][which]
    # long words spell out to less than the smallest double, so the two ways are added as logarithms
    both = np.logaddexp((np.log10(1 - new) + whole[which]) * LN10, (np.log10(new) + rest) * LN10) / LN10
    both[last] = 0.0  # the end is its class's only member
    at = np.cumsum(counts) - counts
    return (np.add.reduceat(opening + both, at).tolist(), counts.tolist(), np.add.reduceat((uses[which] > 0).astype(np.int64), at).tolist(),
            np.add.reduceat(base[which], at).tolist())


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a text's end counts as one token.
    A null text counts as empty and is just an end. Rows whose crc32 of the id as text is
    divisible by ten are held out (a null id counts as the text None). Without training rows
    all shares are equal and the base score is 0 times its tokens. Rows may repeat; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = grouped(docs, id_col, text_col)
    gathered = stage(gather(rows, path), "lm-gathered")
    used = gathered.where("word IS NOT NULL").select("chunk", "word", "n")
    counts = stage(used.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = fit(gathered, counts, path)
    back = used.select("chunk", "word").join(counts, "word")
    floor = float(np.log10(total + 0.1 * (distinct + 1)))

    def run(table: pa.Table, words: pa.Table) -> pa.Table:
        uses = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist()))
        score_, n, known, base = score_group(table.column("text").to_pylist(), uses, model, Subwords(path))
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([int(total)] * len(n), pa.int64()),
                         "base_score": pa.array([b - k * floor for b, k in zip(base, n)], pa.float64()),
                         "score": pa.array(score_, pa.float64())})

    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
